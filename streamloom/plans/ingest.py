"""Ingest: raw files to canonical shards and a manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.operators.align import add_missing_columns, align_to_protocol
from streamloom.operators.manifest import ordered_list, resolve_provenance
from streamloom.operators.select import batch_metadata_errors, require_no_rows
from streamloom.plans.datasets import DatasetSpec
from streamloom.protocols import INGEST_MANIFEST, PROTOCOL_RANK, PROVENANCE
from streamloom.session import checkpoint_dir
from streamloom.sources.files import (
    list_files,
    path_protocol,
    read_by_header,
    read_parquet_by_schema,
    source_files,
    with_ingest_order,
    with_path_metadata,
    with_sidecar_metadata,
)
from streamloom.sources.writers import write_manifest, write_shards, written_segments


@dataclass(frozen=True)
class DelimitedSource:
    """Vendor exports as delimited text; protocol and key come from the path."""

    spec: DatasetSpec

    def read(self, spark: SparkSession, root: str) -> dict[str, list[DataFrame]]:
        files = list_files(spark, root, self.spec.include, self.spec.exclude)
        # File names only: they decide which files each protocol's scan opens.
        named = files.select("path", path_protocol(F.col("path")).alias("p")).collect()
        unknown = [r["path"] for r in named if r["p"] is None]
        if unknown:
            raise ValueError(f"No protocol in paths: {unknown[:20]}")
        out = {}
        for name in PROTOCOL_RANK:
            paths = [f"{root.rstrip('/')}/{r['path']}" for r in named if r["p"] == name]
            if paths:
                out[name] = read_by_header(spark, paths, describe=with_path_metadata)
        return out


@dataclass(frozen=True)
class SidecarSource:
    """Parquet sources described by a table of (file name, JSON payload)."""

    spec: DatasetSpec
    sidecar: DataFrame

    def read(self, spark: SparkSession, root: str) -> dict[str, list[DataFrame]]:
        payloads = with_sidecar_metadata(
            self.sidecar.withColumn("raw file path", F.col("path")), "path", "metadata"
        ).drop("metadata", "raw file path")
        named = payloads.collect()
        out = {}
        for name in PROTOCOL_RANK:
            paths = [f"{root.rstrip('/')}/{r['path']}" for r in named if r[C.PROTOCOL.name] == name]
            if not paths:
                continue
            drop = C.EIS_VOLTAGE.name if name != "EIS" else "__none"
            relative = F.element_at(
                F.split("raw file path", "\\Q/" + root.split(":", 1)[-1].strip("/") + "/\\E", 2), -1
            )
            out[name] = [
                rows.withColumn("path", relative).join(payloads, "path").drop("path", drop)
                for rows in read_parquet_by_schema(spark, paths)
            ]
        return out


def align_batches(spec: DatasetSpec, raw: Mapping[str, Sequence[DataFrame]]) -> dict[str, DataFrame]:
    """Canonical rows per protocol with task key, `ingest order` and `row position`.

    Every table of a protocol (files with one header) is aligned by itself; files are numbered over all of them.
    """
    out = {}
    for name, parts in raw.items():
        ingest = spec.ingest_spec(name)
        key = ingest.protocol.key_names
        slim = [C.PROTOCOL.name, *key, C.CYCLE_INDEX.name, C.CELL_ID.name, C.SOC.name, "raw file path"]
        named = [p.select(*[col(c) for c in dict.fromkeys(slim) if c in p.columns]) for p in parts]
        files = source_files(reduce(partial(DataFrame.unionByName, allowMissingColumns=True), named), key)
        checkpoint_dir(files.sparkSession)
        files = files.checkpoint()
        require_no_rows(
            batch_metadata_errors(files, ingest.protocol).select("raw file path", "problem"),
            "Raw batch metadata",
        )
        aligned = []
        for rows in parts:
            ordered = with_ingest_order(rows, files)
            extra = [c.name for c in ingest.manifest_columns if c.name in ordered.columns]
            keep = [*key, C.PROTOCOL.name, *extra, "raw file path", C.INGEST_ORDER.name, C.ROW_POSITION.name]
            filled = add_missing_columns(ordered, ingest.columns, ignore=keep)
            surplus = [C.SOC.name] if C.SOC.name not in key and C.SOC.name in filled.columns else []
            aligned.append(align_to_protocol(filled.drop(*surplus), ingest, keep)[0])
        out[name] = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), aligned)
    return out


def run_ingest(
    spark: SparkSession,
    source,
    input_root: str,
    output_root: str,
    provenance: Mapping[str, object],
) -> DataFrame:
    """Write ingested shards per protocol and the manifest; returns the manifest."""
    spec = source.spec
    stage = f"{output_root.rstrip('/')}/{spec.stage_root('ingested')}"
    parts = []
    for name, rows in align_batches(spec, source.read(spark, input_root)).items():
        ingest = spec.ingest_spec(name)
        key = ingest.protocol.key_names
        path = f"{stage}/data/{name.casefold()}"
        write_shards(rows, path, key, rows=rows.count())
        written = spark.read.parquet(path)
        segments = written_segments(spark, output_root, path, key)
        merged = segments.groupBy(C.PROTOCOL.name, *[col(k) for k in key]).agg(
            F.flatten(ordered_list(F.col("segments"), col(C.ROW_POSITION.name))).alias(
                C.INGESTED_SEGMENTS.name
            ),
            F.sum(col(C.ROW_COUNT.name)).alias(C.ROW_COUNT.name),
        )
        first = written.groupBy(*[col(k) for k in key], "raw file path").agg(
            F.min(col(C.INGEST_ORDER.name)).alias("o")
        )
        paths = first.groupBy(*[col(k) for k in key]).agg(
            ordered_list(F.col("`raw file path`"), F.col("o")).alias(C.RAW_PATHS.name)
        )
        parts.append(merged.join(paths, list(key)))
    layout = INGEST_MANIFEST.with_protocols([i.protocol for i in spec.ingest])
    manifest = None
    for part in parts:
        manifest = part if manifest is None else manifest.unionByName(part, allowMissingColumns=True)
    if manifest is None:
        raise ValueError(f"No raw files below {input_root!r}")
    for column in layout.columns:
        if column.name not in manifest.columns:
            manifest = manifest.withColumn(column.name, column.null())
    relative = f"{spec.stage_root('ingested')}/manifest.parquet"
    runtime = {
        C.DATASET_ID.name: spec.dataset_id,
        C.PROCESSING_STAGE.name: "ingested",
        C.MANIFEST_PATH.name: relative,
        **provenance,
    }
    write_manifest(resolve_provenance(manifest, PROVENANCE, runtime), stage, "manifest")
    return spark.read.parquet(f"{stage}/manifest.parquet")


def ingested_rows(spark: SparkSession, output_root: str, spec: DatasetSpec, protocol: str) -> DataFrame:
    stage = f"{output_root.rstrip('/')}/{spec.stage_root('ingested')}"
    return spark.read.parquet(f"{stage}/data/{protocol.casefold()}")
