"""Training index: union of manifests with row ids, splits and scaling checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.scaling import Scale
from streamloom.operators.align import union_relaxed
from streamloom.operators.joins import key_join
from streamloom.operators.ranking import digest, digest_rank, total_order_position
from streamloom.operators.select import (
    check_protocols,
    check_revisions,
    non_canonical_segments,
    provided_groups,
    require_columns,
    require_no_rows,
    with_dataset_id,
)
from streamloom.protocols import protocol_name

MANIFEST_ROW_ID = "__manifest_row_id"
INDEX_ROW_ID = "__ml_index_row_id"
DEFAULT_GROUP = (C.DATASET_ID.name, C.CELL_ID.name, C.CYCLE_INDEX.name)
INDEX_ORDER = (*DEFAULT_GROUP, C.PROTOCOL.name, C.SOC.name, C.MANIFEST_PATH.name, MANIFEST_ROW_ID)
MANIFEST_ORDER = (C.CYCLE_INDEX.name, C.CELL_ID.name, C.PROTOCOL.name)


@dataclass(frozen=True)
class ValidationSplit:
    """sample: a share of the groups by digest; provide: listed groups; merge: listed, topped up."""

    strategy: str = "sample"
    fraction: float = 0.2
    seed: int = 69
    group_by: tuple[str, ...] = DEFAULT_GROUP
    provided: tuple[Mapping[str, object], ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.strategy not in ("sample", "provide", "merge"):
            raise ValueError(f"Unknown validation strategy: {self.strategy!r}")
        if not 0.0 <= self.fraction < 1.0:
            raise ValueError(f"fraction must be in [0, 1), got {self.fraction}")
        if not self.group_by or len(set(self.group_by)) != len(self.group_by):
            raise ValueError("group_by must be non-empty and without duplicates")
        if self.strategy == "provide" and not self.provided:
            raise ValueError("the provide strategy needs provided groups")


def sampled_groups(
    groups: DataFrame, group_by: Sequence[str], fraction: float, seed: int, already: int = 0
) -> DataFrame:
    """The first `int((n + already) * fraction) - already` groups in digest order."""
    named = groups.withColumn("__digest", digest(F.lit(seed), *[col(c) for c in group_by]))
    ranked = digest_rank(named, "__digest", group_by, "__rank", "__total")
    wanted = F.floor((F.col("__total") + already) * F.lit(float(fraction))) - already
    return ranked.filter(F.col("__rank") < wanted).select(*[col(c) for c in group_by])


def validation_groups(index: DataFrame, split: ValidationSplit) -> DataFrame:
    require_columns(index.columns, split.group_by, "Index")
    names = list(split.group_by)
    groups = index.select(*[col(c) for c in names]).distinct()
    if split.strategy == "sample":
        return sampled_groups(groups, names, split.fraction, split.seed)
    listed = provided_groups(groups, split.provided, names)
    if split.strategy == "provide":
        return listed
    rest = key_join(groups, listed, names, "left_anti")
    sampled = sampled_groups(rest, names, split.fraction, split.seed, already=listed.count())
    return listed.unionByName(sampled)


def assign_splits(index: DataFrame, split: ValidationSplit | None = None) -> DataFrame:
    """`split` column: val for the chosen groups, train for all others."""
    chosen = validation_groups(index, split or ValidationSplit(fraction=0.0))
    flagged = key_join(
        index, chosen.withColumn("__val", F.lit(True)), list((split or ValidationSplit()).group_by), "left"
    )
    label = F.when(F.col("__val"), "val").otherwise("train")
    return flagged.withColumn(C.SPLIT.name, label).drop("__val")


def with_manifest_row_ids(manifest: DataFrame) -> DataFrame:
    """Row number inside one manifest: cycle, cell, protocol, then the remaining key columns."""
    extra = [c.name for c in (C.SOC, C.EIS_VOLTAGE) if c.name in manifest.columns]
    order = [c for c in MANIFEST_ORDER if c in manifest.columns] + extra
    return total_order_position(manifest, order, MANIFEST_ROW_ID)


def with_index_row_ids(index: DataFrame) -> DataFrame:
    order = [c for c in INDEX_ORDER if c in index.columns]
    return total_order_position(index.drop(INDEX_ROW_ID), order, INDEX_ROW_ID)


def build_index(
    manifests: Mapping[str, DataFrame],
    revisions: Mapping[str, str] | None = None,
    protocols: Sequence[object] | None = None,
    protocol_mode: str = "strict",
    validation: ValidationSplit | None = None,
) -> DataFrame:
    """Union of normalized manifests (by canonical path) with split and row ids."""
    if not manifests:
        raise ValueError("manifests must not be empty")
    named = {p: m.withColumn(C.MANIFEST_PATH.name, F.lit(p)) for p, m in manifests.items()}
    for path, manifest in named.items():
        if manifest.isEmpty():
            raise ValueError(f"Manifest is empty: {path}")
        if C.NORMALIZED_SEGMENTS.name in manifest.columns:
            require_no_rows(
                non_canonical_segments(manifest, C.NORMALIZED_SEGMENTS.name), "Segment paths"
            )
    if revisions is not None:
        recorded = [C.MANIFEST_PATH.name, C.GIT_COMMIT.name, C.GIT_STATUS.name]
        parts = [m.select(*[col(c) for c in recorded]).distinct() for m in named.values()]
        check_revisions(union_relaxed(parts), {p: revisions[p] for p in named})
    loaded = [with_dataset_id(m, p) for p, m in named.items()]
    plain = union_relaxed(loaded)
    require_columns(
        plain.columns, (C.PROTOCOL.name, C.ROW_COUNT.name, C.NORMALIZED_SEGMENTS.name), "Manifest"
    )
    if protocols is not None:
        # Checked before row ids are added, which the check does not need.
        check_protocols(plain, protocols, protocol_mode)
    index = union_relaxed([with_manifest_row_ids(m) for m in loaded])
    if protocols is not None:
        index = index.filter(col(C.PROTOCOL.name).isin(*[protocol_name(p) for p in protocols]))
    return with_index_row_ids(assign_splits(index, validation))


def scaling_violations(index: DataFrame, rules: Sequence[Scale]) -> DataFrame:
    """Streams whose recorded column range leaves a rule's input bounds, or has none recorded."""
    if C.NORMALIZED_STATS.name not in index.columns:
        raise ValueError(f"The index has no {C.NORMALIZED_STATS.name!r}")
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r.column).alias("column"),
                    F.lit(float(r.source[0])).alias("lower"),
                    F.lit(float(r.source[1])).alias("upper"),
                )
                for r in rules
            ]
        )
    )
    rows = index.withColumn("__rule", wanted)
    match = F.filter(col(C.NORMALIZED_STATS.name), lambda s: s["column"] == F.col("__rule.column"))
    stat = F.get(match, 0)
    low, high = stat["min"], stat["max"]
    problem = F.when(low.isNull() | high.isNull(), "missing stats").when(
        (low < F.col("__rule.lower")) | (high > F.col("__rule.upper")), "out of bounds"
    )
    return (
        rows.withColumns(
            {
                "column": F.col("__rule.column"),
                "observed min": low,
                "observed max": high,
                "problem": problem,
            }
        )
        .filter(F.col("problem").isNotNull())
        .drop("__rule", C.NORMALIZED_STATS.name)
    )


def group_options(index: DataFrame) -> tuple[DataFrame, list[str]]:
    """Protocols present, and the columns a split may group by."""
    usable = [c.name for c in (C.DATASET_ID, C.CELL_ID, C.CYCLE_INDEX, C.PROTOCOL, C.SOC, C.EIS_VOLTAGE)]
    return (
        index.select(col(C.PROTOCOL.name)).distinct(),
        [c for c in usable if c in index.columns],
    )
