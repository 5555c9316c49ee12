"""Raw files: discovery, untyped reading, and what their paths and sidecars tell."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom import columns as C
from streamloom.columns import col
from streamloom.operators.joins import key_join
from streamloom.session import written


class SourceAdapter(Protocol):
    """Extension point for a raw dataset: its files as rows with protocol and key columns."""

    def read(self, spark: SparkSession, root: str) -> dict[str, DataFrame]:
        """Untyped raw rows per protocol, each with task key columns and `raw file path`."""


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression over the whole path; `*` also crosses `/`."""
    out = []
    for part in re.split(r"(\*+|\?|\[[^\]]+\])", pattern):
        if part.startswith("*"):
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part.startswith("["):
            out.append(part.replace("[!", "[^"))
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"


def list_files(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = ("*",),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Distinct relative paths below `root`, sorted; hidden files and folders are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.element_at(F.split("path", "\\Q" + bare + "\\E", 2), -1)
    paths = found.select(relative.alias("path"))
    wanted = F.lit(False)
    for pattern in include:
        wanted = wanted | F.col("path").rlike(glob_regex(pattern))
    for pattern in exclude:
        wanted = wanted & ~F.col("path").rlike(glob_regex(pattern))
    hidden = F.col("path").rlike(r"(^|/)\.")
    return paths.filter(wanted & ~hidden).distinct().orderBy("path")


FILE_ROW = "file row"


def _by_signature(files: DataFrame) -> list[list[str]]:
    """Paths grouped by signature from (path, signature) rows, as many as there are files."""
    groups: dict[object, list[str]] = {}
    for r in sorted(files.collect(), key=lambda r: r["path"]):
        groups.setdefault(r["signature"], []).append(r["path"])
    return list(groups.values())


def read_by_header(
    spark: SparkSession,
    paths: Sequence[str],
    separator: str = ",",
    describe: Callable[[DataFrame], DataFrame] = lambda files: files,
) -> list[DataFrame]:
    """Delimited exports with every column as text, their path and row number: one table for each header.

    A scan takes its columns from one file and reads the others by position, so files are first grouped by their first
    line. Large files are read in splits. A row's number is its place in its split plus the rows of the splits before
    it; rows are written once with their place, as a second scan might be split otherwise. Columns that `describe` adds from the
    `raw file path` are worked out once a split, not once a row, and replace columns of that name in the file.
    """
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(list(paths)).where(start == 0).select(path.alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("signature"))
    reader = spark.read.option("header", "true").option("inferSchema", "false").option("sep", separator)
    return [_numbered(reader.csv(group), describe) for group in _by_signature(heads)]


def _numbered(raw: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = written(
        raw.withColumns(
            {
                "raw file path": F.col("_metadata.file_path"),
                "__split": F.col("_metadata.file_block_start"),
                "__seen": F.monotonically_increasing_id(),
            }
        ),
        "raw-rows",
    )
    splits = rows.groupBy("raw file path", "__split").agg(
        F.min("__seen").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy("raw file path").orderBy("__split")
    starts = splits.withColumn("__start", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    described = describe(starts)
    added = [c for c in described.columns if c not in starts.columns]
    # One row a split: sent to all tasks, so that no file's rows meet in one task, nor are rows sent instead as they pack so small.
    numbered = key_join(rows.drop(*added), F.broadcast(described), ["raw file path", "__split"])
    return numbered.withColumn(
        FILE_ROW, F.col("__start") + F.col("__seen") - F.col("__first")
    ).drop("__split", "__seen", "__first", "__start")


def read_untyped(spark: SparkSession, paths: Sequence[str], separator: str = ",") -> DataFrame:
    """The tables of `read_by_header` in one, columns by name; what a file lacks is null."""
    out, *more = read_by_header(spark, paths, separator)
    for part in more:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_parquet_by_schema(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """Raw parquet files with their path and row number: one table for each schema. Footers are read, no rows."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(spark.read.parquet(path).schema.simpleString(), []).append(path)
    return [
        spark.read.parquet(*group).withColumns(
            {"raw file path": F.col("_metadata.file_path"), FILE_ROW: F.col("_metadata.row_index")}
        )
        for group in groups.values()
    ]


def source_files(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per raw file: its number in the total file order and its start in its stream.

    As long as the list of input files, which Spark itself keeps on the driver.
    """
    names = list(dict.fromkeys([C.PROTOCOL.name, *key, C.CYCLE_INDEX.name, C.CELL_ID.name, C.SOC.name]))
    present = [n for n in names if n in rows.columns]
    files = rows.groupBy("raw file path", *[col(n) for n in present]).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    if C.SOC.name not in present:
        files = files.withColumn(C.SOC.name, C.SOC.null())
    ordered = files.withColumn("__order", source_order())
    in_stream = Window.partitionBy(*[col(k) for k in key]).orderBy("__order")
    return ordered.withColumns(
        {
            "__file_no": F.row_number().over(Window.orderBy("__order")) - 1,
            "__start": F.sum("__rows").over(in_stream) - F.col("__rows"),
        }
    ).drop("__order")


def with_ingest_order(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`ingest order` (unique, files in order then rows in file order) and `row position`.

    Both are sums of file sizes and row numbers, so no data row is sorted.
    """
    # One row a file: a shuffled join would put all rows of a file into one task.
    places = F.broadcast(files.select("raw file path", "__file_no", "__start"))
    joined = key_join(rows, places, ["raw file path"])
    row = F.col(f"`{FILE_ROW}`")
    return joined.withColumns(
        {
            C.INGEST_ORDER.name: (F.col("__file_no") * F.lit(1 << 40) + row).cast("long"),
            C.ROW_POSITION.name: (F.col("__start") + row).cast("long"),
        }
    ).drop("__file_no", "__start", FILE_ROW)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _required(value: Column, missing: Column, text: str, path: Column) -> Column:
    return F.when(missing, F.raise_error(F.concat(F.lit(text), path))).otherwise(value)


def path_protocol(path: Column) -> Column:
    """Protocol from indicator words; impedance wins over pulse, diagnostics and cycling."""
    return (
        F.when(path.contains("EIS"), "EIS")
        .when(path.contains("HPPC"), "HPPC")
        .when(path.contains("Diag"), "RPT")
        .when(path.contains("Cycling"), "cycling")
    )


# Patterns of the raw folder naming convention.
SOC_PATTERN = r"(?:SOC|EIS)(\d+(?:\.\d+)?)"
FOLDER_PATTERN = r"(?:^|/)(Cycling|Diag)_(\d+)(?=/|$)"
CYCLING_CELL_PATTERN = r"(?:^|/)Cycling_\d+/([A-Za-z]\d+)(?=/|$)"
STEM_CYCLE_PATTERN = r"(?:Cycling|Diag|HPPC)_(\d+)"
CELL_TOKEN_PATTERN = r"(?:^|_)([A-Za-z]\d+)(?=_|$)"
EIS_VOLTAGE_PATTERN = r"EIS(\d+(?:p\d+|\.\d+)?)V"


def with_path_metadata(df: DataFrame, path_column: str = "raw file path", strict: bool = True) -> DataFrame:
    """Protocol, SOC, cycle index and cell id from a raw path.

    The first `Cycling_N` or `Diag_N` folder decides: cycling folders are followed by the cell
    folder, `Diag_N` means cycle N-1 with the cell in the file name. Without such a folder both
    come from the file name. With `strict` an unreadable path fails the job, else it gives nulls.
    """
    path = col(path_column)
    stem = _stem(path)
    before_channel = F.substring_index(stem, "_Channel_", 1)
    cell_tokens = F.regexp_extract_all(before_channel, F.lit(CELL_TOKEN_PATTERN), F.lit(1))
    stem_cell = F.try_element_at(cell_tokens, F.lit(-1))
    folder = F.regexp_extract(path, FOLDER_PATTERN, 1)
    folder_no = F.regexp_extract(path, FOLDER_PATTERN, 2).try_cast("long")
    stem_no = F.regexp_extract(stem, STEM_CYCLE_PATTERN, 1).try_cast("long")
    protocol = path_protocol(path)
    cycle = F.when(folder == "Cycling", folder_no).when(folder == "Diag", folder_no - 1).otherwise(stem_no)
    folder_cell = F.nullif(F.regexp_extract(path, CYCLING_CELL_PATTERN, 1), F.lit(""))
    cell = F.when(folder == "Cycling", folder_cell).otherwise(stem_cell)
    soc = F.when(protocol == "EIS", F.regexp_extract(path, SOC_PATTERN, 1).try_cast("double"))
    if strict:
        protocol = _required(protocol, protocol.isNull(), "no protocol in path: ", path)
        soc_missing = (path_protocol(path) == "EIS") & soc.isNull()
        soc = _required(soc, F.coalesce(soc_missing, F.lit(False)), "no SOC in path: ", path)
        cycle = _required(cycle, cycle.isNull(), "no cycle in path: ", path)
        cell = _required(cell, cell.isNull(), "no cell in path: ", path)
    return df.withColumns(
        {C.PROTOCOL.name: protocol, C.SOC.name: soc, C.CYCLE_INDEX.name: cycle, C.CELL_ID.name: cell}
    )


SIDECAR_SCHEMA = T.StructType(
    [
        T.StructField(
            "index",
            T.StructType(
                [
                    T.StructField("cell_id", T.StringType()),
                    T.StructField("cycle_index", T.StringType()),
                    T.StructField("nominal_capacity_ah", T.StringType()),
                    T.StructField("domain", T.StringType()),
                ]
            ),
        )
    ]
)


def with_sidecar_metadata(
    df: DataFrame, path_column: str = "raw file path", json_column: str = "metadata"
) -> DataFrame:
    """Protocol, cell, cycle, capacity and voltage state from a path and its JSON payload."""
    path, stem = col(path_column), _stem(col(path_column))
    index = F.from_json(col(json_column), SIDECAR_SCHEMA)["index"]
    domain = F.coalesce(index["domain"], F.lit(""))
    protocol = (
        F.when(stem.startswith("Cycling_") | (domain == "Cycling"), "cycling")
        .when(stem.startswith("Diag_") | (domain == "Diag"), "RPT")
        .when(stem.startswith("EIS") | (domain == "EIS"), "EIS")
    )
    volts = F.replace(F.regexp_extract(stem, EIS_VOLTAGE_PATTERN, 1), F.lit("p"), F.lit("."))
    voltage = F.when(protocol == "EIS", volts.try_cast("double"))
    cell, cycle = index["cell_id"], index["cycle_index"].try_cast("double").cast("long")
    no_voltage = F.coalesce((protocol == "EIS") & voltage.isNull(), F.lit(False))
    return df.withColumns(
        {
            C.PROTOCOL.name: _required(protocol, protocol.isNull(), "no protocol: ", path),
            C.CELL_ID.name: _required(cell, cell.isNull(), "no cell_id: ", path),
            C.CYCLE_INDEX.name: _required(cycle, cycle.isNull(), "no cycle_index: ", path),
            C.NOMINAL_CAPACITY.name: index["nominal_capacity_ah"].try_cast("double"),
            C.EIS_VOLTAGE.name: _required(voltage, no_voltage, "no voltage: ", path),
        }
    )


def source_order(path_column: str = "raw file path") -> Column:
    """Total order of raw files: protocol, cycle, cell, SOC (-1 when absent), part, channel, path."""
    path, stem = col(path_column), _stem(col(path_column))
    # Rank of each protocol in the file order.
    rank = (
        F.when(col(C.PROTOCOL.name) == "cycling", 0)
        .when(col(C.PROTOCOL.name) == "HPPC", 1)
        .when(col(C.PROTOCOL.name) == "RPT", 2)
        .when(col(C.PROTOCOL.name) == "EIS", 3)
        .otherwise(99)
    )
    number = lambda text: F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))
    part = number(F.regexp_extract(stem, r"^.*?Part(\d+)(?=_|Part|$)", 1))
    after_dot = F.regexp_extract(stem, r"\.(\d+)$", 1)
    channel = number(F.when(after_dot != "", after_dot).otherwise(F.regexp_extract(stem, r"_(\d+)$", 1)))
    return F.struct(
        rank.alias("protocol"),
        col(C.CYCLE_INDEX.name).alias("cycle"),
        col(C.CELL_ID.name).alias("cell"),
        F.coalesce(col(C.SOC.name), F.lit(-1.0)).alias("soc"),
        part.alias("part"),
        channel.alias("channel"),
        path.alias("path"),
    )
