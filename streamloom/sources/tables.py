"""Parquet tables, row ranges of shards and windows over segment lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.columns import col
from streamloom.operators.joins import key_join, spread_join

ROW_INDEX = "__row_index"
FILE = "__file"
_OVERLAP_BUCKET = 1 << 16


def read_table(
    spark: SparkSession,
    location: str | Sequence[str],
    columns: Sequence[str] | None = None,
    condition: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One or several parquet locations as a table with projection, predicate and limit."""
    paths = [location] if isinstance(location, str) else list(location)
    df = spark.read.parquet(*paths)
    if columns is not None:
        df = df.select(*[col(c) for c in columns])
    if condition is not None:
        df = df.filter(condition)
    return df if limit is None else df.limit(limit)


def with_row_source(df: DataFrame, root: str | None = None) -> DataFrame:
    """Add the file (relative to `root` when given) and the row number inside it."""
    path = F.col("_metadata.file_path")
    if root is not None:
        bare = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
        path = F.element_at(F.split(path, _literal(bare), 2), -1)
    return df.withColumns({FILE: path, ROW_INDEX: F.col("_metadata.row_index")})


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def segment_rows(manifest: DataFrame, segments: str, keys: Sequence[str]) -> DataFrame:
    """One row per manifest segment: keys, its place in the stream and the file row range."""
    items = manifest.select(*[col(k) for k in keys], F.posexplode(col(segments)).alias("__pos", "__s"))
    before = Window.partitionBy(*[col(k) for k in keys]).orderBy("__pos")
    return items.select(
        *[col(k) for k in keys],
        F.col("__pos").alias("segment"),
        F.col("__s.`file path`").alias("file path"),
        F.col("__s.`row start`").alias("row start"),
        F.col("__s.`row count`").alias("row count"),
        (F.sum("__s.`row count`").over(before) - F.col("__s.`row count`")).alias("stream start"),
    )


#: Segments are indexed on grids of these many rows, each on the smallest one that is not shorter than it.
GRIDS = (16, 256, 4_096, 65_536)


def _grid(rows: Column) -> Column:
    """Number of the grid that suits a segment of so many rows; the longest ones take several cells of the last."""
    number = F.lit(len(GRIDS) - 1)
    for i in reversed(range(len(GRIDS) - 1)):
        number = F.when(rows <= GRIDS[i], F.lit(i)).otherwise(number)
    return number


def _cell(row: Column, grid: int) -> Column:
    return F.struct(F.lit(grid).alias("grid"), F.floor(row / GRIDS[grid]).cast("long").alias("at"))


def segment_index(ranges: DataFrame) -> DataFrame:
    """Segments laid out on grid cells (`__cell`): the row of a file is only compared with segments of its own cells.

    A segment takes at most two cells of its grid, or one for every `GRIDS[-1]` rows. Segments that do not overlap
    leave at most `GRIDS[0]` candidates in a cell.
    """
    first, last = F.col("`row start`"), F.col("`row start`") + F.col("`row count`") - 1

    def cells(grid: int) -> Column:
        numbers = F.sequence(*[F.floor(at / GRIDS[grid]).cast("long") for at in (first, last)])
        return F.transform(numbers, lambda n: F.struct(F.lit(grid).alias("grid"), n.alias("at")))

    own = F.coalesce(*[F.when(_grid(F.col("`row count`")) == g, cells(g)) for g in range(len(GRIDS))])
    return ranges.filter(F.col("`row count`") > 0).withColumn("__cell", F.explode(own))


def read_segments(
    spark: SparkSession, root: str, manifest: DataFrame, segments: str, keys: Sequence[str]
) -> DataFrame:
    """Rows of the manifest's segments with their keys and position in the stream.

    Only the listed files are opened (one name per shard comes to the driver). Rows meet segments on
    (file, grid, cell) of the scan's row number, for the few grids in use, so neither a file with very many segments nor a
    segment with very many rows is one task. Overlapping segments each get their rows.
    """
    ranges = segment_rows(manifest, segments, keys)
    indexed = segment_index(ranges.withColumnsRenamed({"file path": FILE}))
    # At most len(GRIDS) rows a file.
    found = indexed.groupBy(FILE).agg(F.collect_set("__cell.grid").alias("grids")).collect()
    if not found:
        raise FileNotFoundError("No segments to read")
    data = with_row_source(spark.read.parquet(*[f"{root.rstrip('/')}/{r[FILE]}" for r in found]), root)
    data = data.drop(*[k for k in keys if k in data.columns])
    used = sorted({g for r in found for g in r["grids"]})
    own = F.explode(F.array(*[_cell(F.col(ROW_INDEX), g) for g in used]))
    inside = (F.col(ROW_INDEX) >= F.col("`row start`")) & (
        F.col(ROW_INDEX) < F.col("`row start`") + F.col("`row count`")
    )
    hit = data.withColumn("__cell", own).join(indexed, [FILE, "__cell"]).filter(inside)
    position = F.col("`stream start`") + F.col(ROW_INDEX) - F.col("`row start`")
    return hit.withColumn("stream position", position).drop(
        FILE, ROW_INDEX, "__cell", "segment", "row start", "row count", "stream start"
    )


def stage_segments(
    spark: SparkSession, root: str, manifest: DataFrame, selected: DataFrame, segments: str, keys: Sequence[str]
) -> DataFrame:
    """Rows of the selected streams through the manifest's segments: other streams of the same files are not matched."""
    wanted = selected.select(*[col(k) for k in keys]).distinct()
    return read_segments(spark, root, key_join(manifest, wanted, keys, "left_semi"), segments, keys)


def segment_windows(
    ranges: DataFrame, windows: DataFrame, keys: Sequence[str], bucket: int = _OVERLAP_BUCKET
) -> DataFrame:
    """Overlap of row windows (`window offset`, `window rows`) with the segments of their stream.

    Both sides are laid out on fixed position buckets and joined on (stream, bucket), so a long
    stream never pairs all its windows with all its segments.
    """
    first = F.greatest(F.col("`window offset`"), F.lit(0))
    w = windows.withColumns({"__ws": first, "__we": first + F.col("`window rows`")}).filter(
        F.col("`window rows`") > 0
    )
    s = ranges.filter(F.col("`row count`") > 0).withColumns(
        {"__ss": F.col("`stream start`"), "__se": F.col("`stream start`") + F.col("`row count`")}
    )

    def laid_out(df: DataFrame, start: str, end: str) -> DataFrame:
        numbers = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))
        return df.withColumn("__bucket", F.explode(numbers))

    pairs = key_join(laid_out(w, "__ws", "__we"), laid_out(s, "__ss", "__se"), [*keys, "__bucket"])
    start = F.greatest("__ws", "__ss")
    rows = F.least("__we", "__se") - start
    # A pair sharing several buckets is reported in the bucket where the overlap starts.
    once = F.floor(start / bucket) == F.col("__bucket")
    found = pairs.filter((rows > 0) & once).withColumns(
        {
            "window row start": F.col("`row start`") + start - F.col("`stream start`"),
            "window row count": rows,
        }
    )
    return found.drop("__ws", "__we", "__ss", "__se", "__bucket")


def stage_rows(stage_data: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the streams of a selected manifest; our tables carry the key in every row."""
    wanted = selected.select(*[col(k) for k in keys]).distinct()
    row = F.struct(*[col(c) for c in stage_data.columns if c not in keys])
    return spread_join(stage_data, wanted, keys, row, "left_semi")
