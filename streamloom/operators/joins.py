"""Key joins used by several operators; null keys match null keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.columns import col


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where null equals null; left columns keep their names.

    The physical join is Catalyst's choice: it broadcasts only below its size threshold.
    """
    if not keys:
        raise ValueError("a key join needs at least one key column")
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    side = right.withColumnsRenamed(renamed)
    on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    joined = left.join(side, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


SALT_COPIES = 32


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    copies: int = SALT_COPIES,
) -> DataFrame:
    """Join data rows with a table of one row per key, however many rows a key has.

    A plain key join would put all rows of a key into one task and, as its partitioning suits a
    following group-by on more columns, keep them there. Rows are therefore spread over
    `copies` salts taken from a row-level value, and the small side is repeated once per salt.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(copies)).cast("int"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    repeated = per_key.withColumn("__salt", numbers)
    return key_join(salted, repeated, [*keys, "__salt"], how).drop("__salt")


LOOKUP_IDS = 10_000


def lineage_lookup(
    manifest: DataFrame, wanted: DataFrame, path: str = "manifest path", row_id: str = "row id"
) -> DataFrame:
    """Manifest rows of the wanted (manifest path, row id) pairs, once each.

    What is wanted is summed up first, in one small aggregate: the scan gets the range of ids, and the paths and ids themselves while they
    are few, as conditions that reach the file. Only then do rows meet the pairs; wanted pairs may repeat.
    """
    pairs = wanted.select(col(path), col(row_id)).distinct()
    few = F.approx_count_distinct(col(row_id)) <= LOOKUP_IDS // 2
    asked = pairs.agg(
        F.min(col(row_id)).alias("low"), F.max(col(row_id)).alias("high"), few.alias("few"), F.approx_count_distinct(col(path)).alias("paths")
    ).first()
    if asked["low"] is None:
        return key_join(manifest, pairs, [path, row_id], "left_semi")
    rows = manifest.filter(col(row_id).between(asked["low"], asked["high"]))
    if asked["paths"] <= LOOKUP_IDS // 100:
        names = [r[0] for r in pairs.select(col(path)).distinct().limit(LOOKUP_IDS).collect()]
        rows = rows.filter(col(path).isin(names))
    if asked["few"]:
        ids = [r[0] for r in pairs.select(col(row_id)).distinct().limit(LOOKUP_IDS + 1).collect()]
        rows = rows.filter(col(row_id).isin(ids)) if len(ids) <= LOOKUP_IDS else rows
    return key_join(rows, pairs, [path, row_id], "left_semi")
