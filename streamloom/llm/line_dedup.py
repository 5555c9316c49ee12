"""Incremental and reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without blanks at its ends, A-Z lower-cased, as md5. The index lies in one shared folder as
tables that are only added to; a small table of state names the parts that count, so a job that dies half-way leaves
nothing behind that is read:

* `lines`: one row per document and distinct key, which a deletion needs to find what a document held,
* `refs`: per key the number of documents that hold it and the smallest of them (the keeper), exact; a later
  version of a key replaces the earlier one,
* `filters`: one cuckoo filter per shard of the keys, with one 16-bit fingerprint per key in use,
* `removed`: deleted documents.

Insertion asks the filters first: a key they do not hold is new and needs no look at `refs`; the others, false hits
included, meet `refs` exactly. Deletion takes references off, takes a key's fingerprint out of its shard when the last one goes,
and finds the next keeper among the documents left, so that insert and delete in any order give the index of the documents
that are there. Filters that would be too full, and all of them when keys outgrow the shards, are built anew from `refs`.

Scale: copies of a line meet in map-side sums, so a hot key is one row per task; a shard holds at most four times
`SHARD_KEYS` keys; keys that very many documents hold meet those documents by broadcast (at most `HOT_KEYS` of them can
exceed the bound), all others by an ordinary join.

Defined results: null text is one empty line; keys shorter than `least` are never touched; a row without doc_id counts as
coming after every document and loses lines that any has; rows with one doc_id are one document, and keep what it keeps; repeated
lines of a document stay or go together. A text that loses all lines is empty. A very long text is one row of its join;
lines are looked up in a set. Empty tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import stored
from streamloom.session import checkpoint_dir

LEAST = 10
SHARD_KEYS = 1 << 18
HOT_KEYS = 4096
SLOTS = 4
#: A filter is made for so many times its keys, so that loads of the same size can follow before it is built anew.
ROOM = 4
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter over 16-byte keys: buckets of four 16-bit fingerprints, whole arrays at a time.

    A key has two buckets, each found from the other and the fingerprint. `insert` expects keys that are not in it,
    `delete` keys that are.
    """

    def __init__(self, buckets: int, table: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        given = np.zeros(buckets * SLOTS, np.uint16) if table is None else np.frombuffer(table, np.uint16).copy()
        self.table = given.reshape(buckets, SLOTS)

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        """Filled to at most 80 percent by so many keys."""
        return Cuckoo(1 << max(4, int(keys / (0.8 * SLOTS)).bit_length()))

    @property
    def room(self) -> int:
        return int(self.table.size * 0.85) - int(np.count_nonzero(self.table))

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return at ^ ((mixed | np.uint64(1)) & self.mask)

    def _placed(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        return parts[:, 0] & self.mask, (parts[:, 1] % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)

    def __contains__(self, key: bytes) -> bool:
        return bool(self.contains([key])[0])

    def contains(self, keys: list[bytes]) -> np.ndarray:
        at, prints = self._placed(keys)
        here, there = self.table[at], self.table[self._other(at, prints)]
        return ((here == prints[:, None]) | (there == prints[:, None])).any(axis=1)

    def insert(self, keys: list[bytes], rounds: int = 500) -> bool:
        """Puts the keys in; False if some found no place (the filter is of no use then)."""
        at, prints = self._placed(keys)
        draw = np.random.default_rng(len(keys))  # a retried task draws alike
        fresh = np.ones(len(at), bool)
        for _ in range(rounds):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, prints, fresh = at[order], prints[order], fresh[order]
            first = np.concatenate([[True], at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(axis=1)
            empty = np.argsort(taken, axis=1, kind="stable")  # empty slots first
            self.table[at[fits], empty[fits, rank[fits]]] = prints[fits]
            at, prints, fresh, first = at[~fits], prints[~fits], fresh[~fits], (rank == 0)[~fits]
            # One key of a full bucket that was turned away from both of its buckets puts a resident out.
            swap = np.flatnonzero(~fresh & first)
            slot = draw.integers(SLOTS, size=len(swap))
            old = self.table[at[swap], slot]
            self.table[at[swap], slot] = prints[swap]
            prints[swap] = old
            fresh[:] = False
            at = self._other(at, prints)
        return not len(at)

    def delete(self, keys: list[bytes]) -> None:
        at, prints = self._placed(keys)
        while len(at):
            other = self._other(at, prints)
            here = self.table[at] == prints[:, None]
            in_first = here.any(axis=1)
            bucket = np.where(in_first, at, other)
            found = self.table[bucket] == prints[:, None]
            if not found.any(axis=1).all():
                raise ValueError("a key to delete is not in the filter")
            flat = bucket.astype(np.int64) * SLOTS + np.argmax(found, axis=1)
            _, once = np.unique(flat, return_index=True)
            self.table.reshape(-1)[flat[once]] = 0
            left = np.ones(len(at), bool)
            left[once] = False
            at, prints = at[left], prints[left]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def keys_of(text: Column, least: int = LEAST) -> Column:
    """The distinct digests of the keys of a text's lines that have at least `least` code points."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key)
    return F.array_distinct(F.transform(F.filter(lines, lambda k: F.length(k) >= least), lambda k: F.unhex(F.md5(k))))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


_KEY_SCHEMA = "key binary"
_FILTER_SCHEMA = "shard long, buckets long, used long, bits binary"
_REFS = "key binary, refs long, keeper long, version int"
_LINES = "doc_id long, text_id long, key binary, version int"
_REMOVED = "doc_id long, version int"
_STATE = "version int, shards long, lines array<string>, refs array<string>, filters string, removed array<string>"


class LineIndex:
    """The index in a folder; every change makes a new version, and the object stands for the newest."""

    def __init__(self, spark: SparkSession, folder: str, state: dict, shard_keys: int = SHARD_KEYS):
        self.spark, self.folder, self.state, self.shard_keys = spark, folder.rstrip("/"), state, shard_keys

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, shard_keys: int = SHARD_KEYS) -> LineIndex:
        folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
        start = {"version": 0, "shards": 1, "lines": [], "refs": [], "filters": None, "removed": []}
        return cls(spark, folder, start, shard_keys)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, shard_keys: int = SHARD_KEYS) -> LineIndex:
        newest = spark.read.schema(_STATE).parquet(f"{folder.rstrip('/')}/state/*").orderBy(F.desc("version")).first()
        return cls(spark, folder, newest.asDict(), shard_keys)

    def _write(self, df: DataFrame, name: str) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        return part

    def _read(self, parts: list[str] | str | None, schema: str) -> DataFrame:
        parts = [parts] if isinstance(parts, str) else parts
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts])

    def _commit(self, **parts) -> None:
        state = self.state | {"version": self.state["version"] + 1}
        for name, part in parts.items():
            state[name] = [*state[name], part] if isinstance(state[name], list) else part
        self.spark.createDataFrame([tuple(state.values())], _STATE).write.parquet(f"{self.folder}/state/{state['version']:09d}")
        self.state = state

    # --- tables ---

    def refs(self) -> DataFrame:
        """key, refs, keeper: the exact counts of all keys in use."""
        return self._newest(self._read(self.state["refs"], _REFS)).where("refs > 0")

    @staticmethod
    def _newest(refs: DataFrame) -> DataFrame:
        last = refs.groupBy("key").agg(F.max(F.struct("version", "refs", "keeper")).alias("__last"))
        return last.select("key", "__last.refs", "__last.keeper")

    def lines(self) -> DataFrame:
        """doc_id, text_id, key of the documents that are there."""
        lines = self._read(self.state["lines"], _LINES)
        if not self.state["removed"]:
            return lines.select("doc_id", "text_id", "key")
        gone = self._read(self.state["removed"], _REMOVED).groupBy("doc_id").agg(F.max("version").alias("__gone"))
        left = lines.join(gone, "doc_id", "left").where(F.coalesce(F.col("__gone"), F.lit(-1)) < F.col("version"))
        return left.select("doc_id", "text_id", "key")

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.state["shards"])))

    def filters(self) -> DataFrame:
        return self._read(self.state["filters"], _FILTER_SCHEMA)

    # --- filters ---

    def _maybe(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` whose key may be in use, by the filter of their shard."""

        def look(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(rows):
                return rows[["key"]].iloc[:0]
            held = Cuckoo(int(filters["buckets"][0]), filters["bits"][0])
            return rows.loc[held.contains(rows["key"].tolist()), ["key"]]

        asked = self._sharded(keys.select("key"))
        return self.filters().groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(look, _KEY_SCHEMA)

    def _changed_filters(self, keys: DataFrame, add: bool) -> str:
        """Filters after `keys` came in (or went out); shards without room are left empty-handed and built anew."""

        def change(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return filters
            keys, shard = rows["key"].tolist(), rows["shard"].iloc[0]
            held = Cuckoo(int(filters["buckets"][0]), filters["bits"][0]) if len(filters) else Cuckoo.sized(ROOM * len(keys))
            if add:
                done = len(keys) <= held.room and held.insert(keys)
            else:
                held.delete(keys)
                done = True
            return _row(shard, held, done)

        rows = self._sharded(keys.select("key"))
        made = self.filters().groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(change, _FILTER_SCHEMA)
        return self._write(made, "filters")

    def _built_filters(self, refs: DataFrame, shards: DataFrame | None = None) -> DataFrame:
        """Filters of the given shards (of all) from the exact table."""

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            keys, room = rows["key"].tolist(), ROOM * len(rows)
            while True:
                held = Cuckoo.sized(room)
                if held.insert(keys):
                    break
                room *= 2
            return _row(rows["shard"][0], held, True)

        rows = self._sharded(refs.where("refs > 0").select("key"))
        if shards is not None:
            rows = rows.join(shards, "shard", "left_semi")
        return rows.groupBy("shard").applyInPandas(build, _FILTER_SCHEMA)

    def _refiltered(self, fresh: DataFrame, gone: DataFrame | None, refs_part: str) -> str:
        """The filters of the next version, once `refs_part` is written."""
        refs = self._newest(self._read([*self.state["refs"], refs_part], _REFS)).where("refs > 0")
        if gone is not None:
            part = self._changed_filters(gone, add=False)
        else:
            in_use = fresh.count() + (self.filters().agg(F.sum("used")).first()[0] or 0)
            if self.state["filters"] is None or in_use > 4 * self.shard_keys * self.state["shards"]:
                self.state = self.state | {"shards": 1 << (in_use // self.shard_keys).bit_length()}
                return self._write(self._built_filters(refs), "filters")
            part = self._changed_filters(fresh, add=True)
        full = self._read(part, _FILTER_SCHEMA).where("bits IS NULL").select("shard")
        if full.isEmpty():
            return part
        kept = self._read(part, _FILTER_SCHEMA).where("bits IS NOT NULL")
        return self._write(kept.union(self._built_filters(refs, full)), "filters")

    # --- changes ---

    def insert(self, docs: DataFrame, least: int = LEAST, slices: int = 1) -> LineIndex:
        """Adds documents (doc_id, text). A large load may come in slices: their lines are hashed once, and from the second
        slice on only keys that the filters may hold meet the exact table. A document must not be there already."""
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        keyed = keyed.withColumn("__keys", keys_of(F.col("text"), least))
        rows = keyed.select("doc_id", _text_id(F.col("text")).alias("text_id"), F.explode("__keys").alias("key"))
        rows = rows.withColumn("__slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
        part = self._write(rows, "hashed")
        hashed = self._read(part, "doc_id long, text_id long, key binary, __slice long")
        for k in range(slices):
            self._insert(hashed.where(F.col("__slice") == k).drop("__slice"))
        return self

    def _insert(self, lines: DataFrame) -> None:
        version = F.lit(self.state["version"] + 1)
        lines_part = self._write(lines.withColumn("version", version), "lines")
        mine = self._read(lines_part, _LINES).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        if self.state["filters"] is None:
            counted = mine.withColumns({"was": F.lit(0).cast("long"), "old": F.lit(None).cast("long")})
        else:
            mine = stored(mine, "line-keys")
            maybe = stored(self._maybe(mine), "line-maybe")
            known = self._newest(self._read(self.state["refs"], _REFS).join(maybe, "key", "left_semi"))
            counted = mine.join(known.select("key", F.col("refs").alias("was"), F.col("keeper").alias("old")), "key", "left")
            counted = stored(counted, "line-counted")
        # The smaller keeper, or the other one where one is null.
        n, keeper = F.coalesce("was", F.lit(0)) + F.col("n"), F.least("first", "old")
        refs_part = self._write(counted.select("key", n.alias("refs"), keeper.alias("keeper"), version.alias("version")), "refs")
        filters = self._refiltered(counted.where("coalesce(was, 0) = 0"), None, refs_part)
        self._commit(lines=lines_part, refs=refs_part, filters=filters)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (a column doc_id) out again: counts, keepers and fingerprints become those of the rest."""
        version = F.lit(self.state["version"] + 1)
        removed = self._write(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("version", version), "removed")
        going = self._read(removed, _REMOVED).select("doc_id")
        lost = self.lines().join(going, "doc_id", "left_semi").groupBy("key")
        lost = stored(lost.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "line-lost")
        known = self._newest(self._read(self.state["refs"], _REFS).join(lost, "key", "left_semi"))
        left = stored(known.join(lost, "key").select("key", (F.col("refs") - F.col("n")).alias("refs"), "keeper", "first"), "line-left")
        orphans = left.where("refs > 0 AND first <= keeper").select("key")
        before = self.state
        self.state = before | {"removed": [*before["removed"], removed]}
        heirs = self.lines().join(orphans, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        self.state = before
        kept = F.when(F.col("refs") == 0, F.lit(None)).when(F.col("first") <= F.col("keeper"), F.col("heir")).otherwise(F.col("keeper"))
        refs = left.join(heirs, "key", "left").select("key", "refs", kept.cast("long").alias("keeper"), version.alias("version"))
        refs_part = self._write(refs, "refs")
        filters = self._refiltered(None, left.where("refs = 0"), refs_part)
        self._commit(refs=refs_part, filters=filters, removed=removed)
        return self

    # --- results ---

    def dropped(self) -> DataFrame:
        """doc_id, text_id, keys: the keys that a document loses, because a smaller document holds them."""
        shared = stored(self.refs().where("refs > 1 AND keeper IS NOT NULL"), "line-shared")
        bound = max(1000, (shared.agg(F.sum("refs")).first()[0] or 0) // HOT_KEYS)
        lines = self.lines()
        loses = F.coalesce(F.col("keeper") < F.col("doc_id"), F.lit(True))
        # The sum of all counts bounds how many keys can be hot.
        hot = F.broadcast(shared.where(F.col("refs") > bound).select("key", "keeper"))
        cold = shared.where(F.col("refs") <= bound).select("key", "keeper")
        hit = lines.join(hot, "key").where(loses).select("doc_id", "text_id", "key")
        hit = hit.union(lines.join(cold, "key").where(loses).select("doc_id", "text_id", "key"))
        return hit.groupBy("doc_id", "text_id").agg(F.collect_set("key").alias("keys"))

    def deduplicated(self, docs: DataFrame, least: int = LEAST) -> DataFrame:
        """Per row of `docs`, all of them in the index: doc_id, n_lines, n_dropped, text (the lines that stay)."""

        def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
            out = [_kept(t, g, least) if g is not None else (None, None) for t, g in zip(text, gone, strict=True)]
            return pd.DataFrame(out, columns=["text", "left"]).astype({"left": "Int64"})

        cut_udf = F.pandas_udf(cut, "text string, left long")
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        given = given.withColumn("__t", F.xxhash64("text"))
        gone = self.dropped().withColumnsRenamed({"doc_id": "__d", "text_id": "__u"})
        rows = given.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__u")), "left")
        # Only texts that lose lines are handed to Python.
        rows = rows.withColumn("__cut", cut_udf(F.when(F.col("keys").isNotNull(), F.col("text")), F.col("keys")))
        n = F.size(F.split("text", "\n")).cast("long")
        left = F.coalesce(F.col("__cut.left"), n)
        text = F.when(F.col("keys").isNull(), F.col("text")).otherwise(F.col("__cut.text"))
        return rows.select("doc_id", n.alias("n_lines"), (n - left).alias("n_dropped"), text.alias("text"))


def _row(shard: int, held: Cuckoo, done: bool) -> pd.DataFrame:
    used = int(np.count_nonzero(held.table))
    bits = held.table.tobytes() if done else None
    return pd.DataFrame({"shard": [shard], "buckets": [len(held.table)], "used": [used], "bits": [bits]})


def _kept(text: str, gone: Iterator[bytes], least: int) -> tuple[str, int]:
    gone, out = set(map(bytes, gone)), []
    for line in text.split("\n"):
        key = line.strip(_BLANKS)
        # Only A-Z change case; bytes.lower leaves all others as they are.
        if len(key) < least or hashlib.md5(key.encode().lower()).digest() not in gone:
            out.append(line)
    return "\n".join(out), len(out)


def report(docs: DataFrame, slices: int = 3) -> DataFrame:
    index = LineIndex.create(docs.sparkSession).insert(docs, slices=slices)
    rows = index.deduplicated(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
