"""Exact n-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification a pair.

Documents with equal shingle sets are one node from the start. Every other document is indexed under the rarest
shingles of its set: two sets above the threshold share at least one of them. Rarity comes from document counts of all
shingles in hashed cells (a table of fixed size); any order gives the same links, this one keeps the lists short.

Components need no pair inside a group that is known to hang together. So each list of the index first links its
members to two hubs, then those of the components found to hubs of two other components, and only pairs across
components that are still different are then met in full, each from its smaller set's shorter prefix: a group of
thousands of near copies costs as many comparisons as it has members, and no link between groups is lost. Each pair is
verified once, as pairs verified before either hang together or are left out.

Defined results: a document without words has an empty set and is its own component; a shorter document is one shingle;
doc_id identifies a document (rows that repeat it belong together); a row without doc_id gets the component of
documents with an equal set, else null. Extra columns are carried by `deduplicated` and ignored by `report`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm import shingles
from streamloom.llm.common import stored
from streamloom.llm.components import components

CELL_BITS = 18
#: Longs of a set's bitmap; ids that are broadcast at once at most (16 MB).
MARK_LONGS = 16
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Threshold:
    """Sets link when 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _marks(s: np.ndarray) -> list[int]:
    """Bitmap of a set: a bit says whether an odd number of its hashes fall there. Of two bitmaps no more bits can
    differ than the sets have members that are not common."""
    odd = np.bincount((s & np.uint64(64 * MARK_LONGS - 1)).astype(np.int64), minlength=64 * MARK_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _scanned(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: one per document (doc_id, n, digest), and one per cell and task with its documents' count."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            n, digests, marks = [], [], []
            for part in shingles.sliced(texts):
                found = shingles.sets(texts[part], words)
                n += map(len, found)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                marks += [_marks(s) for s in found]
                counts += np.bincount(_cell(np.concatenate(found)), minlength=1 << CELL_BITS)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n": n, "digest": digests, "marks": marks, "cell": None, "seen": None})
        cells = np.flatnonzero(counts)
        yield pd.DataFrame({"doc_id": None, "n": None, "digest": None, "marks": None, "cell": cells, "seen": counts[cells]})

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInPandas(scan, "doc_id long, n long, digest binary, marks array<long>, cell long, seen long")


def _indexed(docs: DataFrame, rarity: np.ndarray, t: Threshold) -> DataFrame:
    """(token, id, n, pos): the rarest shingles of every document, enough of them for the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # 2^CELL_BITS numbers, whatever the data

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].to_numpy(np.int64)
            for part in shingles.sliced(texts):
                tokens, owner, size, place = [], [], [], []
                for doc, s in zip(ids[part], shingles.sets(texts[part], t.words), strict=True):
                    if not len(s):
                        continue
                    p = t.prefix(len(s))
                    first = s[np.lexsort((s, order[_cell(s)]))[:p]]
                    tokens.append(first)
                    owner.append(np.full(len(first), doc))
                    size.append(np.full(len(first), len(s)))
                    place.append(np.arange(len(first)))
                if tokens:
                    yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "id": np.concatenate(owner), "n": np.concatenate(size), "pos": np.concatenate(place)})

    slim = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInPandas(index, "token long, id long, n int, pos int")


def _apart(a: str, b: str, longs: int) -> Column:
    """Least number of members that two sets do not share, by their bitmaps."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(longs)), F.lit(0))


def _may_link(n_a: str, n_b: str, apart: Column, t: Threshold) -> Column:
    """Suffix filter: |A and B| <= (|A| + |B| - apart) / 2."""
    most = (F.col(n_a) + F.col(n_b) - apart) / 2
    return 100 * most >= t.percent * (F.col(n_a) + F.col(n_b) - most)


def _folded() -> Column:
    """The bitmap `marks` at half its length: folding keeps odd numbers odd."""
    half = MARK_LONGS // 2
    return F.array(*[F.get("marks", i).bitwiseXOR(F.get("marks", i + half)) for i in range(half)])


def _folds_may_link(a: str, b: str, n_a: str, n_b: str, t: Threshold) -> Column:
    """True also where a fold is missing (a doc_id with several rows)."""
    return F.coalesce(_may_link(n_a, n_b, _apart(a, b, MARK_LONGS // 2), t), F.lit(True))


def _near(pairs: DataFrame, marks: DataFrame, t: Threshold) -> DataFrame:
    a, b = (marks.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "marks")]) for x in "ab")
    both = pairs.join(a, pairs["a"] == a["id_a"]).join(b, pairs["b"] == b["id_b"])
    return both.where(_may_link("n_a", "n_b", _apart("marks_a", "marks_b", MARK_LONGS), t)).select("a", "b").distinct()


def _kept_sets(docs: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """(id, hashes): the sorted sets of the documents in the pairs. Their ids are broadcast while they are few; beyond
    that the texts are joined by a shuffle."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["id"].to_numpy(np.int64)
            for part in shingles.sliced(texts):
                found = shingles.sets(texts[part], t.words)
                yield pd.DataFrame({"id": ids[part], "hashes": [s.tobytes() for s in found]})

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return texts.mapInPandas(build, "id long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                ok.append(100 * same >= t.percent * (len(x) + len(y) - same))
            yield frame.loc[ok, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long")


def _first_can_be(n_a: str, pos_a: str, n_b: str, pos_b: str, t: Threshold) -> Column:
    """Positional filter: two sets that link have at their first common shingle enough members left, in both, for the
    intersection that their sizes demand."""
    left = F.least(F.col(n_a) - F.col(pos_a), F.col(n_b) - F.col(pos_b))
    return (100 + t.percent) * left >= t.percent * (F.col(n_a) + F.col(n_b))


def _hub_pairs(lists: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of a list's hubs with its other members that are not known to hang together with them. The hubs have the
    smallest and the largest component; of its members the one that holds the list's shingle first, which is the
    one with the fewest shingles of its own."""
    w = Window.partitionBy("token")
    member = F.struct("root", "pos", "n", "id", "fold")
    met = lists.withColumn("ends", F.array(F.min(member).over(w), F.max(member).over(w)))
    met = met.select("id", "n", "pos", "root", "fold", F.explode("ends").alias("hub")).where("hub.root != root")
    met = met.where(
        _first_can_be("n", "pos", "hub.n", "hub.pos", t) & _folds_may_link("fold", "hub.fold", "n", "hub.n", t)
    )
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _cross_pairs(lists: DataFrame, t: Threshold) -> DataFrame:
    """All pairs across components that can have their first common shingle in a list.

    A pair is taken from the side of its smaller set, which needs only the front of its prefix: with percent = 85, 15 in
    185 of its members in place of 15 in 100. Length, positional and suffix filter are conditions of the join, so that a
    pair that cannot link is not made.
    """
    w = Window.partitionBy("token")
    open_lists = lists.withColumn("lo", F.min("root").over(w)).withColumn("hi", F.max("root").over(w)).where("lo != hi").drop("lo", "hi")
    a, b = (open_lists.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "root", "fold")]) for x in "ab")
    a = a.where(f"{100 + t.percent} * pos_a <= {100 - t.percent} * n_a")
    met = a.join(b, "token").where(
        F.expr("(n_a < n_b OR (n_a = n_b AND id_a < id_b)) AND root_a != root_b")
        & _first_can_be("n_a", "pos_a", "n_b", "pos_b", t)
        & _folds_may_link("fold_a", "fold_b", "n_a", "n_b", t)
    )
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def linked(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles, digest of the set and component_id of every row."""
    spark = docs.sparkSession
    scan = stored(_scanned(docs, t.words), "jaccard-scan")
    found = scan.where("cell IS NULL").select("doc_id", "n", "digest", "marks")
    rarity = np.zeros(1 << CELL_BITS, np.int64)
    for r in scan.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen")).toLocalIterator():
        rarity[r["cell"]] = r["seen"]
    known = found.where("doc_id IS NOT NULL AND n > 0")
    # Equal sets are one node; a doc_id that repeats with other texts ties its sets together.
    first = known.groupBy("n", "digest").agg(F.min("doc_id").alias("rep"))
    held = known.select("doc_id", "n", "digest").join(first, ["n", "digest"]).select("doc_id", "rep").distinct()
    own = F.max(F.col("rep") == F.col("doc_id"))
    nodes = held.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("reps"), own.alias("owns"))
    folds = known.groupBy(F.col("doc_id").alias("__d")).agg(F.count(F.lit(1)).alias("k"), F.first(_folded()).alias("fold"))
    folds = folds.select("__d", F.when(F.col("k") == 1, F.col("fold")).alias("fold"))
    nodes = stored(nodes.join(folds, nodes["doc_id"] == folds["__d"]).drop("__d"), "jaccard-nodes")
    several = nodes.where("reps > 1").select("doc_id")
    links = held.join(several, "doc_id").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    w = Window.partitionBy("token")
    lists = _indexed(docs, rarity, t).withColumn("k", F.count(F.lit(1)).over(w)).where("k > 1").drop("k")
    lists = (
        lists.join(nodes.where("owns").select(F.col("doc_id").alias("id"), "fold"), "id")  # copies add nothing to a list
        .withColumn("k", F.count(F.lit(1)).over(w))
        .where("k > 1")
        .select("token", "id", "n", "pos", "fold")
    )
    lists = stored(lists, "jaccard-lists")
    marks = known.join(nodes.where("owns").select("doc_id"), "doc_id").join(lists.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    marks = stored(marks.select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "marks"), "jaccard-marks")
    roots = tried = None
    for step in ("hubs", "hubs", "cross"):
        now = lists if roots is None else lists.join(roots, "id", "left")
        now = now.withColumn("root", F.coalesce("root", "id") if roots is not None else F.col("id"))
        pairs = _cross_pairs(now, t) if step == "cross" else _hub_pairs(now, t)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        near = stored(_near(pairs, marks, t), "jaccard-pairs")
        sets = stored(_kept_sets(docs, near, t), "jaccard-sets")
        new = stored(_verified(near, sets, t), "jaccard-links")
        tried = near if tried is None else tried.union(near)
        links = links.union(new)
        if roots is None or not new.isEmpty():
            roots = stored(components(links), "jaccard-roots")
    by_doc = (
        nodes.select("doc_id", "rep")
        .join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
        .select(F.col("doc_id").alias("__d"), F.coalesce("root", "rep").alias("component"))
    )
    by_set = first.join(by_doc, first["rep"] == by_doc["__d"]).select(F.col("n").alias("__n"), F.col("digest").alias("__g"), F.col("component").alias("set_component"))
    return (
        found.drop("marks").join(by_doc, found["doc_id"] == by_doc["__d"], "left")
        .join(by_set, (found["n"] == by_set["__n"]) & (found["digest"] == by_set["__g"]), "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "digest",
            F.coalesce(F.least("component", "set_component"), "component", "set_component", "doc_id").alias("component_id"),
        )
    )


def report(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    return linked(docs, t).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, t: Threshold = Threshold(words=5, percent=80)) -> DataFrame:
    """One document of every component stays, the one with the smallest doc_id. Documents without words all stay; of rows
    that repeat a doc_id one stays; rows without doc_id stay, one for each text."""
    ids = linked(docs, t)
    gone = ids.where("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    out = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    has_words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    named = out.where(F.col("doc_id").isNotNull() & has_words).dropDuplicates(["doc_id"])
    nameless = docs.where(F.col("doc_id").isNull() & has_words).dropDuplicates(["text"])
    return named.unionByName(out.where(~has_words)).unionByName(nameless)
