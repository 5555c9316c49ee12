"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs of rotated, centred vectors. The rotations are learned (PCA, then iterative quantisation from several
random starts, one part of the code each) on a sample of at most `sample` vectors in hash order of their ids, which is
also where the search radius comes from: wide enough for the share `reach` of the true neighbours in the sample. Every
vector is indexed. A code is split into 16-bit substrings, each with an index of its own; by the pigeonhole
principle a code within the radius of a query's agrees with it, in some substring, up to that substring's share of the
radius. Probing those buckets retrieves every code within the radius; their vectors are then ranked by
inner product in double precision.

Index blocks hold at most about `block_rows` vectors, query groups `group_queries` queries; each task searches one
block for one group, and widens the radius for a query that has not found k vectors, so results are never short.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than the
commonest one (the larger of equally common ones) take no part, nor do rows without vec_id; of rows that repeat a vec_id
the smallest vector counts. Ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm.common import shuffled_order, stored

PIECE = 16


@dataclass(frozen=True)
class Search:
    k: int = 20
    bits: int = 256
    sample: int = 8000
    reach: float = 0.97
    rounds: int = 15
    block_rows: int = 16384
    group_queries: int = 1024


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    rotations: list[np.ndarray]
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit words, one column a substring."""
        signs = np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], 1)
        return np.packbits(signs, axis=1).view(np.uint16)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & ~zero).select(F.col("vec_id").cast("long"), v.alias("v"))
    one = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return one.join(F.broadcast(lengths.select("d")), F.size("v") == F.col("d")).drop("d")  # one row


def learn(vectors: DataFrame, s: Search) -> Codes | None:
    rows = vectors.withColumn("__o", shuffled_order(F.col("vec_id"))).orderBy("__o", "vec_id").limit(s.sample).select("v").toPandas()
    if rows.empty:
        return None
    x = np.stack(rows["v"].to_numpy())
    mean = x.mean(0)
    c = x - mean
    dims = x.shape[1]
    _, axes = np.linalg.eigh(c.T @ c)
    rng, rotations = np.random.default_rng(4), []
    width = max(PIECE, -(-dims // PIECE) * PIECE)
    projected = c @ axes
    while sum(r.shape[1] for r in rotations) < s.bits:
        r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(s.rounds):  # alternate between codes and the rotation nearest to them
            b = np.sign(projected @ r)
            u, _, w = np.linalg.svd(projected.T @ b)
            r = u @ w
        r = axes @ r
        rotations.append(np.concatenate([r, rng.standard_normal((dims, width - dims))], 1) if width > dims else r)
    codes = Codes(mean, rotations, 0)
    words = codes.encode(x)
    far = []
    for i in range(min(300, len(x))):
        near = np.argsort(-(x @ x[i]), kind="stable")[1 : s.k + 1]
        far.append(np.bitwise_count(words[near] ^ words[i]).sum(1))
    distances = np.concatenate(far) if far else np.zeros(1)
    radius = int(np.quantile(distances, s.reach)) if len(distances) else words.shape[1] * PIECE
    return Codes(mean, rotations, radius)


def _masks(radius: int) -> np.ndarray:
    """All 16-bit words with at most `radius` bits set."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(PIECE), r)]
    return np.array(out, np.uint16)


class Index:
    """The substring indexes of one block: for every substring its values, sorted, and the rows that hold them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.order = [np.argsort(w, kind="stable") for w in words.T]
        self.values, self.begins = [], []
        for w, o in zip(words.T, self.order, strict=True):
            values, begins = np.unique(w[o], return_index=True)
            self.values.append(values)
            self.begins.append(np.append(begins, len(o)))
        self.masks: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius. Radii of the substrings add up to radius - (substrings - 1): one
        that exceeds its share everywhere would be too far in all."""
        pieces = len(code)
        base, more = divmod(radius, pieces)
        seen = np.zeros(len(self.words), bool)
        for j in range(pieces):
            r = min(PIECE, base if j <= more else base - 1)
            if r < 0:
                continue
            values, begins, order = self.values[j], self.begins[j], self.order[j]
            if r not in self.masks and r <= 4:
                self.masks[r] = _masks(r)
            if r in self.masks and len(self.masks[r]) < len(values):
                probes = self.masks[r] ^ code[j]
                at = np.searchsorted(values, probes)
                hit = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
            else:  # more probes than buckets: test the buckets instead
                hit = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= r)
            n = begins[hit + 1] - begins[hit]
            ends = np.cumsum(n)
            if len(ends):
                seen[order[np.repeat(begins[hit] - (ends - n), n) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.words[rows] ^ code).sum(1) <= radius]


def _searched(block: pd.DataFrame, queries: pd.DataFrame, codes: Codes, k: int) -> pd.DataFrame:
    names = ["query_id", "vec_id", "score"]
    if block.empty or queries.empty:
        return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    ids, x = block["vec_id"].to_numpy(np.int64), np.stack(block["v"].to_numpy())
    own, q = queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_numpy())
    index, words = Index(codes.encode(x)), codes.encode(q)
    pieces = words.shape[1]
    out = []
    for i in range(len(q)):
        radius = codes.radius
        while True:
            rows = index.within(words[i], radius)
            rows = rows[ids[rows] != own[i]]
            if len(rows) >= k or radius >= pieces * PIECE:
                break
            radius += 2 * pieces
        score = (x[rows] * q[i]).sum(1)
        best = np.lexsort((ids[rows], -score))[:k]
        out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[rows[best]], "score": score[best]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, is_query: Column, s: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` nearest found for every vector with `is_query`, all others being candidates."""
    schema = "query_id long, vec_id long, score double"
    good = stored(usable(vectors), "search-vectors")
    codes = learn(good, s)
    spark = vectors.sparkSession
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = good.where(is_query)
    blocks, groups = (max(1, -(-n // size)) for n, size in ((good.count(), s.block_rows), (asked.count(), s.group_queries)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        part = F.pmod(shuffled_order(F.col("vec_id")), F.lit(n)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(good, "block", blocks, "group", groups).groupBy("block", "group")
    right = dealt(asked, "group", groups, "block", blocks).groupBy("block", "group")
    found = left.cogroup(right).applyInPandas(lambda b, q: _searched(b, q, codes, s.k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, s: Search = Search()) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0, s)
