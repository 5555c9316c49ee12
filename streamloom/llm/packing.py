"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

Lengths are integers from 1 to the capacity, so the packing of any number of pieces is planned on at most `capacity`
counts: pieces above one third of the capacity are paired, largest first with the largest partner that still fits (a bin
holds at most two of them); smaller ones go, largest first, to the tightest gap. All pieces of one length are placed in
bulk, so the plan's size depends on the capacity alone; Spark then deals the pieces to their places by their rank
among the pieces of their length.

Defined results: null text is empty and still has its end id, so every row gives at least one piece; repeated rows are
packed each on their own; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm import tokens
from streamloom.llm.common import ranked, shuffled_order, stored

CAPACITY = 4096
END_ID = 1
#: Documents that a Python worker holds at once.
BATCH_ROWS = 1_000


@dataclass(frozen=True)
class Placements:
    """Where the pieces of a length go: ranks from `lo` on fill bins from `bin` on, `each` to a bin, from `offset` on."""

    size: np.ndarray
    lo: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.size << 46) + self.lo
        at = np.searchsorted(key, (size << 46) + rank, "right") - 1
        past = rank - self.lo[at]
        return self.bin[at] + past // self.each[at], self.offset[at] + past % self.each[at] * size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Placements:
    """Placements for `counts` pieces of each length."""
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups of bins (first, number)
    bins = 0

    def place(size: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((size, used[size], first, each, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in counts if 3 * s > capacity and counts[s])
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at < 0:
            n = left[size]
            place(size, n, bins, 1, 0)
            filled = size
        elif (other := large[at]) == size and left[size] == 1:
            at -= 1
            other = large[at] if at >= 0 else 0
            n = 1
            place(size, 1, bins, 1, 0)
            if other:
                place(other, 1, bins, 1, size)
            filled = size + other
        elif other == size:
            n = left[size] // 2
            place(size, 2 * n, bins, 2, 0)
            filled = 2 * size
        else:
            n = min(left[size], left[other])
            place(size, n, bins, 1, 0)
            place(other, n, bins, 1, size)
            filled = size + other
        if filled < capacity:
            gaps.setdefault(capacity - filled, []).append((bins, n))
        bins += n
        large = [s for s in large if left[s]] if not left[size] or (at >= 0 and not left[other]) else large

    open_gaps = sorted(gaps)
    for size in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                gap, (first, n) = capacity, (bins, -(-left[size] // (capacity // size)))
                bins += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            each = gap // size
            full = min(n, left[size] // each)
            parts = [(first, full, each)]
            if full < n and left[size] % each and left[size] - full * each < each:
                parts.append((first + full, 1, left[size] - full * each))
            for begin, many, per in parts:
                if many:
                    place(size, many * per, begin, per, capacity - gap)
            for begin, many, per in (*parts, (first + sum(p[1] for p in parts), n - sum(p[1] for p in parts), 0)):
                rest = gap - per * size
                if many and rest:
                    if rest not in gaps:
                        bisect.insort(open_gaps, rest)
                    gaps.setdefault(rest, []).append((begin, many))
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Placements(*cols, bins)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the encoded documents; only those above the capacity are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(vocabulary)
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = encoder(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            table = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield table.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(encode, schema)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of `pieces` (a stored table: it is read more than once)."""
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(histogram, capacity)  # at most `capacity` counts came to the driver
    ordered = cut.withColumn("__order", shuffled_order(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    rows = ranked(ordered, ["length"], "__order", ["doc_id", "piece"], rank="__rank", rows=sum(histogram.values()))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size, rank = frame["length"].to_numpy(np.int64), frame["__rank"].to_numpy(np.int64)
            found, offset = places.find(size, rank) if len(frame) else (rank, rank)
            yield frame.drop(columns=["__rank"]).assign(sequence_id=found, offset=offset)

    slim = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in assign(frames):
            yield frame.astype({"doc_id": "Int64"})

    return slim.mapInPandas(typed, schema)


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    cut = pieces(docs, vocabulary or tokens.vocabulary("word_bpe_49k.json"))
    return packed(stored(cut, "packing-pieces", batch_rows=BATCH_ROWS))
