"""Periodic runs of words: maximal pairs in the LCP-interval tree of every document.

A run is a stretch of words with smallest period q and length of at least max(`length`, `exponent` * q) that no neighbouring
word extends. Words i < j that begin equal stretches of L words, with different words before and after them (a maximal pair),
make the stretch [i, j + L) with period j - i, and nothing extends it. So the maximal pairs whose distance is at most
L / (exponent - 1) are the runs themselves, each also at multiples of its smallest period, of which the smallest is kept.

Pairs are found bottom-up: the words of a batch of documents, set apart by marks of their own, are named by order
(three words at once, then by doubling where suffixes still tie); the tree has an interval for every stretch of L words that
occurs twice in a document, and its positions are held in sorted lists by the word to their left. Where two children
meet, each position of the smaller looks for partners within reach in the other classes of the larger, then joins it.
Stretches shorter than any run could leave are never put in the tree.

No row meets another: there is no shuffle. A task holds one batch of about `BATCH_WORDS` words, or one longer text.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; repeated rows give repeated equal
results, ties between runs go to the smaller start, then period; very long texts are a batch of their own. Columns besides
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import words

BATCH_WORDS = 1 << 19


@dataclass(frozen=True)
class RunLimits:
    length: int = 6
    exponent: int = 4

    @property
    def least(self) -> int:
        """The fewest words that a pair of a run can share."""
        return min(max(self.length - q, (self.exponent - 1) * q) for q in range(1, self.length + 1))


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names in the order of the keys, and the stable order itself."""
    order = np.argsort(key, kind="stable")
    shown = key[order]
    fresh = np.empty(len(key), bool)
    fresh[:1] = True
    np.not_equal(shown[1:], shown[:-1], out=fresh[1:])
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(fresh) - 1
    return names, order


def _firsts(flags: np.ndarray) -> np.ndarray:
    """Per place the index of the last flag at or before it."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def _suffix_groups(seq: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share their first `least` words with another of their document, in the order of their suffixes,
    and flags where a group of equal beginnings starts. Every document of `seq` ends with a word found nowhere else."""
    size = len(seq)
    padded = np.concatenate([seq, seq.max() + 1 + np.arange(least)])
    names, order, reach = padded, None, 1
    bits = max(1, int(padded.max()).bit_length())
    if 3 * bits <= 62 and least >= 3:
        key = (padded[:-2] << 2 * bits) | (padded[1:-1] << bits) | padded[2:]
        names, order = _named(key)
        reach = 3
    while reach < least:
        step = min(reach, least - reach)
        bits = max(1, int(names.max()).bit_length())
        names, order = _named((names[:-step] << bits) | names[step:])
        reach += step
    if order is None:
        names, order = _named(names)
    order = order[order < size]
    same = (names[order[1:]] == names[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    fresh = np.concatenate([[True], ~same])
    place = np.empty(size, np.int64)  # where a suffix stands, or the first of those it ties with
    place[order] = _firsts(fresh)
    in_group = ~fresh | np.concatenate([~fresh[1:], [False]])
    chosen, starts = np.flatnonzero(in_group), fresh[in_group]
    where, tied, far = order.copy(), order[chosen], least
    while len(tied):
        first, then = place[tied], place[tied + far]
        by = np.argsort(first * size + then, kind="stable")
        tied, first, then = tied[by], first[by], then[by]
        old = np.concatenate([[True], first[1:] != first[:-1]])
        new = old | np.concatenate([[True], then[1:] != then[:-1]])
        begin = first - _firsts(old)
        where[begin + np.arange(len(tied))] = tied
        place[tied] = begin + _firsts(new)
        alone = new & np.concatenate([new[1:], [True]])
        tied, far = tied[~alone], far * 2
    return where[chosen], starts


def _shared(seq: list[int], suffixes: list[int], starts: list[bool], least: int) -> list[int]:
    """Words that a suffix shares with the one before it in its group (0 for the first), by positions in text order."""
    before = {p: (k, -1 if starts[k] else suffixes[k - 1]) for k, p in enumerate(suffixes)}
    out, last, held = [0] * len(suffixes), -2, least
    for i in sorted(before):
        k, j = before[i]
        if j < 0:
            continue
        held = max(held - 1, least) if last == i - 1 else least
        while seq[i + held] == seq[j + held]:
            held += 1
        out[k], last = held, i
    return out


class _Node:
    """Positions below an interval: all in order, and by the word to their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def _joined(a: _Node, b: _Node, shared: int, exponent: int, left: list[int], found: dict) -> _Node:
    """Both children in one, after the pairs between them; pairs share exactly `shared` words."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = shared // (exponent - 1)

    def pair(x: int, y: int) -> None:
        i, j = (x, y) if x < y else (y, x)
        key = i, j + shared
        found[key] = min(found.get(key, j - i), j - i)

    for kind, places in b.classes.items():
        for x in places:
            lo, hi = bisect_left(a.places, x - reach), bisect_right(a.places, x + reach)
            if hi - lo <= len(a.classes):
                for y in a.places[lo:hi]:
                    if left[y] != kind:
                        pair(x, y)
            else:
                for other, ys in a.classes.items():
                    if other != kind:
                        for y in ys[bisect_left(ys, x - reach) : bisect_right(ys, x + reach)]:
                            pair(x, y)
    for kind, places in b.classes.items():
        mine = a.classes.setdefault(kind, [])
        for x in places:
            insort(mine, x)
            insort(a.places, x)
    return a


def _tree_pairs(suffixes: list[int], shared: list[int], exponent: int, left: list[int], found: dict) -> None:
    """The intervals of one group, closed bottom-up with a stack of (shared words, what lies left in the interval)."""
    stack: list[tuple[int, _Node]] = []
    now = _Node(suffixes[0], left[suffixes[0]])
    for place, depth in zip(suffixes[1:], shared[1:], strict=True):
        while stack and stack[-1][0] > depth:
            at, node = stack.pop()
            now = _joined(node, now, at, exponent, left, found)
        if stack and stack[-1][0] == depth:
            now = _joined(stack.pop()[1], now, depth, exponent, left, found)
        stack.append((depth, now))
        now = _Node(place, left[place])
    while stack:
        at, node = stack.pop()
        now = _joined(node, now, at, exponent, left, found)


def find_runs(texts: list[list[str]], limits: RunLimits = RunLimits()) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers = defaultdict(count().__next__)
    parts = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    marks = len(numbers) + np.arange(len(texts) + 1)
    # A mark before the first text and after every text: no stretch crosses it, and it is the left word of the first.
    seq = np.concatenate([marks[:1], *[x for p, m in zip(parts, marks[1:], strict=True) for x in (p, [m])]]).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)]).astype(np.int64)
    suffixes, starts = _suffix_groups(seq, owner, limits.least)
    if not len(suffixes):
        return out
    shown = seq.tolist()
    shared = _shared(shown, suffixes.tolist(), starts.tolist(), limits.least)
    left = [-1, *shown[:-1]]
    begins = np.flatnonzero(starts)
    ends = [*begins[1:].tolist(), len(suffixes)]
    deepest = np.maximum.reduceat(np.array(shared), begins)
    # Groups without two positions near enough to each other for their deepest interval hold no run.
    by = np.lexsort((suffixes, np.cumsum(starts)))
    gaps = np.diff(suffixes[by], prepend=0)
    gaps[begins] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gaps, begins) <= deepest // (limits.exponent - 1)
    begin_of = np.concatenate([[0], np.cumsum(lengths)])[:-1] + 1
    found: list[dict] = [{} for _ in texts]
    for a, b, worth in zip(begins.tolist(), ends, near.tolist(), strict=True):
        if worth:
            places = suffixes[a:b].tolist()
            _tree_pairs(places, shared[a:b], limits.exponent, left, found[int(owner[places[0]])])
    for k, pairs in enumerate(found):
        first = int(begin_of[k])
        runs = ((s - first, e - s, q) for (s, e), q in pairs.items() if e - s >= limits.length)
        out[k] = sorted(runs, key=lambda r: (r[0], r[2]))
    return out


def collapsed(text: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, with one blank between them."""
    if not runs:
        return " ".join(text)
    change = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([w for w, gone in zip(text, np.cumsum(change).tolist()) if not gone])


_WORD = re.compile(r"[^ \t-\r]+")
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def found(docs: DataFrame, limits: RunLimits = RunLimits()) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period) and collapsed (text without the repeats)."""
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def emit(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        runs = find_runs(texts, limits)
        rows = [ids, list(map(len, texts)), runs, list(map(collapsed, texts, runs))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds.types)], schema=kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(*batch.columns, strict=True):
                ids.append(i.as_py())
                texts.append(_WORD.findall(text.as_py() or ""))
                held += len(texts[-1]) + 1
                if held >= BATCH_WORDS:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield emit(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(work, _SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its own words up to its end: from word a = g % n on, word
    i is the one at a + (i - a) % p. The crc32 of doc_id decides."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = docs.select(F.col("doc_id"), F.col("text"), (h % 10 == 0).alias("__loop"), F.floor(h / 10).cast("long").alias("__g"))
    rows = rows.withColumn("__words", F.when(F.col("__loop"), words(F.col("text"))))
    n = F.size("__words").cast("long")
    a = (F.col("__g") % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("__g") % 8))).cast("int")
    rows = rows.withColumns({"__a": a, "__p": p, "__n": n.cast("int")})
    cycle = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")
    made = F.slice(F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(cycle, times))), F.lit(1), F.col("__n"))
    text = F.when(F.col("__loop") & (F.col("__n") > 0), F.array_join(made, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Figures of `found` over the looped documents: the longest run, and digests of all runs and of the collapsed text."""
    rows = found(looped(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("__best", best)
    length, period = F.col("__best.l"), -F.col("__best.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
