"""Token files compressed by Re-Pair grammars, with random access to documents.

Documents are dealt out by ranges of doc_id; every task encodes its documents in order and closes a block (a shard of
the grammar) after `block_tokens` ids. In a block, pairs of ids are replaced by nonterminals, the most frequent
first and many a round, until no pair occurs twice; the block keeps its rules, the expansion length of every rule, the sequence and where each
document begins in it. Nonterminals never span the end id, so a document is decoded from its own part of the sequence.

The file format is Parquet with one row a block, written by Spark's own writer: a lost executor only repeats its task.

    part, block      place in the order of documents: ascending (part, block), then position in the lists
    doc_ids          array<long>, ascending, null first
    starts           array<long>, where each document begins in the sequence of symbols
    lengths          array<long>, ids of each document, with its end id
    rules            little-endian uint32 pairs; rule i is symbol `first_rule` + i
    expansions       little-endian uint32, ids that a rule expands to
    sequence         little-endian symbols of `width` bytes

Defined results: null text is empty (its end id only); repeated rows are documents of their own, ordered by text among
equal doc_ids; a null doc_id comes first; an empty table gives no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm import tokens
from streamloom.llm.common import batches
from streamloom.session import checkpoint_dir

END_ID = 0
#: Documents that are handed to Python at once, and characters that are encoded at once.
BATCH_ROWS = 2_000
_BATCH_CHARS = 1 << 23


@dataclass(frozen=True)
class Grammar:
    first_rule: int
    rules: np.ndarray
    expansions: np.ndarray
    sequence: np.ndarray


def _grouped_pairs(at: np.ndarray, a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (ascending) of pairs without END_ID that occur more than once, equal pairs together and ascending; the sizes of
    these groups, and their pairs (the first symbol 32 bits up)."""
    bits, places = int(top).bit_length(), int(at.max(initial=0)).bit_length()
    if 2 * bits + places < 64:  # one sort of plain integers
        key = a.astype(np.int64)
        key <<= bits
        key |= b
        key <<= places
        key |= at
        key.sort()
        at, key = key, key >> places
    else:
        bits, places, key = 32, 32, (a.astype(np.int64) << 32) | b
        order = np.lexsort((at, key))
        at, key = at[order].astype(np.int64), key[order]
    edge = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=edge[1:-1])
    edge = np.flatnonzero(edge) if len(key) else np.zeros(1, np.int64)
    begins, sizes = edge[:-1], np.diff(edge)
    often = np.flatnonzero(sizes > 1)
    pair = key[begins[often]]
    a, b = pair >> bits, pair & ((1 << bits) - 1)
    inside = (a != END_ID) & (b != END_ID)
    often = often[inside]
    found = at[_ranges(begins[often], sizes[often])] & ((1 << places) - 1)
    return found.astype(np.int32), sizes[often], a[inside] << 32 | b[inside]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(sizes.sum()) + np.repeat(begins - (ends - sizes), sizes)


def _settled(at: np.ndarray, which: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are replaced, and their ranks: of places (ascending) that overlap the one of smaller rank stays."""
    linked = behind[at[:-1]] == at[1:]
    won = []
    while len(at):
        down = which[:-1] < which[1:]
        wins, beaten = np.ones(len(at), bool), np.zeros(len(at), bool)
        wins[:-1] &= ~linked | down
        wins[1:] &= ~(linked & down)
        won.append((at[wins], which[wins]))
        beaten[:-1] |= linked & wins[1:]
        beaten[1:] |= linked & wins[:-1]
        still = np.flatnonzero(~(wins | beaten))
        linked = linked[still[:-1]] & (np.diff(still) == 1)
        at, which = at[still], which[still]
    places, ranks = zip(*won, strict=True)
    return np.concatenate(places), np.concatenate(ranks)


_NONE = np.int32(np.iinfo(np.int32).max)


def compress(ids: np.ndarray, first_rule: int, least: int = 2) -> Grammar:
    """Re-Pair until no pair occurs `least` (2 or more) times without overlap; pairs with END_ID are left alone.

    A round takes all pairs above a bound that falls by half each round, down to `least`, by exact counts. Where chosen
    pairs overlap the more frequent one stays; a pair left with too few places waits for the next round. The most
    frequent pair always keeps all its places, so every round makes a rule.

    Symbols keep their places, linked to the ones before and behind. Pairs are grouped once, when a round makes them: they
    hold a symbol of that round, so no later round adds to their groups. Sizes are counted down as pairs go, and the
    places of a group are only looked up when it is above the bound.
    """
    n = len(ids)
    seq = np.full(n + 2, END_ID, np.int32)  # a frame of one free place on both sides
    seq[1:-1] = ids
    behind, before = np.arange(1, n + 3, dtype=np.int32), np.arange(-1, n + 1, dtype=np.int32)
    live = np.ones(n + 2, bool)
    live[[0, -1]] = False
    group = np.full(n + 2, _NONE)
    # Places of the groups, one behind the other; a replacement makes two pairs at most.
    places, used = np.empty(3 * n, np.int32), 0
    begins, pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # present and first number of places
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(1, np.int64)
    top, bound, new = first_rule, n, np.arange(1, n, dtype=np.int32)
    while True:
        found, count, made = _grouped_pairs(new, seq[new], seq[behind[new]], top)
        group[found] = np.repeat(np.arange(len(sizes), len(sizes) + len(count), dtype=np.int32), count)
        places[used : used + len(found)] = found
        begins, pairs = np.concatenate([begins, used + np.cumsum(count) - count]), np.concatenate([pairs, made])
        sizes, counts = np.concatenate([sizes, count]), np.concatenate([counts, count])
        used, new = used + len(found), new[:0]
        best = int(sizes.max(initial=0))
        if best < least:
            break
        bound = max(least, min(bound, best) // 2)
        picked = np.flatnonzero(sizes >= bound)
        count = counts[picked]
        made = np.stack([pairs[picked] >> 32, pairs[picked] & 0xFFFFFFFF], 1)
        of = np.repeat(np.arange(len(picked), dtype=np.int32), count)
        at = places[_ranges(begins[picked], count)]
        stay = np.flatnonzero(group[at] == np.repeat(picked.astype(np.int32), count))
        at, of, size = at[stay], of[stay], sizes[picked]
        twin = made[:, 0] == made[:, 1]
        if twin.any():
            # Of occurrences that overlap, every second one counts.
            some = np.flatnonzero(twin[of])
            own, there = of[some], at[some]
            fresh = np.ones(len(some), bool)
            fresh[1:] = (behind[there[:-1]] != there[1:]) | (own[1:] != own[:-1])
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            odd = np.ones(len(at), bool)
            odd[some] = (np.arange(len(some)) - run) % 2 == 0
            at, of = at[odd], of[odd]
            size = np.bincount(of, minlength=len(picked))
            sizes[picked[size < least]] = 0
        chosen = np.flatnonzero(size >= bound)
        if not len(chosen):
            continue
        made = made[chosen]
        # Equally frequent pairs in a scattered order: by value, a repeated passage would be eaten from one end.
        mixed = (made[:, 0] * 2654435761 + made[:, 1] * 2246822519) * 0x9E3779B97F4A7C1 >> 20
        order = np.lexsort((mixed, -size[chosen]))
        chosen, made = chosen[order], made[order]
        place = np.full(len(picked), _NONE)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        which = place[of]
        keep = np.flatnonzero(which != _NONE)
        ordered = np.sort(at[keep].astype(np.int64) << 32 | which[keep])
        at, which = _settled((ordered >> 32).astype(np.int32), ordered.astype(np.int32), behind)
        good = np.bincount(which, minlength=len(chosen)) >= max(least, bound // 2)
        keep = good[which]
        at, which, made = at[keep], which[keep], made[good]
        rules.append(made)
        lengths = np.concatenate([lengths, lengths[np.maximum(made - first_rule + 1, 0)].sum(1)])
        gone = behind[at]
        after = behind[gone]
        seq[at] = (top + np.cumsum(good) - 1).astype(np.int32)[which]
        live[gone] = False
        behind[at], before[after] = after, at
        left = before[at]
        new = np.concatenate([at, left[seq[left] < top]])
        lost = np.concatenate([gone, new])
        held = group[lost]
        sizes -= np.bincount(held[held != _NONE], minlength=len(sizes))
        group[lost] = _NONE
        top += len(made)
    return Grammar(first_rule, np.concatenate(rules), lengths[1:], seq[live].astype(np.uint32))


def expand(symbols: np.ndarray, g: Grammar) -> np.ndarray:
    """The ids of a part of the sequence: every symbol writes its id, or hands its place to the two of its rule."""
    first = g.first_rule
    sizes = np.r_[1, g.expansions]
    rules = g.rules.astype(np.int64)
    inside = sizes[np.maximum(rules[:, 0] - first + 1, 0)]  # ids of a rule's first symbol
    symbols = symbols.astype(np.int64)
    own = sizes[np.maximum(symbols - first + 1, 0)]
    at = np.cumsum(own) - own
    out = np.empty(int(own.sum()), "<u4")
    while len(symbols):
        out[at] = symbols  # a rule's place is taken by its symbols later
        made = np.flatnonzero(symbols >= first)
        rule, begin = symbols[made] - first, at[made]
        at, symbols = np.empty(2 * len(made), np.int64), rules[rule].ravel()
        at[0::2], at[1::2] = begin, begin + inside[rule]
    return out


_SCHEMA = (
    "part int, block int, doc_ids array<long>, starts array<long>, lengths array<long>, first_rule int, rules binary, "
    "expansions binary, width int, sequence binary"
)


def _batches(frame: pd.DataFrame) -> Iterator[tuple[list, list[str | None]]]:
    """Some doc_ids together, and their texts."""
    names, texts, size = [], [], 0
    for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
        names.append(None if pd.isna(doc) else int(doc))
        texts.append(text)
        size += len(text or "")
        if size >= _BATCH_CHARS:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def _block(part: int, block: int, docs: list, lengths: list[int], ids: np.ndarray, first_rule: int) -> tuple:
    g = compress(ids, first_rule)
    sizes = np.ones(len(g.sequence), np.int64)
    made = g.sequence >= first_rule
    sizes[made] = g.expansions[g.sequence[made] - first_rule]
    begins = np.cumsum(sizes) - sizes
    starts = np.searchsorted(begins, np.cumsum([0, *lengths[:-1]]))
    width = 2 if first_rule + len(g.rules) <= 1 << 16 else 4
    return (
        part,
        block,
        docs,
        starts.tolist(),
        lengths,
        first_rule,
        g.rules.astype("<u4").tobytes(),
        g.expansions.astype("<u4").tobytes(),
        width,
        g.sequence.astype(f"<u{width}").tobytes(),
    )


def blocks(docs: DataFrame, vocabulary: str, block_tokens: int = 1 << 20) -> DataFrame:
    """One row a block, in ascending doc_id over (part, block)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(vocabulary)
        first_rule = encoder.tokenizer.get_vocab_size()
        part, block = TaskContext.get().partitionId(), 0
        docs, sizes, ids, size = [], [], [], 0

        def closed() -> pd.DataFrame:
            row = _block(part, block, docs, sizes, np.concatenate(ids), first_rule)
            return pd.DataFrame([row], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

        for frame in frames:
            for names, texts in _batches(frame):
                found, lengths = encoder.batch(texts)
                ends = np.cumsum(lengths + 1)
                found = np.insert(found, np.cumsum(lengths), END_ID)
                begin = start = 0
                while begin < len(names):
                    # The document that fills the block is its last one.
                    end = min(int(np.searchsorted(ends, block_tokens - size + start)) + 1, len(names))
                    stop = int(ends[end - 1])
                    docs += names[begin:end]
                    sizes += (lengths[begin:end] + 1).tolist()
                    ids.append(found[start:stop])
                    size += stop - start
                    begin, start = end, stop
                    if size >= block_tokens:
                        yield closed()
                        docs, sizes, ids, size, block = [], [], [], 0, block + 1
        if docs:
            yield closed()

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = slim.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return ranged.mapInPandas(encode, _SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> str:
    with batches(docs.sparkSession, BATCH_ROWS):
        blocks(docs, vocabulary or tokens.vocabulary("byte_bpe_50k.json")).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    files = spark.read.schema(_SCHEMA).parquet(path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                rules = np.frombuffer(row.rules, "<u4").astype(np.int64).reshape(-1, 2)
                g = Grammar(row.first_rule, rules, np.frombuffer(row.expansions, "<u4").astype(np.int64), np.frombuffer(row.sequence, f"<u{row.width}"))
                ids = memoryview(expand(g.sequence, g)).cast("B")
                ends = 4 * np.cumsum(row.lengths)
                begins = ends - 4 * np.asarray(row.lengths)
                yield pd.DataFrame(
                    {
                        "part": row.part,
                        "block": row.block,
                        "doc_id": pd.array([None if d is None or pd.isna(d) else int(d) for d in row.doc_ids], "Int64"),
                        "inside": begins // 4,
                        "n_tokens": np.asarray(row.lengths),
                        "ids_crc32": [zlib.crc32(ids[s:e]) for s, e in zip(begins, ends, strict=True)],
                    }
                )

    rows = files.mapInPandas(decode, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("p0"))  # a row per written part
    starts = sizes.withColumn("b0", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "part")
    return rows.join(starts.select("part", "block", (F.col("p0") + F.col("b0")).alias("__b")), ["part", "block"]).select(
        "doc_id", (F.col("__b") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Random access: the ids of one document, expanding only its own part of the sequence."""
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    row = spark.read.schema(_SCHEMA).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select(
        "first_rule", "rules", "expansions", "width", "sequence", (at - 1).alias("at"), "starts"
    ).first()
    seq = np.frombuffer(row["sequence"], f"<u{row['width']}")
    stops = [*row["starts"][1:], len(seq)]
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    g = Grammar(row["first_rule"], rules, np.frombuffer(row["expansions"], "<u4").astype(np.int64), seq)
    return expand(seq[row["starts"][row["at"]] : stops[row["at"]]], g).tolist()


def report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read(spark, write(docs, path))
