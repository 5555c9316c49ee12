"""Removal of repeated byte passages with a distributed difference-cover suffix sort.

A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller doc_id.

1. Anchors. The smallest hashed k-gram of a window (its anchor) and the pair of the smallest and the largest depend on
   the window's bytes alone, so equal windows agree in both. Windows whose anchor, or then whose pair, is met in one
   document only are dropped: they occur nowhere else. Each takes one shuffle of a row per value and document; values
   met in several documents go into a Bloom filter of fixed size. Where a filter errs more text goes on to the next step,
   and the result is the same. Anchors beyond what one filter is good for are dealt out to parts, by their value; steps 1
   (its pairs) to 4 run part by part, each with filters of its own, and leave nothing on disk but the spans.
2. Stretches. Consecutive windows left with one anchor form a stretch of text, named by its anchor and a digest. Equal
   stretches take one another's windows by name alone, each from the smallest doc_id that holds it. Text is fetched only
   for anchors with different stretches (a third filter): equal ones become one row, before and after the shuffle, and
   are dealt out by anchor. An anchor with very many different stretches is not one block: its stretches are cut where the
   smallest gram under another hash changes, equal pieces become one row and are dealt out by that gram too, and so on, a
   few times. What is too much for a block then is compared by single windows, summed up before and after a shuffle by
   their bytes.
3. Suffix sort. In each bounded block of stretches, suffixes are sorted by the difference-cover method: positions not
   divisible by three are sorted by triples and named, the names are sorted by recursion until they tell apart `window`
   bytes, the remaining suffixes are sorted by their first byte and the rank behind it, and both are merged. Suffixes
   adjacent in this order whose first `window` bytes agree get the smallest doc_id of their run; it counts where it is
   below that of the stretch.
4. Windows whose smallest doc_id is below their own document's mark their bytes.

Defined results: null text is empty; a row with null doc_id loses nothing and takes nothing away; rows that repeat a
doc_id are one document for this purpose (they take nothing from one another) and each get a result; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import batches, removed
from streamloom.llm.common import stored as _table

#: Documents that a Python worker holds at once.
BATCH_ROWS = 1_000

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Passages:
    window: int = 50
    #: Bytes of a gram, 8 at least.
    gram: int = 16
    #: Bytes of stretches after which a block is sorted, and stretches of the longest kind whose bytes an anchor's different
    #: stretches have at most to stay together; with the longest stretch they keep a block below 2^_BITS bytes.
    block_bytes: int = 1 << 19
    together: int = 900
    #: Windows in one stretch at most (long runs of one anchor are cut), and bits of the filter, as powers of two.
    longest: int = 1024
    filter_bits: int = 27

    def beyond(self) -> int:
        """Bytes of different stretches that do not stay together."""
        return self.together * (self.longest + self.window - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MIX


def _named(gram: np.ndarray) -> np.ndarray:
    """Anchors by their grams: smallest hashes lie close together, anchors fill a filter evenly."""
    return _mixed(gram * _BASE)


def _gram_hashes(data: bytes, k: int) -> np.ndarray:
    """Hashes of all k-grams from the 8-byte words that cover them; their leading bits are mixed best."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) * _BASE
    words ^= words >> np.uint64(32)
    n = len(data) - k + 1
    out = words[:n]
    for at in range(8, k, 8):
        out = out * _BASE + words[min(at, k - 8) :][:n]
    return _mixed(out)


def _slide(x: np.ndarray, span: int, n: int, pick: np.ufunc) -> np.ndarray:
    """pick.reduce over each of the first n runs of `span` values, by doubling."""
    size = 1
    while size * 2 <= span:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[span - size : span - size + n])


def _begins(*values: np.ndarray) -> np.ndarray:
    """Places from which on one of the values is another than before, the first included."""
    new = np.zeros(len(values[0]), bool)
    new[:1] = True
    for x in values:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


@dataclass(frozen=True)
class _Joined:
    """Texts one behind the other, worked on as one array. A window has the number of the byte it begins at; `begins` and
    `stops` bound the windows of the texts (`number`) that have any. Windows that reach into the next text are in no run."""

    data: bytes
    offsets: np.ndarray
    number: np.ndarray
    begins: np.ndarray
    stops: np.ndarray
    grams: np.ndarray

    @classmethod
    def make(cls, texts: list[bytes], p: Passages) -> "_Joined":
        sizes = np.array([len(x) for x in texts], np.int64)
        offsets = np.cumsum(sizes) - sizes
        number, data = np.flatnonzero(sizes >= p.window), b"".join(texts)
        begins, stops = offsets[number], (offsets + sizes)[number] - p.window + 1
        return cls(data, offsets, number, begins, stops, _gram_hashes(data, p.gram) if len(number) else np.zeros(0, np.uint64))

    def picked(self, p: Passages, pick: np.ufunc) -> np.ndarray:
        """The smallest or largest hash of the grams of every window."""
        return _slide(self.grams, p.window - p.gram + 1, len(self.data) - p.window + 1, pick) if len(self.number) else self.grams

    def runs(self, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, the one behind the last, and text of the runs of windows with equal values."""
        new = np.zeros(len(values[0]) + 1, bool)
        for x in values:
            new[1:-1] |= x[1:] != x[:-1]
        new[self.begins] = new[self.stops] = True
        at = np.flatnonzero(new)
        low = np.searchsorted(at, self.begins)
        count = np.searchsorted(at, self.stops) - low
        i = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        return at[i], at[i + 1], np.repeat(self.number, count)

    def anchors(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and text of the runs of windows with one anchor."""
        low = self.picked(p, np.minimum)
        at, _, of = self.runs(low)
        return _named(low[at]), of

    def pairs(self, p: Passages, passes) -> tuple[np.ndarray, ...]:
        """First window, the one behind the last, text, anchor and pair of the runs of windows with one pair, where the anchor
        passes."""
        low, high = self.picked(p, np.minimum), self.picked(p, np.maximum)
        at, stop, of = self.runs(low, high)
        anchor = _named(low[at])
        new = _begins(anchor, of)
        ok = np.repeat(passes(anchor[new]), np.diff(np.append(new, len(anchor))))
        at, stop, of, anchor = at[ok], stop[ok], of[ok], anchor[ok]
        return at, stop, of, anchor, _mixed((anchor * _BASE) ^ high[at])


def _digests(grams: np.ndarray, k: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of the `size` bytes from `first` on, each: a chain over the hashes of the k-grams that cover them one behind the
    other, the last one ending with them. All stretches take a step together, the longest go on."""
    order = np.argsort(-size)
    begin, short = first[order], -size[order]
    last, x = begin - short - k, (-short).astype(np.uint64) * _MIX
    n, step = len(x), 0
    while n:
        x[:n] = _mixed(x[:n] * _BASE + grams[np.minimum(begin[:n] + step, last[:n])])
        step += k
        n = int(np.searchsorted(short, -step))
    out = np.empty_like(x)
    out[order] = x ^ (x >> np.uint64(32))
    return out


#: Bytes of texts that are worked on as one array.
_JOIN = 1 << 16


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows of some texts together, and the texts."""
    for frame in frames:
        texts, begin, size = [], 0, 0
        for i, text in enumerate(frame["text"]):
            texts.append(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
            size += len(texts[-1])
            if size >= _JOIN or i + 1 == len(frame):
                yield frame.iloc[begin : i + 1], texts
                texts, begin, size = [], i + 1, 0


# ---- difference-cover suffix sort of one block ------------------------------------------------------------------


_BITS = 21  # symbols and ranks of a block, so that three of them make one sortable number


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, their ranks (equal keys share one) from 1 on, and the number of ranks."""
    order = np.argsort(key)
    sorted_key = key[order]
    names = np.empty(len(key), np.int64)
    rank = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
    names[order] = rank
    return order, names, int(rank[-1])


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions of the numbers s (all > 0, below 2^_BITS, as is their count) sorted by their first `depth` symbols at least."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(6, np.int64)])
    # One more sample at n when n % 3 == 1 keeps the halves apart in the recursion.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    pairs = (t[:-1] << _BITS) | t[1:]
    triples = (pairs[:-1] << _BITS) | t[2:]
    order, names, count = _names(np.concatenate([triples[1 : n + (n % 3 == 1) : 3], triples[2:n:3]]))
    if count < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3))
    # Beyond the depth any order does, as long as it is one order.
    rank = np.zeros(n + 6, np.int64)
    ordered = sample[order]
    rank[ordered] = np.arange(1, len(sample) + 1)
    one = order < len(ones)
    if n % 3 == 1:
        inside = ordered < n
        order, ordered, one = order[inside], ordered[inside], one[inside]
    # A remaining suffix compares with samples of either kind by symbols and the rank behind them.
    one_key = lambda first: (t[first:n:3] << _BITS) | rank[first + 1 : n + 1 : 3]
    two_key = lambda first: (pairs[first:n:3] << _BITS) | rank[first + 2 : n + 2 : 3]
    key = one_key(0)
    rest = np.argsort(key)
    before = np.searchsorted(one_key(1)[order[one]], key[rest])
    before += np.searchsorted(two_key(2)[order[~one] - len(ones)], two_key(0)[rest])
    at = np.maximum.accumulate(before) + np.arange(len(rest))
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at] = rest * 3
    free[at] = False
    out[free] = ordered
    return out


def smaller_owners(texts: list[bytes], owners: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows (text, first, the one behind the last, owner) that are found in the block with a smaller owner than
    their text's, the smallest there."""
    # A separator per text that no byte equals; windows never reach across it.
    data = b"\0".join([*texts, bytes(window + 8)])
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbols = np.frombuffer(data, np.uint8)[:n].astype(np.int64) + 2
    symbols[ends - 1] = 1
    whole = np.repeat(ends - window, sizes) > np.arange(n)
    order = suffix_order(symbols, window)
    order = order[whole[order]]
    # Equal prefixes of adjacent suffixes, eight bytes at a time.
    words = np.ndarray(n + window, "<u8", data, strides=(1,)).copy()
    begins = np.ones(len(order), bool)
    begins[1:] = False
    for k in [*range(0, window - 8, 8), window - 8]:
        c = words[k : k + n].take(order)
        begins[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(begins)
    own = np.repeat(owners, sizes)
    best = own.copy()
    if len(begins):
        least = np.minimum.reduceat(own[order], begins)
        best[order] = np.repeat(least, np.diff(np.append(begins, len(order))))
    at = np.flatnonzero(best < own)
    new = _begins(at - np.arange(len(at)), best[at])
    first, last, of = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at, np.repeat(np.arange(len(texts)), sizes)
    text = of[first]
    offset = (ends - sizes)[text]
    return text, first - offset, last + 1 - offset, best[first]


# ---- the Spark job ------------------------------------------------------------------------------------------------


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that ends its step: the shuffles behind it are no longer needed."""
    return _table(df, f"passages-{name}", release=True)


#: Bits of a filter for a value that it is good for: beyond, the anchors are dealt out to parts.
_BITS_EACH = 6


def _in_part(value, part: int, parts: int):
    """Of the 40 bits of an anchor, alike in a column and an array; all bits count, so that a part fills all of a filter."""
    return value % 8191 % parts == part


def _anchor_passes(anchor: np.ndarray, bits: list, p: Passages, part: tuple[int, int]) -> np.ndarray:
    """Anchors of a part that pass all of the filters."""
    ok = np.ones(len(anchor), bool)
    if part[1] > 1:
        ok &= _in_part((anchor >> np.uint64(24)).astype(np.int64), *part)
    for b in bits:
        ok[ok] = _passes(b.value, anchor[ok], p)
    return ok


def _met(docs: DataFrame, p: Passages, anchor_bits=None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(value, doc_id) of the anchors of a document, or, given the filter of a part's anchors, of the pairs of windows that
    pass it.
    The 40 leading bits of the values do: what collides is only filtered less."""

    def values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of the texts, and the text of each, none twice."""
        joined = _Joined.make(texts, p)
        if anchor_bits is None:
            value, of = joined.anchors(p)
        else:
            *_, of, _, value = joined.pairs(p, lambda x: _anchor_passes(x, [anchor_bits], p, part))
        both = np.sort((of.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
        both = both[_begins(both)]
        return both & np.uint64((1 << 40) - 1), (both >> np.uint64(40)).astype(np.int64)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for rows, texts in _batches(frames):
            value, of = values(texts)
            found.append((value.view(np.int64), rows["doc_id"].to_numpy(np.int64)[of]))
            size += len(value)
            if size > 200_000:
                yield pd.DataFrame(dict(zip(("value", "doc_id"), map(np.concatenate, zip(*found)))))
                found, size = [], 0
        if found:
            yield pd.DataFrame(dict(zip(("value", "doc_id"), map(np.concatenate, zip(*found)))))

    return docs.mapInPandas(find, "value long, doc_id long")


#: 32-bit words of the filter that come to the driver as one value.
_CHUNK = 1 << 13


def _shared(met: DataFrame) -> DataFrame:
    """The values met in several documents."""
    shared = met.groupBy("value").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    return stored(shared.select("value"), "shared")


def _bits(shared: DataFrame, p: Passages) -> np.ndarray:
    """The filter that holds the values (40 bits) of `shared`: a table of 2^filter_bits bits, whatever the data."""
    cells = F.array(*[F.shiftright("value", k) % (1 << p.filter_bits) for k in (40 - p.filter_bits, 0)])
    bit = shared.select(F.explode(cells).alias("bit"))
    bit = bit.select(F.expr("CAST(bit DIV 32 AS INT)").alias("word"), F.expr("shiftleft(1L, CAST(bit % 32 AS INT))").alias("m"))
    words = bit.groupBy("word").agg(F.bit_or("m").alias("m")).withColumn("chunk", F.expr(f"CAST(word DIV {_CHUNK} AS INT)"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(_CHUNK, np.uint32)
        out[rows["word"].to_numpy(np.int64) % _CHUNK] = rows["m"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "bits": [out.tobytes()]})

    out = np.zeros(max(_CHUNK, 1 << (p.filter_bits - 5)), np.uint32)
    table = stored(words.groupBy("chunk").applyInPandas(packed, "chunk int, bits binary"), "bits")
    for r in table.toLocalIterator():
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["bits"], np.uint32)
    removed(table)
    return out


def _passes(bits: np.ndarray, value: np.ndarray, p: Passages) -> np.ndarray:
    h, ok = (value >> np.uint64(24)).astype(np.int64), np.ones(len(value), bool)
    for k in (40 - p.filter_bits, 0):
        at = (h >> k) & ((1 << p.filter_bits) - 1)
        ok &= (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
    return ok


def _stretches(docs: DataFrame, anchor_bits, pair_bits, p: Passages, text_bits=None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(anchor, digest, doc_id, version, first, windows) of the stretches of a part's anchors: 64 bits tell stretches of one
    anchor apart. Given the filter of the anchors whose text is wanted, (anchor, digest, doc_id, stretch) of theirs."""

    def passes(anchor: np.ndarray) -> np.ndarray:
        return _anchor_passes(anchor, [text_bits, anchor_bits] if text_bits is not None else [anchor_bits], p, part)

    def places(joined: _Joined) -> tuple[np.ndarray, ...]:
        """(anchor, first window, windows, text) of the stretches."""
        at, stop, of, anchor, pair = joined.pairs(p, passes)
        ok = _passes(pair_bits.value, pair, p)
        at, stop, of, anchor = at[ok], stop[ok], of[ok], anchor[ok]
        begins = np.append(_begins(np.cumsum(stop - at) - stop, anchor, of), len(at))
        first, of, anchor = at[begins[:-1]], of[begins[:-1]], anchor[begins[:-1]]
        windows = stop[begins[1:] - 1] - first
        parts = -(-windows // p.longest)
        i = np.repeat(np.arange(len(parts)), parts)
        inside = (np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)) * p.longest
        return anchor[i], first[i] + inside, np.minimum(windows[i] - inside, p.longest), of[i]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        more = p.window - 1
        out, size = [], 0
        for rows, texts in _batches(frames):
            joined = _Joined.make(texts, p)
            h, first, windows, of = places(joined)
            names = _digests(joined.grams, p.gram, first, windows + more)
            one = {"anchor": h.view(np.int64), "digest": names.view(np.int64), "doc_id": rows["doc_id"].to_numpy(np.int64)[of]}
            if text_bits is None:
                one["version"] = rows["version"].to_numpy(np.int32)[of]
                one |= {"first": (first - joined.offsets[of]).astype(np.int32), "windows": windows.astype(np.int32)}
                size += len(h) * 32
            else:
                parts = [joined.data[f:e] for f, e in zip(first.tolist(), (first + windows + more).tolist())]
                one["stretch"] = np.array(parts, object)
                size += sum(map(len, parts))
            out.append(one)
            if size > 8 << 20:
                yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in one})
                out, size = [], 0
        if out:
            yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})

    kind = "version int, first int, windows int" if text_bits is None else "stretch binary"
    return docs.mapInPandas(cut, f"anchor long, digest long, doc_id long, {kind}")


_RUNS = "anchor long, digest long, start int, stop int, least long"


def _sorted_blocks(rows: DataFrame, p: Passages) -> DataFrame:
    """(anchor, digest, start, stop, least): runs of windows of a stretch with their smallest doc_id, where it is below the
    smallest of the stretch. `rows` has the different stretches, (anchor, digest, stretch, least), and is not a join by
    anchor: behind one Spark takes the rows as dealt out by anchor already, and may make it a broadcast join later on."""

    names = ["anchor", "digest", "stretch", "least"]

    def solve(block: list[list[np.ndarray]]) -> pd.DataFrame:
        anchor, digest, stretch, owner = map(np.concatenate, zip(*block))
        text, start, stop, least = smaller_owners(stretch.tolist(), owner, p.window)
        return pd.DataFrame({"anchor": anchor[text], "digest": digest[text], "start": start, "stop": stop, "least": least})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size, last = [], 0, None
        for frame in frames:
            columns = [frame[c].to_numpy() for c in names]
            ends = np.cumsum([len(x) for x in columns[2]])
            before, new = np.append(0, ends), _begins(columns[0])
            if len(new) and columns[0][0] == last:
                new = new[1:]
            begin = 0
            # A block ends before the first new anchor that has enough bytes behind it.
            while (i := np.searchsorted(before[new], before[begin] + p.block_bytes - size)) < len(new):
                block.append([x[begin : new[i]] for x in columns])
                yield solve(block)
                block, size, begin = [], 0, int(new[i])
            if len(frame):
                block.append([x[begin:] for x in columns])
                size, last = size + int(before[-1] - before[begin]), columns[0][-1]
        if block:
            yield solve(block)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select(*names).mapInPandas(blocks, _RUNS)


#: Times that stretches are cut by another gram.
_LEVELS = 5


def _pieces(rows: DataFrame, p: Passages, level: int) -> DataFrame:
    """(anchor, digest, start, windows, key, name, piece, least): pieces of the stretches, in which the smallest gram under a
    hash of the level's own is the same; `key` is of that gram and the anchor, `name` of the piece."""
    salt = np.uint64(level * int(_BASE) % (1 << 64))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stretches, more = frame["stretch"].tolist(), p.window - 1
            for low in range(0, len(stretches), 1000):
                rows, texts = frame.iloc[low : low + 1000], stretches[low : low + 1000]
                joined = _Joined.make(texts, p)
                least = _slide(_mixed(joined.grams ^ salt), p.window - p.gram + 1, len(joined.data) - p.window + 1, np.minimum)
                at, stop, of = joined.runs(least)
                out = rows[["anchor", "digest", "least"]].iloc[of].reset_index(drop=True)
                out["start"], out["windows"] = (at - joined.offsets[of]).astype(np.int32), (stop - at).astype(np.int32)
                out["key"] = _mixed((out["anchor"].to_numpy().view(np.uint64) * _BASE) ^ least[at]).view(np.int64)
                out["name"] = _digests(joined.grams, p.gram, at, stop - at + more).view(np.int64)
                out["piece"] = [joined.data[f:e] for f, e in zip(at.tolist(), (stop + more).tolist())]
                yield out

    kinds = "anchor long, digest long, least long, start int, windows int, key long, name long, piece binary"
    return rows.select("anchor", "digest", "stretch", "least").mapInPandas(cut, kinds)


def _single_windows(rows: DataFrame, p: Passages) -> DataFrame:
    """The same for anchors with too many different stretches: by pieces of the stretches, and in the end window by window."""
    return _finer(rows, p, 1)


def _finer(rows: DataFrame, p: Passages, level: int) -> DataFrame:
    """The same, as a stored table, for anchors whose stretches were cut by a gram for each level before."""
    if level > _LEVELS:
        return stored(_each_window(rows, p), "windows")
    pieces = stored(_pieces(rows, p, level), "pieces")
    different = pieces.groupBy(F.col("key").alias("anchor"), F.col("name").alias("digest"), F.col("piece").alias("stretch"))
    different = stored(different.agg(F.min("least").alias("least"), F.max("least").alias("most")), "different")
    size = F.sum(F.octet_length("stretch") + 1).alias("bytes")
    per = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), size, F.min("least").alias("a"), F.max("most").alias("b"))
    several = per.where("k > 1 AND a < b").select("anchor", "bytes")
    compared = stored(different.drop("most").join(several, "anchor"), "compared")
    runs, deeper = _sorted_blocks(compared.where(f"bytes <= {p.beyond()}"), p), []
    many = compared.where(f"bytes > {p.beyond()}")
    if not many.isEmpty():
        deeper.append(_finer(many, p, level + 1))
        runs = runs.union(deeper[0])
    equal = different.where("least < most").select("anchor", "digest", F.lit(0), F.lit(None).cast("int"), "least")
    found = equal.union(runs).toDF("key", "name", "from", "to", "all")
    begin, end = F.col("start") + F.col("from"), F.col("start") + F.coalesce("to", "windows")
    out = pieces.drop("piece").join(found.hint("merge"), ["key", "name"]).where("all < least")
    out = stored(out.select("anchor", "digest", begin.alias("start"), end.alias("stop"), F.col("all").alias("least")), "finer")
    removed(pieces, different, compared, *deeper)
    return out


def _each_window(rows: DataFrame, p: Passages) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.octet_length("stretch") - p.window)).alias("start")
    windows = rows.select("anchor", "digest", "stretch", "least", at)
    windows = windows.withColumn("w", F.expr(f"substring(stretch, start + 1, {p.window})")).drop("stretch")
    least = windows.groupBy("w").agg(F.min("least").alias("all"))
    return windows.join(least, "w").where("all < least").select(
        "anchor", "digest", "start", (F.col("start") + 1).alias("stop"), F.col("all").alias("least")
    )


def covered(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, version (hash of the text) and `spans`, the unmerged byte spans (start, stop) that go."""
    whole = docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {p.window}").select(
        F.col("doc_id").cast("long"), F.hash("text").alias("version"), F.col("text").cast("binary")
    )
    shared = _shared(_met(whole.select("doc_id", "text"), p))
    parts = max(1, -(-shared.count() * _BITS_EACH >> p.filter_bits))
    spans = [_spans(whole, shared, p, (i, parts)) for i in range(parts)]
    removed(shared)
    if parts == 1:
        return spans[0]
    out = reduce(DataFrame.union, spans).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = stored(out, "spans")
    removed(*spans)
    return out


def _spans(whole: DataFrame, shared: DataFrame, p: Passages, part: tuple[int, int]) -> DataFrame:
    """The spans that go by windows whose anchors are in the part."""
    share = whole.sparkSession.sparkContext.broadcast  # of 2^filter_bits bits, 16 MB
    anchor_bits = share(_bits(shared.where(_in_part(F.col("value"), *part)), p))
    pairs = _shared(_met(whole.select("doc_id", "text"), p, anchor_bits, part))
    pair_bits = share(_bits(pairs, p))
    removed(pairs)
    held = stored(_stretches(whole, anchor_bits, pair_bits, p, part=part), "stretches")
    names = ["anchor", "digest"]
    named = stored(held.groupBy(names).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("windows").alias("windows")), "names")
    several = stored(several_stretches(named, p), "anchors")
    text_bits = share(_bits(several.select(F.shiftrightunsigned("anchor", 24).alias("value")), p))
    texts = _stretches(whole, anchor_bits, pair_bits, p, text_bits, part)
    different = texts.groupBy(*names, "stretch").agg(F.min("doc_id").alias("least"))
    many = several.where(f"bytes > {p.beyond()}").select("anchor")
    done = [held, named, several]
    if many.isEmpty():
        runs = _sorted_blocks(different, p)
    else:
        different = stored(different.join(many.withColumn("many", F.lit(True)), "anchor", "left"), "different")
        finer = _single_windows(different.where("many"), p)
        runs = _sorted_blocks(different.where("many IS NULL"), p).union(finer)
        done += [different, finer]
    runs = stored(runs, "runs")
    equal = named.where("least < most").select(*names, F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"), "least")
    # Joined by shuffles at every size: what fits a broadcast in a small corpus does not in a large one.
    gone = held.join(equal.union(runs).hint("merge"), names).where("least < doc_id")
    last = F.coalesce("stop", "windows") - 1 + p.window
    span = F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + last).alias("stop"))
    spans = stored(gone.groupBy("doc_id", "version").agg(F.collect_set(span).alias("spans")), "spans")
    removed(*done, runs)
    for bits in (anchor_bits, pair_bits, text_bits):
        bits.destroy()
    return spans


def several_stretches(named: DataFrame, p: Passages) -> DataFrame:
    """(anchor, bytes): anchors that have different stretches and are met in several documents, and the bytes of those
    stretches. Only their text is compared."""
    size = F.sum(F.col("windows") + F.lit(p.window)).alias("bytes")  # with the separator of the block
    per = named.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), size, F.min("least").alias("a"), F.max("most").alias("b"))
    return per.where("k > 1 AND a < b").select("anchor", "bytes")


def _applied(docs: DataFrame, p: Passages) -> DataFrame:
    """The documents with `__spans`, null where nothing goes."""
    gone = covered(docs, p).withColumnsRenamed({"doc_id": "__id", "version": "__v", "spans": "__spans"})
    own = docs.withColumn("__version", F.hash("text"))
    on = (own["doc_id"] == gone["__id"]) & (own["__version"] == gone["__v"])
    return own.join(gone.hint("merge"), on, "left").drop("__id", "__v", "__version")


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for cut in cuts for x in cut], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def report(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """One row per document: its bytes, the removed bytes and spans, and the digest of what is left."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, spans in zip(frame["text"], frame["__spans"], strict=True):
                data = b"" if text is None else text.encode("utf-8", "surrogatepass")
                cuts = [] if spans is None else merged(spans)
                out.append((len(data), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(kept_bytes(data, cuts)).hexdigest()))
            table = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pd.concat([frame[["doc_id"]].astype("Int64").reset_index(drop=True), table], axis=1)

    with batches(docs.sparkSession, BATCH_ROWS):
        rows = _applied(docs.select(F.col("doc_id").cast("long"), "text"), p)
        measured = rows.mapInPandas(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return stored(measured, "report")
