"""Fill-in-the-middle: every text is cut into prefix, middle and suffix by a Fenwick tree over blocks of its bytes.

A text is taken as UTF-8 bytes in blocks of fixed length. The tree holds, for every block, how many units begin in it and how
many code points; a descent by powers of two finds the block of a cut in logarithmic time, and only that block is
looked at to place the boundary. Units are code points, or the non-empty matches of a pattern (words, lines): a cut after k
units lies where unit k (from 0) begins, or at the end of the text.

Draws come from sha256 of `seed:doc_id`, so reruns and retried tasks give the same rows. No row meets another: there is no
shuffle, and a task holds one Arrow batch.

Defined results: null text is empty, and an empty text, or one that holds a mark, stays plain; a null doc_id draws as the
word `null`; repeated rows give repeated equal results. Very long texts cost their own length only, as blocks are
counted once. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512
#: Bytes of output after which a task hands on a batch.
BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class Rates:
    """Of 100 documents `transformed` are cut; of 100 of those `spm` put the suffix first."""

    transformed: int = 90
    spm: int = 20


class Fenwick:
    """Partial sums of two counts per block: units and code points."""

    def __init__(self, units: list[int], points: list[int]):
        size = len(units)
        self.size, self.top = size, 1 << (size.bit_length() - 1) if size else 0
        self.units, self.points = [0, *units], [0, *points]
        for at in range(1, size + 1):
            above = at + (at & -at)
            if above <= size:
                self.units[above] += self.units[at]
                self.points[above] += self.points[at]

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block in which unit k begins, with the units and the code points before that block."""
        at, units, points, step = 0, 0, 0, self.top
        while step:
            further = at + step
            if further <= self.size and units + self.units[further] <= k:
                at, units, points = further, units + self.units[further], points + self.points[further]
            step >>= 1
        return at, units, points


class CutText:
    """A text with its tree; `cut(k)` gives the byte and the code point at which unit k begins."""

    def __init__(self, data: bytes, unit: re.Pattern | None = None, block: int = BLOCK):
        self.data, self.block, self.unit = data, block, unit
        self.bytes = np.frombuffer(data, np.uint8)
        leads = np.flatnonzero((self.bytes & 0xC0) != 0x80)
        self.n_points = len(leads)
        if unit is None:
            self.starts = leads
        else:
            found = [m.start() for m in unit.finditer(data.decode()) if m.end() > m.start()]
            self.starts = leads[np.asarray(found, np.int64)]
        self.n = len(self.starts)
        blocks = -(-len(data) // block)
        points = np.bincount(leads // block, minlength=blocks)
        units = points if unit is None else np.bincount(self.starts // block, minlength=blocks)
        self.tree = Fenwick(units.tolist(), points.tolist())

    def cut(self, k: int) -> tuple[int, int]:
        if k >= self.n:
            return len(self.data), self.n_points
        at, units, points = self.tree.descend(k)
        begin = at * self.block
        local = np.flatnonzero((self.bytes[begin : begin + self.block] & 0xC0) != 0x80)
        if self.unit is None:
            return begin + int(local[k - units]), points + k - units
        first = int(np.searchsorted(self.starts, begin))
        byte = int(self.starts[first + k - units])
        return byte, points + int(np.searchsorted(local, byte - begin))


def _draw(number: int, seed: int) -> Column:
    """The given 8-digit group (from 0) of sha256 of `seed:doc_id`, as an unsigned number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(name, 256), 1 + 8 * number, 8), 16, 10).cast("long")


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def transformed(docs: DataFrame, unit: str | None = None, rates: Rates = Rates(), seed: int = 1, block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain), output (text)."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string())]
        + [("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]
    )
    pattern = re.compile(unit) if unit else None

    def one(data: bytes, draws: tuple[int, ...]) -> tuple:
        text = CutText(data, pattern, block)
        if not data or draws[2] % 100 >= rates.transformed or any(m in data for m in marks):
            return text.n, "plain", None, None, data
        low, high = sorted((draws[0] % (text.n + 1), draws[1] % (text.n + 1)))
        (a, before), (b, until) = text.cut(low), text.cut(high)
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        p, s, m = marks
        if draws[3] % 100 < rates.spm:
            form, out = "spm", b"".join([s, suffix, p, prefix, m, middle])
        else:
            form, out = "psm", b"".join([p, prefix, s, suffix, m, middle])
        return text.n, form, before, until - before, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            ids, texts, *draws = batch.columns
            for i, text, *h in zip(ids, texts, *(d.to_pylist() for d in draws), strict=True):
                rows.append((i.as_py(), *one(text.as_py() or b"", tuple(h))))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    given = given.select("*", *[_draw(k, seed).alias(f"h{k + 1}") for k in range(4)])
    return given.mapInArrow(run, _SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text from which `output` was made. Its first marks are the ones put in, as the text holds none."""

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, then, 1), first, -1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    made = transformed(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
