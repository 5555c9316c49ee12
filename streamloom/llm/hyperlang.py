"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters, each
permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams, and a language's prototype those
of all its training texts. A text gets the language whose prototype, centred on the mean prototype, has the largest cosine.

Bundling is linear, so n-grams are counted first and each distinct one is bound once for a block of texts. A letter's
vector is made from its code point by a seeded bit mixer, so every script has letters of its own and no table is kept; a trigram is one
64-bit number of three code points. Sums are whole numbers: results do not depend on how texts are dealt to tasks. Very long
texts are bound `BLOCK` trigrams at a time.

Defined results: null text, or text without a letter, is `und` with score 0; without training rows everything is `und`;
repeated rows give repeated results; ties go to the first language by name. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import stored

BITS = 21  # of a code point; 0 is a gap
BLOCK = 8192  # trigrams bound at once
HELD = 4_000_000  # trigrams of training texts held before they are counted


@dataclass(frozen=True)
class Space:
    dimensions: int = 512
    seed: int = 9

    def letters(self, points: np.ndarray) -> np.ndarray:
        """+1 and -1 by the bits of a mixed counter (splitmix64; fixed multipliers) that starts at the code point."""
        words = -(-self.dimensions // 64)
        at = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64)
        x = (at + np.uint64(self.seed << 40)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        signs = np.unpackbits(x.view(np.uint8), axis=1)[:, : self.dimensions].astype(np.int8)
        return 2 * signs - 1

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Bound vectors of trigrams, numbered (a << 2 * BITS) + (b << BITS) + c."""
        mask = (1 << BITS) - 1
        points, at = np.unique(np.stack([ids >> 2 * BITS, (ids >> BITS) & mask, ids & mask]), return_inverse=True)
        a, b, c = at.reshape(3, -1)
        v = self.letters(points)
        return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]

    def bundles(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A bundle per text from its sorted trigrams and counts; every trigram of the list is bound once."""
        out = np.zeros((len(counted), self.dimensions))
        every = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.int64)
        for i in range(0, len(every), BLOCK):
            block = every[i : i + BLOCK]
            vectors = self.grams(block).astype(np.float32)
            for t, (g, n) in enumerate(counted):
                lo, hi = np.searchsorted(g, block[0]), np.searchsorted(g, block[-1], "right")
                if hi > lo:
                    out[t] += n[lo:hi].astype(np.float32) @ vectors[np.searchsorted(block, g[lo:hi])]
        return out


_TABLE: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _TABLE[0]


def placed_trigrams(text: str | None) -> np.ndarray:
    """Trigrams of a text over its letters, words parted by one gap; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.where(_is_letter()[points], points, 0)
    if not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([np.zeros(1, np.int64), s, np.zeros(1, np.int64)])
    s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]
    return (s[:-2] << 2 * BITS) + (s[1:-1] << BITS) + s[2:]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, sorted, with their counts."""
    return np.unique(placed_trigrams(text), return_counts=True)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): trigram counts of the training texts (columns lang, text)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, list[np.ndarray]] = {}
        held = 0

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, parts in texts.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g, "n": n})
            texts.clear()

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                ids = placed_trigrams(text)
                texts.setdefault(lang, []).append(ids)
                held += len(ids) + 1
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, space: Space = Space()) -> DataFrame:
    """(lang, prototype): the bundle of a language's n-grams. Partial bundles are made of blocks of n-grams and added up."""

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, rows in frame.groupby("lang"):
                g, n = rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
                part = np.zeros(space.dimensions)
                for i in range(0, len(g), BLOCK):
                    part += n[i : i + BLOCK] @ space.grams(g[i : i + BLOCK]).astype(np.float64)
                yield pd.DataFrame({"lang": [lang], "part": [part.tolist()]})

    parts = counts.mapInPandas(bundle, "lang string, part array<double>")
    each = parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return each.groupBy("lang").agg(listed.alias("prototype"))  # `dimensions` numbers a language


def predicted(docs: DataFrame, learned: DataFrame, space: Space = Space()) -> DataFrame:
    """doc_id, lang_pred, score. `learned` is the small table of prototypes: one row a language."""
    rows = sorted((r["lang"], r["prototype"]) for r in learned.collect())  # languages x dimensions numbers
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), space.dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    mean = matrix.mean(0) if len(rows) > 1 else np.zeros(space.dimensions)
    centred = (matrix - mean) / np.maximum(np.linalg.norm(matrix - mean, axis=1, keepdims=True), 1e-12) if len(rows) else matrix

    def judged(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], list[float]]:
        v = space.bundles(texts)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        v -= mean
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        found, score = [], []
        for row, (g, _) in zip(v, texts, strict=True):
            if not len(g) or not names:
                found.append("und")
                score.append(0.0)
                continue
            cosine = centred @ row
            best = int(cosine.argmax())
            found.append(names[best])
            score.append(float(min(1.0, max(0.0, (1 + cosine[best]) / 2))))
        return found, score

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[str] = []
            score: list[float] = []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for text in frame["text"]:
                waiting.append(trigrams(text))
                size += len(waiting[-1][0])
                if size > 32 * BLOCK:
                    for to, more in zip((found, score), judged(waiting), strict=True):
                        to.extend(more)
                    waiting, size = [], 0
            for to, more in zip((found, score), judged(waiting), strict=True):
                to.extend(more)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "lang_pred": found, "score": score})

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return slim.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame, space: Space = Space()) -> DataFrame:
    training = docs.where(~held_out())
    learned = stored(prototypes(profiles(training), space).coalesce(1), "language-prototypes")
    return predicted(docs, learned, space)
