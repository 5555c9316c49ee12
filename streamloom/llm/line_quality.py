"""Quality rules with the frequency of lines across documents, in DataFrame functions only.

Lines are normalised and hashed; for every host (a column, `source` here) the distinct documents that carry
a line are counted. A line in more documents than the limit is removed from all of them but its keeper, so that no
content vanishes altogether; a document left with too few of its words is rejected.

The keeper is the smallest doc_id among the carriers that pass the base rules. Where the keepers' choice leaves such a
document depleted all the same (by its other lines), the smallest carrier that is not depleted takes the line over; if
there is none, the first keeper stays and is rescued: it is not rejected. A line thus vanishes only with documents that
all fail the base rules.

Defined results: null text has no words and fails the base rules; a null host is a host of its own, a null doc_id a
document of its own and the smallest; repeated rows count once and give repeated equal results; exact copies under other
doc_ids are documents; a document without words is never "depleted" but fails by length. Very long texts are
arrays of their words and lines in one row: memory grows with the longest text alone.
Extra columns of the input are carried by `clean` and ignored by `report`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import WORD, stored, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz0000000000"


@dataclass(frozen=True)
class LineLimits:
    """A line is removed when more than `documents` documents of its host carry it, however large the host is."""

    documents: int = 20
    least_left: float = 0.3


def _with_repeats(df: DataFrame) -> DataFrame:
    """From `__tokens`: n_repeat_words, the number of words in a 3-word window found at least twice.

    Windows are compared by 64-bit hash. Each step is a column of its own, as an expression inside a lambda is
    evaluated again for every element; only lists with a repeated window are sorted.
    """
    window = F.transform("__tokens", lambda w, i: F.xxhash64(w, F.get("__tokens", i + 1), F.get("__tokens", i + 2)))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(
        "__placed",
        lambda s, i: ((i > 0) & (F.get("__placed", i - 1)["h"] == s["h"])) | (F.get("__placed", i + 1)["h"] == s["h"]),
    )
    reach = F.transform("__starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__starts", k + 1) - p, F.lit(3))))
    return (
        df.withColumn("__windows", F.slice(window, F.lit(1), F.greatest(F.size("__tokens") - 2, F.lit(0))))
        .withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed))
        .withColumn("__starts", F.sort_array(F.transform(twice, lambda s: s["i"])))
        .withColumn(
            "n_repeat_words",
            F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        )
        .drop("__windows", "__placed", "__starts")
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))


def normalised(line: Column) -> Column:
    """Lower case for A-Z, digits as 0, runs of blanks as one blank."""
    return F.translate(F.trim(F.regexp_replace(line, r"[ \t-\r]+", " ")), _UPPER, _LOWER)


def line_key(line: Column) -> Column:
    clean = normalised(line)
    return F.struct(F.xxhash64(clean).alias("a"), F.hash(clean).alias("b"))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = (
        docs.withColumn("__tokens", words(F.col(text)))
        .withColumn("__lines", _lines(F.col(text)))
        .withColumn("n_words", F.size("__tokens").cast("long"))
        .withColumn("word_chars", F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    )
    out = _with_repeats(out)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__tokens", "__lines")


def _keyed_columns(host: str) -> list[Column]:
    return [F.col("doc_id").alias("__id"), F.col(host).alias("__host"), F.xxhash64("text").alias("__text"), F.col("text")]


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(*_keyed_columns(host))


_DOC = ["__id", "__host", "__text"]
_LINE = ["__host", "key"]


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names where nulls are equal; the right side's keys are dropped."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return left.join(right.withColumnsRenamed({c: f"{c}_" for c in on}), same, how).drop(*[f"{c}_" for c in on])


def frequent_lines(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Lines above the limit: __host, key, documents. Counted in two steps, so that no line meets in one task."""
    each = F.array_distinct(F.transform(_lines(F.col("text")), line_key))
    seen = _keyed(docs, host).select("__host", "__id", F.explode(each).alias("key")).distinct()
    return seen.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > limits.documents)


def _hits(docs: DataFrame, based: DataFrame, host: str, limits: LineLimits) -> DataFrame:
    """One row per document and frequent line: lines and words it takes there, with n_words and base_failed."""
    lines = F.transform(_lines(F.col("text")), lambda x: F.struct(line_key(x).alias("key"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    carried = _keyed(docs, host).select(*_DOC, F.explode(lines).alias("line")).select(*_DOC, "line.key", "line.n")
    found = _joined(carried, frequent_lines(docs, host, limits).select(*_LINE), _LINE)
    per = found.groupBy(*_DOC, "key").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("words"))
    # Repeated rows of one document must not add up.
    one = based.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("rows"), F.max("n_words").alias("n_words"), F.max("base_failed").alias("base_failed"))
    rows = _joined(per, one, _DOC)
    return rows.withColumns({c: (F.col(c) / F.col("rows")).cast("long") for c in ("lines", "words")}).drop("rows")


def _thin(lost: DataFrame, limits: LineLimits) -> DataFrame:
    """The documents that lose too many of their words."""
    sums = lost.groupBy(*_DOC).agg(F.sum("words").alias("words"), F.max("n_words").alias("n_words"))
    left = F.col("n_words") - F.col("words")
    return sums.where((F.col("n_words") > 0) & (left < limits.least_left * F.col("n_words"))).select(*_DOC, F.lit(True).alias("thin"))


def removals(docs: DataFrame, based: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Per document with a frequent line: __id, __host, __text, removed (line keys), n_removed_lines, n_removed_words,
    depleted. `based` holds a row of base figures per input row (_DOC, n_words, base_failed)."""
    hits = stored(_hits(docs, based, host, limits), "quality-hits")
    own, passes = F.struct("__id"), ~F.col("base_failed")
    first = hits.where(passes).groupBy(*_LINE).agg(F.min(own).alias("keeper"))
    lost = _joined(hits, first, _LINE, "left").where(~own.eqNullSafe(F.col("keeper")))
    marked = _joined(hits, _thin(lost, limits), _DOC, "left").withColumn("thin", F.coalesce("thin", F.lit(False)))
    marked = stored(marked, "quality-marked")
    keeper = F.coalesce(F.min(F.when(passes & ~F.col("thin"), own)), F.min(F.when(passes, own)))
    final = _joined(marked, marked.groupBy(*_LINE).agg(keeper.alias("keeper")), _LINE)
    gone = ~own.eqNullSafe(F.col("keeper"))
    return final.groupBy(*_DOC).agg(
        F.collect_set(F.when(gone, F.col("key"))).alias("removed"),
        F.sum(F.when(gone, F.col("lines")).otherwise(0)).alias("n_removed_lines"),
        F.sum(F.when(gone, F.col("words")).otherwise(0)).alias("n_removed_words"),
        (F.max("thin") & ~F.max(passes & ~gone)).alias("depleted"),
    )


def _judged(docs: DataFrame, host: str, limits: LineLimits) -> DataFrame:
    """A row per input row: _DOC, base figures, the removed lines, kept. The base figures are written first: were
    a filter pushed into their computation, Spark would inline its steps."""
    based = stored(base_columns(_keyed(docs, host)).drop("text"), "quality-base")
    rows = _joined(based, removals(docs, based, host, limits), _DOC, "left")
    return rows.withColumns(
        {
            "kept": ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)),
            "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)).cast("long"),
            "n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"),
        }
    )


def report(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per document with the base figures, the removed lines and the verdict `kept`."""
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(docs, host, limits).select(F.col("__id").alias("doc_id"), *figures, "n_removed_lines", "n_removed_words")


def clean(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents with their columns; frequent lines are cut out of the text."""
    judged = _judged(docs, host, limits).where("kept").dropDuplicates(_DOC)
    kept = judged.select(*[F.col(c).alias(f"{c}_") for c in _DOC], F.col("removed").alias("__removed"))
    # The input's row travels as one struct, so that its columns cannot clash.
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *_keyed_columns(host))
    rows = boxed.join(kept, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _DOC])
    lines = F.filter(
        F.split(F.col("text"), "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("__removed"), line_key(x)))
    )
    text = F.when(F.coalesce(F.size("__removed"), F.lit(0)) <= 0, F.col("text")).otherwise(F.array_join(lines, "\n"))
    rows = rows.withColumn("text", text)
    fields = {c: F.col("__row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in fields:
        fields["n_chars"] = F.length("text").cast("long")
    return rows.select(*[v.alias(k) for k, v in fields.items()])
