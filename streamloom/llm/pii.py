"""Personal data by weak supervision, in DataFrame functions only.

Regex, gazetteer and context labelers vote on candidate spans. Votes are summed up by pattern (a bounded table:
kinds x 3^labelers), expectation-maximisation estimates the reliability of every labeler and the posterior of every
pattern, and a naive Bayes classifier over features of the span, trained on those posteriors, gives the verdict.
Spans of the base patterns always count; the method adds spans that the base patterns miss.

Defined results: null text is empty and has no spans; repeated rows give equal rows; an empty table gives an empty
result (and a classifier that accepts nothing). Extra columns are carried by `redacted` and ignored by `report`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import stored

#: Kinds in the order of the digest.
KINDS = ("email", "ip", "card", "phone")

#: Java forms of the base patterns. They match what the plain patterns match, but in linear time and without
#: recursion: a start inside a run that an earlier start has already tried is skipped.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]+?(?=[ -](?![0-9])|[^0-9 -]|\z)",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: Wider patterns for further candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z]{2,24}",
    "phone": r"(?<![0-9+().-])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}

#: Gazetteers and context words.
TLDS = "com org net edu gov io info biz eu de fr es uk it nl ch at pl us ca au".split()
ISSUERS = "4 51 52 53 54 55 34 37 6011 65 22 23 24 25 26 27 35 36 38".split()
HINTS = {
    "email": "mail e-mail email contact write",
    "ip": "ip address host server client",
    "card": "card visa mastercard amex credit debit",
    "phone": "phone tel call mobile fax cell",
}
DOUBTS = "version release license section figure isbn issn order invoice chapter table".split()

LABELERS = ("regex", "valid", "gazetteer", "context", "doubt")


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, m): places come from the lengths of what lies between."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("m"))
    )
    empty = F.array().cast("array<struct<start:int,m:string>>")
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).cast("int").alias("start"), p["m"].alias("m")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    value = F.transform(at, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match passes the check of its kind."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


#: A cheap test that every match passes.
_SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _matches(text: Column, kind: str, pattern: str, sign: str | None) -> Column:
    may = text.rlike("[0-9]") if sign is None else text.contains(sign)
    if kind == "ip":
        may = text.rlike(r"[0-9]\.[0-9]")
    return F.when(may, _found(text, pattern)).otherwise(F.array().cast("array<struct<start:int,m:string>>"))


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `__all`: every candidate as struct (start, kind, end, m, strict, wide), where strict
    marks the base spans and wide those of the wider patterns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", _matches(whole, kind, PATTERNS[kind], _SIGNS[kind]))
    df = df.withColumn("__wide_email", _matches(whole, "email", WIDE["email"], "at")).withColumn(
        "__wide_phone", _matches(whole, "phone", WIDE["phone"], None)
    )

    def spans(column: str, kind: str, strict: bool) -> Column:
        ok = (lambda m: valid(kind, m)) if strict else (lambda m: F.lit(False))
        return F.transform(
            column,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (s["start"] + F.length(s["m"])).alias("end"),
                s["m"].alias("m"),
                ok(s["m"]).alias("strict"),
                F.lit(not strict).alias("wide"),
            ),
        )

    parts = [spans(f"__{kind}", kind, True) for kind in KINDS]
    parts += [spans("__wide_email", "email", False), spans("__wide_phone", "phone", False)]
    names = [f"__{k}" for k in (*KINDS, "wide_email", "wide_phone")]
    return df.withColumn("__all", F.concat(*parts)).drop(*names)


def _says(text: Column, listed: list[str]) -> Column:
    return F.lower(text).rlike(r"(?<![a-z])(" + "|".join(listed) + r")(?![a-z])")


def votes(kind: Column, m: Column, strict: Column, wide: Column, near: Column) -> dict[str, Column]:
    """1, 0 or -1 (abstains) from each labeler."""
    k = {name: kind == i for i, name in enumerate(KINDS)}
    n = F.length(_digits(m))

    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0)

    checks = F.when(k["ip"], flag(valid("ip", m))).when(k["card"], flag(valid("card", m))).when(k["phone"], flag(n.between(10, 15)))
    ending = F.element_at(F.split(F.lower(m), r"[^a-z]+"), -1)
    listed = (
        F.when(k["email"], flag(ending.isin(TLDS)))
        .when(k["card"], flag(F.regexp_replace(m, "[^0-9]", "").rlike("^(" + "|".join(ISSUERS) + ")")))
        .when(k["ip"], flag(~m.rlike(r"^(0+|127|255)\.")))
    )
    hint = reduce(lambda c, name: c.when(k[name] & _says(near, HINTS[name].split()), 1), KINDS, F.when(F.lit(False), 1))
    return {
        "regex": F.when(~wide, flag(strict)).otherwise(-1),
        "valid": F.coalesce(checks, F.lit(-1)),
        "gazetteer": F.coalesce(listed, F.lit(-1)),
        "context": F.coalesce(hint, F.lit(-1)),
        "doubt": F.when(_says(near, DOUBTS), 0).otherwise(-1),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate span with its votes and features."""
    near = F.substring(F.col("text"), F.greatest(F.col("c.start") - 39, F.lit(1)), F.least(F.lit(40), F.col("c.start")))
    rows = (
        with_candidates(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), "text")
        .where(F.size("__all") > 0)
        .select("doc_id", "digest", "text", F.explode("__all").alias("c"))
        .select("doc_id", "digest", "c.*", F.when(F.col("c.start") > 0, near).otherwise("").alias("near"))
    )
    digits = F.length(_digits(F.col("m")))
    return (
        rows.withColumns(votes(*map(F.col, ("kind", "m", "strict", "wide", "near"))))
        .withColumn("f_digits", F.least(digits, F.lit(20)))
        .withColumn("f_length", F.least(F.floor(F.length("m") / 4), F.lit(12)).cast("int"))
        .withColumn("f_marks", F.least(F.length(F.regexp_replace("m", "[A-Za-z0-9]", "")), F.lit(6)))
        .withColumn("f_before", F.when(F.col("near").rlike("[=:] ?$"), 2).when(F.col("near").rlike("[ \n]$"), 1).otherwise(0))
        .drop("m", "near")
    )


@dataclass(frozen=True)
class Reliabilities:
    """Prior of a true span, and for each labeler the chance to vote 1 given that it votes, for true and false spans."""

    prior: float
    true: tuple[float, ...]
    false: tuple[float, ...]


START = Reliabilities(0.5, (0.9, 0.9, 0.7, 0.8, 0.2), (0.2, 0.2, 0.4, 0.3, 0.1))
FEATURES = ("f_digits", "f_length", "f_marks", "f_before")


def _posterior(r: Reliabilities) -> Column:
    """P(true | votes); abstentions carry no weight."""
    odds = F.lit(r.prior / (1 - r.prior))
    for name, t, f in zip(LABELERS, r.true, r.false, strict=True):
        v = F.col(name)
        odds = odds * F.when(v == 1, t / f).when(v == 0, (1 - t) / (1 - f)).otherwise(1.0)
    return odds / (1 + odds)


def estimate(patterns: DataFrame, rounds: int = 12) -> Reliabilities:
    """Expectation-maximisation over the pattern table (columns: the labelers, n). Each round is one aggregate whose
    single row of sums gives the next reliabilities, smoothed by one vote of the starting values."""
    r = START
    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("t")]
        for name in LABELERS:
            voted, yes = F.col(name) >= 0, F.col(name) == 1
            for tag, weight in (("t", n * p), ("f", n * (1 - p))):
                sums += [F.sum(F.when(voted, weight).otherwise(0.0)).alias(f"{name}_{tag}"), F.sum(F.when(yes, weight).otherwise(0.0)).alias(f"{name}_{tag}1")]
        row = patterns.withColumn("p", _posterior(r)).agg(*sums).first()
        if not row["n"]:
            return r

        def rate(name: str, tag: str, start: float) -> float:
            value = (row[f"{name}_{tag}1"] + 10 * start) / (row[f"{name}_{tag}"] + 10)
            return min(0.99, max(0.01, value))

        r = Reliabilities(
            min(0.99, max(0.01, (row["t"] + 1) / (row["n"] + 2))),
            tuple(rate(name, "t", s) for name, s in zip(LABELERS, START.true, strict=True)),
            tuple(rate(name, "f", s) for name, s in zip(LABELERS, START.false, strict=True)),
        )
    return r


def classified(found: DataFrame) -> DataFrame:
    """Candidates with `p`, the verdict of the final classifier.

    The classifier is naive Bayes over discrete features (at most 4 kinds x 21 values each), whose counts are sums of
    the posteriors over all candidates; it sees the span, not the votes, and so also judges where labelers abstain.
    """
    patterns = stored(found.groupBy(*LABELERS).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "pii-patterns")
    soft = found.withColumn("q", _posterior(estimate(patterns)))
    feature = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("int").alias("value")) for f in FEATURES]))
    counts = (
        soft.select("kind", "q", feature.alias("f"))
        .groupBy("kind", F.col("f.name").alias("name"), F.col("f.value").alias("value"))
        .agg(F.sum("q").alias("t"), F.sum(1 - F.col("q")).alias("f"))
    )
    totals = soft.groupBy("kind").agg(F.sum("q").alias("all_t"), F.sum(1 - F.col("q")).alias("all_f"))
    rates = counts.join(totals, "kind").select(
        "kind",
        F.struct("name", "value").alias("k"),
        F.log(((F.col("t") + 0.5) / (F.col("all_t") + 10)) / ((F.col("f") + 0.5) / (F.col("all_f") + 10))).alias("w"),
        F.log((F.col("all_t") + 1) / (F.col("all_f") + 1)).alias("w0"),
    )
    model = rates.groupBy("kind").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("weights"), F.first("w0").alias("w0")
    )  # one row a kind, at most 84 weights each
    score = F.col("w0")
    for f in FEATURES:
        key = F.struct(F.lit(f).alias("name"), F.col(f).cast("int").alias("value"))
        score = score + F.coalesce(F.try_element_at("weights", key), F.lit(0.0))
    return soft.join(F.broadcast(model), "kind").withColumn("p", 1 / (1 + F.exp(-score))).drop("weights", "w0")


ACCEPT = 0.9


def added(found: DataFrame) -> DataFrame:
    """Per document the spans that the method adds: judged true by both the votes and the classifier, clear of base spans."""
    return (
        classified(found)
        .where(~F.col("strict") & (F.col("p") >= ACCEPT) & (F.col("q") >= ACCEPT))
        .groupBy("doc_id", "digest")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("__more"))
        .withColumnsRenamed({"doc_id": "__id", "digest": "__d"})
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds `__base` and `__spans`, sorted arrays of structs (start, kind, end), to rows with doc_id and text."""
    more = added(stored(candidates(docs), "pii-candidates"))
    rows = with_candidates(docs.withColumn("__digest", F.xxhash64("text")), "text")
    slim = F.transform(
        F.filter("__all", lambda c: c["strict"]), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    )
    rows = rows.withColumn("__base", F.sort_array(slim)).drop("__all")
    rows = rows.join(more, rows["doc_id"].eqNullSafe(more["__id"]) & (rows["__digest"] == more["__d"]), "left")
    clear = F.filter(
        F.coalesce("__more", F.array().cast("array<struct<start:int,kind:int,end:int>>")),
        lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return rows.withColumn("__spans", F.sort_array(F.concat("__base", clear))).drop("__id", "__d", "__digest", "__more")


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    rows = with_spans(docs.select("doc_id", "text"))
    of = F.transform("__base", lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets. Of overlapping spans the first one names
    the replacement, which covers them all."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    rows = with_spans(boxed)
    span = "struct<start:int,kind:int,end:int>"
    # Disjoint cover of the spans, in order.
    cover = F.aggregate(
        "__spans",
        F.array().cast(f"array<{span}>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)) > s["start"]),
            F.concat(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.get(a, F.size(a) - 1)["kind"].alias("kind"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    rows = rows.withColumn("__cover", cover)
    piece = F.transform(
        "__cover",
        lambda s, i: F.concat(
            F.substring(
                F.col("text"),
                F.coalesce(F.get("__cover", i - 1)["end"], F.lit(0)) + 1,
                s["start"] - F.coalesce(F.get("__cover", i - 1)["end"], F.lit(0)),
            ),
            F.get(names, s["kind"]),
        ),
    )
    tail = F.substring(F.col("text"), F.get("__cover", F.size("__cover") - 1)["end"] + 1, F.length("text"))
    text = F.when(F.size("__cover") == 0, F.col("text")).otherwise(F.concat(F.array_join(piece, ""), tail))
    fields = {c: F.col("__row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in fields:
        fields["n_chars"] = F.length(text).cast("long")
    return rows.select(*[v.alias(k) for k, v in fields.items()])
