"""Every stage of the pipeline against a plain version, stage by stage on what the one before kept."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from streamloom.llm import mixing, packing
from tests.llm.helpers import documents, empty_documents, odd_documents
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import base
from tests.llm.test_tokens import check_packing


def plain_quality(rows):
    """Base rules, lines carried by more than 20 documents of a source, keepers among documents that pass."""

    def words(text):
        for blank in "\t\n\x0b\x0c\r":
            text = text.replace(blank, " ")
        return [w for w in text.split(" ") if w]

    def key(line):
        return "".join("0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c for c in " ".join(words(line)))

    def passes(r):
        w = words(r["text"] or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    ok = {r["doc_id"] for r in rows if passes(r)}
    lines = {r["doc_id"]: (r["text"] or "").split("\n") for r in rows}
    carriers = {}
    for r in rows:
        for line in set(map(key, lines[r["doc_id"]])) - {""}:
            carriers.setdefault((r["source"], line), set()).add(r["doc_id"])
    carriers = {k: v for k, v in carriers.items() if len(v) > 20}

    def kept_lines(r, keepers):
        own = {(r["source"], key(x)) for x in lines[r["doc_id"]]} & carriers.keys()
        gone = {k for k in own if keepers.get(k) != r["doc_id"]}
        return [x for x in lines[r["doc_id"]] if (r["source"], key(x)) not in gone]

    first = {k: min(v & ok) for k, v in carriers.items() if v & ok}
    thin = set()
    for r in rows:
        left = sum(len(words(x)) for x in kept_lines(r, first))
        if left < 0.3 * len(words(r["text"] or "")):
            thin.add(r["doc_id"])
    second = {k: min((v & ok) - thin or v & ok) for k, v in carriers.items() if v & ok}
    stay = ok - thin | ok & set(second.values())
    return {r["doc_id"]: "\n".join(kept_lines(r, second)) for r in rows if r["doc_id"] in stay}


def test_stages_in_order(spark, tmp_path):
    docs = documents(spark)
    columns = docs.columns

    def stage(k, docs):
        out = cp.STAGES[k][1](spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    first = stage(0, docs)
    assert first.columns == columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert kept == plain_quality(docs.collect())

    second = stage(1, first)
    assert second.columns == columns
    roots = brute(sorted(kept.items()), 5, 80)
    assert {r["doc_id"]: r["text"] for r in second.collect()} == {i: kept[i] for i, _, root in roots if i == root}

    third = stage(2, second)
    before = {r["doc_id"]: r["text"] for r in second.collect()}
    for r in third.collect():
        assert not base(r["text"])
        if not base(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])

    fourth = stage(3, third)
    assert fourth.columns == columns
    report = {r["doc_id"]: r for r in mixing.report(third).collect()}
    words = Counter()
    for r in fourth.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {i: r["taken"] for i, r in report.items() if r["taken"]}
    per = {}
    for r in third.collect():
        per.setdefault(r["source"], []).append(report[r["doc_id"]])
    assert all(abs(sum(x["taken"] for x in v) - v[0]["target"]) <= 1 for v in per.values())

    fifth = stage(4, fourth)
    check_packing(fifth.collect(), fourth)


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_odd_input(spark, make, tmp_path):
    docs = make(spark)
    for k, (_, f) in enumerate(cp.STAGES):
        out = f(spark, docs, None)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / str(k)))
