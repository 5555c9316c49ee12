"""Balanced label propagation: even counts, gapless slots, few cut links, odd input."""

import zlib
from collections import Counter

from streamloom.llm import balanced_shards as bs
from tests.llm.helpers import documents, empty_documents, odd_documents


def check(docs, shards):
    source = docs.collect()
    got = bs.report(docs, shards).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards))
    sizes = [counts.get(i, 0) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for i in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == i) == list(range(sizes[i]))
    return got


def cut(got):
    groups = {}
    for r in got:
        groups.setdefault(r["text_crc32"], []).append(r["shard"])
    return sum(len(set(s)) - 1 for s in groups.values())


def test_documents(spark):
    assert cut(check(documents(spark), 40)) <= 2
    check(odd_documents(spark), 3)
    check(odd_documents(spark), 40)
    assert bs.report(empty_documents(spark)).count() == 0


def test_groups_gather_and_a_giant_one_spans_few_shards(spark):
    rows = [(i, f"single {i}") for i in range(200)] + [(1000 + i, f"group {i % 25}") for i in range(100)]
    rows += [(2000 + i, "giant") for i in range(120)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 7)
    assert cut(got) <= 6
    again = bs.report(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_a_giant_group_fills_its_shards_and_no_more(spark):
    rows = [(i, f"single {i}") for i in range(400)] + [(1000 + i, "giant") for i in range(200)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    giant = Counter(r["shard"] for r in got if r["doc_id"] >= 1000)
    assert len(giant) <= 7 and cut(got) <= 6


def test_groups_gather_without_unlinked_documents(spark):
    pairs = [(i, f"pair {i % 60}") for i in range(120)]
    got = check(spark.createDataFrame(pairs, "doc_id long, text string"), 6)
    assert cut(got) <= 10  # about 50 of the 60 are apart at the start
