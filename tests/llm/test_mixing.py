"""Mixing: odd input, exact totals, the splitting tree and disjoint shards."""

import numpy as np

from streamloom.llm import mixing
from tests.llm.helpers import documents, empty_documents, odd_documents


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = mixing.report(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.report(empty_documents(spark)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(empty_documents(spark)).count() == 0


def test_shares_are_exact_and_disjoint(spark):
    rows = [("a", 1000), ("b", 37), (None, 400), ("c", 1)]
    got = mixing.shares(spark.createDataFrame(rows, "source string, quota long"), 13).collect()
    sizes = np.zeros(13, int)
    for source, quota in rows:
        ranges = sorted((r["lo"], r["hi"]) for r in got if r["source"] == source)
        assert ranges[0][0] == 0 and ranges[-1][1] == quota
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    for r in got:
        sizes[r["shard"]] += r["hi"] - r["lo"]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 1438
    # Shares are random, not proportional cuts, and the same in every run.
    share = [r["hi"] - r["lo"] for r in sorted(got, key=lambda r: r["shard"]) if r["source"] is None]
    assert len(set(share)) > 1
    again = mixing.shares(spark.createDataFrame(rows, "source string, quota long"), 13).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_tree_has_one_python_step_a_stage(spark):
    root = spark.createDataFrame([(1, 0, 600, [100_000, 777, 3])], "node long, first long, n long, quotas array<long>")
    stages = mixing.leaves(root, 600, 5)._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert [s.count("MapInPandas") for s in stages] == [1, 1]
    assert mixing.leaves(root, 256, 5)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1

    def plain(node, first, n, quotas):
        if n == 1:
            return [(first, quotas)]
        half, total = n // 2, sum(quotas)
        left = mixing._split(quotas, sum(total // n + (i < total % n) for i in range(half)), node, 5)
        right = [a - b for a, b in zip(quotas, left)]
        return plain(2 * node, first, half, left) + plain(2 * node + 1, first + half, n - half, right)

    got = sorted((r["first"], r["quotas"]) for r in mixing.leaves(root, 600, 5).collect())
    assert got == plain(1, 0, 600, [100_000, 777, 3])


def test_split_follows_the_hypergeometric_law():
    draws = np.array([mixing._split([60, 30, 10], 50, node, 0) for node in range(4000)])
    assert (draws.sum(1) == 50).all() and np.allclose(draws.mean(0), [30, 15, 5], atol=0.3)
    assert abs(draws[:, 0].var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.6
    big = mixing._split([3_000_000_000, 2_000_000_000], 2_500_000_000, 1, 0)
    assert sum(big) == 2_500_000_000 and abs(big[0] - 1_500_000_000) < 1_000_000


def test_mix_has_the_words_of_the_report(spark):
    docs = documents(spark)
    small = mixing.Mix(shard_words=20_000)
    plan = mixing.planned(docs, small)
    rows = mixing.draws(plan, small).collect()
    assert len({r["__shard"] for r in rows}) > 3
    mix = mixing.mixed(docs, small)
    words = sum(len(r["text"].split()) for r in mix.collect())
    report = mixing.report(docs).collect()
    assert words == sum(r["taken"] for r in report) == sum(r["__words"] for r in rows)
    per = {}
    for r in report:
        per.setdefault(r["target"], []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 or len(v) > 20 for t, v in per.items())
