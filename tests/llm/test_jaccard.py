"""Jaccard join against all pairs, odd input, components and deduplication."""

import random

import numpy as np
import pytest

from streamloom.llm import jaccard, shingles
from streamloom.llm.components import components
from tests.llm.helpers import ODD_TEXTS, empty_documents, odd_documents


def gram_set(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, percent):
    sets = [(i, gram_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and 100 * len(x & y) >= percent * len(x | y)]
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((i, len(s), root[i]) for i, s in sets)


def families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "w1 w2"), (len(rows) + 3, "W1\tW2 ")]
    return rows


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80)])
def test_components_equal_brute_force(spark, seed, k, percent):
    rows = families(seed)
    got = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Threshold(k, percent))
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_odd_input(spark):
    docs = odd_documents(spark)
    rows = jaccard.report(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["component_id"] == 5 and by[0]["component_id"] == 0 and by[None]["component_id"] is None
    assert jaccard.report(empty_documents(spark)).count() == 0
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == [-1, *range(len(ODD_TEXTS))]
    assert jaccard.deduplicated(empty_documents(spark)).count() == 0


def test_word_hashes_tell_words_apart():
    texts = ["Aa bb\tcc", "aa  bb cc", "aabb cc", None, "é aa"]
    h, at = shingles.word_hashes(texts)
    words = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert words[0] == words[1] and len(words[0]) == 3 and words[3] == []
    assert len(words[2]) == 2 and words[2][0] not in words[0] and words[4][1] == words[0][0]
    assert [len(s) for s in shingles.sets(["a b c d e", "a b", "", "a a a a a a"], 4)] == [2, 1, 0, 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in got} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_many_just_below_the_threshold(spark):
    """Sets that share 47 of 55 shingles never link; the few that share more do, and no list is joined with itself for it."""
    own = lambda i, k: " ".join(f"o{i}x{j}" for j in range(k))
    template = " ".join(f"t{j}" for j in range(50))
    rows = [(i, f"{own(i, 8)} {template}") for i in range(1500)]
    rows += [(2000 + i, f"{own(2000 + i, 3)} {template}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.report(docs).collect()}
    assert all(got[i] == i for i in range(1500))
    assert [got[2000 + i] for i in range(3)] == [2000] * 3
    lists = spark.createDataFrame(
        [(7, i, 55, 8, i, [i * 977 % 251] * 8) for i in range(1000)],
        "token long, id long, n int, pos int, root long, fold array<long>",
    )
    assert jaccard._cross_pairs(lists, jaccard.Threshold()).isEmpty()
