"""Runs of words against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest

from streamloom.llm import runs
from tests.llm.helpers import documents, empty_documents, odd_documents


def brute(w, length=6, exponent=4):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def words(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [x for x in text.split(" ") if x]


def plain(doc_id, text):
    w = words(text or "")
    n, h = len(w), zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *figures, digest, hashlib.sha256(rest.encode()).hexdigest())


def check(docs):
    want = sorted(((repr(r["doc_id"]), *plain(r["doc_id"], r["text"])) for r in docs.collect()), key=repr)
    got = sorted(((repr(r["doc_id"]), *tuple(r)[1:]) for r in runs.report(docs).collect()), key=repr)
    assert got == want


def test_documents(spark):
    check(documents(spark).where("n_chars < 6000"))


def test_odd_input(spark):
    check(odd_documents(spark))
    assert runs.report(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        t = []
        while len(t) < rng.randrange(1, 120):
            piece = [rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randrange(1, 7))]
            t += piece * rng.randrange(1, 8)
        texts.append(t)
    texts += [[], ["a"], texts[0]]
    assert runs.find_runs(texts) == [brute(t) for t in texts]
    limits = runs.RunLimits(4, 2)
    assert runs.find_runs(texts, limits) == [brute(t, 4, 2) for t in texts]
    assert runs.find_runs(texts, runs.RunLimits(9, 3)) == [brute(t, 9, 3) for t in texts]


def test_very_long_texts():
    one = ["a"] * 200_000
    block = [f"w{i}" for i in range(5000)] * 12
    near = [x for i in range(20_000) for x in ("same", "five", "words", "come", "again", f"n{i}")]
    got = runs.find_runs([one, block, near, ["x", *one[:50], "y"]])
    assert got == [[(0, 200_000, 1)], [(0, 60_000, 5000)], [], [(1, 50, 1)]]


def test_collapsed_keeps_the_first_period():
    text = "x a b a b a b a b y".split()
    found = runs.find_runs([text])[0]
    assert found == [(1, 8, 2)] and runs.collapsed(text, found) == "x a b y"
