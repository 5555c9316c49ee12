"""Fill-in-the-middle against plain slicing, with other units, tiny blocks and odd input."""

import hashlib
import random
import re

import pytest

from streamloom.llm import fim
from tests.llm.helpers import documents, empty_documents, odd_documents


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(docs):
    want = sorted((repr(r["doc_id"]), *plain(r["doc_id"], r["text"])[:4], sha(plain(r["doc_id"], r["text"])[4]), sha(r["text"] or "")) for r in docs.collect())
    got = sorted((repr(r["doc_id"]), *tuple(r)[1:]) for r in fim.report(docs).collect())
    assert got == want


def test_documents(spark):
    check(documents(spark))


def test_odd_input(spark):
    check(odd_documents(spark))
    assert fim.report(empty_documents(spark)).count() == 0


def test_marks_long_texts_and_split_points(spark):
    texts = ["has <M> in it", "<P", "S><", "<" * 40, "é東\U0001f600" * 70_000, "a", "<<S", "x<P>"]
    rows = [(10 * k + j, t) for k, t in enumerate(texts) for j in range(8)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("unit", [None, r"[^ \t-\r]+", r"[^\n]*\n?"])
@pytest.mark.parametrize("block", [1, 3, 64])
def test_every_cut(unit, block):
    rng = random.Random(block)
    for _ in range(30):
        text = "".join(rng.choice("ab \né東\U0001f600") for _ in range(rng.randrange(60)))
        cut = fim.CutText(text.encode(), re.compile(unit) if unit else None, block)
        starts = [m.start() for m in re.finditer(unit or r"(?s:.)", text) if m[0]]
        assert cut.n == len(starts)
        for k in range(cut.n + 2):
            point = starts[k] if k < len(starts) else len(text)
            assert cut.cut(k) == (len(text[:point].encode()), point)


def test_words_as_units(spark):
    docs = spark.createDataFrame([(i, "  one two\nthree four ") for i in range(40)], "doc_id long, text string")
    rows = fim.transformed(docs, unit=r"[^ \t-\r]+").withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert {r["n"] for r in rows} == {4} and {r["back"] for r in rows} == {"  one two\nthree four "}
    assert {r["prefix_chars"] for r in rows} <= {None, 2, 6, 10, 16, 21}
