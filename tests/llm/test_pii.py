"""Personal data: base spans against plain patterns, the votes' estimation, redaction."""

import hashlib
import re

import pytest

from streamloom.llm import pii
from tests.llm.helpers import documents, empty_documents, odd_documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def joined(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def check(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in want)
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r["spans"].split(",")) or not want
    return got


@pytest.mark.parametrize("make", [documents, odd_documents, empty_documents])
def test_base_spans(spark, make):
    check(make(spark))


def test_tricky_matches(spark):
    texts = [
        "a@b.co_x@d.com a@b..c a@b.c. x@@y.z",
        "a%b+c@x-y.co.uk!q@w 5.5@1.2",
        "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1..2.3.4",
        "4111-1111-1111-1111 4111  1111 1111 1111 4111 1111 1111 1112 1-2-",
        "+1 (555) 123-4567 +123 +12345678901234567 +1.2.3.4.5.6.7.8.9.0",
        "é 4111111111111111 \U0001f600 1.1.1.1",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_estimation_finds_the_good_labelers(spark):
    rows = [(1, 1, 1, 1, -1, 400), (0, 0, 1, -1, 0, 300), (0, 1, 1, 1, -1, 100), (0, 0, 0, -1, -1, 200)]
    r = pii.estimate(spark.createDataFrame(rows, "regex int, valid int, gazetteer int, context int, doubt int, n long"))
    assert 0.4 < r.prior < 0.6
    assert r.true[0] > 0.7 > 0.1 > r.false[0]


def test_added_spans_and_redaction(spark):
    rows = [(i, f"call my phone +1 (555) 123-{4000 + i} or write to mail joe{i}@x.com") for i in range(200)]
    rows += [(i, f"my phone 555-123-{4000 + i} rings") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert all(got[i]["spans"] == "phone:9:21" for i in range(200, 300))
    text = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert text[0] == "call my phone <PHONE> or write to mail <EMAIL>"
    assert text[250] == "my phone <PHONE> rings"
    odd = pii.redacted(odd_documents(spark))
    assert odd.columns == odd_documents(spark).columns and odd.count() == odd_documents(spark).count()
    assert pii.redacted(empty_documents(spark)).count() == 0
