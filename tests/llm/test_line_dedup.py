"""Line deduplication: the filter itself, reversible inserts and deletes, odd input (the SQL test covers the figures)."""

import hashlib
import os
import random

import pytest

from streamloom.llm import line_dedup
from streamloom.llm.line_dedup import Cuckoo, LineIndex
from tests.llm.helpers import empty_documents, odd_documents

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(BLANKS).translate(UPPER)


def plain(rows):
    """(doc_id, n_lines, n_dropped, text) of (doc_id, text) rows; rows without id come last."""
    keeper = {}
    for d, t in rows:
        if d is not None:
            for k in map(key, (t or "").split("\n")):
                keeper[k] = min(d, keeper.get(k, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and key(x) in keeper and (d is None or keeper[key(x)] < d) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def result(index, docs):
    return sorted(map(tuple, index.deduplicated(docs).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(60_000)]
    held = Cuckoo.sized(40_000)
    assert held.insert(keys[:40_000]) and held.contains(keys[:40_000]).all()
    assert held.contains(keys[40_000:]).mean() < 0.002
    held.delete(keys[:30_000])
    assert held.contains(keys[30_000:40_000]).all() and held.contains(keys[:30_000]).mean() < 0.002
    assert np_count(held) == 10_000
    copy = Cuckoo(len(held.table), held.table.tobytes())
    copy.delete(keys[30_000:40_000])
    assert np_count(copy) == 0 and keys[0] not in copy
    assert not Cuckoo(16).insert(keys[:100])
    with pytest.raises(ValueError):
        copy.delete(keys[:1])


def np_count(held):
    return int((held.table != 0).sum())


def made(seed, n, base=0):
    rng = random.Random(seed)
    line = lambda: f" {rng.choice(['Shared', 'SHARED', 'short'])} line no {rng.randrange(40)}\t" if rng.random() < 0.7 else f"own {rng.random()}"
    return [(base + i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(n)]


@pytest.mark.parametrize("shard_keys", [8, 1 << 18])
def test_insert_and_delete_in_any_order(spark, tmp_path, shard_keys):
    a, b, c = made(1, 30, 100), made(2, 30, 0), made(3, 30, 200)
    index = LineIndex.create(spark, str(tmp_path / "i"), shard_keys).insert(frame(spark, a)).insert(frame(spark, b), slices=2)
    assert result(index, frame(spark, a + b)) == plain(a + b)
    first = {r["key"]: (r["refs"], r["keeper"]) for r in index.refs().collect()}
    index = LineIndex.open(spark, str(tmp_path / "i"), shard_keys).insert(frame(spark, c))
    index.delete(frame(spark, c))
    assert {r["key"]: (r["refs"], r["keeper"]) for r in index.refs().collect()} == first
    index.delete(frame(spark, b[::2]))
    rest = a + b[1::2]
    assert result(index, frame(spark, rest)) == plain(rest)
    index.insert(frame(spark, b[::2]))
    assert result(index, frame(spark, a + b)) == plain(a + b)
    assert {r["key"]: (r["refs"], r["keeper"]) for r in index.refs().collect()} == first
    # One fingerprint per key in use, and none is missed.
    bits = sum(np_count(Cuckoo(r["buckets"], r["bits"])) for r in index.filters().collect())
    assert bits == len(first) and index._maybe(index.refs()).count() == len(first)
    index.delete(frame(spark, a + b))
    assert index.refs().count() == 0 and index.lines().count() == 0
    assert sum(np_count(Cuckoo(r["buckets"], r["bits"])) for r in index.filters().collect()) == 0


def test_a_failed_change_leaves_nothing(spark, tmp_path):
    a = made(5, 10)
    index = LineIndex.create(spark, str(tmp_path / "i")).insert(frame(spark, a))
    index._write(frame(spark, made(6, 10)), "lines")  # a part that no state names
    assert result(LineIndex.open(spark, str(tmp_path / "i")), frame(spark, a)) == plain(a)
    assert len(os.listdir(tmp_path / "i" / "state")) == 1


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = line_dedup.report(docs).collect()
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got), key=repr) == sorted(
        ((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want), key=repr
    )
    assert line_dedup.report(empty_documents(spark)).count() == 0


def test_hot_line_and_very_long_text(spark):
    rows = [(i, f"the line that all documents hold\nown line number {i}") for i in range(3000)]
    rows += [(None, "THE line that all documents hold"), (None, "nobody else has this")]
    rows += [(5000 + k, "\n".join(f"long text line {i}" for i in range(30_000))) for k in range(2)]
    index = LineIndex.create(spark).insert(frame(spark, rows), slices=2)
    assert result(index, frame(spark, rows)) == plain(rows)
