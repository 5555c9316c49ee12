"""Passage removal against brute force; the suffix order against sorting."""

import contextlib
import cProfile
import hashlib
import pstats
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamloom.llm import common
from streamloom.llm import suffix_dedup as sd
from streamloom.llm.common import stored
from tests.llm.helpers import documents, empty_documents, odd_documents


def brute(rows, window=50):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1 if doc is not None else 0):
            w = data[i : i + window]
            least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - window + 1 if doc is not None else 0):
            if least[data[i : i + window]] < doc:
                gone[i + 1 : i + 1 + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[1:-1]])
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("make", [documents, odd_documents, empty_documents])
def test_equals_brute_force(spark, make):
    docs = make(spark)
    assert sorted(repr(tuple(r)) for r in sd.report(docs).collect()) == brute(rows_of(docs))


def test_planted_passages_and_many_stretches(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, hub = word(90), word(60)
    rows = []
    for i in range(120):
        text = word(rng.choice([10, 60, 200])) + rng.choice(["", passage, passage[:49], passage[10:70]]) + word(20)
        rows.append((1000 - i, text + (hub if i % 2 else "") + word(30)))
    rows += [(2000, "ab" * 400), (2001, "xx" + "ab" * 60 + "yy"), (2002, "z" * 3000), (2003, "z" * 51), (1000, passage + "another version")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = sd.Passages(block_bytes=3000, together=20, longest=64, filter_bits=20)
    for p in (sd.Passages(), small):
        assert sorted(repr(tuple(r)) for r in sd.report(docs, p).collect()) == brute(rows)


def test_equal_stretches_send_no_text(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy, passage = word(3000), word(200)
    rows = [(i, copy) for i in range(20)] + [(100 + i, word(80) + passage + word(80)) for i in range(5)]
    dealt = []
    blocks = sd._sorted_blocks
    monkeypatch.setattr(sd, "_sorted_blocks", lambda rows, p: (dealt.append(rows.collect()), blocks(rows, p))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in sd.report(docs).collect()) == brute(rows)
    # Whole copies are settled by name; only where the passage's ends differ is text compared.
    assert not [r for r in dealt[0] if bytes(r["stretch"]) in copy.encode()]
    assert sum(len(r["stretch"]) for r in dealt[0]) < 3000


def test_short_stretches_stay_together_by_their_bytes(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(60)
    rows = [(i, word(60) + passage[: 52 + i % 9] + word(60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    singly = []
    windows = sd._single_windows
    monkeypatch.setattr(sd, "_single_windows", lambda rows, p: (singly.append(rows.count()), windows(rows, p))[1])
    # More than five different stretches, whose bytes five of the longest kind would have.
    assert sorted(repr(tuple(r)) for r in sd.report(docs, sd.Passages(together=5)).collect()) == brute(rows) and not singly
    tight = sd.Passages(together=1, longest=64)
    assert sorted(repr(tuple(r)) for r in sd.report(docs, tight).collect()) == brute(rows) and singly[0] > 5


def test_few_texts_are_with_python_at_once(spark, monkeypatch):
    seen = []
    applied = sd._applied
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(sd, "_applied", lambda docs, p: (seen.append(spark.conf.get(key)), applied(docs, p))[1])
    before = spark.conf.get(key)
    assert sd.report(documents(spark)).count() == documents(spark).count()
    assert seen == [str(sd.BATCH_ROWS)] and spark.conf.get(key) == before


def test_shuffles_go_with_the_tables_they_made(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def left(release):
        def files():
            found = blocks.getAllFiles()
            return {str(found.apply(i)) for i in range(found.size()) if "shuffle_" in str(found.apply(i))}

        before = files()
        stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted", release=release)
        for _ in range(50):
            if not (more := files() - before) or not release:
                break
            time.sleep(0.2)
        return len(more)

    before = spark.conf.get(key)
    assert left(False) and not left(True) and spark.conf.get(key) == before


def test_joins_do_not_depend_on_the_size(spark, monkeypatch):
    plans, table = [], sd._table
    monkeypatch.setattr(sd, "_table", lambda df, name, **kw: (plans.append((name, df._jdf.queryExecution().toString(), kw)), table(df, name, **kw))[1])
    assert sd.report(documents(spark)).count() == documents(spark).count()
    assert {n for n, _, _ in plans} >= {"passages-shared", "passages-bits", "passages-spans", "passages-report"}
    assert all(kw == {"release": True} and "BroadcastHashJoin" not in plan for _, plan, kw in plans)
    assert sum("SortMergeJoin" in plan for _, plan, _ in plans) == 2


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 5, 17, 300, 301, 302):
        s = rng.integers(1, int(rng.choice([2, 3, 30, 257])) + 1, n)
        assert sd.suffix_order(s, n + 3).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        short = sd.suffix_order(s, 9)
        prefixes = [s[i : i + 9].tolist() for i in short]
        assert prefixes == sorted(prefixes) and sorted(short.tolist()) == list(range(n))


class Frames:
    """Rows that are handed to a Python step here."""

    def __init__(self, *frames):
        self.frames = frames

    def repartition(self, *names):
        return self

    sortWithinPartitions = select = repartition

    def mapInPandas(self, step, schema):
        return list(step(iter(self.frames)))


def calls(step):
    profile = cProfile.Profile()
    out = profile.runcall(step)
    return out, pstats.Stats(profile).total_calls


class Bits:
    def __init__(self, p):
        self.value = np.full(1 << (p.filter_bits - 5), 0xFFFFFFFF, np.uint32)


def test_stretches_are_named_and_sorted_without_calls_for_each():
    rng, p = random.Random(8), sd.Passages(filter_bits=20)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    docs = pd.DataFrame({"doc_id": range(40), "version": 1, "text": texts})
    frames, n = calls(lambda: sd._stretches(Frames(docs), Bits(p), Bits(p), p))
    held = pd.concat(frames)
    assert len(held) > 5_000 and n < len(held)
    assert held.groupby("doc_id")["windows"].sum().tolist() == [3000 - p.window + 1] * 40
    rows = pd.DataFrame({"anchor": 7, "digest": range(3000), "least": range(3000, 0, -1)})
    rows["stretch"] = [x.encode()[at : at + 60] for x in texts for at in range(0, 75 * 12, 12)]
    frames, n = calls(lambda: sd._sorted_blocks(Frames(rows), p))
    # Neighbours share no window, as they are 12 bytes apart and have 11 windows; their owners fall.
    assert not len(pd.concat(frames)) and n < 4 * len(rows)


@pytest.mark.parametrize("longest", [16, 1024])
def test_stretches_have_one_name_wherever_they_lie(longest):
    p = sd.Passages(filter_bits=20, longest=longest)
    grown = b"a"
    while len(grown) < 4096:
        grown += bytes(97 + 98 - x for x in grown)
    rng = random.Random(9)
    other = "".join(rng.choice("abé ") for _ in range(90_000))
    texts = [grown.decode(), grown.translate(bytes.maketrans(b"ab", b"ba")).decode(), "ab" * 300, other, "xyz" + other[:5000], other[-500:]]
    # The sequence above and its complement, in words with a common part: sums of hashes times powers come near each other there.
    texts += ["".join("one core of all words" + {"a": "0123456789", "b": "9876543210"}[c] for c in x[:512]) for x in texts[:2]]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "version": 1, "text": texts})
    held = pd.concat(sd._stretches(Frames(docs.iloc[:4], docs.iloc[4:]), Bits(p), Bits(p), p))
    data = [x.encode() for x in texts]
    held["text"] = [data[d][f : f + w + p.window - 1] for d, f, w in zip(held["doc_id"], held["first"], held["windows"])]
    assert (held.groupby(["anchor", "digest"])["text"].nunique() == 1).all()
    assert (held.groupby("text")["digest"].nunique() == 1).all()
    texts = pd.concat(sd._stretches(Frames(docs), Bits(p), Bits(p), p, Bits(p)))
    assert sorted(zip(texts["digest"], texts["stretch"])) == sorted(zip(held["digest"], held["text"]))


@pytest.mark.parametrize("frame", [1, 7, 1000])
def test_sorted_blocks_find_the_smallest_owner(frame):
    rng = random.Random(10)
    rows = []
    for anchor in range(6):
        core = "".join(rng.choice("ab") for _ in range(70))
        for i in range(rng.choice([1, 2, 9])):
            text = core[rng.randrange(20) :] + "".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 40])))
            rows.append((anchor, i, text.encode(), rng.randrange(50)))
    rows.append((9, 0, b"\0" * 60, 5))
    rows.append((9, 1, b"\0" * 70, 4))
    all_rows = pd.DataFrame(rows, columns=["anchor", "digest", "stretch", "least"])
    frames = [all_rows.iloc[i : i + frame] for i in range(0, len(rows), frame)]
    for block in (1, 200, 1 << 19):
        found = {}
        for r in pd.concat(sd._sorted_blocks(Frames(*frames), sd.Passages(block_bytes=block))).itertuples(index=False):
            for at in range(r.start, r.stop):
                found[r.anchor, r.digest, at] = r.least
        least = {}
        for anchor, _, text, owner in rows:
            for at in range(len(text) - 49):
                key = (anchor, text[at : at + 50])
                least[key] = min(owner, least.get(key, owner))
        expected = {}
        for anchor, digest, text, owner in rows:
            for at in range(len(text) - 49):
                if least[anchor, text[at : at + 50]] < owner:
                    expected[anchor, digest, at] = least[anchor, text[at : at + 50]]
        assert found == expected


def test_texts_longer_than_a_batch(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = word(70)
    rows = [(3, word(70_000) + passage + word(70_000)), (1, passage), (2, ""), (4, word(49)), (5, word(10) + passage[5:66])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in sd.report(docs).collect()) == brute(rows)


@contextlib.contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(f"spark.sql.{k.replace('__', '.')}", None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k.replace('__', '.')}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            name = f"spark.sql.{k.replace('__', '.')}"
            spark.conf.unset(name) if v is None else spark.conf.set(name, v)


def common_phrases(n, phrases, seed):
    """Texts with phrases in ever other surroundings, some of them met again."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, again = [word(24) for _ in range(phrases)], [word(40) for _ in range(10)]
    return [(i, word(30) + rng.choice([word(20), *again]) + common[i % phrases] + rng.choice([word(20), *again]) + word(30)) for i in range(n)]


def test_blocks_hold_whole_anchors_beside_hot_ones(spark):
    rows = common_phrases(400, 4, 12) + common_phrases(400, 100, 13)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    # The list of hot anchors looks too large for a broadcast, and when it is there it is not.
    conf = {"autoBroadcastJoinThreshold": "1k", "adaptive__coalescePartitions__enabled": "false", "shuffle__partitions": "6"}
    with settings(spark, **conf):
        found = sd.report(docs, sd.Passages(together=12, longest=64)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows)


def test_stretches_of_hot_anchors_are_cut_finer(spark, monkeypatch):
    rows = common_phrases(300, 1, 14)
    hot, windows, real, each = [], [], sd._pieces, sd._each_window
    monkeypatch.setattr(sd, "_pieces", lambda rows, p, level: (hot.append(rows.count()), real(rows, p, level))[1])
    monkeypatch.setattr(sd, "_each_window", lambda rows, p: (windows.append(rows.count()), each(rows, p))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = sd.Passages(together=40, longest=64)
    assert sorted(repr(tuple(r)) for r in sd.report(docs, p).collect()) == brute(rows)
    assert hot and hot[0] > 50 and not windows
    monkeypatch.setattr(sd, "_LEVELS", 1)
    p = sd.Passages(together=1, longest=64)
    assert sorted(repr(tuple(r)) for r in sd.report(docs, p).collect()) == brute(rows) and windows


def test_anchors_beyond_a_filter_go_in_parts_and_leave_only_spans(spark, monkeypatch, tmp_path):
    rows = common_phrases(300, 20, 15)
    parts, spans = [], sd._spans
    monkeypatch.setattr(sd, "_spans", lambda whole, shared, p, part: (parts.append((part, shared.count())), spans(whole, shared, p, part))[1])
    monkeypatch.setattr(common, "checkpoint_dir", lambda spark: f"{tmp_path}/with space")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.report(docs, sd.Passages(filter_bits=9)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows)
    assert len(parts) > 2 and [x for x, _ in parts] == [(i, len(parts)) for i in range(len(parts))]
    assert len(parts) == -(-parts[0][1] * sd._BITS_EACH // 512)
    left = sorted(x.name.rsplit("-", 1)[0] for x in (tmp_path / "with space").iterdir())
    assert left == ["passages-report", "passages-spans"]
