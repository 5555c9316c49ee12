"""Encoding, packing and token files against the whole-text encoding of the library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from streamloom.llm import packing, repair, tokens
from streamloom.llm.common import stored
from tests.llm.helpers import ODD_TEXTS, documents, empty_documents, odd_documents

TRICKY = ["a  b", "a \nb", "a\n b", "it's a 'test' don't  we'll", " x  y", "İ ΣΑΣ ς ' s", "<|endoftext|> x", "a<|endoftext|>b c", " <|startoftext|> d", "<|ENDOFTEXT|> <|endoftext", "é é ́x", "a\x00 b", "12 34,5 6.", "\n\n a", "tab\t x", "end ", "x</w> y", "a\xa0 b c"]


FRESH = {n: Tokenizer.from_file(tokens.vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def whole(name, text):
    ids = FRESH[name].encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memory_changes_no_id(name):
    encoder = tokens.encoder(tokens.vocabulary(name))
    for text in [t for t in ODD_TEXTS if t] + TRICKY:
        assert encoder(text) == whole(name, text).tobytes(), text[:50]


def check_packing(got, docs):
    want = {}
    for r in docs.collect():
        ids = np.append(whole("word_bpe_49k.json", r["text"]), 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            key = (r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got:
        key = tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
        have[key] = have.get(key, 0) + 1
    assert have == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        assert sum(3 * n > 4096 for _, n in parts) <= 2
    return bins


def marked_documents(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")


@pytest.mark.parametrize("make", [documents, odd_documents, empty_documents, marked_documents])
def test_packing(spark, make):
    docs = make(spark)
    got = packing.report(docs).collect()
    bins = check_packing(got, docs)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) * 1.02 + 1


def test_plan_equals_best_fit_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cap = int(rng.integers(6, 60))
        sizes = sorted(rng.integers(1, cap + 1, rng.integers(1, 200)).tolist(), reverse=True)
        large, gaps = [s for s in sizes if 3 * s > cap], []
        while large:
            s = large.pop(0)
            k = next((i for i, t in enumerate(large) if s + t <= cap), None)
            gaps.append(cap - s - (large.pop(k) if k is not None else 0))
        for s in [s for s in sizes if 3 * s <= cap]:
            fit = [g for g in gaps if g >= s]
            gaps.remove(min(fit)) if fit else None
            gaps.append((min(fit) if fit else cap) - s)
        places = packing.plan({s: sizes.count(s) for s in set(sizes)}, cap)
        assert places.bins == len(gaps)


@pytest.mark.parametrize("make", [documents, odd_documents, empty_documents])
def test_token_files(spark, make, tmp_path):
    docs = make(spark)
    path = repair.write(docs, str(tmp_path / "tokens"))
    got = sorted(repair.read(spark, path).collect(), key=lambda r: r["start"])
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start = 0
    assert len(got) == len(rows)
    for r, d in zip(got, rows):
        ids = np.append(whole("byte_bpe_50k.json", d["text"]), 0).astype("<u4")
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    if rows:
        one = rows[len(rows) // 2]
        assert repair.document(spark, path, one["doc_id"]) == [*whole("byte_bpe_50k.json", one["text"]).tolist(), 0]


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (5000, 4), (5000, 300), (20000, 2)):
        ids = rng.integers(0, top, n)
        g = repair.compress(ids, 1000)
        assert (repair.expand(g.sequence, g) == ids).all()
    g = repair.compress(np.tile([1, 2, 3, 4, 0], 1000), 10)
    assert len(g.sequence) <= 2000 and g.expansions.max() == 4


def test_grammar_is_whole():
    """Rules go on until no pair occurs twice, however rare or deep they are."""

    def left_over(g):
        counts, last = {}, {}
        for i, pair in enumerate(zip(g.sequence.tolist(), g.sequence[1:].tolist())):
            if 0 not in pair and last.get(pair) != i - 1:
                counts[pair], last[pair] = counts.get(pair, 0) + 1, i
        return max(counts.values(), default=0)

    rng = np.random.default_rng(2)
    passage = rng.integers(1, 50000, 4000)
    twice = np.concatenate([passage, [0], passage, [0]])
    many = np.concatenate([rng.integers(1, 300, 30000), np.tile(passage[:500], 40), np.ones(5000, np.int64)])
    for ids in (twice, many, np.tile([1, 2, 3, 4, 0], 1000)):
        g = repair.compress(ids, 50257)
        assert (repair.expand(g.sequence, g) == ids).all() and left_over(g) < 2
    g = repair.compress(twice, 50257)
    assert len(g.sequence) <= 4 and g.expansions.max() == 4000


def test_pairs_are_grouped_once(monkeypatch):
    """A round groups the pairs it made, not the whole sequence again."""
    seen, grouped = [], repair._grouped_pairs
    monkeypatch.setattr(repair, "_grouped_pairs", lambda *a: (seen.append(len(a[0])), grouped(*a))[1])
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 60000) % 4000, np.tile(rng.integers(1, 4000, 300), 30), np.ones(1001, np.int64)])
    g = repair.compress(ids, 4000)
    assert (repair.expand(g.sequence, g) == ids).all()
    assert len(seen) > 10 and sum(seen) <= 3 * len(ids)


def test_batches_of_texts_equal_the_library(monkeypatch):
    """Units cut by the classes of characters; each different one is looked up once a batch."""
    rng = random.Random(9)
    common = ["a", "St", "re", "ll", "ve", "'", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "é", "ß", "1", "²", "½", "!", ".", "\x00", "ɏ"]
    odd = ["ɐ", "中", "\x1c", "\x1f", "\u2003", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choices(common if i % 5 else common + odd, k=rng.choice([0, 1, 2, 3, 9, 40]))) or None for i in range(3000)]
    texts += ["x" * 5000, " " * 3000 + "x", "!" * 2500]
    encoder = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    ids, sizes = encoder.batch(texts)
    want = [whole("byte_bpe_50k.json", t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()
    assert [x.tolist() for x in encoder.batch([])] == [[], []]
    looked = []
    encode = encoder.units.encode
    monkeypatch.setattr(encoder.units, "encode", lambda u: (looked.append(u), encode(u))[1])
    encoder.batch(["some unseen words, some unseen words"] * 500)
    assert len(looked) == len(set(looked)) < 8


def test_blocks_close_behind_the_document_that_fills_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = repair.blocks(docs, tokens.vocabulary("byte_bpe_50k.json"), block_tokens=20).orderBy("part", "block").collect()
    assert [d for r in rows for d in r["doc_ids"]] == list(range(40))
    for r in rows:
        assert sum(r["lengths"][:-1]) < 20
    for r, later in zip(rows, rows[1:]):
        assert sum(r["lengths"]) >= 20 or later["part"] != r["part"]


def test_packing_hands_few_texts_to_python_at_once(spark):
    docs = spark.range(2_500).coalesce(1).selectExpr("id AS doc_id", "'a text' AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = docs.mapInPandas(lambda frames: (f.iloc[:1].assign(doc_id=len(f)) for f in frames), "doc_id long, text string")
    sizes = sorted(r["doc_id"] for r in stored(rows, "batches", batch_rows=packing.BATCH_ROWS).collect())
    assert sizes == [500, 1_000, 1_000]
    assert packing.report(docs).count() == 2_500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
