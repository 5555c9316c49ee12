"""Language profiles: held-out accuracy, odd input, the algebra."""

import numpy as np
import zlib

from streamloom.llm import hyperlang
from tests.llm.helpers import documents, empty_documents, odd_documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "0.01")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = hyperlang.report(docs).collect()
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    print(right, len(held))
    assert right >= 0.97 * len(held)


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in hyperlang.report(docs).collect()}
    assert len(hyperlang.report(docs).collect()) == docs.count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 11))
    assert got[3]["lang_pred"] == "en"
    assert hyperlang.report(empty_documents(spark)).count() == 0


def test_bundle_equals_binding_letter_by_letter():
    space = hyperlang.Space(64)
    padded = [0, *map(ord, "abca"), 0, ord("b"), 0]
    v = {p: space.letters(np.array([p]))[0].astype(int) for p in padded}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(padded, padded[1:], padded[2:]))
    other = hyperlang.trigrams("ab cd é 漢字")
    got = space.bundles([hyperlang.trigrams("abca b"), hyperlang.trigrams(None), other])
    assert np.array_equal(got[0], want) and not got[1].any()
    assert np.array_equal(got[2], other[1] @ space.grams(other[0]).astype(int))
    long, short = hyperlang.trigrams("ab cd é " * 2000), hyperlang.trigrams("ab cd é " * 2)
    assert long[0].tolist() == short[0].tolist()


def test_letters_of_all_scripts_differ():
    space = hyperlang.Space()
    points = np.array([ord(c) for c in "abzéßαβωжщяאبضकあア漢字한𐐀"])
    v = space.letters(points).astype(int)
    assert np.abs(v @ v.T - 512 * np.eye(len(v), dtype=int)).max() < 150


def test_whole_prediction_against_a_plain_version(spark):
    """Letter by letter, in exact whole numbers up to the cosine; scripts that share no letter, long and short texts."""
    scripts = {"el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "漢字语言文本学习", "en": "abcdefgh"}
    rng = np.random.default_rng(3)
    word = lambda s: "".join(rng.choice(list(s), 4))
    rows = []
    for i in range(80):
        lang = sorted(scripts)[i % 4]
        rows.append((i, " ".join(word(scripts[lang]) for _ in range(3 + i % 7)), lang))
    rows += [(80, "αβγδ " * 30_000, None), (81, "123 ...", "en"), (82, None, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    space = hyperlang.Space()

    def bundle(text):
        padded = [0]
        for c in (text or "").lower():
            p = ord(c) if c.isalpha() else 0
            if p or padded[-1]:
                padded.append(p)
        padded += [0] if padded[-1] else []
        v = {p: space.letters(np.array([p]))[0].astype(int) for p in set(padded)}
        out = np.zeros(space.dimensions)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
        return out

    unit = lambda x: x / np.linalg.norm(x)
    learned = {}
    for i, text, lang in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[lang] = learned.get(lang, 0) + bundle(text)
    names = sorted(learned)
    matrix = np.array([unit(learned[n]) for n in names])
    mean, right = matrix.mean(0), 0
    got = {r["doc_id"]: r for r in hyperlang.report(docs).collect()}
    for i, text, lang in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        cosine = [unit(p - mean) @ unit(unit(bundle(text)) - mean) for p in matrix]
        assert got[i]["lang_pred"] == names[int(np.argmax(cosine))]
        right += got[i]["lang_pred"] == (lang or "el")
        assert abs(got[i]["score"] - (1 + max(cosine)) / 2) < 1e-9
    assert right >= 0.9 * (len(rows) - 2)  # few words, so some share no trigram with the training texts
