"""Shared by the tests of the corpus operators."""

import os

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "word",
    "one two three four",
    "a b c a b c a b c d",
    "Ärger im Café 東京 \U0001f600 end",
    "x" * 5000,
    "repeat me now " * 400,
    "a line\nthe same line\nthe same line\n\n",
    "mail a.b@c.de_x@d.com. 1.2.3.4 and 999.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 1.2.3.4.5",
    "1" * 3000 + " " + "1 " * 500 + "@" * 200 + "+" * 200,
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, rank string"


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with results."""
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "x", 1, "r") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[10], (None, "no id here", None, None, None, None, None, None), (100, ODD_TEXTS[5], None, "a", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")




DRIVER_FOLDER = os.environ.get("CORPUS_TEST_DIR", "/root/testdata/sf0.001")
