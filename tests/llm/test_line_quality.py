"""Line quality: odd input, boilerplate lines and depleted documents (the SQL test covers the figures)."""

from streamloom.llm import line_quality
from tests.llm.helpers import empty_documents, odd_documents


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = line_quality.report(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[5]["n_repeat_words"] == 9
    assert by[8]["n_repeat_words"] == by[8]["n_words"] == 1200
    assert by[9]["n_dup_lines"] == 1
    assert line_quality.report(empty_documents(spark)).count() == 0
    assert line_quality.clean(docs).columns == docs.columns


def test_boilerplate_goes(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    banner = "all rights reserved " * 10
    rows = [(i, f"{own(i)}\n{banner}", "h") for i in range(30)]
    rows += [(100 + i, own(999), "h") for i in range(40)]  # exact copies
    rows += [(200 + i, f"{banner}\n" + "b%d " % i * 8, "h") for i in range(5)]
    rows += [(rows[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.report(docs).collect()}
    assert got[0]["n_removed_lines"] == 0  # the first document keeps the line
    assert all(got[i]["n_removed_lines"] == 1 and got[i]["n_removed_words"] == 30 and got[i]["kept"] for i in range(1, 30))
    assert got[100]["kept"] and not any(got[100 + i]["kept"] for i in range(1, 40))  # the first of the copies keeps their lines
    assert not any(got[200 + i]["kept"] for i in range(5))
    texts = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert texts[7] == own(7) and texts[0].endswith(banner) and 200 not in texts


def own(name, n=60):
    """A line of n words of its own; digits would be alike after normalising."""
    letters = str(name).translate(str.maketrans("0123456789", "qrstuvwxyz"))
    return " ".join(f"{letters}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))


def test_documents_are_counted_and_the_limit_is_absolute(spark):
    footer = "contact the editors here"
    rows = [(i, f"{own(i)}\n{footer}" if i < 21 else own(i), "large") for i in range(1500)]
    rows += [(2000 + i, f"{own(5000)}\nsome closing words {footer}", "copies") for i in range(21)]  # one text, 21 documents
    rows += [(3000, f"{own(5001)}\n{footer}", "large")] * 3  # repeated rows are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_quality.report(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["n_removed_lines"] for i in range(21)] == [0] + [1] * 20 and by[3000]["n_removed_lines"] == 1
    assert by[2000]["kept"] and by[2000]["n_removed_lines"] == 0
    assert not any(by[2000 + i]["kept"] for i in range(1, 21))
    texts = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert texts[3000] == own(5001) and texts[0].endswith(footer)


def test_keepers_pass_the_rules(spark):
    notice = "this notice is carried by every document " * 10
    rows = [(0, notice, "short")]  # smallest, but its words repeat
    rows += [(i, f"{own(i, 100)}\n{notice}", "short") for i in range(1, 31)]
    # Documents of two frequent lines alone: 100 keeps none, 101 and later are made of them.
    lines = [own(f"l{k}", 80) for k in range(3)]
    rows += [(100 + i, "\n".join([lines[0], lines[1]]), "pairs") for i in range(25)]
    rows += [(90, f"{lines[0]}\n{own('z', 10)}", "pairs")]
    # The first carrier is depleted by its other line; a later one that is not takes the line over.
    rows += [(200, f"{own('a', 90)}\n{own('b', 20)}", "moved")]
    rows += [(190 + i, f"{own('a', 90)}\n{own(f'c{i}', 300)}", "moved") for i in range(2)]
    rows += [(300 + i, f"{own('a', 90)}\n{own('b', 20)}\n{own(f'd{i}', 300)}", "moved") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.report(docs).collect()}
    assert got[0]["base_failed"] and got[1]["kept"] and got[1]["n_removed_lines"] == 0
    assert all(got[i]["n_removed_lines"] == 1 for i in range(2, 31))
    # 90 keeps the first line; 100 keeps the second and has enough left; the copies go.
    assert got[90]["n_removed_lines"] == 0 and got[90]["kept"]
    assert got[100]["kept"] and got[100]["n_removed_lines"] == 1 and not got[101]["kept"]
    # 190 keeps "a"; 200 would keep "b" (20 of 110 words) but is depleted, so 300 keeps it.
    assert not got[200]["kept"] and got[200]["n_removed_lines"] == 2
    assert got[300]["kept"] and got[300]["n_removed_lines"] == 1 and got[301]["n_removed_lines"] == 2


def test_the_only_carriers_are_rescued(spark):
    small, big = [own(f"s{i}", 20) for i in range(2)], own("big", 100)
    rows = [(10 + i, "\n".join([big, small[i % 2]]), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.report(docs).collect()}
    # 10 keeps the big line and the first small one; 11 keeps the second small one only, is depleted, and no other can take it.
    assert got[10]["kept"] and got[11]["kept"] and not any(got[i]["kept"] for i in range(12, 70))
    texts = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert texts == {10: rows[0][1], 11: small[1]}
