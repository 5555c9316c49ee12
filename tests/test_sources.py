import os

import pytest
from pyspark.sql import functions as F

from streamloom.sources.files import (
    glob_regex,
    list_files,
    read_by_header,
    read_untyped,
    source_files,
    with_ingest_order,
    with_path_metadata,
)
from streamloom.sources.tables import read_segments, read_table, segment_index, segment_rows, segment_windows, stage_segments
from streamloom.sources.writers import write_manifest, write_shards, write_table_once, written_segments


def touch(root, *names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write("a,b\n1,\n2,y\n")


def test_discovery(spark, tmp_path):
    touch(tmp_path, "x/one.csv", "x/README.csv", "x/two.txt", ".h/three.csv", "x/.four.csv", "five 5.csv")
    found = [r[0] for r in list_files(spark, str(tmp_path), ["*.csv"], ["*/README.csv"]).collect()]
    assert found == ["five 5.csv", "x/one.csv"]
    assert glob_regex("a?[bc]*.x") == r"^a.[bc].*\.x$"


def test_untyped_read_numbers_rows(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("n,t\n" + "".join(f"{i},\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_untyped(spark, [str(tmp_path / "big.csv")])
        assert df.rdd.getNumPartitions() > 1
        assert dict(df.dtypes)["n"] == "string"
        assert df.filter(F.col("n").cast("long") != F.col("`file row`")).isEmpty()
        assert df.filter("t is not null").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_with_other_headers_keep_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,current,voltage\n1,2,3\n4,5,6\n")
    (tmp_path / "b.csv").write_text("voltage,time,current\n30,10,20\n")
    (tmp_path / "c.csv").write_text("time,current,voltage\n7,8,9\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    assert len(read_by_header(spark, paths)) == 2
    got = read_untyped(spark, paths).select("time", "current", "voltage", "file row").collect()
    assert sorted(map(tuple, got)) == [("1", "2", "3", 0), ("10", "20", "30", 0), ("4", "5", "6", 1), ("7", "8", "9", 0)]


def test_strict_paths_fail(spark):
    df = spark.createDataFrame([("raw/unknown.csv",)], "`raw file path` string")
    with pytest.raises(Exception, match="no protocol"):
        with_path_metadata(df).collect()


def test_shards_segments_and_once(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, "HPPC").otherwise("cycling").alias("protocol"),
        F.concat(F.lit("c "), (F.col("id") % 2).cast("string")).alias("cell id"),
        F.floor(F.col("id") / 6).alias("row position"),
        "id",
    )
    df = df.dropDuplicates(["protocol", "cell id", "row position"])
    write_shards(df, f"{root}/data", ["cell id"], piece_rows=4, max_records_per_file=7)
    segs = written_segments(spark, root, f"{root}/data", ["cell id"], piece_rows=4)
    keys = ["protocol", "cell id"]
    manifest = segs.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row position", "segments"))), lambda s: s["segments"])).alias("segments")
    )
    back = read_segments(spark, root, manifest, "segments", keys)
    assert back.count() == df.count()
    assert back.filter(F.col("`stream position`") != F.col("`row position`")).isEmpty()
    write_table_once(df, f"{root}/once")
    with pytest.raises(Exception, match="already exists"):
        write_table_once(df, f"{root}/once")
    assert write_manifest(df, root, "none") is None
    assert read_table(spark, f"{root}/once", ["id"], F.col("id") < 5, 2).count() == 2


def test_segment_windows_on_two_segments(spark):
    manifest = spark.createDataFrame(
        [("s", [("a", 5, 20), ("b", 0, 24)])],
        "k string, segs array<struct<`file path` string, `row start` long, `row count` long>>",
    )
    ranges = segment_rows(manifest, "segs", ["k"])
    windows = spark.createDataFrame(
        [("s", 15, 11), ("s", -3, 4), ("s", 40, 10), ("s", 3, 0)], "k string, `window offset` long, `window rows` long"
    )
    for bucket in (4, 1 << 16):
        got = segment_windows(ranges, windows, ["k"], bucket)
        rows = {(r["window offset"], r["file path"], r["window row start"], r["window row count"]) for r in got.collect()}
        assert rows == {(15, "a", 20, 5), (15, "b", 0, 6), (-3, "a", 5, 4), (40, "b", 20, 4)}
        assert got.count() == 4


SEGMENTS = "array<struct<`file path` string, `row start` long, `row count` long>>"


def test_many_segments_in_one_file(spark, tmp_path):
    """10,000 segments of one file of many lengths, one of them over several cells of the coarsest grid."""
    spark.range(300_000).coalesce(1).write.parquet(f"{tmp_path}/data")
    name = next(p.name for p in (tmp_path / "data").glob("*.parquet"))
    pieces, at = [], 0
    for k in range(9_999):
        rows = (1, 2, 16, 17, 40)[k % 5]
        pieces.append((f"s{k % 50}", [(f"data/{name}", at, rows)]))
        at += rows
    pieces.append(("long", [(f"data/{name}", at, 100_000), (f"data/{name}", 5, 3), (f"data/{name}", 7, 0)]))
    manifest = spark.createDataFrame(pieces, f"k string, segs {SEGMENTS}").groupBy("k").agg(
        F.flatten(F.sort_array(F.collect_list("segs"))).alias("segs")
    )
    wanted = {}
    for r in manifest.collect():
        ids = [i for s in r["segs"] for i in range(s["row start"], s["row start"] + s["row count"])]
        wanted |= {(r["k"], n): i for n, i in enumerate(ids)}
    rows = read_segments(spark, str(tmp_path), manifest, "segs", ["k"])
    assert {(r["k"], r["stream position"]): r["id"] for r in rows.collect()} == wanted
    indexed = segment_index(segment_rows(manifest, "segs", ["k"]))
    assert indexed.groupBy("`file path`", "__cell").count().agg(F.max("count")).first()[0] <= 16
    some = spark.createDataFrame([("s3",), ("long",), ("s3",)], "k string")
    rows = stage_segments(spark, str(tmp_path), manifest, some, "segs", ["k"])
    assert {(r["k"], r["stream position"]): r["id"] for r in rows.collect()} == {p: i for p, i in wanted.items() if p[0] in ("s3", "long")}


def test_paths_are_read_once_a_split_and_files_stay_spread(spark, tmp_path):
    """Names are parsed on the list of splits, and neither list is shuffled with the rows, however small Spark may send."""
    paths = [f"{tmp_path}/Cycling_{n}/V{n}/a_Channel_1.csv" for n in (1, 2)]
    for path in paths:
        os.makedirs(os.path.dirname(path))
        with open(path, "w") as f:
            f.write("x,cell id\n" + "".join(f"{i},wrong\n" for i in range(30)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (rows,) = read_by_header(spark, paths, describe=with_path_metadata)
        files = source_files(rows, ["cell id", "cycle index"]).checkpoint()
        placed = with_ingest_order(rows, files)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        physical = placed._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in physical and physical.count("BroadcastHashJoin") == 2
        # Nothing with a pattern stands above the join of rows and splits.
        assert "regexp" not in plan[: plan.rindex("Join ")]
        got = sorted((r["cell id"], r["cycle index"], int(r["x"]), r["row position"]) for r in placed.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(f"V{n}", n, i, i) for n in (1, 2) for i in range(30)]


def test_a_task_sorts_few_pieces(spark, tmp_path):
    """Small pieces are not put together again, though they would fit one task by their compressed bytes."""
    rows = spark.range(4000).selectExpr("'cycling' AS protocol", "'a' AS cell", "id AS `row position`")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        write_shards(rows, f"{tmp_path}/s", ["cell"], piece_rows=100)
        segments = written_segments(spark, str(tmp_path), f"{tmp_path}/s", ["cell"], piece_rows=100)
        files = [r[0] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("_metadata.file_path").count().select("count").collect()]
        assert len(files) > 8 and max(files) <= 1000 and sum(files) == 4000
        assert segments.count() == 40 and segments.agg({"row count": "max"}).first()[0] == 100
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        write_shards(rows, f"{tmp_path}/known", ["cell"], piece_rows=100, rows=4000)
        assert len(spark.read.parquet(f"{tmp_path}/known").inputFiles()) > 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
