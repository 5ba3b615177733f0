import os

from pyspark.sql import functions as F

from dbpulse.functions.scalars import like
from dbpulse.operators import maintain

from lake_paths import SF_SMOKE


def test_compaction_bands_and_rewrite(spark, scratch):
    path = os.path.join(scratch, "t")
    ev = spark.read.parquet(f"{SF_SMOKE}/events.parquet").withColumn("d", F.to_date("ts"))
    ev.repartition(40).write.partitionBy("d").parquet(path)
    before = ev.groupBy("d").count().collect()
    stats = maintain.compact_partitions(spark, path, ["d"], target_file_bytes=1 << 20)
    assert {r.band for r in stats.collect()} <= {"none", "light", "full"}
    after = spark.read.parquet(path)
    assert sorted(before) == sorted(after.groupBy("d").count().collect())
    files = maintain.file_fragmentation(spark, path, ["d"], 1 << 20).agg(F.max("files")).first()[0]
    assert files == 1
    assert maintain.compaction_band(3) == "none" and maintain.compaction_band(40) == "repartition"


def test_like_sets(spark):
    df = spark.createDataFrame([("HOST_1",), ("host_2",), ("HOST_9",), (None,)], "h string")
    got = [r.h for r in df.filter(like(F.col("h"), "host[_][1-2]%")).collect()]
    assert got == ["HOST_1", "host_2"]


def test_text_lines_blocks(spark):
    df = spark.createDataFrame([(1, "Title\nline a\n\nSecond\n  b  \x07")], "doc_id int, text string")
    rows = maintain.text_lines(df).orderBy("line_no").collect()
    assert [(r.line_no, r.block_no, r.line_in_block, r.header, r.line) for r in rows] == [
        (1, 1, 1, "Title", "Title"), (2, 1, 2, "Title", "line a"),
        (4, 2, 1, "Second", "Second"), (5, 2, 2, "Second", "b  ?")]


def test_profile_counts_nested_values_by_type(spark):
    df = spark.createDataFrame([(["a, b"], b"\x00"), (["a", "b"], b"\x01"), (["a", "b"], None), (None, b"\x01")],
                               "a array<string>, b binary")
    got = {r.column_name: r.distinct_count for r in maintain.column_profile(df.select("a", "b"), "t", exact_distinct=True).collect()}
    assert got == {"a": 2, "b": 2}


def test_merged_parts_equal_one_pass(spark):
    rows = [(i, float(i % 7), None if i % 5 else f"t{i % 90}", d) for d in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, x double, t string, day string")
    parts = maintain.profile_sketches(df, "lake", F.col("day"))
    assert parts.count() == 12 and {r.part for r in parts.select("part").distinct().collect()} == {"a", "b", None}
    merged = {r.column_name: r for r in maintain.merge_profiles(parts).collect()}
    once = {r.column_name: r for r in maintain.merge_profiles(maintain.profile_sketches(df, "lake")).collect()}
    plain = lambda rs: {c: [x for n, x in r.asDict().items() if n != "distinct_count"] for c, r in rs.items()}
    assert plain(merged) == plain(once)
    assert all(abs(merged[c].distinct_count - once[c].distinct_count) <= 0.05 * once[c].distinct_count for c in once)
    exact = {r.column_name: r for r in maintain.column_profile(df, "lake", exact_distinct=True).collect()}
    for c, r in merged.items():
        assert (r.row_count, r.null_count, r.min_num, r.max_num, r.min_text, r.max_text) == (
            exact[c].row_count, exact[c].null_count, exact[c].min_num, exact[c].max_num, exact[c].min_text, exact[c].max_text)
        assert abs(r.distinct_count - exact[c].distinct_count) <= max(1, 0.1 * exact[c].distinct_count)
    assert maintain.merge_profiles(maintain.profile_sketches(df.limit(0), "lake", F.col("day"))).count() == 0


def test_blocks_of_odd_texts(spark):
    texts = ["", "\n\n", None, "a", "\na\n", " \n x \n\n\n-\n- -\n", "1\t2\n\n3", "a\r\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in maintain.text_blocks(df, scrub=False).collect():
        got.setdefault(r.doc_id, []).append((r.block_no, [(x.line_no, x.line) for x in r.lines]))
    want = {}
    for i, t in enumerate(texts):
        block, lines = 1, []
        for n, line in enumerate((t or "").split("\n"), 1):
            if not line.strip(" "):
                block += 1
                continue
            if not lines or lines[-1][0] != block:
                lines.append((block, []))
            lines[-1][1].append((n, line.strip(" ")))
        if lines:
            want[i] = lines
    assert {k: sorted(v) for k, v in got.items()} == want


def test_light_band_merges_files_and_leaves_other_partitions(spark, scratch):
    path = os.path.join(scratch, "light")
    big = spark.range(0, 40_000).selectExpr("id", "md5(cast(id as string)) v", "1 d")
    big.repartition(9).write.mode("append").partitionBy("d").parquet(path)
    spark.range(5).selectExpr("id", "'x' v", "1 d").coalesce(1).write.mode("append").partitionBy("d").parquet(path)
    spark.range(40_000).selectExpr("id", "md5(cast(id as string)) v", "2 d").coalesce(1).write.mode("append").partitionBy("d").parquet(path)
    files = lambda d: sorted(f for f in os.listdir(os.path.join(path, f"d={d}")) if f.endswith(".parquet"))
    size = os.path.getsize(os.path.join(path, "d=1", max(files(1), key=lambda f: os.path.getsize(os.path.join(path, "d=1", f)))))
    untouched, before = files(2), len(files(1))
    stats = {r.d: r.band for r in maintain.compact_partitions(spark, path, ["d"], target_file_bytes=size).collect()}
    assert stats == {1: "light", 2: "none"} and before == 10
    assert files(2) == untouched and len(files(1)) < before
    got = spark.read.parquet(path)
    assert got.where("d = 1").count() == 40_005 and got.where("d = 2").count() == 40_000
