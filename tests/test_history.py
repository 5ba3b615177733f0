import datetime as dt
import os

from pyspark.sql import functions as F

from dbpulse.sources import history
from dbpulse.streaming.activity import collect_batches, minute_activity, minute_activity_stream

from lake_paths import SF_SMOKE


def test_first_row_wins_idempotent(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, "c")], "k int, o int, v string")
    once = history.first_row_wins(df, ["k"], [F.col("o")])
    twice = history.first_row_wins(once, ["k"], [F.col("o")])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.k: r.v for r in once.collect()} == {1: "b", 2: "c"}


def test_retention_keeps_nulls(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 30),), (None,)],
                               "t timestamp_ntz")
    kept = history.apply_retention(df, "t", F.lit("2024-01-31").cast("timestamp_ntz"), 7).collect()
    assert len(kept) == 2


def test_table_name_check():
    assert history.check_table_name("[db].[dbo].[ActivityHistory]") == "db.dbo.ActivityHistory"
    for bad in ("", "a.b.c.d", "a..b"):
        try:
            history.check_table_name(bad)
            assert False, bad
        except ValueError:
            pass


def test_purge_partitions(spark, scratch):
    path = os.path.join(scratch, "hist")
    rows = [(dt.datetime(2024, 1, d, h), d) for d in (1, 2, 3) for h in (0, 12)]
    df = (spark.createDataFrame(rows, "collection_time timestamp_ntz, v int")
          .withColumn("collection_date", F.to_date("collection_time")))
    history.overwrite_date_partitions(df, path)
    history.purge_partitions(spark, path, dt.datetime(2024, 1, 4, 6), days=2)
    left = sorted(r.collection_time for r in spark.read.parquet(path).collect())
    assert left == [dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 3, 0), dt.datetime(2024, 1, 3, 12)]


def test_minute_stream_equals_batch(spark, scratch):
    ev = spark.read.parquet(f"{SF_SMOKE}/events.parquet")
    src = os.path.join(scratch, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (minute_activity_stream(stream, watermark="0 seconds").writeStream.format("memory")
         .queryName("minute_stream_test").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("minute_stream_test")
    want = minute_activity(ev)
    # append mode emits a window once the watermark passes it: all but the last minute(s)
    assert got.subtract(want).count() == 0
    assert got.count() >= want.count() - 5


def test_collect_batches_idempotent(spark, scratch):
    ev = spark.read.parquet(f"{SF_SMOKE}/events.parquet").limit(200)
    src = os.path.join(scratch, "raw")
    ev.write.parquet(src)
    out = os.path.join(scratch, "hist")

    def build(b):
        return (b.groupBy(F.date_trunc("minute", "ts").alias("collection_time"))
                .agg(F.count(F.lit(1)).alias("n"))
                .withColumn("collection_date", F.to_date("collection_time")))

    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = collect_batches(stream, build, out, os.path.join(scratch, "ckpt"), trigger_seconds=None)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out)
    assert got.agg(F.sum("n")).first()[0] == 200


def test_append_to_table_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "session_id bigint, status string")
    history.append_to_table(a, "[activity_hist]")
    b = spark.createDataFrame([("y", 2)], "status string, session_id bigint")
    history.append_to_table(b, "activity_hist")
    got = sorted((r.session_id, r.status) for r in spark.table("activity_hist").collect())
    assert got == [(1, "x"), (2, "y")]


def test_append_collection_keeps_same_day_and_is_idempotent(spark, scratch):
    path = os.path.join(scratch, "h")

    def coll(t, n):
        return (spark.createDataFrame([(t, i) for i in range(n)], "collection_time timestamp_ntz, v int")
                .withColumn("collection_date", F.to_date("collection_time")))
    a, b = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11)
    history.append_collection(spark, coll(a, 3), path)
    history.append_collection(spark, coll(b, 2), path)
    history.append_collection(spark, coll(b, 2), path)   # replayed
    got = spark.read.parquet(path).groupBy("collection_time").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(a, 3), (b, 2)]


def test_append_collection_keeps_other_servers_at_the_same_time(spark, scratch):
    path = os.path.join(scratch, "h2")
    t = dt.datetime(2024, 1, 1, 10)

    def coll(inst, n):
        return (spark.createDataFrame([(inst, t, i) for i in range(n)],
                                      "instance_id string, collection_time timestamp_ntz, v int")
                .withColumn("collection_date", F.to_date("collection_time")))
    history.append_collection(spark, coll("a", 3), path)
    history.append_collection(spark, coll("b", 2), path)
    history.append_collection(spark, coll("a", 3), path)   # replayed
    got = spark.read.parquet(path).groupBy("instance_id").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [("a", 3), ("b", 2)]


def test_collections_are_leaves_that_are_replaced_alone(spark, scratch):
    path = os.path.join(scratch, "leaves")
    times = [dt.datetime(2024, 1, 1, h) for h in (9, 10, 11)] + [dt.datetime(2024, 1, 2, 9)]

    def coll(inst, t, v):
        return (spark.createDataFrame([(inst, t, v)], "instance_id string, collection_time timestamp_ntz, v int")
                .withColumn("collection_date", F.to_date("collection_time")))
    for inst in ("a~b/c=d", None, "", "-"):
        for t in times:
            history.append_collection(spark, coll(inst, t, 1), path)
    files = lambda: {f for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") for f in [os.path.join(d, n)]}
    before = files()
    history.append_collection(spark, coll(None, times[1], 7), path)   # a late rerun
    assert len(before - files()) == 1 and len(files() - before) == 1
    got = history.read_history(spark, path)
    assert got.count() == 16 and got.columns == ["instance_id", "collection_time", "v", "collection_date"]
    assert [(r.instance_id, r.collection_time) for r in got.where("v = 7").collect()] == [(None, times[1])]
    kept = files()
    history.purge_partitions(spark, path, dt.datetime(2024, 1, 11, 10), days=10)
    left = history.read_history(spark, path)
    assert {r[0] for r in left.select("collection_time").distinct().collect()} == set(times[1:]) and left.count() == 12
    assert files() < kept     # no file was rewritten
