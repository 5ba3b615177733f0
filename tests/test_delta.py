import datetime as dt
import os

from pyspark.sql import functions as F

from dbpulse.operators.delta import snapshot_delta, with_previous_snapshot_time
from dbpulse.streaming.activity import snapshot_delta_stream

T0 = dt.datetime(2024, 1, 1, 0, 0)
T1 = dt.datetime(2024, 1, 1, 0, 1)
T2 = dt.datetime(2024, 1, 1, 0, 2)
S0 = dt.datetime(2023, 12, 31)
S1 = dt.datetime(2024, 1, 1)

SCHEMA = ("instance_id string, session_id bigint, request_id bigint, collection_time timestamp_ntz, "
          "last_request_start_time timestamp_ntz, reads bigint, tempdb_current bigint, "
          "CPU bigint, thread_CPU_snapshot bigint")

ROWS = [
    # one snapshot only
    ("a", 1, 0, T1, S0, 10, 1, 5, 0),
    # steady request: plain deltas, falling tempdb_current stays negative
    ("a", 2, 0, T0, S0, 100, 10, 50, 40), ("a", 2, 0, T1, S0, 150, 4, 60, 90),
    # restarted request (start time changed): no deltas
    ("a", 3, 0, T0, S0, 100, 1, 1, 1), ("a", 3, 0, T1, S1, 200, 2, 2, 2),
    # falling counter: NULL
    ("a", 4, 0, T0, S0, 100, 1, 10, 0), ("a", 4, 0, T1, S0, 90, 1, 5, 0),
    # NULL metric on one side
    ("a", 5, 0, T0, S0, None, 1, 1, 1), ("a", 5, 0, T1, S0, 10, 1, 1, 1),
    # gap: absent at T1, back at T2 -> not consecutive
    ("a", 6, 0, T0, S0, 1, 1, 1, 1), ("a", 6, 0, T2, S0, 5, 1, 1, 1),
    ("b", 9, 0, T2, S0, 1, 1, 1, 1),
]


def batch(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {(r.session_id, r.collection_time): r for r in
            snapshot_delta(df, metrics=("reads", "tempdb_current")).collect()}


def test_delta_edges(spark):
    got = batch(spark)
    assert got[(1, T1)].reads_delta is None
    r = got[(2, T1)]
    assert (r.reads_delta, r.tempdb_current_delta, r.CPU_delta) == (50, -6, 50)
    assert got[(3, T1)].reads_delta is None and got[(3, T1)].tempdb_current_delta is None
    assert got[(4, T1)].reads_delta is None and got[(4, T1)].CPU_delta is None
    assert got[(5, T1)].reads_delta is None
    assert got[(6, T2)].reads_delta is None


def test_delta_telescopes(spark):
    rows = [("a", 1, 0, dt.datetime(2024, 1, 1, 0, m), S0, v, 0, 0, 0)
            for m, v in enumerate([3, 8, 20, 21, 40])]
    df = spark.createDataFrame(rows, SCHEMA)
    s = snapshot_delta(df, metrics=("reads",)).agg(F.sum("reads_delta")).first()[0]
    assert s == 40 - 3


def streamed(spark, scratch, snapshots, **options):
    """Rows of the stream form, one snapshot file per micro-batch, and the query's last progress with state."""
    name = f"delta_{os.path.basename(scratch).replace('-', '_')}_{len(os.listdir(scratch))}"
    src = os.path.join(scratch, f"snaps_{name}")
    for i, df in enumerate(snapshots):
        df.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(snapshots[0].schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    out = snapshot_delta_stream(stream, ["instance_id", "session_id", "request_id"], ["reads", "tempdb_current"],
                                cpu=("CPU", "thread_CPU_snapshot"), **options)
    q = (out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(scratch, f"ckpt_{name}")).start())
    q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return {(r.instance_id, r.session_id, r.collection_time): (r.reads_delta, r.tempdb_current_delta, r.CPU_delta)
            for r in spark.table(name).collect()}, state


def test_stream_equals_batch(spark, scratch):
    later = [("a", 2, 0, T2, None, 5, 5, 5, 5), ("a", 2, 0, T2 + dt.timedelta(days=40), None, 9, 1, 5, 50),  # no start: NULL = NULL
             ("a", 4, 0, T2 + dt.timedelta(days=40), S0, 95, 0, 9, 9)]
    rows = spark.createDataFrame([*ROWS, *later], SCHEMA)
    df = with_previous_snapshot_time(rows)
    times = sorted({r[3] for r in [*ROWS, *later]})
    snaps = [df.filter(F.col("collection_time") == F.lit(t)) for t in times]
    got, _ = streamed(spark, scratch, snaps)      # all collectors pause for 40 days: no event time passes
    want = {(r.instance_id, r.session_id, r.collection_time): (r.reads_delta, r.tempdb_current_delta, r.CPU_delta)
            for r in snapshot_delta(rows, metrics=("reads", "tempdb_current")).collect()}
    assert got == want
    assert got["a", 2, times[-1]] == (4, -4, 45) and got["a", 4, T1] == (None, 0, None)


def test_stream_state_expires_in_event_time(spark, scratch):
    rows = [("a", 1, 0, T0, S0, 1, 1, 1, 1), ("a", 2, 0, T0, S0, 1, 1, 1, 1)]
    rows += [("a", 2, 0, T0 + dt.timedelta(minutes=m), S0, 1 + m, 1, 1, 1) for m in range(1, 6)]
    df = with_previous_snapshot_time(spark.createDataFrame(rows, SCHEMA))
    snaps = [df.filter(F.col("collection_time") == F.lit(T0 + dt.timedelta(minutes=m))) for m in range(6)]
    got, state = streamed(spark, scratch, snaps, state_ttl_ms=120_000, watermark="0 seconds")
    assert [got["a", 2, T0 + dt.timedelta(minutes=m)][0] for m in range(1, 6)] == [1] * 5
    assert max(state) > state[-1]      # the session that left is forgotten, the one that stays is not
    again, kept = streamed(spark, scratch, snaps, state_ttl_ms=None, watermark="0 seconds")
    assert again == got and kept[-1] == max(kept)
