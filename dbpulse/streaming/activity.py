"""Streaming forms of the collection jobs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dbpulse.sources import history


# ------------------------------------------------------------------- T7
def minute_activity(events: DataFrame, time_col: str = "ts", by: Sequence[str] = ("event_type",),
                    width: str = "60 seconds") -> DataFrame:
    """T7 (batch form): event counts per tumbling minute and group."""
    return (events.groupBy(F.window(time_col, width).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, "events"))


def minute_activity_stream(events: DataFrame, time_col: str = "ts", by: Sequence[str] = ("event_type",),
                           width: str = "60 seconds", watermark: str = "10 minutes") -> DataFrame:
    """T7 (stream): the same counts with a watermark, so each minute is
    emitted once (append mode) when it can no longer change and its state
    is dropped — state stays bounded by the watermark delay."""
    ntz = isinstance(events.schema[time_col].dataType, T.TimestampNTZType)
    if ntz:  # watermarks need TIMESTAMP; the wall-clock value round-trips
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    out = minute_activity(events.withWatermark(time_col, watermark), time_col, by, width)
    if ntz:
        out = (out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
               .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))
    return out


# ------------------------------------------------------------------- T2
STATE_TTL_MS = 7 * 24 * 3600 * 1000   # longer than any planned pause of a collector
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SnapshotDeltas(StatefulProcessor):
    """The last row of one (instance, session, request), and the deltas to it.

    One value holds the row: its time, its guard, its metrics and CPU pair, and
    the event time at which it is forgotten. A row re-arms that timer; when the
    watermark passes it, the entity is taken to have left.
    """

    def __init__(self, entity: list[str], metrics: list[str], signed: set[str],
                 cpu: tuple[str, str] | None, guarded: bool, ttl_ms: int | None):
        self.entity, self.metrics, self.signed = entity, metrics, signed
        self.cpu, self.guarded, self.ttl_ms = cpu, guarded, ttl_ms
        self.carried = list(dict.fromkeys([*metrics, *(cpu or ())]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = ", ".join(f"v{i} long" for i in range(len(self.carried)))
        self.last = handle.getValueState("last", f"t long, guard long, timer long, {values}")

    def _deltas(self, row: dict, last) -> list[int | None]:
        valid = last is not None and row["prev__"] == last[0] and (not self.guarded or row["guard__"] == last[1])
        was = dict(zip(self.carried, last[3:])) if valid else {}

        def change(name):
            now, then = row[name], was.get(name)
            return None if now is None or then is None else now - then

        out = [d if d is not None and (d >= 0 or m in self.signed) else None
               for m, d in ((m, change(m)) for m in self.metrics)]
        if self.cpu:
            own, thread = change(self.cpu[0]), change(self.cpu[1])
            faster = own is not None and thread is not None and thread > own and thread > 0
            out.append(thread if faster else own if own is not None and own >= 0 else None)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("time__", kind="stable").drop_duplicates("time__", keep="last")
        names = ["time__", "prev__", "guard__", *self.carried]
        found = [dict(zip(names, (None if pd.isna(x) else int(x) for x in r)))
                 for r in batch[names].itertuples(index=False, name=None)]
        last = tuple(self.last.get()) if self.last.exists() else None
        timer = last[2] if last else None
        out = []
        for row in found:
            if last is not None and row["time__"] <= last[0]:
                continue   # late or repeated snapshots get no delta and leave the state alone
            out.append((row["time__"], *self._deltas(row, last)))
            last = (row["time__"], row["guard__"], None, *(row[c] for c in self.carried))
        if not out:
            return
        if self.ttl_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last[0] // 1000 + self.ttl_ms
            self.handle.registerTimer(timer)
        self.last.update((last[0], last[1], timer, *last[3:]))
        columns = {c: pd.array([k] * len(out)) for c, k in zip(self.entity, key)}
        columns["time__"] = pd.array([r[0] for r in out], dtype="Int64")
        for i, name in enumerate([*self.metrics, *([self.cpu[0]] if self.cpu else [])]):
            columns[f"{name}_delta"] = pd.array([r[1 + i] for r in out], dtype="Int64")
        yield pd.DataFrame(columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def snapshot_delta_stream(snapshots: DataFrame, entity: Sequence[str], metrics: Sequence[str],
                          time_col: str = "collection_time",
                          guard_col: str | None = "last_request_start_time",
                          signed: Sequence[str] = ("tempdb_current",),
                          cpu: tuple[str, str] | None = None,
                          state_ttl_ms: int | None = STATE_TTL_MS, watermark: str = "10 minutes") -> DataFrame:
    """T1 on a stream of snapshot rows, by ``transformWithStateInPandas``.

    State is kept per entity key (instance, session, request): the last
    snapshot time, request start and values, a few numbers per live request,
    so a hot instance spreads over its sessions. Each row must carry
    ``prev_collection_time`` (its instance's previous snapshot, written by the
    collector), which is how "present in both snapshots" is checked without
    instance-wide state. ``cpu`` names the request and thread counters of the
    CPU rule (thread delta if it is the larger and positive).

    All clocks are event time: an event-time timer drops the state of an entity
    whose last row is ``state_ttl_ms`` behind the watermark. While all
    collectors pause no event time passes, so the first snapshot after a pause
    of any length has its deltas, as in the batch form. One collector that
    pauses longer than ``state_ttl_ms`` (a week, unless set; None keeps state
    for ever) while others go on gets NULL deltas for its next snapshot. Rows
    more than ``watermark`` behind the newest are dropped.

    The operator needs the RocksDB state store; it is set on the session if
    the session names none.
    """
    spark = snapshots.sparkSession
    if not spark.conf.get(STATE_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)
    entity, metrics = list(entity), list(metrics)
    kind = {f.name: f.dataType for f in snapshots.schema.fields}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    carried = list(dict.fromkeys([*metrics, *(cpu or ())]))
    rows = snapshots.select(
        *entity, F.col(time_col).cast("timestamp").alias("event_time__"), micros(time_col).alias("time__"),
        micros("prev_collection_time").alias("prev__"),
        (micros(guard_col) if guard_col else F.lit(None).cast("bigint")).alias("guard__"),
        *[F.col(c).cast("bigint").alias(c) for c in carried]).withWatermark("event_time__", watermark)
    out_cols = [*metrics, *([cpu[0]] if cpu else [])]
    schema = ", ".join([*(f"`{c}` {kind[c].simpleString()}" for c in entity), "time__ bigint",
                        *(f"`{m}_delta` bigint" for m in out_cols)])
    out = rows.groupBy(*entity).transformWithStateInPandas(
        SnapshotDeltas(entity, metrics, set(signed), cpu, guard_col is not None, state_ttl_ms),
        schema, "Append", "EventTime")
    return out.select(*entity, F.timestamp_micros("time__").cast(kind[time_col]).alias(time_col),
                      *[f"{m}_delta" for m in out_cols])


# ------------------------------------------------------------- T3 + T5
def collect_batches(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str,
                    checkpoint: str, schema: T.StructType | None = None,
                    retention_days: int | None = None, trigger_seconds: int | None = 60,
                    query_name: str | None = None):
    """T3 + T5: run ``build`` (a batch report) on every micro-batch of raw
    snapshot rows and write the result, once, into ``path``.

    A batch's rows go to leaf folders of their own (date, collection, batch),
    written by a dynamic overwrite of these leaves only: a batch replayed after
    a failure (same batch id, same input from the checkpointed offsets)
    replaces its own files, and nothing else of the day is read or rewritten,
    so two collectors of one day do not meet. Retention (K7) runs after each
    write when ``retention_days`` is set, from the newest time the batch brought.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        out = build(batch)
        if schema is not None:
            out = history._conform(out, schema)
        out = out.withColumn("_batch_id", F.lit(batch_id).cast("bigint"))
        history.write_leaves(out, path, salt=f"b{batch_id}")
        if retention_days is not None:
            timed = batch if "collection_time" in batch.columns else out
            newest = timed.agg(F.max("collection_time")).first()[0]
            if newest is not None:
                history.purge_partitions(batch.sparkSession, path, newest, retention_days)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def sources_of_batch(batch: DataFrame, other_sources: Mapping) -> dict[str, DataFrame]:
    """The other sources as they are now, cut to the span of the batch's
    collection times by filters that reach the scan (and the folders, where
    a source is partitioned by ``collection_date``). A loader may give None:
    no such source yet."""
    t = F.col("collection_time")
    ntz, ts = t.cast("timestamp_ntz"), F.unix_micros(t.cast("timestamp"))
    span = batch.agg(F.min(ntz).cast("string").alias("ntz_from"), F.max(ntz).cast("string").alias("ntz_to"),
                     F.min(ts).alias("ts_from"), F.max(ts).alias("ts_to")).first()
    out = {}
    for name, source in other_sources.items():
        df = source(batch.sparkSession) if callable(source) else source
        if df is None:
            continue
        kinds = {f.name: f.dataType for f in df.schema.fields}
        kind = kinds.get("collection_time")
        if isinstance(kind, T.TimestampNTZType):
            low, high = (F.lit(span[x]).cast("timestamp_ntz") for x in ("ntz_from", "ntz_to"))
            df = df.where(t.between(low, high))
        elif isinstance(kind, T.TimestampType):
            df = df.where(t.between(*(F.timestamp_micros(F.lit(span[x]).cast("bigint")) for x in ("ts_from", "ts_to"))))
        if kind is not None and isinstance(kinds.get("collection_date"), T.DateType):
            # a day more on each side, as the writer may have had another time zone
            low, high = (F.lit(span[x]).cast("timestamp_ntz").cast("date") for x in ("ntz_from", "ntz_to"))
            df = df.where(F.col("collection_date").between(F.date_sub(low, 1), F.date_add(high, 1)))
        out[name] = df
    return out


def collect_activity_stream(processes: DataFrame,
                            other_sources: Mapping[str, Callable[[SparkSession], DataFrame | None] | DataFrame],
                            path: str, checkpoint: str,
                            options=None, retention_days: int | None = 30,
                            trigger_seconds: int | None = 60, query_name: str | None = None):
    """T3 + T5 for the activity report: process rows of new snapshots
    arrive on ``processes`` (a stream keyed by instance and collection
    time); every other source is a lake table joined on the same keys, so
    each micro-batch reports exactly the snapshots it brought. Rows are
    written by name in the history shape, with retention after each batch.

    ``other_sources`` holds loaders (``sources.snapshots.snapshot_loaders``),
    called for every batch, so files that came after the start are seen; the
    collector writes a snapshot's processes last. A DataFrame in place of a
    loader stands for a table that no longer changes: it keeps its first list
    of files.
    """
    from dbpulse.plans.options import ReportOptions
    from dbpulse.plans.report import activity_report
    from dbpulse.functions import scalars as S

    o = options or ReportOptions(get_transaction_info=True, get_outer_command=True, get_plans=1,
                                 format_output=0, output_column_list="[%]", sort_order="")
    fixed = sorted(n for n, x in other_sources.items() if not callable(x))
    if fixed:
        warnings.warn(f"read once, later files are not seen: {', '.join(fixed)}", stacklevel=2)

    def build(batch: DataFrame) -> DataFrame:
        rep = activity_report({**sources_of_batch(batch, other_sources), "processes": batch}, o, materialize=False)
        return (rep.withColumn("elapsed_text",
                               S.elapsed_text(S.elapsed_ms(F.col("start_time"), F.col("collection_time"))))
                .withColumn("collection_date", F.to_date("collection_time")))

    return collect_batches(processes, build, path, checkpoint, schema=history.ACTIVITY_HISTORY_SCHEMA,
                           retention_days=retention_days, trigger_seconds=trigger_seconds,
                           query_name=query_name)
