"""Transaction log use per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.functions.numeric import idiv


def transaction_summary(active: DataFrame, database_tx: DataFrame, session_tx: DataFrame,
                        sessions: DataFrame, keys: Sequence[str] = (),
                        last_collection_start: Column | None = None,
                        database_names: DataFrame | None = None) -> DataFrame:
    """Per (keys, session, request): ``tran_log_writes`` text and
    ``tran_start_time``.

    J9: active transactions (begun by the collection start) join their
    per-database rows (the internal database 32767 left out) and, left, the
    session map. J10: each transaction goes to the collected request that
    names it, or else to a request of the session that owns it — the lowest
    request id wins; transactions with no candidate are dropped. A5: log
    records summed, log bytes summed and divided by 1024, earliest begin,
    per (request, database). W9 + A12: databases are listed latest-start
    first as ``db: records (kB kB)`` joined by commas; the reported start
    is that of the first listed database.
    """
    keys = list(keys)
    a = active
    if last_collection_start is not None:
        a = a.filter(F.col("transaction_begin_time") <= last_collection_start)
    per_tran = [*keys, "transaction_id"]
    s_tran = database_tx.filter(F.col("database_id") < 32767)
    # J9 + A5, first half: one row per transaction and database, before any join
    per_db = (s_tran.join(a.select(*per_tran).distinct(), on=per_tran, how="left_semi")
              .groupBy(*per_tran, "database_id")
              .agg(F.sum("log_record_count").alias("_records"), F.sum("log_bytes_used").alias("_bytes"),
                   F.min("database_transaction_begin_time").alias("_begin")))
    # Each side is brought to one candidate per transaction before they
    # meet: the lowest request that names it, and the lowest request of each
    # owner; an owner's requests are never paired with its transactions
    lowest = F.min(F.struct("request_id", "session_id"))
    sess = sessions.select(*keys, "session_id", "request_id", "transaction_id")
    by_tran = (sess.filter(F.col("transaction_id").isNotNull()).groupBy(*per_tran).agg(lowest.alias("_pick")))
    by_owner = (session_tx.select(*per_tran, "session_id").distinct()
                .join(sess.groupBy(*keys, "session_id").agg(F.min("request_id").alias("request_id")),
                      on=[*keys, "session_id"], how="inner")
                .groupBy(*per_tran).agg(lowest.alias("_pick")))
    tmap = (by_tran.unionByName(by_owner).groupBy(*per_tran).agg(F.min("_pick").alias("_pick"))
            .select(*per_tran, F.col("_pick.session_id").alias("session_id"), F.col("_pick.request_id").alias("request_id")))
    # a transaction may have several owners; each repeats its log rows, as the left join on the owners does
    owners = session_tx.groupBy(*per_tran).agg(F.count(F.lit(1)).alias("_owners"))
    begun = a.groupBy(*per_tran).agg(F.count(F.lit(1)).alias("_begun"))
    times = F.coalesce(F.col("_owners"), F.lit(1)) * F.col("_begun")
    per_db = (per_db.join(tmap, on=per_tran, how="inner").join(begun, on=per_tran, how="inner")
              .join(owners, on=per_tran, how="left")
              .groupBy(*keys, "session_id", "request_id", "database_id")
              .agg(F.coalesce(F.sum(F.col("_records") * times), F.lit(0)).alias("log_record_count"),
                   idiv(F.coalesce(F.sum(F.col("_bytes") * times), F.lit(0)), F.lit(1024)).alias("log_kb_used"),
                   F.min("_begin").alias("transaction_start_time")))
    if database_names is not None:
        per_db = per_db.join(database_names.select(*keys, "database_id", F.col("name").alias("_db")),
                             on=[*keys, "database_id"], how="left")
        db_text = F.coalesce(F.col("_db"), F.lit("(null)"))
    else:
        db_text = F.col("database_id").cast("string")
    order = Window.partitionBy(*keys, "session_id", "request_id").orderBy(
        F.col("transaction_start_time").desc_nulls_last(), F.col("database_id"))
    item = F.concat(db_text, F.lit(": "), F.col("log_record_count").cast("string"), F.lit(" ("),
                    F.col("log_kb_used").cast("string"), F.lit(" kB)"))
    ranked = per_db.withColumn("_r", F.row_number().over(order)).withColumn("_t", item)
    # Bounded list: one element per database a request touched.
    return (ranked.groupBy(*keys, "session_id", "request_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))),
                                          lambda x: x["_t"]), ",").alias("tran_log_writes"),
                 F.min_by("transaction_start_time", "_r").alias("tran_start_time")))
