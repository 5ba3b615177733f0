"""Every registered query against its DuckDB oracle on the smoke tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from dbpulse.plans import catalog
from dbpulse.sources.tables import TABLES, table_path

from lake_paths import SF_SMOKE

catalog.load_all()
ORACLES, QUERIES = catalog.ORACLES, catalog.QUERIES


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMOKE, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMOKE)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = _canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_runs(spark):
    for name, fn in QUERIES.items():
        if name not in ORACLES:
            assert fn(spark, SF_SMOKE).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["t1_snapshot_delta", "k1_wait_history", "j2_j3_p9_overlay",
                                  "c7_c8_formatting"])
def test_results_do_not_depend_on_session_zone(spark, duck, name):
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "Asia/Kolkata")
    try:
        df = QUERIES[name](spark, SF_SMOKE)
        got = _canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set(key, before)
    cur = duck.execute(ORACLES[name])
    want = _canon([d[0] for d in cur.description], cur.fetchall())
    assert got == want
