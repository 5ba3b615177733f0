from pyspark.sql import functions as F

from dbpulse.operators import filters


def names(spark, rows, **kw):
    df = spark.createDataFrame(rows, "session_id bigint, host_name string, program_name string, "
                                     "status string, open_tran_count bigint, is_user_process boolean")
    return sorted(r.session_id for r in filters.session_filter(df, **kw).collect())


ROWS = [(1, "HOST_1", "App_1", "running", 0, True),
        (2, "host_12", None, "running", 0, True),
        (3, None, "App_2", "running", 0, True),
        (4, "HOSTX", "app_3", "sleeping", 0, True),
        (5, "HOST_5", "App_5", "sleeping", 2, True),
        (6, "HOST_6", "App_6", "running", 0, False)]


def test_exclude_keeps_null_names_and_ignores_case(spark):
    got = names(spark, ROWS, exclude=("host", "host[_]1%"), show_sleeping=2, show_system=True)
    assert got == [3, 4, 5, 6]          # NULL host kept; HOST_1 and host_12 excluded, any case
    got = names(spark, ROWS, exclude=("host", "host_"), show_sleeping=2, show_system=True)
    assert got == [1, 2, 3, 5, 6]       # '_' is one character: only the 5-char HOSTX matches


def test_include_session_and_sleeping_levels(spark):
    assert names(spark, ROWS, include=("session", 0), show_sleeping=2, show_system=True) == [1, 2, 3, 4, 5, 6]
    assert names(spark, ROWS, include=("session", 3), show_sleeping=2, show_system=True) == [3]
    assert names(spark, ROWS, show_sleeping=0) == [1, 2, 3]
    assert names(spark, ROWS, show_sleeping=1) == [1, 2, 3, 5]
    assert names(spark, ROWS, show_sleeping=1, own_session_id=2) == [1, 3, 5]


def test_forced_blockers_bypass_filters(spark):
    df = spark.createDataFrame(ROWS, "session_id bigint, host_name string, program_name string, "
                                     "status string, open_tran_count bigint, is_user_process boolean")
    forced = spark.createDataFrame([(4,), (6,)], "session_id bigint")
    got = sorted(r.session_id for r in filters.session_filter(
        df, include=("program", "app[_]1"), forced=forced).collect())
    assert got == [1, 4, 6]
