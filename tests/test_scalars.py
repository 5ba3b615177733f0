from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.functions.numeric import round_div


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_page_type_order(spark):
    pages = [0, 1, 2, 3, 6, 7, 8, 8088, 16176, 511232, 511233, 511238, 511239, None]
    got = one(spark, [(p,) for p in pages], "n bigint", S.page_type(F.col("n")))
    assert got == ["PFS", "PFS", "GAM", "SGAM", "DCM", "BCM", "*", "PFS", "PFS", "GAM", "SGAM",
                   "DCM", "BCM", None]


def test_wait_text(spark):
    rows = [(1, 5, 5, 5), (2, 5, 7, 9), (2, 5, 5, 5), (3, 1, 4, 9), (3, 4, 4, 4), (None, None, None, None)]
    got = one(spark, rows, "n bigint, a bigint, b bigint, c bigint",
              S.wait_text(F.col("n"), F.col("a"), F.col("b"), F.col("c"), F.lit("LCK_M_X")))
    assert got == ["(1x: 5ms)LCK_M_X", "(2x: 5/9ms)LCK_M_X", "(2x: 5ms)LCK_M_X",
                   "(3x: 1/4/9ms)LCK_M_X", "(3x: 4ms)LCK_M_X", None]


def test_kv_extract(spark):
    rows = [("a=1",), ("x objid=42",), ("objid= rest",), ("objid=abc dbid=3",)]
    got = one(spark, rows, "t string", S.kv_extract(F.col("t"), "objid="))
    assert got == [None, "42", None, "abc"]
    got = one(spark, rows, "t string", S.kv_extract_long(F.col("t"), "objid="))
    assert got == [None, 42, None, None]
    got = one(spark, [("object_id = 7, index_id or stats_id = 2",)], "t string",
              S.kv_extract(F.col("t"), "object_id = ", ","))
    assert got == ["7"]


def test_elapsed_text(spark):
    ms = [0, 999, 86399999, 86400000, 8640000000, 576 * 3600000 + 1, -1500]
    got = one(spark, [(m,) for m in ms], "m bigint", S.elapsed_text(F.col("m"), 2))
    assert got == ["00 00:00:00.000", "00 00:00:00.999", "00 23:59:59.999", "01 00:00:00.000",
                   "100 00:00:00.000", "24 00:00:00.001", "-00 00:00:01.500"]
    got = one(spark, [(86400000,)], "m bigint", S.elapsed_text(F.col("m"), 3))
    assert got == ["001 00:00:00.000"]


def test_count_text(spark):
    got = one(spark, [(1234567,), (0,)], "n bigint", S.count_text(F.col("n")))
    assert got == ["          1,234,567", "                  0"]
    got = one(spark, [(1234567890123456,), (-9223372036854775807,)], "n bigint", S.count_text(F.col("n")))
    assert got == ["1,234,567,890,123,456", "-9,223,372,036,854,775,807"]


def test_like_has_no_escape_of_its_own(spark):
    rows = [("CORP\\alice",), ("corp\\bob",), ("CORP_x",), ("CORPyx",), (None,)]
    match = lambda pattern: [r[0] for r in spark.createDataFrame(rows, "h string").filter(S.like(F.col("h"), pattern)).collect()]
    assert match("CORP\\a%") == ["CORP\\alice"]
    assert match("corp[_]%") == ["CORP_x"] and match("corp_x") == ["CORP_x", "CORPyx"]
    assert match("%\\%") == ["CORP\\alice", "corp\\bob"]


def test_statement_slice(spark):
    text = "SELECT 1; UPDATE t SET a = 1; SELECT 2"
    rows = [(text, 20, 56), (text, 20, -1), (text, 0, 30), (text, 200, 400), (text, 4, 10)]
    got = one(spark, rows, "t string, s bigint, e bigint",
              S.statement_slice(F.col("t"), F.col("s"), F.col("e")))
    assert got[0] == text[10:29]
    assert got[1] == text[10:]
    assert got[2] == text          # zero start: whole text, trimmed
    assert got[3] == text          # text shorter than the end offset
    assert got[4] == text          # cut between two alphanumerics


def test_scrub_control(spark):
    got = one(spark, [("a\x07b\tc\nd\x00e\x1f",)], "t string", S.scrub_control(F.col("t")))
    assert got == ["a?b\tc\nde?"]


def test_wait_suffix(spark):
    rows = [("PAGEIOLATCH_SH", "5:1:8088"), ("CXPACKET", "exchangeEvent id=p nodeId=12 x"),
            ("LATCH_EX", "ACCESS_METHODS (0x1)"), ("OLEDB", "LINK (SPID=77)"), ("LCK_M_X", "x")]
    got = one(spark, rows, "w string, r string", S.wait_suffix(F.col("w"), F.col("r")))
    assert got == [":5:1(PFS)", ":12 x", " [ACCESS_METHODS]", "[LINK:77]", ""]


def test_guid_and_agent(spark):
    name = "SQLAgent - TSQL JobStep (Job 0x00112233445566778899AABBCCDDEEFF : Step 3)"
    df = spark.createDataFrame([(name,), ("adhoc",)], "p string")
    r = df.select(S.agent_job_hex(F.col("p")).alias("h"), S.agent_step_id(F.col("p")).alias("s")) \
          .select("s", S.hex_to_guid(F.col("h")).alias("g")).collect()
    assert r[0]["s"] == 3 and r[0]["g"] == "33221100-5544-7766-8899-AABBCCDDEEFF"
    assert r[1]["s"] is None and r[1]["g"] is None


def test_round_to_minute_and_div(spark):
    df = spark.createDataFrame([("2024-01-31 23:59:31",), ("2024-01-31 23:59:29",)], "t string")
    got = [r[0] for r in df.select(S.round_to_minute(F.col("t").cast("timestamp_ntz")).cast("string")).collect()]
    assert got == ["2024-02-01 00:00:00", "2024-01-31 23:59:00"]
    got = one(spark, [(5, 1000), (-5, 1000), (1, 32), (496, 100000)], "a bigint, b bigint",
              round_div(F.col("a"), F.col("b"), 2).cast("string"))
    assert got == ["0.01", "-0.01", "0.03", "0.00"]


def test_labels_and_handles(spark):
    df = spark.createDataFrame([(1, 0, "OBJECT", ""), (0, 5, "METADATA", "SCHEMA"), (None, 9, "KEY", None)],
                               "flag int, iso int, t string, st string")
    got = df.select(S.on_off(F.col("flag")).alias("f"), S.isolation_level_text(F.col("iso")).alias("i"),
                    S.resource_type_text(F.col("t"), F.col("st")).alias("r")).collect()
    assert [(r.f, r.i, r.r) for r in got] == [("ON", "Unspecified", "OBJECT"),
                                             ("OFF", "Snapshot", "METADATA.SCHEMA"),
                                             (None, None, "KEY")]
    h = spark.createDataFrame([(bytearray(b"\x01\xab"),)], "h binary").select(S.handle_hex(F.col("h"))).first()[0]
    assert h == "0x01ab"


def test_block_info_record(spark):
    rows = [("LCK_M_S", "objectlock lockPartition=0 objid=1977058079 subresource=FULL dbid=5 id=lock1", 52),
            ("LCK_M_X", "pagelock fileid=1 pageid=9 dbid=7 associatedObjectId=720575 id=lock2", 52),
            ("LCK_M_X", "keylock hobtid=720576 dbid=7 id=lock3", None),
            ("PAGELATCH_EX", "7:1:9", 52)]
    df = spark.createDataFrame(rows, "w string, r string, b bigint")
    got = [r[0] for r in df.select(S.block_info(F.col("w"), F.col("r"), F.col("b"))).collect()]
    assert got[0].lock_type == "objectlock" and got[0].object_id == "1977058079" and got[0].database_id == 5
    assert got[1].hobt_id == "720575" and got[1].object_id is None
    assert got[2] is None and got[3] is None
