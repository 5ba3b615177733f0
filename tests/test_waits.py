from dbpulse.operators.waits import wait_pareto


def run(spark, rows):
    df = spark.createDataFrame(rows, "instance_id string, wait_type string, wait_time_ms bigint, "
                                     "signal_wait_time_ms bigint, waiting_tasks_count bigint")
    return [(r.instance_id, r.wait_type) for r in
            wait_pareto(df).orderBy("instance_id", "wait_rank").collect()]


def test_prefix_and_crossing_row(spark):
    rows = [("a", "W1", 50, 0, 1), ("a", "W2", 30, 0, 1), ("a", "W3", 16, 0, 1), ("a", "W4", 4, 0, 1)]
    # before W4 the share is 96% >= 95: W4 is dropped; W3 crosses the line and stays
    assert run(spark, rows) == [("a", "W1"), ("a", "W2"), ("a", "W3")]


def test_exactly_95_percent_stops(spark):
    rows = [("a", "W1", 95, 0, 1), ("a", "W2", 5, 0, 1)]
    assert run(spark, rows) == [("a", "W1")]


def test_ties_single_and_zero(spark):
    rows = [("a", "WB", 10, 0, 1), ("a", "WA", 10, 0, 1),
            ("b", "ONLY", 7, 0, 1),
            ("c", "Z1", 0, 0, 1), ("c", "Z2", 0, 0, 3)]
    assert run(spark, rows) == [("a", "WA"), ("a", "WB"), ("b", "ONLY")]


def test_benign_and_idle_types_excluded(spark):
    rows = [("a", "SLEEP_TASK", 1000, 0, 5), ("a", "W1", 10, 0, 0), ("a", "W2", 10, 0, 1)]
    assert run(spark, rows) == [("a", "W2")]


def test_multi_instance_isolation(spark):
    a = [("a", f"W{i}", 100 - i, 0, 1) for i in range(30)]
    b = [("b", f"W{i}", 10 + i * i, 0, 1) for i in range(30)]
    both = run(spark, a + b)
    assert both == run(spark, a) + run(spark, b)


def test_pareto_properties_random_groups(spark):
    """Per group: the result is a prefix of the ranking; the kept share
    reaches 95 % or every type is kept; without its last row the share is
    below 95 %."""
    import random
    rnd = random.Random(7)
    rows = []
    for g in range(40):
        n = rnd.randint(1, 25)
        for i in range(n):
            ms = rnd.choice([0, 1, 5, 10, 100, 1000, rnd.randint(1, 10 ** 6)])
            rows.append((f"g{g}", f"W{i}", ms, ms // 3, rnd.randint(1, 50)))
    df = spark.createDataFrame(rows, "instance_id string, wait_type string, wait_time_ms bigint, "
                                     "signal_wait_time_ms bigint, waiting_tasks_count bigint")
    kept = {}
    for r in wait_pareto(df).collect():
        kept.setdefault(r.instance_id, []).append((r.wait_rank, r.wait_type))
    by_group = {}
    for inst, wt, ms, _, _ in rows:
        by_group.setdefault(inst, []).append((wt, ms))
    for inst, types in by_group.items():
        ranking = sorted(types, key=lambda t: (-t[1], t[0]))
        total = sum(ms for _, ms in ranking)
        got = [wt for _, wt in sorted(kept.get(inst, []))]
        if total == 0:
            assert got == []
            continue
        assert got == [wt for wt, _ in ranking[:len(got)]]          # prefix
        share = sum(ms for _, ms in ranking[:len(got)])
        assert 100 * share >= 95 * total or len(got) == len(ranking)
        assert 100 * (share - ranking[len(got) - 1][1]) < 95 * total
