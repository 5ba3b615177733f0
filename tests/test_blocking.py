from pyspark.sql import functions as F

from dbpulse.operators.blocking import block_leaders, blocker_closure


def counts(spark, edges):
    df = spark.createDataFrame(edges, "session_id bigint, request_id bigint, blocked bigint")
    return {r.session_id: r.blocked_session_count for r in block_leaders(df).collect()}


def test_chain_star_cycle_self_missing(spark):
    edges = [(1, 0, 0), (2, 0, 1), (3, 0, 2),            # chain 1 <- 2 <- 3
             (10, 0, 0), (11, 0, 10), (12, 0, 10), (13, 0, 10),  # star
             (20, 0, 21), (21, 0, 20),                   # two-cycle
             (30, 0, 30),                                # self-block
             (40, 0, 99)]                                # blocker not in snapshot
    got = counts(spark, edges)
    assert got[1] == 2 and got[2] == 1 and got[3] == 0
    assert got[10] == 3 and got[11] == 0
    assert got[20] == 1 and got[21] == 1
    assert got[30] == 0 and got[40] == 0
    assert 99 not in got


def test_two_request_rows_count_distinct_sessions(spark):
    edges = [(1, 0, 0), (2, 0, 1), (2, 1, 1), (3, 0, 2)]
    got = counts(spark, edges)
    assert got[1] == 2 and got[2] == 1


def test_forest_sum_of_counts_is_sum_of_depths(spark):
    edges = [(n, 0, n // 2 if n > 1 else 0) for n in range(1, 64)]
    got = counts(spark, edges)
    depth = {1: 0}
    for n in range(2, 64):
        depth[n] = depth[n // 2] + 1
    assert sum(got.values()) == sum(depth.values())


def test_closure_adds_blockers_until_done(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 2), (4, 0, 77), (5, 0, 0)],
                                 "session_id bigint, request_id bigint, blocked bigint")
    seeds = rows.filter(F.col("session_id").isin(3, 4))
    got = {r.session_id: r.closure_round for r in blocker_closure(rows, seeds).collect()}
    assert got == {3: 0, 4: 0, 2: 1, 1: 2}


def test_multi_instance_isolation(spark):
    rows = [(i, s, 0, b) for i in ("a", "b") for s, b in [(1, 0), (2, 1), (3, 2), (4, 1)]]
    rows += [("b", 5, 0, 4)]
    df = spark.createDataFrame(rows, "instance_id string, session_id bigint, request_id bigint, blocked bigint")
    both = {(r.instance_id, r.session_id): r.blocked_session_count
            for r in block_leaders(df, keys=["instance_id"]).collect()}
    for inst in ("a", "b"):
        one = {r.session_id: r.blocked_session_count
               for r in block_leaders(df.filter(F.col("instance_id") == inst).drop("instance_id")).collect()}
        assert one == {s: c for (i, s), c in both.items() if i == inst}
    assert both[("a", 1)] == 3 and both[("b", 1)] == 4


def test_source_list_wildcard_broker_and_blockers(spark):
    from dbpulse.operators.filters import session_filter
    from dbpulse.operators.sessions import collapse_processes, join_sources
    cols = ("session_id bigint, request_id bigint, login_time timestamp_ntz, last_batch timestamp_ntz, status string, "
            "cmd string, stmt_start int, stmt_end int, host_name string, login_name string, program_name string, "
            "database_id int, memory_usage int, open_tran_count int, wait_type string, wait_resource string, "
            "wait_time int, blocked bigint, hostprocess string")
    row = lambda s, program, host, blocked=0: (
        s, 0, None, None, "running", "SELECT", 0, 0, "h", "l", program, 1, 1, 0, "W", "", 1, blocked, host)
    procs = spark.createDataFrame([row(1, "App", "12"), row(2, "App", ""), row(3, "Worker", ""), row(4, "App", "", 0),
                                   row(5, "App", "9", 4)], cols)
    broker = spark.createDataFrame([(2, 5, 77), (3, 5, 78), (2, 5, 12), (9, 1, 1)],
                                   "session_id bigint, database_id bigint, queue_id bigint")
    first = collapse_processes(join_sources(procs, broker_tasks=broker))
    got = {r.session_id: (r.program_name, r.named) for r in first.collect()}
    # the label takes part in the MAX with the program name, the larger queue text wins
    assert got == {1: ("App", False), 2: ("Service Broker database_id: 5 queue_id: 77", True), 3: ("Worker", True),
                   4: ("App", False), 5: ("App", False)}
    # a system session named by the list passes the filter on system sessions
    assert {r.session_id for r in session_filter(first).collect()} == {1, 2, 3, 5}
    wanted = spark.createDataFrame([(4,), (4,), (99,)], "session_id bigint")
    later = collapse_processes(join_sources(procs, blockers=wanted, broker_tasks=broker, first_pass=False))
    assert [(r.session_id, r.program_name, r.named) for r in later.collect()] == [(4, "App", True)]


def test_bitmaps_equal_reachability_on_random_graphs(spark):
    import random

    import dbpulse.operators.blocking as blocking
    rng = random.Random(4)
    edges = set()
    for snap in ("a", "b", None):
        ids = [rng.randrange(-70, 2_000_000_000) for _ in range(8)] + list(range(1, 60))
        for _ in range(rng.choice([60, 110])):
            a, b = rng.sample(ids, 2)
            edges.add((snap, a, b))
    want = {}
    for snap, root, _ in edges:
        seen, todo = set(), [root]
        while todo:
            n = todo.pop()
            for s, p, c in edges:
                if s == snap and p == n and c not in seen:
                    seen.add(c)
                    todo.append(c)
        want[snap, root] = len(seen - {root})
    df = spark.createDataFrame(sorted(edges, key=str), "k string, parent bigint, child bigint")
    got = {(r.k, r.session_id): r.blocked_session_count for r in blocking._bitmap_counts(df, ["k"]).collect()}
    assert got == want


def test_bitmaps_take_logarithmic_rounds(spark, monkeypatch):
    import dbpulse.operators.blocking as blocking
    rounds = []
    monkeypatch.setattr(blocking, "cut_lineage", lambda df, f=blocking.cut_lineage: (rounds.append(1), f(df))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(200, 1)], "parent bigint, child bigint")
    got = {r.session_id: r.blocked_session_count for r in blocking._bitmap_counts(chain, []).collect()}
    assert got == {i: 199 for i in range(1, 201)} and len(rounds) <= 10


def test_multi_parent_graph_counts_distinct(spark):
    # session 3 has two requests blocked by different sessions (1 and 2);
    # 2 is itself blocked by 1, so 1 reaches 3 along two paths
    edges = [(1, 0, 0), (2, 0, 1), (3, 0, 1), (3, 1, 2), (4, 0, 3)]
    got = counts(spark, edges)
    assert got == {1: 3, 2: 2, 3: 1, 4: 0}


def test_functional_cycle_with_tail(spark):
    edges = [(7, 0, 8), (8, 0, 7), (9, 0, 8), (10, 0, 9)]
    got = counts(spark, edges)
    assert got == {7: 3, 8: 3, 9: 1, 10: 0}


def test_hot_blocker_with_a_third_of_all_sessions(spark):
    n = 9000
    rows = [(1, 0, 0)]
    rows += [(s, 0, 1) for s in range(2, 3002)]                 # 3000 sessions behind session 1
    rows += [(s, 0, s - 1 if s % 3 else 0) for s in range(3002, n + 1)]  # short chains
    parent = {s: b for s, _, b in rows}
    children = {}
    for s, b in parent.items():
        if b:
            children.setdefault(b, []).append(s)

    def below(s):
        out, stack = 0, list(children.get(s, []))
        while stack:
            x = stack.pop()
            out += 1
            stack += children.get(x, [])
        return out

    got = counts(spark, rows)
    assert got[1] == below(1) >= 3000
    assert all(got[s] == below(s) for s in (2, 3002, 3003, 3004, 4500, n))
    assert sum(got.values()) == sum(below(s) for s in parent)

    df = spark.createDataFrame(rows, "session_id bigint, request_id bigint, blocked bigint")
    seeds = df.filter(F.col("session_id").between(2, 3001))
    closed = blocker_closure(df, seeds)
    assert closed.count() == 3001 and closed.filter(F.col("closure_round") == 1).count() == 1


def brute_below(edges):
    up = {}
    for s, _, b in edges:
        if b and b != s:
            up.setdefault(b, set()).add(s)
    out = {}
    for s in {e[0] for e in edges}:
        seen, todo = set(), [s]
        while todo:
            for c in up.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out[s] = len(seen - {s})
    return out


def test_random_graphs_with_rings_and_several_blockers(spark):
    import random
    for seed, several in ((1, False), (2, False), (3, True)):
        rnd = random.Random(seed)
        edges = [(n, 0, rnd.choice([0, rnd.randint(1, 40), max(1, n - 1)])) for n in range(1, 41)]
        if several:
            edges += [(n, 1, rnd.randint(1, 40)) for n in range(1, 41, 7)]
        assert counts(spark, edges) == brute_below(edges)


def test_a_deep_chain_needs_few_rounds(spark):
    edges = [(n, 0, n - 1) for n in range(1, 3001)]
    got = counts(spark, edges)
    assert got[1] == 2999 and got[3000] == 0 and got[1500] == 1500


def test_snapshots_with_and_without_several_blockers(spark):
    a, b = [(1, 0, 0), (2, 0, 1), (3, 0, 2)], [(1, 0, 0), (2, 0, 1), (3, 0, 1), (3, 1, 2)]
    df = spark.createDataFrame([("a", *e) for e in a] + [("b", *e) for e in b],
                               "instance_id string, session_id bigint, request_id bigint, blocked bigint")
    got = {(r.instance_id, r.session_id): r.blocked_session_count for r in block_leaders(df, ["instance_id"]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("a", 3): 0, ("b", 1): 2, ("b", 2): 1, ("b", 3): 0}


def test_bitmap_rounds_make_no_row_of_a_bit(spark, monkeypatch):
    import dbpulse.operators.blocking as blocking
    sent = []

    def watched(df, f=blocking.cut_lineage):
        out = f(df)
        sent.append(out.count())
        return out

    monkeypatch.setattr(blocking, "cut_lineage", watched)
    n = 640   # every session but the last blocks all later ones, ten words in all
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in (i + 1, i + 2, (i + 64) // 64 * 64) if i < j < n],
                                  "parent bigint, child bigint")
    got = {r.session_id: r.blocked_session_count for r in blocking._bitmap_counts(edges, []).collect()}
    assert got == {i: n - 1 - i for i in range(n - 1)}
    # words as wholes: a level within a word takes no round of its own
    assert len(sent) <= 6 and max(sent) <= n * n // 64


def test_bitmaps_in_parts(spark, monkeypatch):
    import random

    import dbpulse.operators.blocking as blocking
    rnd = random.Random(8)
    edges = [(n, 0, rnd.randint(1, 300)) for n in range(1, 301)] + [(n, 1, rnd.randint(1, 300)) for n in range(1, 301, 3)]
    monkeypatch.setattr(blocking, "TILE_ENTRIES", 40)
    assert counts(spark, edges) == brute_below(edges)
