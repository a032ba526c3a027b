"""Small golden cases of the workflow-history operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.functions import scalars as X
from flowsift.operators import boards as B
from flowsift.operators import books as K
from flowsift.operators import graphs as G
from flowsift.operators import history as H

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """(item, second, state) rows as transitions."""
    data = [(i, T0 + timedelta(seconds=s), "task", 1, item, state) for i, (item, s, state) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, ts timestamp, item_type string, flow long, item long, state string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_durations_need_a_start_just_before_the_finish(spark):
    df = events(spark, [(1, 0, "PENDING"), (1, 5, "RUNNING"), (1, 9, "SUCCESS"), (1, 12, "FAILURE"), (2, 0, "RUNNING"), (2, 3, "PENDING"), (2, 7, "SUCCESS")])
    assert [(r.item, r.duration) for r in H.durations(df).collect()] == [(1, 4.0)]
    assert rows(H.leftover_timers(events(spark, [(1, 0, "RUNNING"), (2, 0, "RUNNING"), (2, 1, "SUCCESS")]))) == [("task", 1)]


def test_verdicts(spark):
    df = spark.createDataFrame([("SUCCESS", "RUNNING"), ("PENDING", "SUSPENDED"), ("PENDING", "SUCCESS"), ("RUNNING", "RUNNING")], "a string, b string")
    assert [r[0] for r in df.select(H.verdict(F.col("a"), F.col("b"), "flow")).collect()] == ["ALLOWED", "IGNORED", "INVALID", "IGNORED"]
    assert [r[0] for r in df.select(H.verdict(F.col("a"), F.col("b"), "task")).collect()] == ["IGNORED"] * 4


def test_replay_refuses_and_goes_on(spark):
    out = H.replay_states(events(spark, [(1, 0, "SUCCESS"), (1, 1, "RUNNING"), (1, 2, "SUCCESS")]), "task", "PENDING").orderBy("seq")
    assert [(r.verdict, r.after) for r in out.collect()] == [("IGNORED", "PENDING"), ("ALLOWED", "RUNNING"), ("ALLOWED", "SUCCESS")]


def test_sequence_minus(spark):
    one = spark.createDataFrame([([1, 1, 1, 1], [1, 1, 3]), ([1, 2, 3, 1], [1, 3])], "a array<int>, b array<int>")
    assert [r[0] for r in one.select(K.array_minus(F.col("a"), F.col("b"))).collect()] == [[1, 1], [2, 1]]
    table = lambda x: spark.createDataFrame([("k", v, i) for i, v in enumerate(x)], "k string, v int, pos int")
    assert [r.v for r in K.sequence_minus(table([1, 2, 3, 1]), table([1, 3]), "k", "v", "pos").orderBy("pos").collect()] == [2, 1]


def test_backoff_clamp_and_errors(spark):
    assert [r[0] for r in spark.range(8).select(X.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]
    assert [r[0] for r in spark.range(1).select(X.clamp(F.lit(4.0), 2.0, 3.0)).collect()] == [3.0]
    with pytest.raises(ValueError):
        X.clamp(F.lit(1), 3, 2)


def test_as_int_and_newlines(spark):
    df = spark.createDataFrame([("2",), ("2.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.as_int(F.col("t"))).collect()] == [2, 2, None, None]
    assert spark.createDataFrame([("a\r\nb\rc\n",)], "t string").select(X.normalize_newlines(F.col("t"))).first()[0] == "a\nb\nc"


def test_board_orders(spark):
    jobs = spark.createDataFrame([(1, 1, 0, "LOW"), (2, 2, 0, "high"), (3, 3, 0, "HIGH")], "job long, sequence long, board long, priority string")
    order = lambda mode: [r.job for r in B.board_order(jobs, mode).orderBy("place").collect()]
    assert (order("contract"), order("ascending"), order("descending")) == ([2, 3, 1], [1, 2, 3], [3, 2, 1])


def test_arbitration(spark):
    c = [("post", "a"), ("claim", "a"), ("claim", "b"), ("abandon", "b"), ("consume", "a"), ("consume", "a")]
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=i), 1, who, cmd) for i, (cmd, who) in enumerate(c)], "seq long, ts timestamp, job long, who string, command string")
    assert [r.result for r in B.arbitrate_jobs(df).orderBy("seq").collect()] == ["OK", "OK", "ALREADY_CLAIMED", "WRONG_OWNER", "OK", "UNKNOWN_JOB"]


def test_sessions_end_at_the_boundary(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1, "t") for i, s in enumerate([0, 59, 119, 130])], "seq long, ts timestamp, topic long, task string")
    assert [r.beats for r in B.worker_sessions(df, 60).orderBy("session").collect()] == [2, 2]
    assert [r.beats for r in B.worker_sessions(df, 0).collect()] == [4]


def test_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3)], "src long, dst long")
    assert rows(G.topological_levels(nodes, edges)) == [(0, 0), (1, 1), (2, 2)]
    assert tuple(G.is_acyclic(nodes, edges).first()) == (False, 2)
    assert rows(G.ancestors(edges, nodes.where("node IN (2, 3)"))) == [(2, 0, 1), (2, 1, 1), (3, 4, 1)]
    tree = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)], "node long, parent long")
    assert sorted(r.distance for r in G.tree_paths(tree).where("node = 5").collect()) == [1, 2, 3, 4, 5]
    assert (5, 0, 0) in rows(G.child_counts(tree)) and (0, 1, 5) in rows(G.child_counts(tree))


def test_dependencies_and_symbols(spark):
    provides = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "b")], "flow string, atom long, name string")
    requires = spark.createDataFrame([("f", 4, "a"), ("f", 4, "b"), ("f", 5, "c")], "flow string, atom long, name string")
    assert rows(K.resolve_dependencies(provides, requires)) == [("f", 1, 4, "a")]
    assert {(r.name, r.status) for r in K.symbol_status(provides, requires).collect()} == {("a", "LINKED"), ("b", "AMBIGUOUS"), ("c", "UNSATISFIED")}


def test_claim_lost_as_of(spark):
    t = spark.createDataFrame([(1, T0 + timedelta(seconds=5), 10), (1, T0, 11)], "job long, ts timestamp, seq long")
    c = spark.createDataFrame([(1, T0 + timedelta(seconds=1), 1, "w1"), (1, T0 + timedelta(seconds=5), 2, "w2")], "job long, ts timestamp, seq long, owner string")
    assert rows(B.claim_lost(t, c, F.lit("w2"))) == [(1, 10, "w2", False), (1, 11, None, True)]


def test_functors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert X.reduce_columns(df, lambda x, y: x - y, ["a", "b", "c"], "r").first().r == -4
    assert tuple(X.map_columns(df, lambda x: x * 2, ["a", "b"], ["x", "y"]).select("x", "y").first()) == (2, 4)
    with pytest.raises(ValueError):
        X.reduce_columns(df, lambda x, y: x, ["a"], "r")


def test_median_is_exact_and_needs_no_buffer_of_a_whole_type(spark, capsys):
    import statistics

    rng = random.Random(11)
    rows = [("t", float(rng.randrange(300))) for _ in range(1501)] + [("r", rng.random()) for _ in range(1000)] + [("one", 2.5), ("two", 1.0), ("two", 4.0), ("same", 3.0), ("same", 3.0), ("none", None), ("t", None)]
    out = H.duration_stats(spark.createDataFrame(rows, "item_type string, duration double").repartition(7))
    got = {r.item_type: r for r in out.collect()}
    for kind in {k for k, _ in rows}:
        d = [x for k, x in rows if k == kind and x is not None]
        assert got[kind].n == sum(k == kind for k, _ in rows)
        assert (got[kind].least, got[kind].most) == ((min(d), max(d)) if d else (None, None))
        assert got[kind].median == (round(statistics.median(d), 4) if d else None) and (not d or abs(got[kind].mean - statistics.mean(d)) < 1e-4)
    out.explain(True)
    assert "percentile" not in capsys.readouterr().out.lower()


def test_places_on_one_large_board_are_many_tasks_work(spark):
    rng = random.Random(12)
    rows = [(j, None if j % 50 == 0 else "b" if j % 9 else "c", rng.choice(["LOW", "NORMAL", "HIGH"]), rng.randrange(10**9)) for j in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = B.board_order(spark.createDataFrame(rows, "job int, board string, priority string, sequence long"))
        got = {r.job: r.place for r in out.collect()}
        parts = [r["count"] for r in out.where("board = 'b'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for board in ("b", "c", None):
        ordered = sorted((r for r in rows if r[1] == board), key=lambda r: (["HIGH", "NORMAL", "LOW"].index(r[2]), r[3]))
        assert [got[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))
    assert len(parts) > 1
