"""One group with most rows, as many groups as rows, null keys, cycles."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import boards as B
from flowsift.operators import books as K
from flowsift.operators import graphs as G
from flowsift.operators import history as H

T0 = datetime(2024, 1, 1)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("groups", [[1] * 300 + list(range(2, 302)) + [None] * 5, list(range(600)), [7] * 500, []])
def test_places_and_sums_of_any_groups(spark, uncoalesced, groups):
    rng = random.Random(1)
    rows = [(g, rng.randrange(50), i, rng.randrange(9)) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g long, o long, id long, v long")
    want, sums = {}, {}
    for g in set(groups):
        total = 0
        for n, r in enumerate(sorted((r[1], r[2], r[3]) for r in rows if r[0] == g)):
            want[r[1]], sums[r[1]] = n + 1, total
            total += r[2]
    placed = B.placed(df, "g", [F.asc("o"), F.asc("id")])
    assert {r.id: r.place for r in placed.collect()} == want and placed.columns == ["g", "o", "id", "v", "place"]
    assert {r.id: r.before for r in G.running_sums(df, "g", [F.asc("o"), F.asc("id")], "v").collect()} == sums


def test_what_goes_on_from_range_to_range_is_small(spark, uncoalesced):
    df = spark.range(5000).select((F.col("id") / 2).cast("long").alias("g"), "id").repartitionByRange(4, "g", "id").withColumn("__part", F.spark_partition_id())
    assert G.earlier_ranges(df, "g", F.count("*")).count() <= 4


def test_null_items_change_no_other_one(spark, uncoalesced):
    rng = random.Random(3)
    states = ["PENDING", "RUNNING", "SUCCESS", "FAILURE", "REVERTING", "REVERTED"]
    rows = [(i, T0 + timedelta(seconds=i), "task", 1, None if i % 800 == 0 else 1, rng.choice(states)) for i in range(4000)] + [(5000 + i, T0, "task", 1, 2**60 + i, "RUNNING") for i in range(3)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, item_type string, flow long, item long, state string")
    moves = set(H.ALLOWED["task"])
    now, want = {}, {}
    for seq, _, _, _, item, state in rows:
        old = now.setdefault(item, "PENDING")
        now[item] = state if (old, state) in moves else old
        want[seq] = (item, old, now[item])
    assert {r.seq: (r.item, r.old_state, r.after) for r in H.replay_states(df, "task", "PENDING").collect()} == want


def commands(rng, n, jobs, start=0):
    out = []
    for i in range(n):
        c = rng.choice(["post", "claim", "claim", "extend", "abandon", "consume", "trash", "claim"])
        expiry = rng.choice([None, 5.0, 40.0, 0.0]) if c in ("claim", "extend") else None
        out.append((rng.choice(jobs), T0 + timedelta(seconds=start + i // 2), start + i, rng.choice(["a", "b", "c", " "]), c, expiry))
    return out


QUIET = [(1, T0, 0, "a", "post", None), (1, T0, 1, "a", "claim", None)] + [(1, T0 + timedelta(seconds=i), i, "bcd"[i % 3], "claim", None) for i in range(2, 3000)]


@pytest.mark.parametrize("case", ["mixed", "one", "quiet", "late", "none"])
def test_one_job_with_most_commands_is_many_ranges(spark, uncoalesced, monkeypatch, case):
    rng = random.Random(11)
    rows = {
        "mixed": commands(rng, 1500, [1] * 8 + [2, 3, None, 2**60]), "one": commands(rng, 2000, [5]), "quiet": QUIET, "none": [],
        "late": [(1, T0, 0, "a", "post", None), (1, T0, 1, "a", "claim", 1500.0)] + [(1, T0 + timedelta(seconds=i), i, "bc"[i % 2], "claim" if i % 5 else "abandon", None) for i in range(2, 3000)],
    }[case]
    boards, want = {}, {}
    for job, ts, seq, who, c, e in sorted(rows, key=lambda r: (r[1], r[2])):
        want[seq] = (job, boards.setdefault(job, B.Board()).take(c, who, round((ts - T0).total_seconds() * 1e6) + 1704067200000000, e))
    df = spark.createDataFrame(rows, "job long, ts timestamp, seq long, who string, command string, expiry_s double").repartition(8)
    passes = []
    ran = B._ran
    monkeypatch.setattr(B, "_ran", lambda dealt, ask: passes.append(len(ask)) or ran(dealt, ask))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = B.arbitrate_jobs(df).collect()
        final = B.final_board(df, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.seq: (r.job, r.result) for r in got} == want
    assert sorted((repr(r.job), r.modified) for r in final) == sorted((repr(j), b.modified) for j, b in boards.items())
    assert sum(passes) < 60 and len(passes) <= 8


def test_owner_that_no_range_names_is_predicted(spark, uncoalesced, monkeypatch):
    passes = []
    ran = B._ran
    monkeypatch.setattr(B, "_ran", lambda dealt, ask: passes.append(len(ask)) or ran(dealt, ask))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = B.arbitrate_jobs(spark.createDataFrame(QUIET, "job long, ts timestamp, seq long, who string, command string, expiry_s double")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.result == "ALREADY_CLAIMED" for r in got) == 2998 and len(passes) == 1 and passes[0] >= 10


def test_cycles_of_parents_are_errors(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node long, parent long")
    for f in (lambda: G.climb(ring, F.lit(1), lambda x, y: x + y), lambda: G.descendant_counts(ring), lambda: G.tree_paths(ring)):
        with pytest.raises(ValueError):
            f()


def test_a_root_with_most_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 50)
    tree = spark.createDataFrame([(0, None)] + [(i, 0 if i < 400 else i - 399) for i in range(1, 700)], "node long, parent long")
    counts = {r.node: r.total for r in G.descendant_counts(tree).collect()}
    assert counts[0] == 699 and counts[1] == 1 and counts[500] == 0
    depth = {r.node: r.c for r in G.climb(tree, F.lit(1), lambda x, y: x + y).collect()}
    assert depth[0] == 1 and depth[399] == 2 and depth[400] == 3


def test_more_listeners_than_are_told(spark, monkeypatch):
    monkeypatch.setattr(B, "LISTENERS", 10), monkeypatch.setattr(B, "TOLD", 2)
    events = spark.createDataFrame([(1, "a", None), (2, "b", "{}"), (3, "*", None)], "seq long, event_type string, details string")
    subs = spark.createDataFrame([("*", f"l{i}", i) for i in range(95)] + [("a", "own", 1)], "event_type string, listener string, pos long")
    got = B.notify(events, subs).orderBy("seq", "place").collect()
    assert len(got) == 95 * 2 + 1 and got[95].listener == "own" and [r.listener for r in got[:3]] == ["l0", "l1", "l2"]
    assert B.notify(events, subs.where("event_type = 'a'")).count() == 1


def test_requests_are_opened_before_they_stop(spark):
    rows = [(1, 0, "RUNNING"), (1, 5, "WAITING"), (1, 50, "RUNNING"), (2, 0, "PENDING"), (2, 200, "SUCCESS"), (3, 0, "WAITING"), (4, 290, "WAITING"), (5, 0, "RUNNING"), (6, 3, "WAITING"), (6, 3, "RUNNING"), (0, 300, "RUNNING")]
    df = spark.createDataFrame([(r, T0 + timedelta(seconds=s), i, x) for i, (r, s, x) in enumerate(rows)], "request long, ts timestamp, seq long, state string")
    assert sorted(map(tuple, B.expire_requests(df, 60.0).collect())) == [(1, False), (2, True), (3, True), (6, False)]
    assert sorted(map(tuple, B.expire_requests(df, 60.0, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect())) == [(1, False), (2, True), (3, True), (4, True), (6, False)]


def test_scopes_by_numbers_of_random_trees(spark):
    for seed in range(2):
        rng = random.Random(seed)
        parent = {0: None, 50: None} | {i: rng.choice([x for x in (0, 50, *range(1, i)) if x % 3 != 1]) for i in range(1, 45)}
        order, tree = {}, []
        for i in sorted(parent):
            order[parent[i]] = order.get(parent[i], -1) + 1
            tree.append((i, parent[i], order[parent[i]]))
        inner = set(parent.values())
        nodes = spark.createDataFrame([(i, "flow" if i in inner and i % 2 else rng.choice(["task", "retry"]), i % 7 == 0) for i in sorted(parent)], "node long, kind string, noop boolean")
        edges = spark.createDataFrame(sorted({(rng.randrange(45), rng.randrange(45)) for _ in range(90)} - {(i, i) for i in range(45)}), "src long, dst long")
        tree = spark.createDataFrame(tree, "node long, parent long, child_idx int")
        got, want = (sorted(map(tuple, f(tree, nodes, edges).collect())) for f in (G.scopes_by_numbers, G.visible_scopes))
        assert got == want and len(want) > 20


def test_rounds_of_graphs_broadcast_nothing(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, "task", False) for i in range(9)], "node long, kind string, noop boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(7, 6)], "src long, dst long")
    start, plans, cut = nodes.where("node = 2"), [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert {r.node for r in G.left_over(nodes, edges).collect()} == {6, 7, 8}
    assert G.ancestors(edges, start).count() == 2 and G.reached(nodes, edges, start).count() == 6 and G.connected(nodes, edges, start).count() == 2
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_a_round_of_wanted_symbols_is_one_checkpoint(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    provides, requires, retry = (spark.createDataFrame(rows, schema) for rows, schema in (([("f", 0, "x")], "flow string, atom long, name string"), ([("f", 12, "x"), ("f", 12, "y")], "flow string, atom long, name string"), ([], "flow string, name string")))
    cuts, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: cuts.append(1) or cut(df))
    assert [tuple(r) for r in K.unsatisfied_on_demand(edges, provides, requires, retry).collect()] == [("f", 12, "y")]
    assert len(cuts) <= 32
