"""Rules over scopes, graphs, boards and long histories against brute force and small cases of our own."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.functions import scalars as X
from flowsift.operators import boards as B
from flowsift.operators import books as K
from flowsift.operators import graphs as G
from flowsift.operators import history as H
from flowsift.operators import retries as R
from flowsift.operators.states import ALLOWED
from flowsift.sources import history as S

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_one_item_with_nearly_all_events_is_replayed_in_ranges(spark):
    rng = random.Random(61)
    states = ["PENDING", "RUNNING", "SUCCESS", "FAILURE", "REVERTING", "REVERTED"]
    events = [(1 if i % 50 else i, T0 + timedelta(seconds=rng.randrange(9000)), i, rng.choice(states)) for i in range(6000)]
    table = spark.createDataFrame(events, "item long, ts timestamp, seq long, state string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = H.replay_states(table, "task", "PENDING")
        parts = out.where("item = 1").select(F.spark_partition_id().alias("p")).distinct().count()
        got = {r.seq: (r.old_state, r.verdict, r.after) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    now, allowed = {}, set(ALLOWED["task"])
    for item, _, seq, state in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        old = now.get(item, "PENDING")
        done = (old, state) in allowed
        now[item] = state if done else old
        assert got[seq] == (old, "ALLOWED" if done else "IGNORED", now[item])
    assert parts > 1
    assert H.replay_states(table.where("false"), "flow", "PENDING").count() == 0


def test_a_deep_chain_climbs_in_few_rounds(spark):
    n = 700
    tree = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(n)] + [(n + i, 3, i + 1) for i in range(20)], "node long, parent long, child_idx int")
    counts = {r.node: (r.direct, r.total) for r in G.child_counts(tree).collect()}
    assert counts[0] == (1, n + 19) and counts[3] == (21, n + 16) and counts[n - 1] == (0, 0)
    order = {r.node: (r.depth, r["at"]) for r in G.tree_order(tree).collect()}
    assert order[0] == (0, 0) and order[n - 1] == (n - 1, n - 1) and order[n + 19] == (4, n + 19)
    retries = tree.where("node IN (2, 100)").select("node")
    near = {r.node: (r.retry, r.distance) for r in R.nearest_retry(tree, retries).collect()}
    assert 2 not in near and near[3] == (2, 1) and near[100] == (2, 98) and near[n - 1] == (100, n - 101) and near[n + 5] == (2, 2)
    chains = {r.node: [c.retry for c in r.chain] for r in R.enclosing_retries(tree, retries.withColumn("decision", F.lit("REVERT"))).collect()}
    assert chains[1] == [] and chains[50] == [2] and chains[101] == [100, 2]


def test_visible_scopes_of_nested_flows(spark):
    # root: a, flow f (b, flow g (c, d)), e; each after the one before
    tree = spark.createDataFrame([("root", None, 0), ("a", "root", 0), ("f", "root", 1), ("b", "f", 0), ("g", "f", 1), ("c", "g", 0), ("d", "g", 1), ("e", "root", 2)], "node string, parent string, child_idx int")
    nodes = tree.select("node", F.when(F.col("node").isin("root", "f", "g"), "flow").otherwise("task").alias("kind"), F.col("node").isin("root", "f", "g").alias("noop"))
    edges = spark.createDataFrame([("a", "f"), ("f", "b"), ("b", "g"), ("g", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seen = {}
    for r in G.visible_scopes(tree, nodes, edges).orderBy("node", "level", "at").collect():
        seen.setdefault(r.node, {}).setdefault(r.level, []).append(r.visible)
    assert seen == {"b": {1: ["a"]}, "c": {1: ["b"], 2: ["a"]}, "d": {0: ["c"], 1: ["b"], 2: ["a"]}, "e": {0: ["d", "c", "b", "a"]}}


def test_deciders_of_all_depths(spark):
    # s -> 1..4, each before a task, a flow (noop) with a task in it, and so on
    names = ["s"] + [f"{k}{i}" for i in range(1, 5) for k in "tuvw"]
    nodes = spark.createDataFrame([(x, "flow" if x[0] == "v" else "task", x[0] == "v", "SUCCESS" if x == "s" else "PENDING") for x in names], "node string, kind string, noop boolean, state string")
    depth = {1: "ALL", 2: "FLOW", 3: "NEIGHBORS", 4: "ATOM"}
    edges = [("s", f"t{i}", False, depth[i]) for i in depth]
    edges += [e for i in depth for e in ((f"t{i}", f"u{i}", None, None), (f"u{i}", f"v{i}", None, None), (f"v{i}", f"w{i}", None, None))]
    table = spark.createDataFrame(edges, "src string, dst string, vote boolean, depth string")
    assert {r.node for r in G.apply_deciders(nodes, table).collect()} == {"t1", "u1", "w1", "t2", "u2", "t3", "u3", "t4"}
    ignored = nodes.withColumn("state", F.when(F.col("node") == "s", "IGNORE").otherwise(F.col("state")))
    assert G.apply_deciders(ignored, table).count() == 0  # who is ignored doesn't vote
    assert {r.node for r in G.apply_deciders(nodes, table, F.col("dst") != "t4").where("depth IS NOT NULL").collect()} == {"t4"}


def test_readiness_both_ways(spark):
    nodes = spark.createDataFrame([(1, "task", False, "SUCCESS", "EXECUTE"), (2, "task", False, "IGNORE", "IGNORE"), (3, "flow", True, "PENDING", "EXECUTE"), (4, "task", False, "PENDING", "EXECUTE"), (5, "task", False, "PENDING", "EXECUTE")], "node long, kind string, noop boolean, state string, intention string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    assert rows(G.ready_for(nodes, edges)) == [(4,)]
    back = nodes.withColumn("intention", F.when(F.col("node") == 1, "REVERT").otherwise(F.col("intention")))
    assert rows(G.ready_for(back, edges, "revert")) == [(1,)] and rows(G.ready_for(back, edges)) == []
    reset = {r.node: (r.state, r.intention) for r in G.reset_from(back, edges, back.where("node = 1"), intention="RETRY", with_start=True).collect()}
    assert reset[1] == ("SUCCESS", "REVERT") and reset[2] == ("PENDING", "RETRY") and reset[3] == ("PENDING", "EXECUTE")


def test_graph_lists_tell_overlaps(spark):
    g = lambda *n: (spark.createDataFrame([(i, f"g{n[0]}") for i in n], "node long, tag string"), spark.createDataFrame([(n[0], n[-1])], "src long, dst long"))
    with pytest.raises(ValueError, match="1 nodes"):
        G.merge_graph_list([g(1, 2), g(2, 3)])
    nodes, edges = G.merge_graph_list([g(1, 2), g(2, 3)], allow_overlaps=True)
    assert rows(nodes) == [(1, "g1"), (2, "g2"), (3, "g2")] and rows(edges) == [(1, 2), (2, 3)]
    cyclic = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "graph string, node long")
    assert rows(G.acyclic_graphs(cyclic, spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))) == [("x", False, 2), ("y", True, 0)]


def test_look_ups_through_scopes(spark):
    args = spark.createDataFrame([("f", "t", a, a, a == "o2") for a in ("own", "in", "near", "open", "o2", "none", "skip")], "flow string, atom string, arg string, name string, optional boolean")
    injected = spark.createDataFrame([("f", "t", "own", "p", False), ("f", "t", "own", "q", True)], "flow string, atom string, name string, value string, transient boolean")
    inputs = spark.createDataFrame([("f", "in", "i")], "flow string, name string, value string")
    provided = spark.createDataFrame([("f", "a", "near", "RESULT", "far"), ("f", "b", "near", "RESULT", None), ("f", "c", "near", "RESULT", "close"), ("f", "b", "open", "NOT_KNOWN", None), ("f", "a", "open", "RESULT", "x"), ("f", "b", "skip", "IGNORED", None), ("f", "a", "skip", "FAILURE", "E")], "flow string, atom string, name string, status string, value string")
    scopes = spark.createDataFrame([("f", "t", 0, 1, "b"), ("f", "t", 0, 2, "c"), ("f", "t", 1, 1, "a")], "flow string, atom string, level int, at int, visible string")
    got = {r.arg: (r.status, r.source, r.value) for r in K.look_up_arguments(args, injected, inputs, provided, scopes).collect()}
    assert got == {
        "own": ("FOUND", "TRANSIENT", "q"), "in": ("FOUND", "INPUT", "i"), "near": ("FOUND", "SCOPE", "close"), "open": ("NOT_FOUND", None, None),
        "o2": ("OMITTED", None, None), "none": ("NOT_FOUND", None, None), "skip": ("FOUND", "SCOPE", "E"),
    }
    every = provided.withColumn("pos", F.ascii("atom"))
    assert {r.name: (r.status, r.value) for r in K.fetch_all(every, lambda v: F.array_join(v, "+")).collect()} == {"near": ("NOT_FOUND", None), "open": ("NOT_FOUND", None), "skip": ("FOUND", "E")}


def test_boards_with_expiry(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    told = [("post", "x", 0, None), ("claim", "x", 1, 10.0), ("claim", "y", 5, None), ("claim", "x", 6, 20.0), ("extend", None, 20, 5.0), ("abandon", "x", 25, None), ("extend", None, 26, 5.0), ("claim", " ", 27, None), ("claim", "y", 28, 0.0), ("claim", "y", 29, None), ("consume", "x", 30, None), ("trash", "y", 31, None), ("claim", "y", 32, None)]
    table = spark.createDataFrame([("j", i, at(s), who, c, e) for i, (c, who, s, e) in enumerate(told)], "job string, seq long, ts timestamp, who string, command string, expiry_s double")
    got = [r.result for r in B.arbitrate_jobs(table).orderBy("seq").collect()]
    assert got == ["OK", "OK", "ALREADY_CLAIMED", "ALREADY_CLAIMED", "OK", "UNKNOWN_OWNER", "NOT_EXTENDED", "BAD_OWNER", "BAD_EXPIRY", "OK", "WRONG_OWNER", "OK", "UNKNOWN_JOB"]
    assert B.final_board(table, F.lit(at(99))).first().state == "TRASHED"
    half = B.final_board(table.where("seq <= 4"), F.lit(at(24))).first()
    assert (half.state, half.owner) == ("CLAIMED", "x") and B.final_board(table.where("seq <= 4"), F.lit(at(25))).first().state == "UNCLAIMED"
    assert B.arbitrate_jobs(table.where("false")).count() == 0 and B.final_board(table.where("false"), F.lit(at(0))).count() == 0


def test_subscriptions_in_order_and_by_predicate(spark):
    events = spark.createDataFrame([(1, "a", None), (2, "*", "{}"), (3, "b", "{\"k\": 1}")], "seq long, event_type string, details string")
    listeners = spark.createDataFrame([("a", "one", 1), ("*", "all", 9), ("*", "rest", 3)], "event_type string, listener string, pos int")
    got = [(r.seq, r.listener, r.place, r.details) for r in B.notify(events, listeners).orderBy("seq", "place").collect()]
    assert got == [(1, "rest", 1, "{}"), (1, "all", 2, "{}"), (1, "one", 3, "{}"), (3, "rest", 1, '{"k": 1}'), (3, "all", 2, '{"k": 1}')]
    assert B.notify(events, listeners, lambda details, listener: details != "{}").count() == 2
    assert B.notify(events, listeners.where("false")).count() == 0


def test_values(spark):
    text = lambda r, i: tuple(one(spark, X.extract_indexed(F.lit(r), F.lit(i))))
    assert text('{"a": null}', '"a"') == ("FOUND", None) and text("[1, 2]", "-1") == ("FOUND", "2") and text("[1]", "1") == ("NOT_SUPPLIED", None) and text("5", "0") == ("NOT_SUPPLIED", None)
    assert text("no json", None) == ("FOUND", "no json") and text(None, '"a"') == ("NOT_SUPPLIED", None)
    lists = F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("C")))
    assert one(spark, X.failures_check(lists, "C", "B")) == "B" and one(spark, X.failures_check(lists)) is None and one(spark, X.failures_check(lists, "Z")) is None
    assert one(spark, X.failure_report(F.lit(None), F.lit("m"), F.lit(None))) == "Failure: m\nTraceback not available."
    assert one(spark, X.is_near(F.lit(1.0), F.lit(1.0005))) and not one(spark, X.is_near(F.lit(1.0), F.lit(1.01)))
    assert one(spark, B.disposition(F.lit("SUSPENDED"), F.array(F.array(F.lit("StorageFailure")), F.array(F.lit("KeyError"))), F.lit(None).cast("array<string>"), F.lit(True))) == "consume"


def test_levels_of_merges(spark):
    base = spark.createDataFrame([(1, 10, "old", "RUNNING")], "uuid long, parent_uuid long, meta string, state string")
    new = spark.createDataFrame([(1, 10, "new", "SUCCESS", 1), (2, 10, "more", None, 1), (3, 99, "lost", None, 1)], "uuid long, parent_uuid long, meta string, state string, seq int")
    merged, rejected = K.merge_level(base, new, "flow", "seq", spark.createDataFrame([(10,)], "uuid long"))
    assert rows(merged) == [(1, 10, "new", "SUCCESS"), (2, 10, "more", None)] and [(r.uuid, r.problem) for r in rejected.collect()] == [(3, "NOT_FOUND")]


def test_history_is_read_as_json_and_over_jdbc(spark, tmp_path):
    books = spark.createDataFrame([(1, "b", "m")], S.SCHEMAS["books"])
    for name in ("books", "flows", "atoms"):
        (books if name == "books" else spark.createDataFrame([], S.SCHEMAS[name])).write.json(f"{tmp_path}/json/{name}")
    assert [tuple(r) for r in S.read_logbooks(spark, f"{tmp_path}/json", "json", lazy=True)[0].collect()] == [(1, "b", "m")]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    books.write.format("jdbc").options(url=url, dbtable="books", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    (read,) = S.read_logbooks(spark, url, "jdbc", lazy=True, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert [tuple(r)[:2] for r in read.collect()] == [(1, "b")]


def test_long_chains_of_a_graph(spark):
    nodes = spark.createDataFrame([(i, "task", False) for i in range(36)], "node long, kind string, noop boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(35)] + [(0, 35)], "src long, dst long")
    assert rows(G.topological_levels(nodes, edges)) == sorted(((i, i) for i in range(36)), key=repr)
    start = nodes.where("node = 5")
    assert {r.node for r in G.reached(nodes, edges, start).collect()} == set(range(6, 36))
    assert {(r.node, r.hops) for r in G.connected(nodes, edges, start, forward=True).collect()} == {(i, i - 5) for i in range(6, 36)}


def test_pairs_by_doubling_are_those_of_the_walk(spark):
    rng = random.Random(5)
    kinds = [(i, rng.choice(["task", "task", "retry", "flow"]), i % 6 == 0) for i in range(60)]
    nodes = spark.createDataFrame(kinds, "node long, kind string, noop boolean")
    ways = {(i, i + 1) for i in range(59)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(6)}
    edges = spark.createDataFrame(sorted(ways), "src long, dst long")
    told = lambda df: sorted(map(tuple, df.collect()))
    for through in (G.KINDS, ("task",)):
        walked = told(G.connected(nodes, edges, nodes, through=through))
        assert told(G.connected_pairs(nodes, edges, through)) == walked
        assert told(G.connected_pairs(nodes, edges, through, 11)) == [r for r in walked if r[2] <= 11]
    assert max(r[2] for r in told(G.connected_pairs(nodes, edges))) > 11
