"""Small golden cases of records, retries, storage and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import graphs as G
from flowsift.operators import records as R
from flowsift.operators import retries as T
from flowsift.sources import history as S

T0 = datetime(2024, 1, 1)
GOOD = {"exception_str": "disk full", "traceback_str": "", "exc_type_names": ["RuntimeError", "Exception"]}


def problems(spark, check, records, *more):
    rows = [(i, json.dumps(r) if not isinstance(r, str | None) else r, *more) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "i int, record string" + (", kind string" if more else ""))
    return [r.problem for r in check(df).orderBy("i").collect()]


def test_failures(spark):
    nested = lambda n, last="BaseException": GOOD | {"causes": [nested(n - 1, last)]} if n else GOOD | {"exc_type_names": [last]}
    records = [GOOD, GOOD | {"version": -1}, GOOD | {"exc_type_names": []}, GOOD | {"exc_type_names": ["A", 5]}, GOOD | {"exc_type_names": ["A", "object"]}, nested(3), nested(3, "object"), nested(5), GOOD | {"traceback_str": None}, "[]", "no json", None]
    wrong = [None, "version", "exc_type_names", "exc_type_names", "root type", None, "causes", "causes", "traceback_str", "not an object", "not an object", "not an object"]
    assert problems(spark, R.validate_failures, records) == wrong


def test_messages(spark):
    responses = [{"state": "EVENT", "data": {"event_type": "e", "details": {}}}, {"state": "SUCCESS", "data": {"result": None}}, {"state": "PENDING", "data": {}}, {"state": "EVENT", "data": {"event_type": "e"}}, {"state": "X", "data": {}}, {"state": "RUNNING"}, {"state": "RUNNING", "data": {}, "a": 1}]
    assert problems(spark, R.validate_messages, responses, "RESPONSE") == [None, None, None, "data", "state", "data", "other keys"]
    request = {"task_cls": "c", "task_name": "n", "task_version": "1.0", "action": "execute"}
    requests = [request, request | {"action": "x"}, request | {"result": ["failure", {}]}, request | {"result": ["success", 5]}, request | {"failures": {"a": GOOD}}]
    assert problems(spark, R.validate_messages, requests, "REQUEST") == [None, "action", "result", None, None]
    assert problems(spark, R.validate_messages, [{"topic": "t", "tasks": []}, {"topic": "t"}], "OTHER") == ["kind", "kind"]


def test_every_cause_is_followed(spark):
    nested = lambda n, last="BaseException": GOOD | {"causes": [GOOD, nested(n - 1, last)]} if n else GOOD | {"exc_type_names": [last]}
    check = lambda df: R.validate_failures(df, depth=None)
    records = [GOOD, nested(3), nested(4), nested(9), nested(9, "object"), nested(9, "object"), nested(1, "object"), nested(2) | {"version": -1}, GOOD | {"causes": 5}, "no json", None]
    assert problems(spark, check, records) == [None, None, None, None, "causes", "causes", "causes", "version", "causes", "not an object", "not an object"]
    request = {"task_cls": "c", "task_name": "n", "task_version": "1.0", "action": "execute"}
    requests = [request | {"failures": {"a": nested(7)}}, request | {"failures": {"a": GOOD, "b": nested(7, "object")}}, request | {"result": ["failure", nested(7)]}, request | {"result": ["failure", nested(7, "object")]}, request | {"result": ["success", nested(7, "object")]}]
    assert problems(spark, R.validate_messages, requests, "REQUEST") == [None, "failures", None, "result", None]


def test_postings_and_envelopes(spark):
    df = spark.createDataFrame([('{"uuid":"u","name":"n"}',), ('{"uuid":"u","name":"n","priority":"vEry_high"}',), ('{"name":"n"}',), ("[]",), (None,)], "record string")
    assert [(r.priority, r.problem) for r in R.parse_postings(df).collect()] == [("NORMAL", None), ("VERY_HIGH", None), (None, "uuid"), (None, "not an object"), (None, "not an object")]
    df = spark.createDataFrame([('{"type":"RETRY_DETAIL","atom":{"name":"r","meta":7,"results":[[42,{"t":"boom"}],["b",{}]]}}',), ('{"type":"X","atom":{}}',)], "record string")
    first, second = R.parse_atom_envelopes(df).collect()
    assert [(a.value, a.failures) for a in first.attempts] == [("42", {"t": "boom"}), ("b", {})] and first.atom.meta == "{}" and first.problem is None
    assert second.problem == "unknown type" and second.attempts == []


def test_masking_and_row_task(spark):
    df = spark.createDataFrame([('{"a": {"certificate": "x"}, "b": [{"certificate": {"c": 1}}, 2]}',), ("5",), ("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(R.mask_keys(F.col("t"), ["certificate"])).collect()] == ['{"a": {"certificate": "***"}, "b": [{"certificate": "***"}, 2]}', "5", "nope", None]
    out = R.row_task(spark.createDataFrame([(1,), (0,)], "x int"), lambda x: 1 / x, ["x"], "y").collect()
    assert out[0].y == 1.0 and out[0].failure is None and out[1].y is None and out[1].failure.type == "ZeroDivisionError"


def test_progress_keeps_and_erases_details(spark):
    def last(*updates):
        rows = [(1, T0, i, p, d) for i, (p, d) in enumerate(updates)]
        r = T.task_progress(spark.createDataFrame(rows, "item int, ts timestamp, seq int, progress double, details string")).first()
        return r.progress, r.at_progress, r.details

    assert last((0.5, "11"), (0.7, "17"), (0.99, None)) == (0.99, 0.7, "17")
    assert last((0.5, "11"), (9.0, "{}")) == (1.0, None, None)
    assert last((None, None)) == (0.0, None, None)


def test_foreach_and_resolution(spark):
    tries = lambda tried: spark.range(1).select(T.foreach_decision(F.array(*map(F.lit, [3, 2, 3, 5])), F.array(*map(F.lit, tried)).cast("array<int>")).alias("d")).first().d
    assert [tuple(tries(t)) for t in ([], [3], [3, 2], [3, 2, 3], [3, 2, 3, 5])] == [("RETRY", 3), ("RETRY", 2), ("RETRY", 3), ("RETRY", 5), ("REVERT", None)]
    chains = [[], ["RETRY"], ["REVERT"], ["REVERT", "REVERT"], ["REVERT", "RETRY"], ["REVERT", "REVERT_ALL"]]
    df = spark.createDataFrame([(i, [(k, d) for k, d in enumerate(c)]) for i, c in enumerate(chains)], "i int, chain array<struct<retry:bigint,decision:string>>").orderBy("i")
    assert [tuple(r[0]) for r in df.select(T.resolution(F.col("chain"))).collect()] == [("REVERT_ALL", None), ("RETRY", 0), ("REVERT", 0), ("REVERT", 0), ("RETRY", 1), ("REVERT_ALL", None)]
    assert [tuple(r[0]) for r in df.select(T.resolution(F.col("chain"), defer_reverts=True)).collect()] == [("REVERT_ALL", None), ("RETRY", 0), ("REVERT_ALL", None), ("REVERT_ALL", None), ("RETRY", 1), ("REVERT_ALL", None)]


def test_results_in_order(spark):
    def stored(*states):
        rows = [(1, T0 + timedelta(seconds=i), i, s, s[:2] + str(i)) for i, s in enumerate(states)]
        return tuple(T.put_results(spark.createDataFrame(rows, "item int, ts timestamp, seq int, state string, result string")).first())[2:]

    assert stored("FAILURE", "SUCCESS") == ("SU1", None, None, None)
    assert stored("SUCCESS", "REVERTED") == ("SU0", None, "RE1", None)
    assert stored("SUCCESS", "REVERT_FAILURE") == (None, None, None, "RE1")
    assert stored("FAILURE", "REVERT_FAILURE", "REVERTED") == (None, "FA0", "RE2", None)


def test_first_failure_of_an_atom_is_kept(spark):
    attempts = spark.createDataFrame([(1, 1), (1, 2)], "item int, attempt int")
    failures = spark.createDataFrame([(1, T0, 1, "a", "first"), (1, T0, 2, "a", "second"), (2, T0, 3, "b", "x")], "item int, ts timestamp, seq int, atom string, failure string")
    assert sorted(map(tuple, T.record_retry_failures(attempts, failures).collect())) == [(1, 2, {"a": "first"}, None), (2, None, {"b": "x"}, "NO_ATTEMPT")]


def test_tree_orders(spark):
    parents = {"works": (None, 0), "hall": ("works", 0), "yard": ("works", 1), "shed": ("works", 2), "press": ("hall", 0), "lathe": ("hall", 1), "truck": ("yard", 0), "wheel": ("truck", 0)}
    tree = spark.createDataFrame([(k, p, i) for k, (p, i) in parents.items()], "node string, parent string, child_idx int")
    assert [r.node for r in G.tree_order(tree).orderBy("at").collect()] == ["works", "hall", "press", "lathe", "yard", "truck", "wheel", "shed"]
    assert [r.node for r in G.tree_order(tree, "bfs").orderBy("depth", "at").collect()] == ["works", "shed", "yard", "hall", "truck", "lathe", "press", "wheel"]


def test_overlapping_graphs(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "node int, x string"), spark.createDataFrame([(2, "b")], "node int, x string")
    with pytest.raises(ValueError):
        R.merge_graphs(a, b)
    assert sorted(map(tuple, R.merge_graphs(a, b, allow_overlaps=True).collect())) == [(1, "a"), (2, "b")]


def test_lazy_reading(spark):
    folder = S.shared_folder(spark)
    books = spark.createDataFrame([(1, "b", None)], S.SCHEMAS["books"])
    flows, atoms = spark.createDataFrame([], S.SCHEMAS["flows"]), spark.createDataFrame([], S.SCHEMAS["atoms"]).drop("bucket")
    S.write_history(books, flows, atoms, folder)
    assert [len(S.read_logbooks(spark, folder, lazy=x)) for x in (False, True)] == [3, 1]
    assert S.read_logbooks(spark, folder)[0].count() == 1


def test_tried_values_are_counted_not_gathered(spark):
    rows = [("a", s) for s in ["x"] * 5000 + ["y"] + [None] * 3] + [("b", None), ("c", "y"), ("c", "y")]
    got = {r.item: sorted(r.tried) for r in T.tried_values(spark.createDataFrame(rows, "item string, state string"), "item", "state", 3).collect()}
    assert got == {"a": ["x", "x", "x", "y"], "b": [], "c": ["y", "y"]}
