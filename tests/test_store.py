"""Stored tables with versions, labels on demand, folds and sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import books as K
from flowsift.operators import folds as L
from flowsift.sources.store import HistoryStore

SCHEMA = "uuid long, parent_uuid long, meta string, state string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_buckets_are_rewritten_and_versions_stay(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path), 16)
    base = [(i, i % 7, "m", "PENDING") for i in range(200)]
    store.create("flows", spark.createDataFrame(base, SCHEMA), "uuid")
    incoming = [(3, 1, "new", "SUCCESS", 2), (3, 1, "old", "FAILURE", 1), (900, 2, "n", "RUNNING", 3), (901, 99, "x", "RUNNING", 4)]
    parents = spark.createDataFrame([(i,) for i in range(7)], "uuid long")
    rejected = store.merge("flows", spark.createDataFrame(incoming, SCHEMA + ", sequence long"), "flow", "sequence", parents)
    assert [(r.uuid, r.problem) for r in rejected.collect()] == [(901, "NOT_FOUND")]
    want = sorted([r for r in base if r[0] != 3] + [(3, 3, "new", "SUCCESS"), (900, 2, "n", "RUNNING")])
    assert rows(store.read("flows")) == want and rows(store.read("flows", 0)) == base and store.version("flows") == 1
    versions = store.manifest("flows")["versions"]
    assert 1 <= sum(v == 1 for v in versions.values()) <= 2 and sum(v == 0 for v in versions.values()) >= 13
    one = store.read("flows", keys=spark.createDataFrame([(3,)], "uuid long"))
    assert len(one.inputFiles()) <= 4 and (3, 3, "new", "SUCCESS") in rows(one)
    assert store.rewrite("flows", spark.createDataFrame([(3,)], "uuid long"), lambda df: df.where("false")) == 1
    assert rows(store.read("flows")) == [r for r in want if r[0] != 3]


def test_a_lost_write_leaves_the_table_as_it_was(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path), 4)
    store.create("flows", spark.createDataFrame([(1, 1, "m", "PENDING"), (2, 1, None, None), (None, 1, "none", None)], SCHEMA), "uuid")
    keys = spark.createDataFrame([(1,)], "uuid long")
    fails = F.udf(lambda x: 1 // 0, "string")
    with pytest.raises(Exception):
        store.rewrite("flows", keys, lambda df: df.withColumn("meta", fails("meta")))
    assert store.version("flows") == 0 and store.read("flows").count() == 3
    store.rewrite("flows", keys, lambda df: df.withColumn("meta", F.lit("again")))
    assert {r.uuid: r.meta for r in store.read("flows").collect()} == {1: "again", 2: None, None: "none"}
    assert store.rewrite("flows", keys.where("false"), lambda df: df) == 0 and store.read("flows").count() == 3
    store.create("nothing", spark.createDataFrame([], SCHEMA), "uuid")
    assert store.read("nothing").collect() == [] and store.read("nothing").columns == ["uuid", "parent_uuid", "meta", "state"]


def test_wanted_symbols_against_all_ancestors(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
        edges = {(a, b) for a, b in edges if a != b}
        provides = {(1, rng.randrange(40), rng.choice("abcd")) for _ in range(25)}
        requires = {(1, rng.randrange(40), rng.choice("abcde")) for _ in range(70)}
        before = {}
        for a, b in edges:
            before.setdefault(b, set()).add(a)

        def ancestors(n):
            seen, todo = set(), [n]
            while todo:
                for x in before.get(todo.pop(), ()):  # noqa: B023
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return seen - {n}

        want = sorted((f, a, n) for f, a, n in requires if n != "d" and not any((1, x, n) in provides for x in ancestors(a)))
        frame = lambda s: spark.createDataFrame(sorted(s), "flow long, atom long, name string")
        retry = spark.createDataFrame([(1, "d")], "flow long, name string")
        got = K.unsatisfied_on_demand(spark.createDataFrame(sorted(edges), "src long, dst long"), frame(provides), frame(requires), retry)
        assert rows(got) == want


def test_folds_of_one_large_group(spark):
    data = [("a", i, str(i % 10)) for i in range(700)] + [(f"g{i}", 1, "x") for i in range(50)] + [("n", None, "1"), ("n", 2, "2")]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, o long, v string")
    got = dict(rows(L.fold_in_order(df, "k", ["o"], "v", lambda x, y: F.concat(x, y), 5)))
    assert got["a"] == "0123456789" * 70 and got["n"] == "12" and got["g7"] == "x" and len(got) == 52
    assert L.fold_in_order(df.where("false"), "k", ["o"], "v", lambda x, y: F.concat(x, y)).collect() == []


def test_days_add_up_to_months(spark):
    t = datetime(2024, 1, 1)
    data = [("x", t + timedelta(hours=i), i % 900, float(i % 1000)) for i in range(1400)]
    df = spark.createDataFrame(data, "k string, ts timestamp, who long, v double")
    days = L.sketches(df, ["k"], "day", "ts", "who", "v")
    months = {r.bucket.month: r for r in L.rolled_up(days, ["k"], "month").collect()}
    assert months[1].n == 744 and abs(months[1].about - 744) < 40 and abs(months[1].p50 - 372) < 30
    whole = L.rolled_up(days, ["k"], None).first()
    assert whole.n == 1400 and abs(whole.about - 900) < 50 and abs(whole.p90 - 857) < 40
