"""What a task sorts, and how often a table is computed, at growing sizes."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flowsift.operators import books as K
from flowsift.operators import graphs as G
from flowsift.operators import subgraphs as S
from flowsift.sources import views

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["atoms", "stored"])
def test_numbered_views_are_sorted_in_parts_by_the_size_of_the_files(spark, monkeypatch, name):
    one = views.view(spark, D, name)
    monkeypatch.setattr(views, "PART", 10_000)
    many = views.view(spark, D, name)
    assert many.rdd.getNumPartitions() >= 5 > one.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, many.select("flow", "pos", "state").collect())) == sorted(map(tuple, one.select("flow", "pos", "state").collect()))


@pytest.mark.parametrize("name", ["j6_missing_in_scopes", "j7_look_up_arguments"])
def test_stored_atoms_are_numbered_once_for_a_query(spark, name):
    assert "Window" not in plan(__spark_entry__.queries()[name](spark, D))  # seven and more windows over all rows before


def test_pairs_come_from_parts_of_the_starts(spark, monkeypatch):
    """One part, many parts, and parts that are walked by rounds give the same pairs; none of them is shuffled or stored on the way in tasks."""
    rng = random.Random(2)
    kinds = [(i, rng.choice(["task", "task", "retry", "flow"]), i % 6 == 0) for i in range(90)]
    nodes = spark.createDataFrame(kinds, "node long, kind string, noop boolean")
    ways = {(i // 2, i) for i in range(1, 90)} | {(rng.randrange(90), rng.randrange(90)) for _ in range(9)}
    edges = spark.createDataFrame(sorted(ways), "src long, dst long")
    told = lambda df: sorted(map(tuple, df.collect()))
    want = {k: told(G.connected(nodes, edges, nodes, through=k)) for k in (G.KINDS, ("task",))}
    for own, most, through, hops in ((1 << 20, 1 << 22, ("task",), None), (1, 95, G.KINDS, 3), (30, 20, G.KINDS, 3)):
        monkeypatch.setattr(S, "OWN", own)
        monkeypatch.setattr(S, "MOST", most)
        pairs = G.connected_pairs(nodes, edges, through, hops)
        assert told(pairs) == [r for r in want[through] if hops is None or r[2] <= hops]
        if most > 20:
            assert "MapInArrow" in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    monkeypatch.undo()
    names = edges.select(*[F.concat(F.lit("n"), F.col(c)).alias(c) for c in edges.columns])
    assert G.ancestors(names, names.select(F.col("dst").alias("node"))).count() == G.ancestors(edges, edges.select(F.col("dst").alias("node"))).count()


def test_wanted_symbols_of_parts_and_of_a_long_way(spark, monkeypatch):
    """A walk of 300 hops needs no rounds in one part; many parts give what one part gives, and parts with too many ways are left for rounds."""
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "flow long, atom long, name string")
    none = frame([]).select("flow", "name")
    cuts, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: cuts.append(1) or cut(df))
    got = K.unsatisfied_on_demand(chain, frame([(0, "a"), (300, "b")]), frame([(300, "a"), (300, "b"), (0, "a")]), none)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 300, "b")] and not cuts
    rng = random.Random(4)
    edges = spark.createDataFrame(sorted({(i // 2, i) for i in range(1, 40)} | {(39, 2), (21, 1)}), "src long, dst long")
    given, wanted = frame({(i, rng.choice("abc")) for i in range(40) if i % 3}), frame({(i, rng.choice("abcd")) for i in range(40)})
    want = sorted(map(tuple, K.unsatisfied_on_demand(edges, given, wanted, none).collect()))
    monkeypatch.setattr(S, "OWN", 20)
    monkeypatch.setattr(S, "MOST", 35)
    assert sorted(map(tuple, K.unsatisfied_on_demand(edges, given, wanted, none).collect())) == want and len(want) > 10


def test_cut_leaves_a_small_table_and_no_shuffles(spark):
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: set(local.rglob("shuffle_*.data"))
    before, rows = files(), spark.range(100_000).select((F.col("id") * 7 % 100_003).alias("k")).distinct()
    table = G.cut(rows)
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before and table.count() == 100_000
    assert all(f.endswith(".parquet") for f in table.inputFiles()) and table.inputFiles()
    assert G.cut(spark.sql("SELECT 1 AS a, null AS b")).collect() == [(1, None)] and G.cut(spark.sql("SELECT 1 AS a, 2 AS A")).count() == 1
