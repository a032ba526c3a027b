"""Streams over shuffled rows in many micro-batches against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import boards as B
from flowsift.operators import history as H
from flowsift.operators import retries as T
from flowsift.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SPREAD = 600  # seconds by which rows come late at the most


def arrivals(rng, rows, parts=6):
    """Rows (ts is the second column) dealt into files so that none is late by more than SPREAD."""
    rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(SPREAD)))
    size = -(-len(rows) // parts)
    return [random.Random(i).sample(rows[i : i + size], len(rows[i : i + size])) for i in range(0, len(rows), size)]


def streamed(spark, tmp_path, rng, rows, schema, operator, until=J.LAST):
    """One file for each micro-batch."""
    import time

    for part in arrivals(rng, rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)  # files are taken by their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return J.drain_in_order(source, lambda r: operator(r, f"{SPREAD} seconds"), until)


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(*a.columns).collect())))


@pytest.fixture
def made(spark, tmp_path):
    rng = random.Random(6)
    at = lambda i: T0 + timedelta(seconds=20 * i // 3)
    return rng, lambda rows, schema, operator, until=J.LAST: streamed(spark, tmp_path, rng, rows, schema, operator, until), at


def test_board_with_lapsing_claims(spark, made):
    rng, run, at = made
    rows = []
    for i in range(500):
        c = rng.choice(["post", "claim", "claim", "extend", "abandon", "consume", "trash"])
        rows.append((rng.randrange(4), at(i), i, rng.choice(["a", "b", " "]), c, rng.choice([None, 30.0, 300.0, 0.0]) if c in ("claim", "extend") else None))
    schema = "job long, ts timestamp, seq long, who string, command string, expiry_s double"
    df = spark.createDataFrame(rows, schema)
    got = run(rows, schema, J.stream_board).persist()
    assert same(B.arbitrate_jobs(df), got.where("seq IS NOT NULL")) and got.where("result = 'LAPSED'").count() > 5
    for as_of in ("2024-01-01 00:56:00", "2024-01-02 00:00:00"):
        when = F.lit(as_of).cast("timestamp")
        assert same(B.final_board(df, when), J.last_board(got, when))


def test_a_trashed_job_stays_trashed(spark, tmp_path):
    schema = "job long, ts timestamp, seq long, who string, command string, expiry_s double"
    rows = [(1, T0, 0, "a", "post", None), (1, T0 + timedelta(seconds=1), 1, "a", "claim", None), (1, T0 + timedelta(seconds=2), 2, "a", "trash", None), (1, T0 + timedelta(hours=9), 3, "b", "claim", None)]
    rows.insert(3, (2, T0 + timedelta(hours=8), 9, "b", "post", None))  # moves the watermark beyond the trash
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    when = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = J.last_board(J.drain_in_order(source, J.stream_board), when)
    assert same(B.final_board(spark.createDataFrame(rows, schema), when), got) and {r.state for r in got.where("job = 1").collect()} == {"TRASHED"}


def test_states_durations_and_responses(spark, made, tmp_path):
    rng, run, at = made
    states = ["PENDING", "RUNNING", "SUCCESS", "FAILURE", "REVERTING", "REVERTED"]
    rows = [(rng.randrange(5), at(i), i, rng.choice(states), "task", 1) for i in range(400)]
    schema = "item long, ts timestamp, seq long, state string, item_type string, flow long"
    got = run(rows, schema, lambda r, delay: J.stream_states(r, "flow", delay=delay))
    assert same(H.replay_states(spark.createDataFrame(rows, schema), "flow", "PENDING"), got)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    assert same(H.durations(spark.createDataFrame(rows, schema)), J.drain_in_order(source(), lambda r: J.stream_durations(r, f"{SPREAD} seconds")))
    words = {"PENDING": "WAITING", "REVERTING": "EVENT", "REVERTED": "PENDING"}
    told = lambda df: df.select(F.col("item").alias("request"), "ts", "seq", F.coalesce(F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[F.col("state")], "state").alias("state"))
    assert same(T.match_responses(told(spark.createDataFrame(rows, schema))), J.drain_in_order(told(source()), lambda r: J.stream_responses(r, f"{SPREAD} seconds")))


def test_expiry_and_registry(spark, made, tmp_path):
    rng, run, at = made
    rows = [(rng.randrange(60), at(i), i, rng.choice(["WAITING", "PENDING", "RUNNING", "SUCCESS", "FAILURE"])) for i in range(300)]
    schema = "request long, ts timestamp, seq long, state string"
    until = T0 + timedelta(seconds=3000)
    got = run(rows, schema, lambda r, delay: J.stream_expiry(r, 120.0, delay), until + timedelta(seconds=SPREAD))
    want = B.expire_requests(spark.createDataFrame(rows, schema), 120.0, F.lit(str(until)).cast("timestamp"))
    assert same(want, got) and {r.expired for r in got.collect()} == {True, False}
    tasks = F.when(F.col("state") == "WAITING", F.array(F.lit("x"), F.lit("y"))).when(F.col("state") == "PENDING", F.array(F.lit("y"), F.lit("x"), F.lit("y"))).otherwise(F.array("state"))
    beats = lambda df: df.select((F.col("request") % 3).alias("topic"), "ts", "seq", tasks.alias("tasks"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert same(B.worker_identities(beats(spark.createDataFrame(rows, schema))), J.drain_in_order(beats(source), lambda r: J.stream_registry(r, f"{SPREAD} seconds")))


def test_an_empty_stream(spark, tmp_path):
    schema = "job long, ts timestamp, seq long, who string, command string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert J.drain_in_order(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), J.stream_arbitration).collect() == []
    with pytest.raises(ValueError):
        J.stream_sessions(spark.readStream.schema("topic long, ts timestamp").parquet(f"{tmp_path}/in"), None)


def test_keys_share_shards(spark, tmp_path):
    """Python is called for shards, not for keys; null keys and whole numbers that no float holds stay what they are."""
    big = 2**53
    keys = [None, big, big + 1, *range(300)]
    states = ["RUNNING", "SUCCESS", "PENDING", "FAILURE"]
    rows = [(k, T0 + timedelta(seconds=7 * i + j), big + 1 + 1000 * j + i, states[(i + j) % 4]) for i, k in enumerate(keys) for j in range(5)]
    schema = "item long, ts timestamp, seq long, state string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert same(H.replay_states(df, "flow", "PENDING"), J.drain_in_order(source, lambda r: J.stream_states(r, "flow", shards=4)))
    to = J.stream_states(source, "flow", shards=4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
    query = to.trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 4 + 1  # the null key's besides


def test_lapses_beside_large_numbers(spark, tmp_path):
    schema = "job long, ts timestamp, seq long, who string, command string, expiry_s double"
    first = 2**53 + 1
    rows = [(j, T0 + timedelta(seconds=s), first + 10 * j + s, "a", c, e) for j in range(20) for s, c, e in ((0, "post", None), (1, "claim", 5.0), (8, "claim", None))]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = J.drain_in_order(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda r: J.stream_board(r, shards=2)).persist()
    assert same(B.arbitrate_jobs(df), got.where("seq IS NOT NULL")) and got.where("result = 'LAPSED'").count() == 20


def test_shards_grow_with_the_table(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("*.parquet"))
    assert J.shards_of(spark, str(tmp_path), least=1) == -(-size // J.SHARD) > 10
    assert J.shards_of(spark, str(tmp_path), least=10_000) == 10_000
