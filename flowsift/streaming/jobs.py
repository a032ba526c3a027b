"""Streaming forms: state per key, one key's rows taken in order of (at, seq), however they arrive.

`at` is microseconds since 1970. Rows wait in their key's state until the watermark has passed
them, so rows that come late by up to the delay, in any micro-batch, are taken in order; what
comes later is dropped by Spark. What happens by itself, such as a claim that lapses, has a
timer and takes its place among the rows. State is a few values and the waiting rows of
each key. Over the same rows a stream ends with what the batch operator returns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from flowsift.operators.boards import Board, task_set
from flowsift.operators.history import micros
from flowsift.operators.states import ALLOWED, FINISHES, FLOW_IGNORED, STARTS
from flowsift.sources.history import forget, shared_folder
from flowsift.sources.views import VIEWS, file_bytes

#: A time that comes after all rows.
LAST = datetime(9999, 1, 1)

#: Shards of keys; bytes of a table's files for each shard where a stream reads all of a table.
SHARDS, SHARD = 1024, 256 << 10


class Clock:
    """A source of rows that hold nothing but a ts, to move the watermark on."""

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema, self.folder = spark, schema, shared_folder(spark)
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def beside(self, rows: DataFrame) -> DataFrame:
        return rows.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def tick(self, ts: datetime = LAST) -> None:
        at = F.lit(ts.isoformat(" ")).cast("timestamp_ntz")
        row = [at.cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def stream_view(spark: SparkSession, sf_dir: str, name: str, table: str = "events") -> DataFrame:
    """One of the model's tables over a stream of Parquet files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    pattern = f"{sf_dir}/[{table[0]}]{table[1:]}.parquet"  # a stream takes a single file by a pattern only
    return spark.sql(VIEWS[name], **{table: spark.readStream.schema(schema).parquet(pattern)})


def shards_of(spark: SparkSession, sf_dir: str, table: str = "events", least: int = 64) -> int:
    """As many shards as a table is large, so that what a shard holds doesn't grow with the table; for streams that begin anew."""
    return max(least, -(-file_bytes(spark.read.parquet(f"{sf_dir}/{table}.parquet")) // SHARD))


def drain(stream: DataFrame, clock: Clock | None = None, until: datetime = LAST) -> DataFrame:
    """All that the stream has now, written to the shared folder and read back; with a clock also what it has
    once the time is `until`. What the run itself needed is removed."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def run() -> None:
        to = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        to.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    if clock:
        clock.tick(until)
        run()
        forget(spark, clock.folder)
    forget(spark, f"{folder}/progress")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_in_order(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], until: datetime = LAST) -> DataFrame:
    """drain() of an operator over rows, up to the last of them."""
    clock = Clock(rows.sparkSession, rows.schema)
    return drain(operator(clock.beside(rows)), clock, until)


class Machine:
    """What a key holds. Rows are (at, seq, other columns); results are tuples of the output's columns."""

    def __init__(self, key: tuple):
        self.key = key

    def take(self, row: list) -> list[tuple]:
        raise NotImplementedError

    def alarm(self) -> int | None:
        """When something happens by itself."""
        return None

    def ring(self, at: int) -> list[tuple]:
        """What happens at the alarm's time."""
        return []

    def dump(self) -> list | None:
        """The values to keep; none if the key needs no state."""
        raise NotImplementedError

    def load(self, values: list) -> None:
        raise NotImplementedError


def in_order(rows: DataFrame, keys: list[str], columns: list[str], machine: Callable[[tuple], Machine], schema: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """A machine for each key over rows (the keys, seq, ts and columns) in the order of (ts, seq).

    Rows without a seq move the watermark and are nobody's, rows without a ts have no place. Keys are whole numbers or strings; they are
    dealt into shards by their hash, and Python is called for a shard, since a call costs more than the rows of most keys.
    A shard's rows of one micro-batch and what it keeps are held together, so more keys want more shards, and a stream that begins
    with a long past reads it in parts (maxFilesPerTrigger of its source). One that goes on from a checkpoint needs the number of shards it began with.
    """
    out = [part.split()[0] for part in schema.split(", ")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, told, times, kept = state.getCurrentWatermarkMs() * 1000, [], [], []
        held = {tuple(key): (waiting, values) for key, waiting, values in json.loads(state.get[0])} if state.exists else {}
        for b in batches:
            plain = {c: b[c].astype(object).where(b[c].notna(), None).tolist() for c in [*keys, "at", "seq", *columns]}
            for key, row in zip(zip(*(plain[c] for c in keys)), zip(*(plain[c] for c in ["at", "seq", *columns]))):
                if key not in held:
                    held[key] = ([], None)
                held[key][0].append(row)

        for key, (waiting, values) in held.items():
            own = machine(key)
            if values is not None:
                own.load(values)

            def rings(until: int) -> None:
                while (at := own.alarm()) is not None and at <= until:
                    told.extend(own.ring(at))

            for row in sorted((r for r in waiting if r[0] <= now), key=lambda r: (r[0], r[1])):
                rings(row[0])
                told += own.take(row)
            rings(now)
            waiting, values = [r for r in waiting if r[0] > now], own.dump()
            if waiting or values is not None:
                kept.append((key, waiting, values))
                times += [*(r[0] for r in waiting), *([own.alarm()] if own.alarm() is not None else [])]
        if kept:
            state.update((json.dumps(kept),))
            if times:  # fires once the watermark is beyond it
                state.setTimeoutTimestamp(max(-(-min(times) // 1000) - 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=out, dtype=object)  # whole numbers beside nulls stay whole

    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.where("CASE WHEN ts IS NOT NULL THEN seq IS NOT NULL END")  # asks for ts, so that it stays behind the watermark
    # Null keys have shards of their own, since pandas makes floats of whole numbers beside nulls.
    shard = {"shard": F.pmod(F.xxhash64(*keys), F.lit(shards)), **{f"no_{k}": F.col(k).isNull() for k in keys}}
    timed = timed.select(*keys, F.col("seq").cast("bigint").alias("seq"), "ts", micros(F.col("ts")).alias("at"), *columns, *(c.alias(n) for n, c in shard.items()))
    return timed.groupBy(*shard).applyInPandasWithState(run, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


class _Duration(Machine):
    since = None

    def take(self, row: list) -> list[tuple]:
        at, seq, state = row
        told = [(seq, self.key[1], self.key[0], self.key[2], state, (at - self.since) / 1e6)] if state in FINISHES and self.since is not None else []
        self.since = at if state in STARTS else None
        return told

    def dump(self) -> list | None:
        return None if self.since is None else [self.since]

    def load(self, values: list) -> None:
        self.since = values[0]


def stream_durations(transitions: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Time from a start row, kept as state, to the finish row that follows it among the watched states."""
    watched = transitions.where(F.col("state").isin([*STARTS, *FINISHES, "PENDING"]) | F.col("seq").isNull())
    schema = "seq long, item_type string, flow long, item long, state string, duration double"
    return in_order(watched, ["flow", "item_type", "item"], ["state"], _Duration, schema, delay, shards)


def stream_states(transitions: DataFrame, kind: str, initial: str = "PENDING", delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """The state machine per item: the current state is kept, each event gets its verdict."""
    listed, ignored = set(ALLOWED[kind]), set(FLOW_IGNORED) if kind == "flow" else set()

    class State(Machine):
        now = initial

        def take(self, row: list) -> list[tuple]:
            _, seq, state = row
            old, move = self.now, (self.now, state)
            lenient = kind in ("task", "retry") or old == state or move in ignored
            self.now = state if move in listed else old
            return [(self.key[0], seq, old, state, "ALLOWED" if move in listed else "IGNORED" if lenient else "INVALID", self.now)]

        def dump(self) -> list | None:
            return [self.now]

        def load(self, values: list) -> None:
            self.now = values[0]

    return in_order(transitions, ["item"], ["state"], State, "item long, seq long, old_state string, state string, verdict string, after string", delay, shards)


class _Claims(Machine):
    def __init__(self, key: tuple):
        super().__init__(key)
        self.board = Board()

    def _row(self, seq: int | None, at: int, result: str) -> tuple:
        b = self.board
        state = "CLAIMED" if b.there and b.owner is not None else "UNCLAIMED" if b.there else "TRASHED" if b.trashed else "GONE"
        return self.key[0], seq, at, result, state, b.owner, b.until, b.modified

    def take(self, row: list) -> list[tuple]:
        at, seq, who, command, expiry = row
        result = self.board.take(command, who, at, expiry)
        return [self._row(seq, at, result)]

    def alarm(self) -> int | None:
        return self.board.until if self.board.owner is not None else None

    def ring(self, at: int) -> list[tuple]:
        self.board.owner = self.board.until = None
        return [self._row(None, at, "LAPSED")]

    def dump(self) -> list | None:
        b = self.board
        return [b.there, b.trashed, b.owner, b.until, b.modified] if b.there or b.trashed else None

    def load(self, values: list) -> None:
        self.board.there, self.board.trashed, self.board.owner, self.board.until, self.board.modified = values


def stream_board(commands: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(job, seq, at, result, state, owner, until, modified): each command's result and the job's place on the board after it.

    All rules of arbitrate_jobs(). A claim that lapses by itself has a row of its own, LAPSED and without
    a seq, when the watermark passes its end. A trashed job keeps its mark, one that is gone needs no state.
    """
    rows = commands if "expiry_s" in commands.columns else commands.withColumn("expiry_s", F.lit(None))
    rows = rows.withColumn("expiry_s", F.col("expiry_s").cast("double"))
    schema = "job long, seq long, at long, result string, state string, owner string, until long, modified long"
    return in_order(rows, ["job"], ["who", "command", "expiry_s"], _Claims, schema, delay, shards)


def stream_arbitration(commands: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(job, seq, result) of each job command."""
    return stream_board(commands, delay, shards).where("seq IS NOT NULL").select("job", "seq", "result")


def last_board(board: DataFrame, as_of: Column) -> DataFrame:
    """final_board() from the rows of stream_board(): each job's last command, and what lapsed by as_of."""
    lapsed = F.col("seq").isNull()
    known = board.where(~lapsed | (F.col("at") <= micros(as_of)))
    order = F.struct("at", (~lapsed).cast("int"), "seq")  # a claim lapses before a command at the same time
    row = known.groupBy("job").agg(F.max_by(F.struct("state", "owner", "until", "modified"), order).alias("r")).select("job", "r.*")
    live = (F.col("state") == "CLAIMED") & (F.col("until").isNull() | (micros(as_of) < F.col("until")))
    state = F.when((F.col("state") == "CLAIMED") & ~live, "UNCLAIMED").otherwise(F.col("state"))
    return row.select("job", state.alias("state"), F.when(live, F.col("owner")).alias("owner"), F.when(live, F.col("until")).alias("until"), "modified")


def stream_expiry(states: DataFrame, timeout_s: float = 60.0, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(request, expired) once for each request, when it is decided, by the rules of expire_requests().

    A timer in event time decides on a request that nothing stops, without further rows of it. A decided
    request keeps a mark, so that it isn't opened again.
    """
    wait = round(timeout_s * 1_000_000)

    class Request(Machine):
        created, done = None, False

        def take(self, row: list) -> list[tuple]:
            at, _, state = row
            if self.done:
                return []
            if state in ("WAITING", "PENDING"):
                self.created = at if self.created is None else self.created
            elif state in ("RUNNING", "SUCCESS", "FAILURE") and self.created is not None:
                self.done = True
                return [(self.key[0], at - self.created > wait)]
            return []

        def alarm(self) -> int | None:
            return None if self.done or self.created is None else self.created + wait + 1

        def ring(self, at: int) -> list[tuple]:
            self.done = True
            return [(self.key[0], True)]

        def dump(self) -> list | None:
            return None if self.created is None else [self.created, self.done]

        def load(self, values: list) -> None:
            self.created, self.done = values

    return in_order(states, ["request"], ["state"], Request, "request long, expired boolean", delay, shards)


def stream_sessions(beats: DataFrame, expiry_s: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """(topic, since, last_seen, beats) of each session that the watermark has passed.

    Spark joins rows that are exactly one gap apart, where silence of expiry_s ends a session,
    so the gap is a microsecond shorter. Sessions without an expiry never end, so they have no stream.
    """
    if not expiry_s or expiry_s <= 0:
        raise ValueError("sessions that never end are never told")
    whole = round(expiry_s * 1_000_000) - 1
    window = F.session_window("ts", f"{whole // 1_000_000} seconds {whole % 1_000_000} microseconds")
    told = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("topic", window.alias("session")).agg(F.min("ts").alias("since"), F.max("ts").alias("last_seen"), F.count("*").alias("beats"))
    return told.select("topic", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "last_seen")], "beats")


class _Registry(Machine):
    number, tasks = 0, None

    def take(self, row: list) -> list[tuple]:
        _, seq, tasks = row
        self.number += self.tasks is not None and tasks != self.tasks
        self.tasks = tasks
        return [(seq, self.key[0], self.number)]

    def dump(self) -> list | None:
        return [self.number, self.tasks]

    def load(self, values: list) -> None:
        self.number, self.tasks = values


def stream_registry(beats: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(seq, topic, identity) of each beat, as worker_identities() gives it; a topic's state is its number and its tasks."""
    rows = beats.withColumn("tasks", task_set(beats))
    return in_order(rows, ["topic"], ["tasks"], _Registry, "seq long, topic long, identity long", delay, shards)


class _Response(Machine):
    known, closed = False, False

    def take(self, row: list) -> list[tuple]:
        _, seq, state = row
        if state == "WAITING" and not self.known:
            self.known, verdict = True, "OPENED"
        elif state == "WAITING" or not self.known or self.closed:
            verdict = "DROPPED"
        else:
            verdict = {"PENDING": "PASSED", "EVENT": "PASSED", "RUNNING": "MOVED"}.get(state, "CLOSED" if state in ("SUCCESS", "FAILURE") else "UNKNOWN")
            self.closed = verdict == "CLOSED"
        return [(seq, self.key[0], verdict)]

    def dump(self) -> list | None:
        return [self.known, self.closed] if self.known else None

    def load(self, values: list) -> None:
        self.known, self.closed = values


def stream_responses(messages: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(seq, request, verdict) of each row (request, ts, seq, state), as match_responses() gives it.

    A request's state is whether it is open or closed, so that what comes late is dropped.
    """
    return in_order(messages, ["request"], ["state"], _Response, "seq long, request long, verdict string", delay, shards)
