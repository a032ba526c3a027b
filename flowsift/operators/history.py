"""Checks, windows and aggregates over state transitions and atom records.

Every function takes and returns DataFrames; see sources/views.py for the columns. Nulls
in ordering columns sort first; ties of ts are broken by seq. Keys are hash partitioned
once per function; watched rows and columns are selected before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import kept as cut
from .states import ALLOWED, FINISHES, FLOW_IGNORED, STARTS


def pairs(column_old: Column, column_new: Column, listed: list[tuple[str, str]]) -> Column:
    return F.concat_ws(">", column_old, column_new).isin([f"{a}>{b}" for a, b in listed])


def verdict(old: Column, new: Column, kind: str) -> Column:
    """ALLOWED, IGNORED or INVALID. Tasks and retries are never INVALID: what isn't listed isn't done."""
    listed = F.when(pairs(old, new, ALLOWED[kind]), "ALLOWED")
    if kind in ("task", "retry"):
        return listed.otherwise("IGNORED")
    same = listed.when(old == new, "IGNORED")
    return (same.when(pairs(old, new, FLOW_IGNORED), "IGNORED") if kind == "flow" else same).otherwise("INVALID")


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def micros(ts: Column) -> Column:
    """Microseconds since 1970; a timestamp without a zone is read in the session's zone (set UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def check_transitions(df: DataFrame, kind: str) -> DataFrame:
    """Each item's consecutive states with a verdict; the first row has no old state and is left out."""
    moved = df.withColumn("old_state", F.lag("state").over(_by("item"))).where("old_state IS NOT NULL")
    return moved.withColumn("verdict", verdict(F.col("old_state"), F.col("state"), kind))


def durations(df: DataFrame) -> DataFrame:
    """Time from a start row to the finish row that follows it among the watched states."""
    watched = df.where(F.col("state").isin([*STARTS, *FINISHES, "PENDING"])).select("seq", "ts", "item_type", "flow", "item", "state")
    w = _by("flow", "item_type", "item")
    timed = watched.withColumn("before", F.lag("state").over(w)).withColumn("since", F.lag("ts").over(w))
    return timed.where(F.col("state").isin(FINISHES) & F.col("before").isin(STARTS)).select("seq", "item_type", "flow", "item", "state", seconds(F.col("ts"), F.col("since")).alias("duration"))


def leftover_timers(df: DataFrame) -> DataFrame:
    """Items whose last watched row is a start, counted by kind of item."""
    watched = df.where(F.col("state").isin([*STARTS, *FINISHES, "PENDING"]))
    last = watched.groupBy("flow", "item_type", "item").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))
    return last.where(F.col("state").isin(STARTS)).groupBy("item_type").agg(F.count("*").alias("n"))


def latest_state(df: DataFrame) -> DataFrame:
    return df.groupBy("item").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("ts"))


def event_timestamps(df: DataFrame) -> DataFrame:
    """Last unix second of every state an item was in, one row for each."""
    return df.groupBy("item", "state").agg(F.max("ts").alias("ts")).select("item", F.concat("state", F.lit("-timestamp")).alias("name"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def drop_repeats(df: DataFrame, saving=("SUCCESS", "FAILURE", "REVERTED", "REVERT_FAILURE")) -> DataFrame:
    """drop_identity() with progress: rows of tasks are repeats only if they carry a progress and it
    is the one told before; rows of retries if the state is the one before.

    The progress told before is that of the last row with one, 0.0 if there was none.
    """
    w = _by("item")
    told = F.coalesce(F.last("progress", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    same = F.col("state").eqNullSafe(F.lag("state").over(w)) & ~F.col("state").isin(list(saving))
    still = F.when(F.col("item_type") == "task", F.coalesce(F.col("progress") == told, F.lit(False))).otherwise(True)
    return df.withColumn("__repeat", same & still).where(~F.col("__repeat")).drop("__repeat")


def drop_identity(df: DataFrame, saving=("SUCCESS", "FAILURE", "REVERTED", "REVERT_FAILURE")) -> DataFrame:
    """Without rows that repeat the state before them, but for states that save a result."""
    before = F.lag("state").over(_by("item"))
    return df.withColumn("before", before).where(~F.col("state").eqNullSafe(F.col("before")) | F.col("state").isin(list(saving))).drop("before")


def replay_states(df: DataFrame, kind: str, initial: str) -> DataFrame:
    """(item, seq, old_state, state, verdict, after): run the state machine per item; refused events
    leave the state as it is.

    Events are dealt into ranges of (item, ts, seq), so an item with a large share of all events
    is many tasks' work. Only the first and last item of a range can go on in another one;
    for these a first pass gives the state at the range's end for every state at its begin.
    These few maps, two at most for a range, tell each range's first state, and a second
    pass replays every range in order, holding one state.
    """
    states = sorted({s for pair in ALLOWED[kind] for s in pair} | {initial})
    moves, ignored = set(ALLOWED[kind]), set(FLOW_IGNORED) if kind == "flow" else set()
    lenient = kind in ("task", "retry")
    key = F.coalesce(F.concat(F.lit("="), F.col("item").cast("string")), F.lit(""))  # text, so that a null item changes no other one
    dealt = df.select(key.alias("item"), "ts", "seq", "state").repartitionByRange("item", "ts", "seq").sortWithinPartitions("item", "ts", "seq")
    dealt = cut(dealt.select("item", F.col("seq").cast("bigint").alias("seq"), "state", F.spark_partition_id().alias("part")))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs = None, []  # [item, state at the end for each state at the begin] of the first and the last item
        for b in batches:
            for item, state, part in zip(b["item"], b["state"], b["part"]):
                if not runs or runs[-1][0] != item:
                    runs = [*runs[:1], [item, {s: s for s in states}]]
                ends = runs[-1][1]
                for s, now in ends.items():
                    if (now, state) in moves:
                        ends[s] = state
        yield pd.DataFrame([(part, n, item, json.dumps(ends)) for n, (item, ends) in enumerate(runs)], columns=["part", "run", "item", "ends"])

    first, at, held = {}, initial, None
    found = dealt.select("item", "state", "part").mapInPandas(edges, "part int, run int, item string, ends string").collect()
    for part, _, item, ends in sorted(map(tuple, found)):  # two short rows for a range, in the order of ranges
        at = at if item == held else initial
        first.setdefault(part, (item, at))
        at, held = json.loads(ends)[at], item

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now = None, initial
        for b in batches:
            out = []
            for item, seq, state, part in zip(b["item"], b["seq"], b["state"], b["part"]):
                if current is None or item != current[0]:
                    now = first[part][1] if current is None else initial
                    current = (item,)
                allowed = (now, state) in moves
                v = "ALLOWED" if allowed else "IGNORED" if lenient or now == state or (now, state) in ignored else "INVALID"
                out.append((item, seq, now, state, v, state if allowed else now))
                now = state if allowed else now
            yield pd.DataFrame(out, columns=["item", "seq", "old_state", "state", "verdict", "after"])

    item = F.when(F.col("item") != "", F.substring("item", 2, 1 << 30)).cast(df.schema["item"].dataType)
    return dealt.mapInPandas(replay, "item string, seq bigint, old_state string, state string, verdict string, after string").withColumn("item", item)


def unique_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def last_transitions(df: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("ts"), F.desc("seq")))
    return df.withColumn("back", rank).where(F.col("back") <= n)


def duration_stats(timed: DataFrame) -> DataFrame:
    """Count, mean, extremes and exact median of durations by item type.

    Durations are counted and the counts dealt into ranges; totals of the ranges tell where
    the middle places are, and only the ranges that hold one are ranked. So no task or
    buffer holds all durations of an item type.
    """
    d, n = F.col("duration"), F.col("n")
    counts = timed.groupBy("item_type", "duration").agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange("item_type", "duration").withColumn("part", F.spark_partition_id()))
    known = F.sum(F.when(d.isNotNull(), n))
    stats = counts.groupBy("item_type").agg(F.sum(n).alias("n"), F.round(F.sum(d * n) / known, 4).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"), known.alias("known"))
    places = stats.select("item_type", F.floor((F.col("known") - 1) / 2).alias("low"), F.ceil((F.col("known") - 1) / 2).alias("high"))
    given = counts.where(d.isNotNull())
    parts = given.groupBy("item_type", "part").agg(F.sum(n).alias("held"))
    parts = parts.withColumn("before", F.sum("held").over(Window.partitionBy("item_type").orderBy("part")) - F.col("held"))
    parts = parts.join(places, "item_type").where("before <= high and before + held > low")
    ranked = given.join(parts, ["item_type", "part"]).withColumn("to", F.col("before") + F.sum(n).over(Window.partitionBy("item_type", "part").orderBy("duration")))
    middle = ranked.where("to > low and to - n <= high").groupBy("item_type").agg(F.round((F.min(d) + F.max(d)) / 2, 4).alias("median"))
    return stats.join(middle, "item_type", "left").select("item_type", "n", "mean", "least", "most", "median")


def seconds_per_state(df: DataFrame, states: list[str]) -> DataFrame:
    """Seconds an item spent in each listed state, 0.0 if never; the last state is open and counts nothing."""
    spent = df.select("item", F.lower("state").alias("state"), seconds(F.lead("ts").over(_by("item")), F.col("ts")).alias("s"))
    return spent.groupBy("item").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("state") == s.lower(), F.col("s"))), F.lit(0.0)), 3).alias(s.lower()) for s in states])


def flow_statistics(df: DataFrame) -> DataFrame:
    """Per flow: finished and failed rows, items, and seconds from the first to the last row."""
    s = F.col("state")
    return df.groupBy("flow").agg(F.count_if(s.isin(FINISHES)).alias("completed"), F.count_if(s == "FAILURE").alias("failures"), F.countDistinct("item").alias("items"), seconds(F.max("ts"), F.min("ts")).alias("active_for"))


def state_counts(atoms: DataFrame) -> DataFrame:
    """Counts by intention and state with subtotals; level tells which columns were summed away."""
    return atoms.rollup("intention", "state").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def failure_trends(atoms: DataFrame) -> DataFrame:
    """Failures by type, atom name and month, with the flows they hit."""
    failed = atoms.where("failure IS NOT NULL").withColumn("bucket", F.date_trunc("month", "updated_at"))
    return failed.groupBy("failure", "name", "bucket").agg(F.count("*").alias("n"), F.countDistinct("flow").alias("flows"))


def failure_cube(atoms: DataFrame) -> DataFrame:
    return atoms.where("failure IS NOT NULL").cube("failure", "name").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def flow_success(atoms: DataFrame) -> DataFrame:
    """True if every atom that isn't ignored is SUCCESS; a flow of ignored atoms only is one too."""
    return atoms.groupBy("flow").agg(F.bool_and((F.col("intention") == "IGNORE") | (F.col("state") == "SUCCESS")).alias("success"))


def flow_failures(atoms: DataFrame) -> DataFrame:
    failed = F.col("failure").isNotNull()
    return atoms.groupBy("flow").agg(F.bool_or(failed).alias("has_failures"), F.count_if(failed).alias("n"), F.countDistinct("failure").alias("types"))


def worker_summary(commands: DataFrame) -> DataFrame:
    c = F.col("command")
    return commands.groupBy("who").agg(*[F.count_if(c == k).alias(n) for k, n in (("claim", "claimed"), ("consume", "consumed"), ("abandon", "abandoned"), ("trash", "trashed"))])


def duplicate_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("flow", "name").agg(F.count("*").alias("n")).where("n > 1")


def map_reduce_sum(df: DataFrame, value: str, key: str, order: list[str], chunk: int, keep_tail: bool = False) -> DataFrame:
    """Sums of chunks of ordered rows per key, then their total. A short last chunk is left
    out unless keep_tail."""
    at = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / chunk)
    parts = df.withColumn("chunk", at).groupBy(key, "chunk").agg(F.sum(value).alias("part"), F.count("*").alias("n"))
    return (parts if keep_tail else parts.where(F.col("n") == chunk)).groupBy(key).agg(F.round(F.sum("part"), 4).alias("total"), F.count("*").alias("chunks"))


def log_level(df: DataFrame, failed: Column | None = None) -> DataFrame:
    """WARNING for the states that tell of trouble, and for a finish row whose result is a failure
    (`failed`, if given); else DEBUG."""
    flow = F.col("state").isin("FAILURE", "REVERTED")
    task = F.col("state").isin("FAILURE", "REVERTED", "RETRYING", "REVERT_FAILURE")
    bad = F.when(F.col("item_type") == "flow", flow).otherwise(task)
    if failed is not None:
        bad = bad | (F.col("state").isin(FINISHES) & F.coalesce(failed, F.lit(False)))
    return df.withColumn("level", F.when(bad, "WARNING").otherwise("DEBUG"))


def capture_transitions(df: DataFrame, listen_for=("*",), capture_flow=True, capture_task=True, skip_items: list | None = None, capture_retry=True, skip: DataFrame | None = None) -> DataFrame:
    """The rows of the wanted kinds and states, without skipped items. '*' listens for all.

    skip: (item_type, item) of items of one kind that are left out, of any number.
    """
    kinds = [k for k, on in (("flow", capture_flow), ("task", capture_task), ("retry", capture_retry)) if on]
    kept = df.where(F.col("item_type").isin(kinds))
    kept = kept if "*" in listen_for else kept.where(F.col("state").isin(list(listen_for)))
    kept = kept.join(skip, ["item_type", "item"], "left_anti") if skip is not None else kept
    return kept.where(~F.col("item").isin(skip_items)) if skip_items else kept


def visible_results(atoms: DataFrame) -> DataFrame:
    """A stored failure wins, else the result is seen in SUCCESS, FAILURE and REVERTING only."""
    status = F.when(F.col("failure").isNotNull(), "FAILURE").when(F.col("state").isin("SUCCESS", "FAILURE", "REVERTING"), "RESULT").when(F.col("intention") == "IGNORE", "IGNORED").otherwise("NOT_KNOWN")
    value = F.when(status == "FAILURE", F.col("failure")).when(status == "RESULT", F.col("part").cast("string"))
    return atoms.select("flow", "pos", "name", status.alias("status"), value.alias("value"))


def unfinished_flows(flows: DataFrame) -> DataFrame:
    return flows.where(~F.coalesce("state", F.lit("PENDING")).isin("SUCCESS", "FAILURE", "REVERTED"))


def unfinished_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.col("state").isin(STARTS))


def classify_details(df: DataFrame, task_keys=("k",), retry_keys=("r",)) -> DataFrame:
    """Tells rows of tasks from those of retries by the keys that their details have."""
    has = lambda keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.array_contains(F.json_object_keys("props"), k), F.lit(False)))
    return df.withColumn("about", F.when(has(task_keys), "task").when(has(retry_keys), "retry").otherwise("neither"))


def results_of(atoms: DataFrame, which: str = "execute") -> DataFrame:
    """(flow, atom, status, value): what a look-up of an atom's result gives. which: execute or revert.

    atoms have state, results, failure, revert_results, revert_failure. A stored failure is the
    result; else the result is seen in the states that have one, IGNORED atoms have none, and
    those that aren't there yet are NOT_KNOWN.
    """
    result, failure, states = {"execute": ("results", "failure", ["SUCCESS", "FAILURE", "REVERTING"]), "revert": ("revert_results", "revert_failure", ["REVERTED", "REVERT_FAILURE", "REVERTING"])}[which]
    status = F.when(F.col(failure).isNotNull(), "FAILURE").when(F.col("state").isin(states), "RESULT").when(F.col("state") == "IGNORE", "IGNORED").otherwise("NOT_KNOWN")
    return atoms.select("flow", "atom", status.alias("status"), F.when(F.col(failure).isNotNull(), F.col(failure)).when(F.col("state").isin(states), F.col(result)).alias("value"))


def last_results(results: Column) -> Column:
    """The value of a retry's last attempt (array of structs with `value`), which look-ups see; null without one."""
    return F.try_element_at(results, F.lit(-1))["value"]


def failure_maps(atoms: DataFrame) -> DataFrame:
    """(flow, execute map, revert map, has_failures): each flow's failures by atom name.

    A flow without any has empty maps; only atoms with a failure are gathered.
    """
    of = lambda c: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("atom", c))), lambda x: x.isNotNull())))
    return atoms.groupBy("flow").agg(of("failure").alias("execute"), of("revert_failure").alias("revert"), F.bool_or(F.col("failure").isNotNull() | F.col("revert_failure").isNotNull()).alias("has_failures"))


def run_statistics(df: DataFrame) -> DataFrame:
    """(flow, completed, discarded_failures, incomplete, awaiting, active_for) from transitions.

    An item is completed if its last state is a finish, incomplete if it is a start, awaiting
    otherwise. A failed row is discarded if its item reached another state later, that is
    if the failure was resolved. active_for: seconds from the first to the last row.
    """
    s = F.col("state")
    item = df.groupBy("flow", "item").agg(F.max_by("state", F.struct("ts", "seq")).alias("last"), F.count_if(s == "FAILURE").alias("failures"), F.min("ts").alias("since"), F.max("ts").alias("until"))
    resolved = F.col("failures") - F.when(F.col("last") == "FAILURE", 1).otherwise(0)
    last = F.col("last")
    return item.groupBy("flow").agg(
        F.count_if(last.isin(FINISHES)).alias("completed"), F.sum(resolved).alias("discarded_failures"), F.count_if(last.isin(STARTS)).alias("incomplete"),
        F.count_if(~last.isin([*FINISHES, *STARTS])).alias("awaiting"), seconds(F.max("until"), F.min("since")).alias("active_for"),
    )


def book_state_counts(atoms: DataFrame, flows: DataFrame) -> DataFrame:
    """(book, flow, state, level, n): counts of atoms by book, flow and state, with all subtotals."""
    placed = atoms.join(flows.select(F.col("uuid").alias("flow"), F.col("parent_uuid").alias("book")), "flow")
    return placed.rollup("book", "flow", "state").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def failure_spread(atoms: DataFrame, bucket: str = "month", error: float = 0.02) -> DataFrame:
    """failure_trends() by type and bucket with the flows counted exactly and approximately, the
    latter in a sketch of fixed size."""
    failed = atoms.where("failure IS NOT NULL").withColumn("bucket", F.date_trunc(bucket, "updated_at"))
    return failed.groupBy("failure", "bucket").agg(F.count("*").alias("n"), F.countDistinct("flow").alias("flows"), F.approx_count_distinct("flow", error).alias("about"))


def duration_percentiles(timed: DataFrame, key: str = "name", shares=(0.5, 0.9, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Count, mean, extremes and percentiles of durations by name, from sketches of bounded size.

    A percentile is a duration at which at least that share of the rows is reached; its rank is off
    by the share 1 / accuracy at most.
    """
    d = F.col("duration")
    by = timed.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"), F.percentile_approx(d, list(shares), accuracy).alias("p"))
    return by.select(key, "n", "mean", "least", "most", *[F.get("p", F.lit(i)).alias(f"p{round(100 * x)}") for i, x in enumerate(shares)])


def first_seen(inputs: list[DataFrame], selector: Column, order: list[str]) -> DataFrame:
    """The first row of each selector value over many inputs, in the order of inputs and within them.

    Inputs have the same columns; the result has these and `source`, the number of the input.
    """
    rows = None
    for number, df in enumerate(inputs):
        df = df.withColumn("source", F.lit(number))
        rows = df if rows is None else rows.unionByName(df)
    first = rows.withColumn("__key", selector).groupBy("__key").agg(F.min_by(F.struct(*rows.columns), F.struct("source", *order)).alias("row"))
    return first.select("row.*")
