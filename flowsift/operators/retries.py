"""Retries and atom updates: progress, histories, decisions, resolution, stored results.

Everything here is an aggregation that combines before its shuffle, a window per key, or
a fold over a chain of enclosing retries, which is as long as a flow is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .books import array_minus
from .graphs import climb


def task_progress(updates: DataFrame) -> DataFrame:
    """(item, progress, at_progress, details) of updates (item, ts, seq, progress, details).

    Progress is that of the last update within [0, 1], 0.0 where it is null. Details are
    those of the last update that has any; empty ones (`{}`) erase what was there.
    """
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("progress", F.lit(0.0))))
    told = F.when(F.col("details").isNotNull(), F.struct("ts", "seq", progress.alias("p"), "details"))
    by = updates.groupBy("item").agg(F.max(F.struct("ts", "seq", progress.alias("p"))).alias("last"), F.max(told).alias("told"))
    kept = F.col("told.details") != "{}"
    return by.select("item", F.col("last.p").alias("progress"), F.when(kept, F.col("told.p")).alias("at_progress"), F.when(kept, F.col("told.details")).alias("details"))


def retry_attempts(histories: DataFrame) -> DataFrame:
    """One row for each attempt and failed atom of (flow, results array<struct<value, failures map>>).

    Attempts count from 1. An attempt without failures has one row with a null atom, an
    empty history has none.
    """
    each = histories.select("flow", F.posexplode("results").alias("attempt", "r"))
    return each.select("flow", (F.col("attempt") + 1).alias("attempt"), F.col("r.value").alias("value"), F.explode_outer("r.failures").alias("atom", "failure"))


def outcomes(results: Column, attempt: int | None = None) -> Column:
    """array<struct<key, value>> of the failed atoms and their failures of one attempt (from 1), or of all in order."""
    some = results if attempt is None else F.slice(results, attempt, 1)
    return F.flatten(F.transform(some, lambda r: F.map_entries(r["failures"])))


def record_retry_failures(attempts: DataFrame, failures: DataFrame) -> DataFrame:
    """(item, attempt, failures map, problem): the failures of an item go to its last attempt.

    attempts (item, attempt), failures (item, ts, seq, atom, failure). Of an atom's failures
    the first is kept. An item with failures and no attempt has the problem NO_ATTEMPT.
    """
    first = failures.groupBy("item", "atom").agg(F.min(F.struct("ts", "seq", "failure")).alias("f"))
    noted = first.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("atom", "f.failure"))).alias("failures"))
    last = attempts.groupBy("item").agg(F.max("attempt").alias("attempt"))
    nothing = F.create_map().cast("map<string,string>")
    both = last.join(noted, "item", "full")
    return both.select("item", "attempt", F.coalesce("failures", nothing).alias("failures"), F.when(F.col("attempt").isNull(), "NO_ATTEMPT").alias("problem"))


def tried_values(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, tried): each value as often as it was tried, but `most` times at the most.

    Values are counted first, so that a row never holds a key's whole history; for
    foreach_decision `most` is the number of values to try.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    times = F.when(F.col(value).isNotNull(), F.array_repeat(F.col(value), F.least("n", F.lit(most)).cast("int"))).otherwise(F.array().cast("array<string>"))
    return counts.groupBy(key).agg(F.flatten(F.collect_list(times)).alias("tried"))


def foreach_decision(values: Column, tried: Column, revert_all: bool = False) -> Column:
    """struct(decision, value): the first value that wasn't tried yet, else the way of giving up."""
    left = array_minus(values, tried)
    return F.struct(F.when(F.size(left) > 0, "RETRY").otherwise("REVERT_ALL" if revert_all else "REVERT").alias("decision"), F.get(left, F.lit(0)).alias("value"))


def caused_by(results: Column, name: str, attempt: int | None = None, own: Column | None = None) -> Column:
    """Whether a failure of one attempt (from 1), or of any, has the type's name; false without failures.

    own: the retry's own failure, which counts as well if it is given.
    """
    hit = lambda r: F.exists(F.map_values(r["failures"]), lambda f: f == name)
    some = F.exists(results, hit) if attempt is None else hit(F.get(results, F.lit(attempt - 1)))
    some = F.coalesce(some, F.lit(False))
    return some if own is None else some | F.coalesce(own == name, F.lit(False))


def find_retry(pairs: DataFrame, retries: DataFrame) -> DataFrame:
    """(node, retry, distance): the nearest enclosing retry. pairs: (node, ancestor, distance)."""
    near = pairs.join(retries.select(F.col("node").alias("ancestor")), "ancestor").groupBy("node").agg(F.min(F.struct("distance", "ancestor")).alias("r"))
    return near.select("node", F.col("r.ancestor").alias("retry"), "r.distance")


def nearest_retry(tree: DataFrame, retries: DataFrame) -> DataFrame:
    """find_retry() of a tree (node, parent): pointers climb until a retry is met, no pairs of nodes arise."""
    above = tree.join(retries.select(F.col("node").alias("parent"), F.lit(True).alias("is_retry")), "parent", "left")
    found = F.when(F.col("is_retry"), F.struct(F.col("parent").alias("retry"), F.lit(1).alias("distance")))
    farther = lambda near, far: F.when(far["found"].isNotNull(), F.struct(far["found"]["retry"].alias("retry"), (far["found"]["distance"] + near["steps"]).alias("distance")))
    both = climb(above, F.struct(F.lit(1).alias("steps"), found.alias("found")), lambda x, y: F.struct((x["steps"] + y["steps"]).alias("steps"), F.coalesce(x["found"], farther(x, y)).alias("found")))
    return both.where("c.found IS NOT NULL").select("node", "c.found.retry", "c.found.distance")


def resolution(chain: Column, defer_reverts: bool = False) -> Column:
    """struct(action, at) for a failed atom's enclosing retries, an array<struct<retry, decision>>, innermost first.

    RETRY acts at its retry, REVERT_ALL on the whole flow. REVERT asks outward: a RETRY or
    REVERT_ALL decided there wins, else it reverts its own subflow; with defer_reverts the
    outer answer always counts. Without any retry the whole flow is reverted.
    """
    answer = lambda action, at, given: F.struct(action.alias("action"), at.cast("bigint").alias("at"), F.lit(given).alias("given"))
    start = answer(F.lit("REVERT_ALL"), F.lit(None), False)

    def ask(outer: Column, r: Column) -> Column:
        revert = answer(F.lit("REVERT"), r["retry"], True)
        passed = outer if defer_reverts else F.when(outer["given"] & (outer["action"] != "REVERT"), outer).otherwise(revert)
        return F.when(r["decision"] == "RETRY", answer(F.lit("RETRY"), r["retry"], True)).when(r["decision"] == "REVERT_ALL", answer(F.lit("REVERT_ALL"), F.lit(None), True)).otherwise(passed)

    out = F.aggregate(F.reverse(chain), start, ask)
    return F.struct(out["action"].alias("action"), out["at"].alias("at"))


def retry_chains(nodes: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(node, chain) for resolution(). decisions: (node, decision) of the retries; nodes outside all have an empty chain."""
    held = pairs.join(decisions.select(F.col("node").alias("ancestor"), "decision"), "ancestor")
    ordered = F.array_sort(F.collect_list(F.struct("distance", F.col("ancestor").alias("retry"), "decision")))
    by = held.groupBy("node").agg(F.transform(ordered, lambda r: F.struct(r["retry"].alias("retry"), r["decision"].alias("decision"))).alias("chain"))
    return nodes.select("node").join(by, "node", "left").select("node", F.coalesce("chain", F.array().cast(by.schema["chain"].dataType)).alias("chain"))


def enclosing_retries(tree: DataFrame, decisions: DataFrame) -> DataFrame:
    """retry_chains() of a tree (node, parent): a row holds the retries around a node, not its ancestors."""
    above = tree.join(decisions.select(F.col("node").alias("parent"), "decision"), "parent", "left")
    one = F.when(F.col("decision").isNotNull(), F.array(F.struct(F.col("parent").alias("retry"), "decision"))).otherwise(F.array())
    return climb(above, one, lambda near, far: F.concat(near, far)).select("node", F.col("c").alias("chain"))


def put_results(updates: DataFrame) -> DataFrame:
    """A task's stored fields after all its updates (item, ts, seq, state, result) in order.

    SUCCESS sets the result and clears the rest; FAILURE sets the failure and clears the
    rest; REVERTED sets the revert result and clears the revert failure; REVERT_FAILURE sets
    the revert failure and clears both results. So a field holds its last value unless a
    state that clears it came later: one aggregation, no gathered histories.
    """
    states = {"s": "SUCCESS", "f": "FAILURE", "r": "REVERTED", "x": "REVERT_FAILURE"}
    last = [F.max(F.when(F.col("state") == v, F.struct("ts", "seq", "result"))).alias(k) for k, v in states.items()]
    by = updates.groupBy("item").agg(F.max(F.struct("ts", "seq", "state")).alias("last"), *last)

    def field(own: str, cleared: str) -> Column:
        later = lambda c: F.col(c).isNull() | (F.struct(f"{own}.ts", f"{own}.seq") > F.struct(f"{c}.ts", f"{c}.seq"))
        kept = F.col(own).isNotNull()
        for c in cleared:
            kept = kept & later(c)
        return F.when(kept, F.col(f"{own}.result"))

    return by.select("item", F.col("last.state").alias("state"), field("s", "fx").alias("results"), field("f", "s").alias("failure"), field("r", "sfx").alias("revert_results"), field("x", "sfr").alias("revert_failure"))


def reset_atoms(atoms: DataFrame, state: str = "PENDING", injector: str | None = None) -> DataFrame:
    """Results and failures cleared, state set, intention EXECUTE; the injector and atoms in that state stay as they are.

    Of the columns failure, results, revert_failure and revert_results those that are there are cleared. A retry's
    results, an array, become an empty one: rows whose `kind` is retry, or all where there is no such column.
    """
    change = ~F.col("state").eqNullSafe(F.lit(state)) & ~F.col("name").eqNullSafe(F.lit(injector))
    cleared = {c: F.when(~change, F.col(c)) for c in ("failure", "results", "revert_failure", "revert_results") if c in atoms.columns}
    if "results" in cleared and atoms.schema["results"].dataType.typeName() == "array":
        kept = F.when(~change, F.col("results"))
        retry = change & (F.coalesce(F.col("kind") == "retry", F.lit(False)) if "kind" in atoms.columns else F.lit(True))
        cleared["results"] = F.when(retry, F.array().cast(atoms.schema["results"].dataType)).otherwise(kept)
    return atoms.withColumns(cleared | {"intention": F.when(change, "EXECUTE").otherwise(F.col("intention")), "state": F.when(change, state).otherwise(F.col("state"))})


def flatten_wrapped(failures: DataFrame) -> DataFrame:
    """(flow, failure): wrapped failures give those inside them, others themselves."""
    inside = F.when(F.size("wrapped") > 0, F.col("wrapped")).otherwise(F.array("failure"))
    return failures.select("flow", F.explode(inside).alias("failure"))


def priority_reorder(df: DataFrame, key: str, order: str) -> DataFrame:
    """Stable order by priority, highest first, per key; unknown priorities have no place and a problem."""
    from .boards import placed, priority_rank

    rank = priority_rank(F.col("priority"))
    known = placed(df.where(rank.isNotNull()), key, [rank.desc(), F.asc(order)])
    unknown = df.where(rank.isNull()).withColumn("place", F.lit(None).cast("int"))
    return known.withColumn("problem", F.lit(None).cast("string")).unionByName(unknown.withColumn("problem", F.lit("BAD_PRIORITY")))


def merge_store(flow_store: Column, job_store: Column) -> Column:
    """The flow's inputs overlaid by the job's; null maps count as empty."""
    none = F.create_map().cast("map<string,string>")
    job = F.coalesce(job_store, none)
    return F.map_concat(F.map_filter(F.coalesce(flow_store, none), lambda k, _: ~F.map_contains_key(job, k)), job)


def match_responses(messages: DataFrame) -> DataFrame:
    """Verdict on each of a request's rows (request, ts, seq, state): OPENED, PASSED (also an EVENT), MOVED, CLOSED,
    DROPPED or, for a state that there isn't, UNKNOWN.

    What comes for a request that isn't open yet, or was closed, is dropped.
    """
    before = Window.partitionBy("request").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("state") == "WAITING").over(before), F.lit(False))
    rows = messages.withColumn("known", known)
    ends = F.col("known") & F.col("state").isin("SUCCESS", "FAILURE")
    rows = rows.withColumn("closed", F.coalesce(F.max(ends).over(before), F.lit(False)))
    waiting = F.col("state") == "WAITING"
    verdict = (
        F.when(waiting & ~F.col("known"), "OPENED").when(waiting | ~F.col("known") | F.col("closed"), "DROPPED")
        .when(F.col("state").isin("PENDING", "EVENT"), "PASSED").when(F.col("state") == "RUNNING", "MOVED")
        .when(F.col("state").isin("SUCCESS", "FAILURE"), "CLOSED").otherwise("UNKNOWN")
    )
    return rows.select("seq", "request", verdict.alias("verdict"))


def put_retry_results(updates: DataFrame) -> DataFrame:
    """A retry's stored fields after all its updates (item, ts, seq, state, result) in order.

    As put_results(), but SUCCESS appends to the results, which nothing clears; FAILURE,
    SUCCESS and REVERTED clear the revert failure, and REVERT_FAILURE the revert result.
    attempts: how many results there are; last: the last of them.
    """
    states = {"s": "SUCCESS", "f": "FAILURE", "r": "REVERTED", "x": "REVERT_FAILURE"}
    last = [F.max(F.when(F.col("state") == v, F.struct("ts", "seq", "result"))).alias(k) for k, v in states.items()]
    by = updates.groupBy("item").agg(F.max(F.struct("ts", "seq", "state")).alias("last"), F.count_if(F.col("state") == "SUCCESS").alias("attempts"), *last)

    def field(own: str, cleared: str) -> Column:
        later = lambda c: F.col(c).isNull() | (F.struct(f"{own}.ts", f"{own}.seq") > F.struct(f"{c}.ts", f"{c}.seq"))
        kept = F.col(own).isNotNull()
        for c in cleared:
            kept = kept & later(c)
        return F.when(kept, F.col(f"{own}.result"))

    return by.select("item", F.col("last.state").alias("state"), "attempts", F.col("s.result").alias("last"), field("f", "s").alias("failure"), field("r", "sfx").alias("revert_results"), field("x", "sfr").alias("revert_failure"))


def altered(updates: DataFrame) -> DataFrame:
    """(item, seq, altered): whether each update of a task (item, ts, seq, state, result) changed what is stored.

    The state changes, or a result that is kept is another one than before. A task's fields
    before an update are those after the one before it, so the last update of each state and
    the last that cleared it decide; all are running maxima over one sorted stream.
    """
    w = Window.partitionBy("item").orderBy("ts", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    states = {"s": "SUCCESS", "f": "FAILURE", "r": "REVERTED", "x": "REVERT_FAILURE"}
    rows = updates.withColumn("n", F.row_number().over(w)).withColumn("old", F.lag("state").over(w))
    for k, v in states.items():
        rows = rows.withColumn(k, F.max(F.when(F.col("state") == v, F.struct("n", "result"))).over(before))
    n = lambda k: F.coalesce(F.col(f"{k}.n"), F.lit(0))
    held = lambda own, *cleared: F.when(n(own) > F.greatest(F.lit(0), *map(n, cleared)), F.col(f"{own}.result"))
    results, failure, reverted, broken = held("s", "f", "x"), held("f", "s"), held("r", "s", "f", "x"), held("x", "s", "f", "r")
    some = lambda *fields: F.coalesce(*fields).isNotNull()
    differs = lambda field: ~F.col("result").eqNullSafe(field)
    state = F.col("state")
    changed = (
        F.when(state == "SUCCESS", differs(results) | some(failure, reverted, broken))
        .when(state == "FAILURE", differs(failure) | some(results, reverted, broken))
        .when(state == "REVERTED", differs(reverted) | some(broken))
        .when(state == "REVERT_FAILURE", differs(broken) | some(results, reverted)).otherwise(False)
    )
    return rows.select("item", "seq", (~state.eqNullSafe(F.coalesce("old", F.lit("PENDING"))) | changed).alias("altered"))
