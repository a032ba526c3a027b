"""Registered queries of recovery after failures and of retries' records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.jobs.links import _symbols
from flowsift.jobs.registry import _with, oracle_sql_of, query
from flowsift.operators import boards as B
from flowsift.operators import books as K
from flowsift.operators import folds as L
from flowsift.operators import graphs as G
from flowsift.operators import recovery as R
from flowsift.operators import retries as T
from flowsift.sources.history import shared_folder
from flowsift.sources.store import HistoryStore
from flowsift.sources.views import view

# a flow's atoms in line; the first and the third may be retries, each around all that follows
_RUN = """SELECT flow, flow * 1000 + pos AS atom, CASE WHEN pos = 1 AND flow % 3 <> 0 OR pos = 3 AND flow % 4 <> 1 THEN 'retry' ELSE 'task' END AS kind,
  CASE WHEN pos > 3 AND flow % 4 <> 1 THEN flow * 1000 + 3 WHEN pos > 1 AND flow % 3 <> 0 THEN flow * 1000 + 1 END AS owner, pos, state,
  CASE WHEN part % 11 = 0 THEN 'REVERT' ELSE 'EXECUTE' END AS intention, failure FROM {atoms}"""
_ANSWERS = f"""run AS ({_RUN.format(atoms="atoms")}),
h AS (SELECT atom AS retry, flow, (flow + pos) % 4 AS n, CASE WHEN (flow + pos) % 4 = 0 THEN NULL WHEN (flow + pos) % 4 < 1 + flow % 3 THEN 'RETRY' WHEN flow % 7 = 0 THEN 'REVERT_ALL' ELSE 'REVERT' END AS d FROM run WHERE kind = 'retry'),
f AS (SELECT x.*, h1.d AS d1, o.owner AS beyond, h2.d AS d2 FROM run x LEFT JOIN h h1 ON h1.retry = x.owner LEFT JOIN run o ON o.atom = x.owner LEFT JOIN h h2 ON h2.retry = o.owner WHERE x.state = 'FAILURE'),
a AS (SELECT atom, flow, pos, failure, owner, beyond, d1, d2, CASE WHEN owner IS NULL THEN 'REVERT_ALL' WHEN d1 <> 'REVERT' THEN d1 WHEN d1 = 'REVERT' AND beyond IS NULL THEN 'REVERT' WHEN d1 = 'REVERT' THEN d2 END AS action,
  CASE WHEN d1 = 'RETRY' OR d1 = 'REVERT' AND (beyond IS NULL OR d2 = 'REVERT') THEN owner WHEN d1 = 'REVERT' AND d2 = 'RETRY' THEN beyond END AS "at",
  CASE WHEN owner IS NOT NULL AND (d1 IS NULL OR d1 = 'REVERT' AND beyond IS NOT NULL AND d2 IS NULL) THEN 'NO_ATTEMPT' END AS problem FROM f)"""
_AFTER = f"""{_ANSWERS}, t AS (SELECT "at" AS node, bool_or(action = 'RETRY') AS tries, bool_or(action = 'REVERT') AS reverts FROM a WHERE problem IS NULL AND "at" IS NOT NULL GROUP BY 1),
i AS (SELECT run.atom, run.flow, run.pos, kind, state, CASE WHEN bool_or(w.flow IS NOT NULL) OVER (PARTITION BY run.flow) OR coalesce(run.pos > min(CASE WHEN t.node IS NOT NULL THEN run.pos END) OVER (PARTITION BY run.flow), FALSE) OR coalesce(reverts, FALSE) THEN 'REVERT'
    WHEN coalesce(tries, FALSE) AND intention <> 'REVERT' THEN 'RETRY' ELSE intention END AS intention
  FROM run LEFT JOIN t ON t.node = run.atom LEFT JOIN (SELECT DISTINCT flow FROM a WHERE problem IS NULL AND action = 'REVERT_ALL') w ON w.flow = run.flow),
b AS (SELECT *, state IN ('SUCCESS', 'FAILURE') AND intention IN ('REVERT', 'RETRY') AND coalesce(max(CASE WHEN NOT (state IN ('PENDING', 'REVERTED', 'IGNORE') OR state IN ('SUCCESS', 'FAILURE') AND intention = 'REVERT') THEN pos END) OVER (PARTITION BY flow), 0) <= pos AS free FROM i),
c AS (SELECT *, free AND intention = 'RETRY' AS trying, coalesce(pos > min(CASE WHEN free AND intention = 'RETRY' THEN pos END) OVER (PARTITION BY flow), FALSE) AS fresh FROM b),
after AS (SELECT atom, kind, CASE WHEN trying AND NOT fresh THEN 'RETRYING' WHEN fresh THEN 'PENDING' WHEN free THEN 'REVERTED' ELSE state END AS state, CASE WHEN trying OR fresh THEN 'EXECUTE' ELSE intention END AS intention FROM c)"""


def _recovered(spark, d):
    """atoms, histories and answers after recovery; the last attempt of every fifth flow has a failure from before."""
    atoms = G.cut(spark.sql(_RUN, atoms=view(spark, d, "atoms")))  # read many times
    edges = G.cut(atoms.selectExpr("atom AS src", "lead(atom) OVER (PARTITION BY flow ORDER BY pos) AS dst").where("dst IS NOT NULL"))
    n = ((F.col("flow") + F.col("pos")) % 4).cast("int")
    old = F.create_map((F.col("flow") * 1000 + 4).cast("string"), F.lit("Old"))
    none = F.create_map().cast("map<string,string>")
    failures = lambda i: F.when((i == n) & (F.col("flow") % 5 == 0), old).otherwise(none)
    attempts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("v"), i.cast("string")).alias("value"), failures(i).alias("failures")))
    kind = "array<struct<value:string,failures:map<string,string>>>"
    histories = atoms.where("kind = 'retry'").select(F.col("atom").alias("retry"), "flow", F.when(n > 0, attempts.cast(kind)).otherwise(F.array().cast(kind)).alias("history"))
    decide = R.times_decision(F.col("flow") % 3 + 1, F.when(F.col("flow") % 7 == 0, "REVERT_ALL").otherwise("REVERT"))
    return R.recover(atoms, edges, histories, decide)


@query("d3_recover_answers", _with("atoms") + f', {_ANSWERS} SELECT atom, action, "at", problem FROM a')
def _(spark, d):
    return _recovered(spark, d)[2]


@query("d3_recover_atoms", _with("atoms") + f", {_AFTER} SELECT atom, state, intention FROM after")
def _(spark, d):
    return _recovered(spark, d)[0]


# each attempt with the failures that it has in the end; a history that was emptied has no row
@query("d3_recover_histories", _with("atoms") + f""", {_AFTER}, asks AS (SELECT owner AS retry, atom AS asker, pos, failure FROM a WHERE d1 IS NOT NULL UNION ALL SELECT beyond, owner, pos, failure FROM a WHERE d1 = 'REVERT' AND d2 IS NOT NULL),
noted AS (SELECT retry, asker, arg_min(failure, pos) AS failure FROM asks GROUP BY 1, 2),
k AS (SELECT h.*, unnest(range(1, n + 1)) AS attempt FROM h WHERE retry NOT IN (SELECT atom FROM after WHERE state = 'REVERTED')),
e AS (SELECT retry, n AS attempt, flow * 1000 + 4 AS asker, 'Old' AS failure FROM k WHERE flow % 5 = 0 AND attempt = n UNION ALL SELECT x.retry, n, asker, failure FROM noted x JOIN k ON k.retry = x.retry AND k.attempt = n WHERE NOT (flow % 5 = 0 AND asker = flow * 1000 + 4))
SELECT k.retry, attempt, concat('v', CAST(attempt AS VARCHAR)) AS value, CAST(asker AS VARCHAR) AS asker, failure FROM k LEFT JOIN e USING (retry, attempt)""")
def _(spark, d):
    histories = _recovered(spark, d)[1].select(F.col("retry").alias("flow"), F.col("history").alias("results"))
    rows = T.retry_attempts(histories)
    return rows.select(F.col("flow").alias("retry"), F.col("attempt").cast("bigint").alias("attempt"), "value", F.col("atom").alias("asker"), "failure")


# ---------------------------------------------------------------- outcomes, causes, resets, sets of tasks, graphs of trees


def _histories(spark, d):
    """A history for each flow: an attempt for every two atoms in order, with their failures."""
    rows = view(spark, d, "stored").withColumn("attempt", F.ceil(F.col("pos") / 2))
    noted = F.filter(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("atom", "failure"))), lambda x: x.isNotNull())
    by = rows.groupBy("flow", "attempt").agg(F.map_from_entries(F.array_sort(noted)).alias("failures"), F.max("revert_failure").alias("own"))
    ordered = F.array_sort(F.collect_list(F.struct("attempt", F.struct(F.col("attempt").alias("value"), "failures").alias("r"))), lambda x, y: (x["attempt"] - y["attempt"]).cast("int"))
    return by.groupBy("flow").agg(F.transform(ordered, lambda x: x["r"]).alias("results"), F.max("own").alias("own"))


@query("w8_outcomes", _with("stored") + "SELECT flow, atom, failure FROM stored WHERE failure IS NOT NULL")
def _(spark, d):
    return _histories(spark, d).select("flow", F.inline(T.outcomes(F.col("results")))).toDF("flow", "atom", "failure")


@query("d2_caused_by_own", _with("stored") + """SELECT flow, coalesce(bool_or(failure = 'ValueError'), FALSE) AS value_error, coalesce(max(revert_failure) = 'IOError', FALSE) OR coalesce(bool_or(failure = 'IOError'), FALSE) AS io_error,
coalesce(bool_or(failure = 'ValueError') FILTER (WHERE pos <= 2), FALSE) AS at_first FROM stored GROUP BY flow""")
def _(spark, d):
    h, results = _histories(spark, d), F.col("results")
    return h.select("flow", T.caused_by(results, "ValueError").alias("value_error"), T.caused_by(results, "IOError", own=F.col("own")).alias("io_error"), T.caused_by(results, "ValueError", 1).alias("at_first"))


@query("d5_reset_whole", _with("stored") + """SELECT flow, atom, CASE WHEN hit THEN 'PENDING' ELSE state END AS state, CASE WHEN hit THEN 'EXECUTE' ELSE 'REVERT' END AS intention, CASE WHEN NOT hit THEN failure END AS failure, CASE WHEN NOT hit THEN revert_failure END AS revert_failure,
CASE WHEN NOT hit THEN value END AS revert_results, CASE WHEN NOT hit THEN CASE WHEN value IS NULL THEN 0 ELSE 2 END WHEN pos % 3 = 0 THEN 0 END AS results FROM (SELECT *, state <> 'PENDING' AND atom <> 'atom-1' AS hit FROM stored) q""")
def _(spark, d):
    lists = F.when(F.col("value").isNotNull(), F.array("value", "value")).otherwise(F.array().cast("array<string>"))
    atoms = view(spark, d, "stored").select("flow", "atom", F.col("atom").alias("name"), "state", F.lit("REVERT").alias("intention"), "failure", "revert_failure", F.col("value").alias("revert_results"), lists.alias("results"), F.when(F.col("pos") % 3 == 0, "retry").otherwise("task").alias("kind"))
    return T.reset_atoms(atoms, injector="atom-1").select("flow", "atom", "state", "intention", "failure", "revert_failure", "revert_results", F.size("results").alias("results"))


@query("r4_registry_of_sets", _with("beats") + """, b AS (SELECT *, CASE WHEN task IN ('view', 'click') THEN 'both' ELSE task END AS t FROM beats), m AS (SELECT *, CASE WHEN t <> lag(t) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY topic ORDER BY ts, seq)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY topic ORDER BY ts, seq) AS BIGINT) AS identity FROM m) SELECT topic, identity, any_value(t) AS kind, max(ts) AS last_seen FROM n GROUP BY topic, identity""")
def _(spark, d):
    task = F.col("task")
    tasks = F.when(task == "view", F.array(F.lit("view"), F.lit("click"))).when(task == "click", F.array(F.lit("click"), F.lit("view"), F.lit("click"))).otherwise(F.array(task))
    registry = B.worker_registry(view(spark, d, "beats").withColumn("tasks", tasks).drop("task"))
    return registry.select("topic", "identity", F.when(F.array_contains("tasks", "view"), "both").otherwise(F.get("tasks", F.lit(0))).alias("kind"), "last_seen")


@query("g12_tree_nodes", _with("tree", "nodes") + "SELECT t.node, kind, priority, (SELECT count(*) FROM tree c WHERE c.parent = t.node) AS children FROM tree t JOIN nodes n ON n.node = t.node")
def _(spark, d):
    nodes, edges = G.tree_to_graph(view(spark, d, "tree").join(view(spark, d, "nodes"), "node"))
    children = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children"))
    return nodes.join(children, "node", "left").select("node", "kind", "priority", F.coalesce("children", F.lit(0).cast("bigint")).alias("children"))


@query("j5_unsatisfied_on_demand", oracle_sql_of("j5_unsatisfied_requires"))
def _(spark, d):
    provides, requires, retry = _symbols(spark, d)
    return K.unsatisfied_on_demand(view(spark, d, "gedges"), provides, requires, retry)


# ---------------------------------------------------------------- stored tables that are rewritten in parts
@query("j2_stored_flows", oracle_sql_of("j2_merge_flows"))
def _(spark, d):
    """Two arrivals of rows are merged into stored flows; the rejected ones are told."""
    parent = F.when(F.col("job") % 4 == 3, F.lit(-1).cast("bigint")).otherwise(F.col("book"))
    incoming = view(spark, d, "jobs").select((F.col("job") + 100).alias("uuid"), parent.alias("parent_uuid"), F.col("priority").alias("meta"), "state", "sequence")
    store, books = HistoryStore(spark, shared_folder(spark)), view(spark, d, "books")
    store.create("flows", view(spark, d, "flows"), "uuid")
    columns, told = ["uuid", "parent_uuid", "meta", "state"], None
    for late in (False, True):
        rejected = store.merge("flows", incoming.where((F.col("sequence") % 2 == 1) == late), "flow", "sequence", books).select(*columns, "problem")
        told = rejected if told is None else told.unionByName(rejected)
    return store.read("flows").select(*columns, F.lit(None).cast("string").alias("problem")).unionByName(told)


# flows that hold a failure start anew: their atoms are reset in the stored table
@query("d5_stored_resets", _with("atoms") + """, f AS (SELECT DISTINCT flow FROM atoms WHERE failure = 'IOError') SELECT a.flow, CAST(pos AS BIGINT) AS pos, CASE WHEN f.flow IS NULL OR state = 'PENDING' THEN state ELSE 'PENDING' END AS state,
CASE WHEN f.flow IS NULL OR state = 'PENDING' THEN intention ELSE 'EXECUTE' END AS intention, CASE WHEN f.flow IS NULL OR state = 'PENDING' THEN failure END AS failure FROM atoms a LEFT JOIN f ON f.flow = a.flow""")
def _(spark, d):
    store = HistoryStore(spark, shared_folder(spark))
    store.create("atoms", view(spark, d, "atoms").select("flow", F.col("pos").cast("bigint").alias("pos"), "name", "state", "intention", "failure"), "flow")
    failed = store.read("atoms").where("failure = 'IOError'").select("flow").distinct()
    store.rewrite("atoms", failed, lambda rows: T.reset_atoms(rows))
    return store.read("atoms").select("flow", "pos", "state", "intention", "failure")


# ---------------------------------------------------------------- folds and sketches of large groups
@query("p3_fold_in_order", _with("transitions") + "SELECT item_type, count(*) AS n, string_agg(substr(state, 1, 1), '' ORDER BY ts, seq) AS states, sum(seq) AS total FROM transitions GROUP BY item_type")
def _(spark, d):
    rows = view(spark, d, "transitions").select("item_type", "ts", "seq", F.struct(F.lit(1).cast("bigint").alias("n"), F.substring("state", 1, 1).alias("states"), F.col("seq").alias("total")).alias("v"))
    both = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), F.concat(x["states"], y["states"]).alias("states"), (x["total"] + y["total"]).alias("total"))
    return L.fold_in_order(rows, "item_type", ["ts", "seq"], "v", both, 64).select("item_type", "v.n", "v.states", "v.total")


# days are summed up to months from their sketches alone; estimates are right if they are within the sketches' error
@query("a6_rolled_up_months", _with("atoms") + "SELECT failure, CAST(date_trunc('month', updated_at) AS TIMESTAMP) AS bucket, count(*) AS n, count(DISTINCT flow) AS flows, TRUE AS near FROM atoms WHERE failure IS NOT NULL GROUP BY ALL")
def _(spark, d):
    atoms = view(spark, d, "atoms").where("failure IS NOT NULL")
    days = L.sketches(atoms, ["failure"], "day", "updated_at", distinct="flow")
    months = L.rolled_up(days, ["failure"], "month")
    exact = atoms.groupBy("failure", F.date_trunc("month", "updated_at").alias("bucket")).agg(F.countDistinct("flow").alias("flows"))
    near = F.abs(F.col("about") - F.col("flows")) <= F.greatest(F.lit(2), 0.1 * F.col("flows"))
    return months.join(exact, ["failure", "bucket"]).select("failure", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", "flows", near.alias("near"))


@query("a7_rolled_up_percentiles", _with("atoms") + "SELECT name, count(*) AS n, TRUE AS near50, TRUE AS near90 FROM atoms GROUP BY name")
def _(spark, d):
    atoms = view(spark, d, "atoms").select("name", "updated_at", "duration")
    days = L.sketches(atoms, ["name"], "month", "updated_at", values="duration")
    total = L.rolled_up(days, ["name"], None, shares=(0.5, 0.9))
    checks = [F.count_if(c) for p in ("p50", "p90") for c in (F.col("duration") <= F.col(p), F.col("duration") < F.col(p))]
    ranks = atoms.join(total.select("name", "p50", "p90"), "name").groupBy("name").agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    near = [((F.col(f"c{2 * i}") >= (q - 0.04) * F.col("n")) & (F.col(f"c{2 * i + 1}") <= (q + 0.04) * F.col("n"))).alias(f"near{round(100 * q)}") for i, q in enumerate((0.5, 0.9))]
    return total.join(ranks, "name").select("name", "n", *near)
