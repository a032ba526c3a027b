"""Registered queries of rules on single atoms, items and values, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import scalars as X
from flowsift.jobs.registry import FINISHED, STARTED, _verdict, _with, query
from flowsift.operators import books as K
from flowsift.operators import history as H
from flowsift.operators import retries as R
from flowsift.sources.views import view


@query("f1_check_job", _with("job_states") + f"SELECT seq, old_state, state, {_verdict('old_state', 'state', 'job')} AS verdict FROM (SELECT seq, state, lag(state) OVER (PARTITION BY job ORDER BY ts, seq) AS old_state FROM job_states) q WHERE old_state IS NOT NULL")
def _(spark, d):
    return H.check_transitions(view(spark, d, "job_states").withColumnRenamed("job", "item"), "job").select("seq", "old_state", "state", "verdict")


# lists of failures: those of a flow's atoms in order, each with its root types
@query("f6_failures_check", _with("stored") + """, f AS (SELECT flow, pos, CASE WHEN failure = 'ValueError' THEN 'ValueError' ELSE 'OSError' END AS m FROM stored WHERE coalesce(failure, revert_failure) IS NOT NULL AND (failure IS NOT NULL OR pos % 2 = 0))
SELECT s.flow, arg_min(m, f.pos) AS matched FROM (SELECT DISTINCT flow FROM stored) s LEFT JOIN f ON f.flow = s.flow GROUP BY s.flow""")
def _(spark, d):
    base = F.array(F.lit("Exception"), F.lit("BaseException"))
    types = F.when(F.col("failure").isNotNull(), F.concat(F.array("failure"), base)).when(F.col("revert_failure").isNotNull(), F.when(F.col("pos") % 2 == 0, F.concat(F.array(F.lit("IOError"), F.lit("OSError")), base)).otherwise(base))
    lists = view(spark, d, "stored").groupBy("flow").agg(F.transform(F.array_sort(F.collect_list(F.when(types.isNotNull(), F.struct("pos", types.alias("types"))))), lambda s: s["types"]).alias("failures"))
    return lists.select("flow", X.failures_check(F.col("failures"), "OSError", "ValueError").alias("matched"))


for _which, _value, _failure, _state, _seen in (("execute", "value", "failure", "state", "('SUCCESS','FAILURE','REVERTING')"), ("revert", "value", "revert_failure", "revert_state", "('REVERTED','REVERT_FAILURE','REVERTING')")):

    @query(f"f9_results_{_which}", _with("stored") + f"""SELECT flow, atom, CASE WHEN {_failure} IS NOT NULL THEN 'FAILURE' WHEN {_state} IN {_seen} THEN 'RESULT' WHEN {_state} = 'IGNORE' THEN 'IGNORED' ELSE 'NOT_KNOWN' END AS status,
CASE WHEN {_failure} IS NOT NULL THEN {_failure} WHEN {_state} IN {_seen} THEN {_value} END AS value FROM stored""")
    def _(spark, d, which=_which, state=_state):
        atoms = view(spark, d, "stored").withColumn("results", F.col("value")).withColumn("revert_results", F.col("value")).withColumn("state", F.col(state))
        return H.results_of(atoms, which)


@query("f9_last_results", _with("transitions") + "SELECT item, arg_max(seq, (ts, seq)) AS value FROM transitions WHERE state <> 'PENDING' GROUP BY item")
def _(spark, d):
    rows = view(spark, d, "transitions").where("state <> 'PENDING'")
    # a history's value is the last attempt's: no more than that is kept of it
    last = rows.groupBy("item").agg(F.array(F.max_by(F.struct(F.col("seq").alias("value")), F.struct("ts", "seq"))).alias("h"))
    return last.select("item", H.last_results(F.col("h")).alias("value"))


@query("f10_log_levels", _with("transitions") + f"""SELECT item_type, state, value > 150 AS failed, CASE WHEN state IN ('FAILURE', 'REVERTED') OR (item_type = 'task' AND state IN ('RETRYING', 'REVERT_FAILURE')) OR (state IN {FINISHED} AND value > 150) THEN 'WARNING' ELSE 'DEBUG' END AS level, count(*) AS n FROM transitions GROUP BY ALL""")
def _(spark, d):
    failed = F.col("value") > 150
    return H.log_level(view(spark, d, "transitions"), failed).groupBy("item_type", "state", failed.alias("failed"), "level").agg(F.count("*").alias("n"))


@query("f11_classify_keys", _with("details") + "SELECT seq, CASE WHEN details LIKE '%\"task_name\"%' AND details LIKE '%\"task_uuid\"%' THEN 'task' WHEN details LIKE '%\"retry_name\"%' AND details LIKE '%\"retry_uuid\"%' THEN 'retry' ELSE 'neither' END AS about FROM details")
def _(spark, d):
    rows = view(spark, d, "details").withColumnRenamed("details", "props")
    return H.classify_details(rows, ("task_name", "task_uuid"), ("retry_name", "retry_uuid")).select("seq", "about")


@query("s6_capture_kinds", _with("transitions") + ", k AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'retry' ELSE item_type END AS kind FROM transitions) SELECT seq, item, kind AS item_type, state, props FROM k WHERE kind IN ('task', 'retry') AND state <> 'PENDING' AND NOT (kind = 'retry' AND item IN (SELECT item FROM k WHERE kind = 'flow'))")
def _(spark, d):
    rows = view(spark, d, "transitions").withColumn("item_type", F.when(F.col("seq") % 3 == 0, "retry").otherwise(F.col("item_type")))
    skip = rows.where("item_type = 'flow'").select(F.lit("retry").alias("item_type"), "item").distinct()
    return H.capture_transitions(rows, ("RUNNING", "REVERTING", "SUCCESS", "FAILURE"), capture_flow=False, skip=skip).select("seq", "item", "item_type", "state", "props")


@query("a2_failure_maps", _with("stored") + """SELECT flow, coalesce(string_agg(atom || '=' || failure, ',' ORDER BY atom) FILTER (WHERE failure IS NOT NULL), '') AS execute,
coalesce(string_agg(atom || '=' || revert_failure, ',' ORDER BY atom) FILTER (WHERE revert_failure IS NOT NULL), '') AS revert, bool_or(failure IS NOT NULL OR revert_failure IS NOT NULL) AS has_failures FROM stored GROUP BY flow""")
def _(spark, d):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return H.failure_maps(view(spark, d, "stored")).select("flow", text("execute"), text("revert"), "has_failures")


@query("a3_run_statistics", _with("transitions") + f""", i AS (SELECT flow, item, arg_max(state, (ts, seq)) AS last, count(*) FILTER (WHERE state = 'FAILURE') AS failures, min(ts) AS since, max(ts) AS until FROM transitions GROUP BY flow, item)
SELECT flow, count(*) FILTER (WHERE last IN {FINISHED}) AS completed, CAST(sum(failures - CASE WHEN last = 'FAILURE' THEN 1 ELSE 0 END) AS BIGINT) AS discarded_failures, count(*) FILTER (WHERE last IN {STARTED}) AS incomplete,
count(*) FILTER (WHERE last NOT IN {FINISHED} AND last NOT IN {STARTED}) AS awaiting, (epoch_us(max(until)) - epoch_us(min(since))) / 1000000.0 AS active_for FROM i GROUP BY flow""")
def _(spark, d):
    return H.run_statistics(view(spark, d, "transitions"))


@query("a5_book_state_counts", _with("atoms", "flows") + "SELECT parent_uuid AS book, flow, a.state, CAST(grouping(parent_uuid, flow, a.state) AS INT) AS level, count(*) AS n FROM atoms a JOIN flows f ON f.uuid = a.flow GROUP BY ROLLUP (parent_uuid, flow, a.state)")
def _(spark, d):
    return H.book_state_counts(view(spark, d, "atoms"), view(spark, d, "flows"))


@query("a6_failure_spread", _with("atoms") + "SELECT failure, CAST(date_trunc('month', updated_at) AS TIMESTAMP) AS bucket, count(*) AS n, count(DISTINCT flow) AS flows, TRUE AS near FROM atoms WHERE failure IS NOT NULL GROUP BY ALL")
def _(spark, d):
    near = F.abs(F.col("about") - F.col("flows")) <= F.greatest(F.lit(2), 0.1 * F.col("flows"))
    return H.failure_spread(view(spark, d, "atoms")).select("failure", "bucket", "n", "flows", near.alias("near"))


# a percentile is right if at least its share of rows, less the sketch's error, reach it, and no more are below it
@query("a7_duration_percentiles", _with("atoms") + "SELECT name, count(*) AS n, round(avg(duration), 4) AS mean, min(duration) AS least, max(duration) AS most, TRUE AS near50, TRUE AS near90, TRUE AS near99 FROM atoms GROUP BY name")
def _(spark, d):
    atoms = view(spark, d, "atoms").select("name", "duration")
    stats = H.duration_percentiles(atoms)
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    checks = [F.count_if(c) for p in shares for c in (F.col("duration") <= F.col(p), F.col("duration") < F.col(p))]
    ranks = atoms.join(stats.select("name", *shares), "name").groupBy("name").agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    near = [((F.col(f"c{2 * i}") >= (q - 0.001) * F.col("n")) & (F.col(f"c{2 * i + 1}") <= (q + 0.001) * F.col("n"))).alias(f"near{p[1:]}") for i, (p, q) in enumerate(shares.items())]
    return stats.join(ranks, "name").select("name", "n", "mean", "least", "most", *near)


@query("w5_drop_repeats", _with("transitions") + f""", p AS (SELECT *, CASE WHEN seq % 3 = 0 THEN NULL ELSE (seq // 2) % 2 / 2.0 END AS progress FROM transitions),
q AS (SELECT *, lag(state) OVER w AS before, coalesce(last_value(progress IGNORE NULLS) OVER (PARTITION BY item ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS told FROM p WINDOW w AS (PARTITION BY item ORDER BY ts, seq))
SELECT seq, item, state FROM q WHERE NOT (state IS NOT DISTINCT FROM before AND state NOT IN {FINISHED} AND CASE WHEN item_type = 'task' THEN coalesce(progress = told, FALSE) ELSE TRUE END)""")
def _(spark, d):
    progress = F.when(F.col("seq") % 3 != 0, F.floor(F.col("seq") / 2) % 2 / 2.0)
    return H.drop_repeats(view(spark, d, "transitions").withColumn("progress", progress)).select("seq", "item", "state")


@query("w10_first_seen", _with("transitions") + ", r AS (SELECT 0 AS source, seq, ts, item, state FROM transitions WHERE state = 'FAILURE' UNION ALL SELECT 1, seq, ts, item, state FROM transitions WHERE state <> 'FAILURE') SELECT CAST(source AS INT) AS source, seq, item, state FROM (SELECT *, row_number() OVER (PARTITION BY item % 11, state ORDER BY source, ts, seq) AS k FROM r) q WHERE k = 1")
def _(spark, d):
    rows = view(spark, d, "transitions").select("seq", "ts", "item", "state")
    found = H.first_seen([rows.where("state = 'FAILURE'"), rows.where("state <> 'FAILURE'")], F.struct(F.col("item") % 11, F.col("state")), ["ts", "seq"])
    return found.select("source", "seq", "item", "state")


# ---------------------------------------------------------------- values
@query("x2_extract_indexed", _with("results") + """SELECT seq, CASE WHEN idx IS NULL OR (shape = 0 AND idx = '"k"') OR (shape = 1 AND idx IN ('0', '1')) THEN 'FOUND' ELSE 'NOT_SUPPLIED' END AS status,
CASE WHEN idx IS NULL THEN result WHEN shape = 0 AND idx = '"k"' THEN CAST(number AS VARCHAR) WHEN shape = 1 AND idx = '0' THEN CAST(number AS VARCHAR) WHEN shape = 1 AND idx = '1' THEN word END AS value FROM results""")
def _(spark, d):
    return view(spark, d, "results").select("seq", X.extract_indexed(F.col("result"), F.col("idx")).alias("x")).select("seq", "x.status", "x.value")


@query("x6_priority_convert", "SELECT o_orderkey AS job, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'VERY_HIGH' WHEN o_orderkey % 4 = 2 THEN 'LOW' END AS priority, CAST(CASE WHEN o_orderkey % 4 = 1 THEN 4 WHEN o_orderkey % 4 = 2 THEN 1 END AS INT) AS rank FROM orders")
def _(spark, d):
    from flowsift.operators import boards as B

    told = F.when(F.col("o_orderkey") % 4 == 0, "urgent").when(F.col("o_orderkey") % 4 == 1, "very_High").when(F.col("o_orderkey") % 4 == 2, "LOW")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("job"), X.priority_convert(told).alias("priority"), B.priority_rank(told).alias("rank"))


@query("x10_failure_report", _with("details") + """SELECT seq, CASE WHEN seq % 3 = 0 THEN 'Failure: ' ELSE 'Failure: ValueError: ' END || event_type || CASE seq % 4 WHEN 0 THEN chr(10) || 'Traceback not available.' WHEN 1 THEN chr(10) || 'Traceback not available.'
WHEN 2 THEN chr(10) || 'Traceback (most recent call last):' || chr(10) || '  line ' || seq ELSE chr(10) || 'Traceback (most recent call last):' || chr(10) || 'a' || chr(10) || 'b' END AS report FROM details""")
def _(spark, d):
    n = F.col("seq")
    kind = F.when(n % 3 != 0, "ValueError")
    traceback = F.when(n % 4 == 1, " \n ").when(n % 4 == 2, F.concat(F.lit("  line "), n, F.lit("\n\n"))).when(n % 4 == 3, "a\nb")
    return view(spark, d, "details").select("seq", X.failure_report(kind, F.col("event_type"), traceback).alias("report"))


@query("x11_failures_match", _with("stored") + ", p AS (SELECT flow, pos, failure, revert_failure, value, lag(failure) OVER w AS f0, lag(revert_failure) OVER w AS r0, lag(value IS NULL) OVER w AS v0, lag(pos) OVER w AS p0 FROM stored WINDOW w AS (PARTITION BY flow ORDER BY pos)) SELECT flow, pos, failure IS NOT DISTINCT FROM f0 AND revert_failure IS NOT DISTINCT FROM r0 AND (value IS NULL) = v0 AS same FROM p WHERE p0 IS NOT NULL")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("flow").orderBy("pos")
    text = lambda c: F.concat(F.lit("m"), F.coalesce(F.col(c), F.lit("")))
    failure = F.struct(F.array("failure").alias("exc_type_names"), F.array(F.col("value").isNull().cast("string")).alias("exc_args"), text("failure").alias("exception_str"), F.lit(None).cast("string").alias("traceback_str"), F.array(F.struct("revert_failure")).alias("causes"))
    rows = view(spark, d, "stored").select("flow", "pos", failure.alias("a")).withColumn("b", F.lag("a").over(w)).where("b IS NOT NULL")
    return rows.select("flow", F.col("pos").cast("bigint").alias("pos"), X.failures_match(F.col("a"), F.col("b")).alias("same"))


@query("x12_fill", _with("turns") + ", l AS (SELECT flow, list(name ORDER BY pos) AS a FROM turns GROUP BY flow) SELECT flow, array_to_string(list_concat(a, ['-', '-', '-', '-'])[1:4], ',') AS filled FROM l")
def _(spark, d):
    lists = view(spark, d, "turns").groupBy("flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("a"))
    return lists.select("flow", F.array_join(X.fill(F.col("a"), 4, F.lit("-")), ",").alias("filled"))


@query("x14_newlines", _with("turns") + "SELECT flow, CAST(pos AS BIGINT) AS pos, name || '|' || CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN '|' ELSE name END || '|end' AS text FROM turns")
def _(spark, d):
    middle = F.when(F.col("pos") % 3 == 0, F.lit("\r\n\r\n")).when(F.col("pos") % 3 == 1, F.lit("\n\r\n\r")).otherwise(F.concat(F.lit("\r"), F.col("name"), F.lit("\n")))
    ends = F.when(F.col("pos") % 2 == 0, "\r\n").otherwise("\r")
    raw = F.concat("name", middle, F.lit("end"), ends)
    return view(spark, d, "turns").select("flow", F.col("pos").cast("bigint").alias("pos"), X.normalize_newlines(raw, "|").alias("text"))


@query("x15_is_near", _with("atoms") + "SELECT flow, CAST(pos AS BIGINT) AS pos, abs(duration - 25) <= 5 AS near FROM atoms")
def _(spark, d):
    return view(spark, d, "atoms").select("flow", F.col("pos").cast("bigint").alias("pos"), X.is_near(F.col("duration"), F.lit(25.0), 5.0).alias("near"))


@query("d1_decisions", _with("transitions") + ", n AS (SELECT item, count(*) FILTER (WHERE state = 'FAILURE') AS attempts FROM transitions GROUP BY item) SELECT item, CASE WHEN attempts < 9 THEN 'RETRY' ELSE 'REVERT' END AS times, CASE WHEN attempts < 9 THEN attempts + 1 END AS next, 'REVERT' AS always, 'REVERT_ALL' AS always_all FROM n")
def _(spark, d):
    n = view(spark, d, "transitions").groupBy("item").agg(F.count_if(F.col("state") == "FAILURE").alias("attempts"))
    t = X.times_decision(F.col("attempts"), 9)
    return n.select("item", t["decision"].alias("times"), t["value"].alias("next"), X.always_decision()["decision"].alias("always"), X.always_decision(True)["decision"].alias("always_all"))


# each item has its own values to try: those of its group's items
@query("d1_parameterized", _with("transitions") + """, v AS (SELECT item, list_sort(['a', 'b', 'c', 'd'][1:CAST(item % 4 + 1 AS INT)]) AS vals FROM transitions GROUP BY item),
t AS (SELECT item, CASE state WHEN 'RUNNING' THEN 'a' WHEN 'REVERTING' THEN 'b' ELSE 'c' END AS x FROM transitions WHERE state IN ('RUNNING', 'REVERTING', 'FAILURE') AND seq % 5 = 0),
o AS (SELECT v.item, u.x, u.i FROM v, unnest(vals) WITH ORDINALITY AS u(x, i)), l AS (SELECT o.item, min(i) AS i FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.item = o.item AND t.x = o.x) GROUP BY o.item)
SELECT v.item, CASE WHEN l.i IS NULL THEN 'REVERT_ALL' ELSE 'RETRY' END AS decision, vals[l.i] AS value FROM v LEFT JOIN l ON l.item = v.item""")
def _(spark, d):
    rows = view(spark, d, "transitions")
    values = rows.select("item").distinct().withColumn("vals", F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (F.col("item") % 4 + 1).cast("int")))
    tried = rows.where("state IN ('RUNNING', 'REVERTING', 'FAILURE') AND seq % 5 = 0").withColumn("x", F.when(F.col("state") == "RUNNING", "a").when(F.col("state") == "REVERTING", "b").otherwise("c"))
    both = values.join(R.tried_values(tried, "item", "x", 4), "item", "left")
    found = R.foreach_decision(F.col("vals"), F.coalesce("tried", F.array().cast("array<string>")), revert_all=True)
    return both.select("item", found["decision"].alias("decision"), found["value"].alias("value"))


@query("u2_union_and_subsets", _with("turns") + """, s AS (SELECT flow, list(name ORDER BY pos) AS a, coalesce(list(text[1:1] ORDER BY pos) FILTER (WHERE pos >= 1), []) AS b FROM turns GROUP BY flow),
u AS (SELECT flow, x, min(i) AS i FROM (SELECT flow, unnest(list_concat(a, b)) AS x, unnest(range(len(a) + len(b))) AS i FROM s) q GROUP BY flow, x)
SELECT s.flow, string_agg(x, ',' ORDER BY i) AS union_, len(list_filter(a, lambda y: NOT list_contains(['user'], y))) = 0 AS subset, list_contains(a, 'user') AND list_contains(a, 'assistant') AS superset FROM s JOIN u ON u.flow = s.flow GROUP BY s.flow, a""")
def _(spark, d):
    in_order = lambda c, x: F.transform(F.array_sort(F.filter(F.collect_list(F.when(c, F.struct("pos", x.alias("x")))), lambda s: s.isNotNull())), lambda s: s["x"])
    s = view(spark, d, "turns").groupBy("flow").agg(in_order(F.lit(True), F.col("name")).alias("a"), in_order(F.col("pos") >= 1, F.substring("text", 1, 1)).alias("b"))
    user = F.array(F.lit("user"))
    return s.select("flow", F.array_join(K.ordered_union(F.col("a"), F.col("b")), ",").alias("union_"), X.is_subset(F.col("a"), user).alias("subset"), X.is_superset(F.col("a"), F.array(F.lit("assistant"), F.lit("user"))).alias("superset"))
