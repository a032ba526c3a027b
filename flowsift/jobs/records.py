"""Registered queries of records, retries, storage and streams, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowsift.functions import scalars as X
from flowsift.jobs.links import _COMMANDS
from flowsift.jobs.registry import _DECIDED_BY, _DUR, _PATHS, FINISHED, _with, oracle_sql_of, query
from flowsift.operators import boards as B
from flowsift.operators import graphs as G
from flowsift.operators import records as R
from flowsift.operators import retries as T
from flowsift.sources import history as S
from flowsift.sources.views import view
from flowsift.streaming import jobs as J

# ---------------------------------------------------------------- storage and records


@query("s5_history_round_trip", _with("books", "flows", "atoms") + ", a AS (SELECT flow, count(*) AS n, min(name) AS first, sum(duration) AS duration FROM atoms GROUP BY flow) SELECT f.uuid AS flow, b.name AS book, n, first, duration FROM flows f LEFT JOIN books b ON b.uuid = f.parent_uuid LEFT JOIN a ON a.flow = f.uuid")
def _(spark, d):
    folder = S.shared_folder(spark)
    S.write_history(*(view(spark, d, v) for v in ("books", "flows", "atoms")), folder)
    books, flows, atoms = S.read_logbooks(spark, folder)
    a = atoms.groupBy("flow").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.sum("duration").alias("duration"))
    named = flows.select(F.col("uuid").alias("flow"), F.col("parent_uuid").alias("uuid")).join(books.select("uuid", F.col("name").alias("book")), "uuid", "left")
    return named.join(a, "flow", "left").select("flow", "book", "n", "first", "duration")


@query("s2_parse_atom_envelopes", _with("atoms") + """SELECT flow, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 2 THEN 'RETRY_DETAIL' WHEN pos = 3 AND flow % 13 = 0 THEN 'OTHER' ELSE 'TASK_DETAIL' END AS type, state, CASE WHEN flow % 4 = 0 THEN '{}' ELSE '{"k":1}' END AS meta,
CASE WHEN pos = 2 THEN 2 ELSE 0 END AS attempts, CASE WHEN pos = 3 AND flow % 13 = 0 THEN 'unknown type' END AS problem FROM atoms""")
def _(spark, d):
    text = """concat('{"type":"', CASE WHEN pos = 2 THEN 'RETRY_DETAIL' WHEN pos = 3 AND flow % 13 = 0 THEN 'OTHER' ELSE 'TASK_DETAIL' END, '","atom":{"uuid":"', part, '","name":"', name, '","state":"', state, '","meta":',
      CASE WHEN flow % 4 = 0 THEN '5' ELSE '{"k":1}' END, ',"results":', CASE WHEN pos = 2 THEN '[["a",{"x":"boom"}],["b",{}]]' ELSE '"done"' END, '}}')"""
    rows = R.parse_atom_envelopes(view(spark, d, "atoms").select("flow", F.col("pos").cast("bigint").alias("pos"), F.expr(text).alias("record")))
    return rows.select("flow", "pos", "type", "atom.state", "atom.meta", F.size("attempts").alias("attempts"), "problem")


@query("s3_parse_postings", _with("jobs") + """, p AS (SELECT *, CASE WHEN job % 11 = 0 THEN 'not an object' WHEN job % 13 = 0 THEN 'name' WHEN job % 7 = 0 THEN 'priority' END AS problem FROM jobs)
SELECT job, CASE WHEN problem IS NULL THEN concat('n', CAST(job AS VARCHAR)) END AS name, CASE WHEN problem IS NOT NULL THEN NULL WHEN job % 5 = 0 THEN 'NORMAL' ELSE priority END AS priority, problem FROM p""")
def _(spark, d):
    text = """CASE WHEN job % 11 = 0 THEN '[1]' ELSE concat('{"uuid":"u', job, '"', CASE WHEN job % 13 = 0 THEN '' ELSE concat(',"name":"n', job, '"') END,
      CASE WHEN job % 7 = 0 THEN ',"priority":"urgent"' WHEN job % 5 = 0 THEN '' ELSE concat(',"priority":"', lower(priority), '"') END, '}') END"""
    return R.parse_postings(view(spark, d, "jobs").select("job", F.expr(text).alias("record"))).select("job", "name", "priority", "problem")


@query("s4_format_postings", _with("jobs") + """SELECT job, concat('{"uuid":"u', CAST(job AS VARCHAR), '","name":"n","priority":"', priority, '"', CASE WHEN job % 3 = 0 THEN '' ELSE concat(',"created_on":', CAST(sequence AS VARCHAR)) END, ',"details":', CASE WHEN job % 2 = 0 THEN '{}' ELSE '{"k":1}' END,
CASE WHEN job % 4 = 0 THEN '' ELSE concat(',"book":{"name":"b","uuid":', CAST(book AS VARCHAR), '}') END, '}') AS posting FROM jobs""")
def _(spark, d):
    opt = lambda c, x: F.when(F.expr(c), x)
    book = opt("job % 4 <> 0", F.struct(F.lit("b").alias("name"), F.col("book").alias("uuid")))
    text = R.format_posting(F.concat(F.lit("u"), F.col("job")), F.lit("n"), F.col("priority"), opt("job % 3 <> 0", F.col("sequence")), F.lit(None).cast("bigint"), opt("job % 2 <> 0", F.lit('{"k": 1}')), book)
    return view(spark, d, "jobs").select("job", text.alias("posting"))


@query("f7_validate_failures", _with("atoms") + """SELECT flow, CAST(pos AS BIGINT) AS pos, CASE WHEN part % 11 = 0 THEN 'not an object' WHEN part % 7 = 0 THEN 'traceback_str' WHEN part % 5 = 0 THEN 'version' WHEN part % 3 = 0 THEN 'root type' WHEN pos % 2 = 0 AND part % 2 = 0 THEN 'causes' END AS problem FROM atoms WHERE failure IS NOT NULL""")
def _(spark, d):
    text = """CASE WHEN part % 11 = 0 THEN '"text"' ELSE concat('{"exception_str":"boom",', CASE WHEN part % 7 = 0 THEN '' ELSE '"traceback_str":"",' END, '"exc_type_names":["', failure, CASE WHEN part % 3 = 0 THEN '"]' ELSE '","Exception"]' END,
      CASE WHEN part % 5 = 0 THEN ',"version":-1' ELSE ',"version":1' END, CASE WHEN pos % 2 = 0 THEN concat(',"causes":[{"exception_str":"a","traceback_str":"","exc_type_names":["', CASE WHEN part % 2 = 0 THEN 'object' ELSE 'BaseException' END, '"]}]') ELSE '' END, '}') END"""
    rows = view(spark, d, "atoms").where("failure IS NOT NULL").select("flow", F.col("pos").cast("bigint").alias("pos"), F.expr(text).alias("record"))
    return R.validate_failures(rows, depth=None).select("flow", "pos", "problem")


@query("f8_validate_messages", _with("requests") + """SELECT seq, CASE seq % 3 WHEN 0 THEN 'NOTIFY' WHEN 1 THEN 'REQUEST' ELSE 'RESPONSE' END AS kind,
CASE seq % 3 WHEN 0 THEN CASE WHEN seq % 5 = 0 THEN 'other keys' WHEN seq % 7 = 0 THEN 'tasks' END WHEN 1 THEN CASE WHEN seq % 7 = 0 THEN 'task_name' WHEN seq % 5 = 0 THEN 'action' WHEN seq % 11 = 0 THEN 'failures' END ELSE CASE WHEN seq % 7 = 0 THEN 'state' WHEN seq % 5 = 0 THEN 'data' END END AS problem FROM requests""")
def _(spark, d):
    text = """CASE seq % 3 WHEN 0 THEN concat('{"topic":"t', request, '","tasks":["a",', CASE WHEN seq % 7 = 0 THEN '5' ELSE '"b"' END, ']', CASE WHEN seq % 5 = 0 THEN ',"x":1' ELSE '' END, '}')
      WHEN 1 THEN concat('{"task_cls":"c",', CASE WHEN seq % 7 = 0 THEN '' ELSE '"task_name":"n",' END, '"task_version":[1,0],"action":"', CASE WHEN seq % 5 = 0 THEN 'run' ELSE 'revert' END, '","failures":{"f":{"exception_str":"e","traceback_str":"","exc_type_names":["E","', CASE WHEN seq % 11 = 0 THEN 'object' ELSE 'Exception' END, '"]}}}')
      ELSE concat('{"state":"', CASE WHEN seq % 7 = 0 THEN 'DONE' ELSE state END, '","data":', CASE WHEN seq % 5 = 0 THEN '{"result":1,"other":2}' WHEN seq % 2 = 0 THEN '{"result":[1]}' ELSE '{}' END, '}') END"""
    kind = "CASE seq % 3 WHEN 0 THEN 'NOTIFY' WHEN 1 THEN 'REQUEST' ELSE 'RESPONSE' END"
    return R.validate_messages(view(spark, d, "requests").select("seq", F.expr(kind).alias("kind"), F.expr(text).alias("record"))).select("seq", "kind", "problem")


@query("x5_mask_keys", """SELECT event_id AS seq, regexp_replace(props, '"k": ?[-0-9.]+', '"k": "***"') AS masked FROM events""")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), R.mask_keys(F.col("props"), ["k"]).alias("masked"))


@query("x9_parse_board_uri", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 0 THEN concat('h', CAST(s_suppkey AS VARCHAR)) END AS host, CASE WHEN s_suppkey % 10 <> 0 THEN CAST(6000 + s_suppkey % 100 AS INT) END AS port, CASE WHEN s_suppkey % 10 <> 0 THEN 'pw' END AS password, CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 3 AS VARCHAR) END AS db FROM supplier")
def _(spark, d):
    uri = "CASE WHEN s_suppkey % 10 = 0 THEN 'plain' ELSE concat('redis://me:pw@h', s_suppkey, ':', 6000 + s_suppkey % 100, '/0?x=1&db=', s_suppkey % 3) END"
    read = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", R.parse_board_uri(F.expr(uri)).alias("u"))
    return read.select(F.col("s_suppkey").alias("id"), "u.host", "u.port", "u.password", F.try_element_at("u.options", F.lit("db")).alias("db"))


@query("x_texts", "SELECT event_id AS seq, concat(CAST(event_id % 3 AS VARCHAR), '.', CAST(event_id % 5 AS VARCHAR)) AS version, CAST(floor(value) AS BIGINT) AS whole, concat('Failure: ', event_type, ': ', props) AS failure FROM events WHERE value >= 0")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("value >= 0")
    version = X.version_string(F.array((F.col("event_id") % 3).cast("string"), (F.col("event_id") % 5).cast("string")))
    return e.select(F.col("event_id").alias("seq"), version.alias("version"), X.as_int(F.col("value").cast("decimal(20,6)").cast("string")).alias("whole"), X.failure_text(F.col("event_type"), F.col("props")).alias("failure"))


@query("p3_reduce_rows", _with("atoms") + ", a AS (SELECT *, count(*) OVER (PARTITION BY flow) AS n FROM atoms) SELECT flow, round(sum(duration * pow(0.5, n - pos)), 4) AS folded FROM a GROUP BY flow")
def _(spark, d):
    return R.reduce_rows(view(spark, d, "atoms"), "flow", "pos", "duration", lambda a, b: a * 0.5 + b).select("flow", F.round("folded", 4).alias("folded"))


@query("p5_row_task", "SELECT event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN 100.0 / (event_id % 7) END AS result, CASE WHEN event_id % 7 = 0 THEN 'ZeroDivisionError' END AS failed FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("by"))
    return R.row_task(e, lambda by: 100.0 / int(by), ["by"], "result").select("seq", "result", F.col("failure.type").alias("failed"))


@query("u3_merge_graphs", _with("nodes") + "SELECT node, CASE WHEN node % 3 = 0 THEN priority + 100 ELSE priority END AS priority FROM nodes WHERE node % 2 = 0 OR node % 3 = 0")
def _(spark, d):
    n = view(spark, d, "nodes").select("node", "priority")
    return R.merge_graphs(n.where("node % 2 = 0"), n.where("node % 3 = 0").withColumn("priority", F.col("priority") + 100), allow_overlaps=True)


# ---------------------------------------------------------------- retries
_UPDATES = "u AS (SELECT item, ts, seq, value / 100.0 AS progress, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE props END AS details FROM transitions), c AS (SELECT *, greatest(0.0, least(1.0, coalesce(progress, 0.0))) AS p, row_number() OVER (PARTITION BY item ORDER BY ts DESC, seq DESC) AS k, row_number() OVER (PARTITION BY item, details IS NULL ORDER BY ts DESC, seq DESC) AS t FROM u)"


@query("w7_task_progress", _with("transitions") + f", {_UPDATES} SELECT a.item, a.p AS progress, CASE WHEN b.details <> '{{}}' THEN b.p END AS at_progress, CASE WHEN b.details <> '{{}}' THEN b.details END AS details FROM (SELECT * FROM c WHERE k = 1) a LEFT JOIN (SELECT * FROM c WHERE t = 1 AND details IS NOT NULL) b ON b.item = a.item")
def _(spark, d):
    details = F.expr("CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE props END")
    return T.task_progress(view(spark, d, "transitions").select("item", "ts", "seq", (F.col("value") / 100.0).alias("progress"), details.alias("details")))


def _histories(spark, d):
    """A flow's atoms in order as the attempts of a retry."""
    failures = F.when(F.col("failure").isNotNull(), F.create_map("name", "failure")).otherwise(F.create_map().cast("map<string,string>"))
    attempts = F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("value"), F.map_entries(failures).alias("f"))))
    made = F.transform(attempts, lambda a: F.struct(a["value"].alias("value"), F.map_from_entries(a["f"]).alias("failures")))
    return view(spark, d, "atoms").groupBy("flow").agg(made.alias("results"))


@query("w8_retry_attempts", _with("atoms") + "SELECT flow, CAST(pos AS INT) AS attempt, name AS value, CASE WHEN failure IS NOT NULL THEN name END AS atom, failure FROM atoms")
def _(spark, d):
    return T.retry_attempts(_histories(spark, d))


@query("d2_caused_by", _with("atoms") + "SELECT flow, coalesce(bool_or(failure = 'IOError'), FALSE) AS ever, coalesce(bool_or(failure = 'IOError') FILTER (WHERE pos = 1), FALSE) AS at_first FROM atoms GROUP BY flow")
def _(spark, d):
    return _histories(spark, d).select("flow", T.caused_by(F.col("results"), "IOError").alias("ever"), T.caused_by(F.col("results"), "IOError", 1).alias("at_first"))


@query("w9_record_retry_failures", _with("transitions") + """, a AS (SELECT item, count(*) AS attempt FROM transitions WHERE state = 'RUNNING' GROUP BY item), f AS (SELECT item, concat('w', CAST(seq % 3 AS VARCHAR)) AS atom, concat('E', CAST(seq % 5 AS VARCHAR)) AS failure, row_number() OVER (PARTITION BY item, seq % 3 ORDER BY ts, seq) AS k FROM transitions WHERE state = 'FAILURE'),
n AS (SELECT item, string_agg(concat(atom, '=', failure), ',' ORDER BY atom) AS failures FROM f WHERE k = 1 GROUP BY item) SELECT coalesce(a.item, n.item) AS item, attempt, coalesce(failures, '') AS failures, CASE WHEN attempt IS NULL THEN 'NO_ATTEMPT' END AS problem FROM a FULL JOIN n ON a.item = n.item""")
def _(spark, d):
    t = view(spark, d, "transitions")
    attempts = t.where("state = 'RUNNING'").groupBy("item").agg(F.count("*").alias("attempt"))
    failures = t.where("state = 'FAILURE'").select("item", "ts", "seq", F.expr("concat('w', seq % 3)").alias("atom"), F.expr("concat('E', seq % 5)").alias("failure"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("failures")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return T.record_retry_failures(attempts, failures).select("item", "attempt", text.alias("failures"), "problem")


@query("d1_foreach", _with("transitions") + """, n AS (SELECT item, count(*) FILTER (WHERE state = 'PENDING') AS p, count(*) FILTER (WHERE state = 'RUNNING') AS r, count(*) FILTER (WHERE state = 'SUCCESS') AS s FROM transitions GROUP BY item),
v AS (SELECT item, CASE WHEN p < 1 THEN 'PENDING' WHEN r < 2 THEN 'RUNNING' WHEN s < 1 THEN 'SUCCESS' END AS value FROM n) SELECT item, CASE WHEN value IS NULL THEN 'REVERT' ELSE 'RETRY' END AS decision, value FROM v""")
def _(spark, d):
    values = ["PENDING", "RUNNING", "RUNNING", "SUCCESS"]
    tried = T.tried_values(view(spark, d, "transitions"), "item", "state", len(values))
    values = F.array(*map(F.lit, values))
    return tried.select("item", T.foreach_decision(values, F.col("tried")).alias("d")).select("item", "d.decision", "d.value")


_DECIDED = "CASE priority % 3 WHEN 0 THEN 'RETRY' WHEN 1 THEN 'REVERT' ELSE 'REVERT_ALL' END"


@query("j14_find_retry", _with("tree", "nodes") + f", {_PATHS} SELECT p.node, arg_min(p.ancestor, p.distance) AS retry, min(p.distance) AS distance FROM p JOIN nodes n ON n.node = p.ancestor WHERE n.kind = 'retry' GROUP BY p.node")
def _(spark, d):
    return T.nearest_retry(view(spark, d, "tree"), view(spark, d, "nodes").where("kind = 'retry'"))


@query("d3_resolution", _with("tree", "nodes") + f""", {_PATHS}, c AS (SELECT p.node, p.ancestor, p.distance, {_DECIDED} AS decision FROM p JOIN nodes n ON n.node = p.ancestor WHERE n.kind = 'retry'),
s AS (SELECT node, arg_min(decision, distance) FILTER (WHERE decision <> 'REVERT') AS firm, arg_min(ancestor, distance) FILTER (WHERE decision <> 'REVERT') AS firm_at, arg_min(ancestor, distance) AS inner_at FROM c GROUP BY node)
SELECT n.node, coalesce(firm, CASE WHEN inner_at IS NOT NULL THEN 'REVERT' ELSE 'REVERT_ALL' END) AS action, CASE WHEN firm = 'RETRY' THEN firm_at WHEN firm IS NULL THEN inner_at END AS "at" FROM nodes n LEFT JOIN s ON s.node = n.node""")
def _(spark, d):
    nodes = view(spark, d, "nodes")
    decisions = nodes.where("kind = 'retry'").select("node", F.expr(_DECIDED).alias("decision"))
    chains = T.enclosing_retries(view(spark, d, "tree"), decisions)
    chains = nodes.select("node").join(chains, "node", "left").withColumn("chain", F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType)))
    return chains.select("node", T.resolution(F.col("chain")).alias("r")).select("node", "r.action", "r.at")


@query("d4_put_results", _with("transitions") + f""", u AS (SELECT item, ts, seq, CASE WHEN state = 'FAILURE' AND seq % 3 = 0 THEN 'REVERTED' WHEN state = 'FAILURE' AND seq % 3 = 1 THEN 'REVERT_FAILURE' ELSE state END AS state FROM transitions WHERE state IN {FINISHED}),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, seq) AS k FROM u), l AS (SELECT item, max(k) AS n, coalesce(max(k) FILTER (WHERE state = 'SUCCESS'), 0) AS s, coalesce(max(k) FILTER (WHERE state = 'FAILURE'), 0) AS f, coalesce(max(k) FILTER (WHERE state = 'REVERTED'), 0) AS r, coalesce(max(k) FILTER (WHERE state = 'REVERT_FAILURE'), 0) AS x FROM o GROUP BY item)
SELECT l.item, max(o.state) FILTER (WHERE k = n) AS state, max(seq) FILTER (WHERE k = s AND s > f AND s > x) AS results, max(seq) FILTER (WHERE k = f AND f > s) AS failure, max(seq) FILTER (WHERE k = r AND r > s AND r > f AND r > x) AS revert_results, max(seq) FILTER (WHERE k = x AND x > s AND x > f AND x > r) AS revert_failure FROM l JOIN o ON o.item = l.item GROUP BY l.item""")
def _(spark, d):
    state = F.expr("CASE WHEN state = 'FAILURE' AND seq % 3 = 0 THEN 'REVERTED' WHEN state = 'FAILURE' AND seq % 3 = 1 THEN 'REVERT_FAILURE' ELSE state END")
    rows = view(spark, d, "transitions").where(f"state IN {FINISHED}").select("item", "ts", "seq", state.alias("state"), F.col("seq").alias("result"))
    return T.put_results(rows)


@query("d5_reset_atoms", _with("atoms") + ", r AS (SELECT *, state <> 'PENDING' AND name <> 'atom-1' AS hit FROM atoms) SELECT flow, CAST(pos AS BIGINT) AS pos, CASE WHEN hit THEN 'PENDING' ELSE state END AS state, CASE WHEN hit THEN 'EXECUTE' ELSE intention END AS intention, CASE WHEN NOT hit THEN failure END AS failure FROM r")
def _(spark, d):
    return T.reset_atoms(view(spark, d, "atoms"), injector="atom-1").select("flow", F.col("pos").cast("bigint").alias("pos"), "state", "intention", "failure")


@query("a12_flatten_wrapped", _with("atoms") + "SELECT flow, failure, count(*) AS n FROM atoms WHERE failure IS NOT NULL GROUP BY flow, failure")
def _(spark, d):
    found = F.collect_list("failure")
    wrapped = view(spark, d, "atoms").groupBy("flow").agg(found.alias("all")).where(F.size("all") > 0)
    rows = wrapped.select("flow", F.when(F.size("all") > 1, F.col("all")).alias("wrapped"), F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("failure"))
    return T.flatten_wrapped(rows).groupBy("flow", "failure").agg(F.count("*").alias("n"))


@query("t4_priority_reorder", _with("jobs") + ", p AS (SELECT job, board, sequence, CASE WHEN job % 7 = 0 THEN 'urgent' ELSE priority END AS priority FROM jobs), r AS (SELECT *, CASE priority WHEN 'VERY_LOW' THEN 0 WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'VERY_HIGH' THEN 4 END AS rank FROM p) SELECT job, CASE WHEN rank IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY board, rank IS NULL ORDER BY rank DESC, sequence) AS INT) END AS place, CASE WHEN rank IS NULL THEN 'BAD_PRIORITY' END AS problem FROM r")
def _(spark, d):
    jobs = view(spark, d, "jobs").withColumn("priority", F.expr("CASE WHEN job % 7 = 0 THEN 'urgent' ELSE lower(priority) END"))
    return T.priority_reorder(jobs, "board", "sequence").select("job", "place", "problem")


@query("j13_merge_store", _with("jobs", "flows") + "SELECT job, concat('a=', meta, ',b=', CASE WHEN job % 2 = 0 THEN priority ELSE 'flow' END, CASE WHEN job % 2 = 0 THEN ',c=x' ELSE '' END) AS store FROM jobs JOIN flows ON flows.uuid = jobs.job")
def _(spark, d):
    flows = view(spark, d, "flows").select(F.col("uuid").alias("job"), F.create_map(F.lit("a"), "meta", F.lit("b"), F.lit("flow")).alias("f"))
    jobs = view(spark, d, "jobs").select("job", F.when(F.col("job") % 2 == 0, F.create_map(F.lit("b"), "priority", F.lit("c"), F.lit("x"))).alias("j"))
    entries = F.array_sort(F.map_entries(T.merge_store(F.col("f"), F.col("j"))))
    return jobs.join(flows, "job").select("job", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("store"))


@query("r7_match_responses", _with("requests") + """, o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts, seq) AS k FROM requests), w AS (SELECT request, min(k) AS opened FROM o WHERE state = 'WAITING' GROUP BY request),
e AS (SELECT o.request, min(o.k) AS ended FROM o JOIN w ON w.request = o.request WHERE o.k > opened AND state IN ('SUCCESS', 'FAILURE') GROUP BY o.request)
SELECT seq, o.request, CASE WHEN k = opened THEN 'OPENED' WHEN opened IS NULL OR k < opened OR state = 'WAITING' OR k > ended THEN 'DROPPED' WHEN state = 'PENDING' THEN 'PASSED' WHEN state = 'RUNNING' THEN 'MOVED' ELSE 'CLOSED' END AS verdict FROM o LEFT JOIN w ON w.request = o.request LEFT JOIN e ON e.request = o.request""")
def _(spark, d):
    return T.match_responses(view(spark, d, "requests"))


# ---------------------------------------------------------------- tree orders
_WALK = "x AS (SELECT node, [0] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, list_append(x.path, {index}) FROM x JOIN tree t ON t.parent = x.node)"


@query("g11_tree_order_dfs", _with("tree") + ", " + _WALK.format(index="CAST(t.child_idx AS INT)") + ' SELECT node, CAST(len(path) - 1 AS INT) AS depth, CAST(row_number() OVER (ORDER BY path, node) - 1 AS BIGINT) AS "at" FROM x')
def _(spark, d):
    return G.tree_order(view(spark, d, "tree"))


@query("g11_tree_order_bfs", _with("tree") + ", " + _WALK.format(index="CAST(-t.child_idx AS INT)") + ' SELECT node, CAST(len(path) - 1 AS INT) AS depth, CAST(row_number() OVER (ORDER BY path, node) - 1 AS BIGINT) AS "at" FROM x')
def _(spark, d):
    return G.tree_order(view(spark, d, "tree"), "bfs")


# ---------------------------------------------------------------- streams
@query("r1_stream_arbitration", oracle_sql_of("r1_arbitrate_jobs"))
def _(spark, d):
    return J.drain_in_order(J.stream_view(spark, d, "commands"), lambda rows: J.stream_arbitration(rows, shards=J.shards_of(spark, d)))


@query("r5_stream_durations", _with("transitions") + ", " + _DUR + " SELECT * FROM d")
def _(spark, d):
    return J.drain_in_order(J.stream_view(spark, d, "transitions"), lambda rows: J.stream_durations(rows, shards=J.shards_of(spark, d)))


@query("r6_stream_states", oracle_sql_of("w6_replay_flow"))
def _(spark, d):
    return J.drain_in_order(J.stream_view(spark, d, "transitions"), lambda rows: J.stream_states(rows, "flow", shards=J.shards_of(spark, d)))


@query("r2_stream_expiry", _with("requests") + ", " + _DECIDED_BY.format(timeout=7200000000))
def _(spark, d):
    last = view(spark, d, "requests").agg(F.max("ts").cast("timestamp_ntz")).first()[0]
    until = (last or datetime(2000, 1, 1)) + timedelta(milliseconds=1)  # watermarks are whole milliseconds
    return J.drain_in_order(J.stream_view(spark, d, "requests"), lambda rows: J.stream_expiry(rows, 7200.0, shards=J.shards_of(spark, d)), until)


@query("r1_stream_board_results", oracle_sql_of("r1_board_results"))
def _(spark, d):
    return _streamed_board(spark, d).where("seq IS NOT NULL").select("job", "seq", "result")


@query("r1_stream_final_board", oracle_sql_of("r1_final_board"))
def _(spark, d):
    return J.last_board(_streamed_board(spark, d), F.lit("2024-01-30 12:00:00").cast("timestamp"))


def _streamed_board(spark, d):
    commands = spark.sql(_COMMANDS, commands=J.stream_view(spark, d, "commands"))
    return J.drain_in_order(commands, lambda rows: J.stream_board(rows, "1 hour", J.shards_of(spark, d)))


@query("r3_stream_sessions", _with("beats") + """, g AS (SELECT topic, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM beats WINDOW w AS (PARTITION BY topic ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY topic ORDER BY ts) AS k FROM g), s AS (SELECT topic, min(ts) AS since, max(ts) AS last_seen, count(*) AS beats FROM n GROUP BY topic, k)
SELECT * FROM s WHERE epoch_us(last_seen) + 21600000000 - 1 <= (SELECT epoch_us(max(ts)) FROM beats)""")
def _(spark, d):
    return J.drain(J.stream_sessions(J.stream_view(spark, d, "beats"), 21600.0))


@query("r4_stream_registry", _with("beats") + """, b AS (SELECT *, CASE WHEN task IN ('view', 'click') THEN 'both' ELSE task END AS t FROM beats), m AS (SELECT *, CASE WHEN t <> lag(t) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY topic ORDER BY ts, seq))
SELECT seq, topic, CAST(sum(fresh) OVER (PARTITION BY topic ORDER BY ts, seq) AS BIGINT) AS identity FROM m""")
def _(spark, d):
    task = F.col("task")
    tasks = F.when(task == "view", F.array(F.lit("view"), F.lit("click"))).when(task == "click", F.array(F.lit("click"), F.lit("view"), F.lit("click"))).otherwise(F.array(task))
    return J.drain_in_order(J.stream_view(spark, d, "beats"), lambda rows: J.stream_registry(rows.withColumn("tasks", tasks), shards=J.shards_of(spark, d)))


@query("r7_stream_responses", oracle_sql_of("r7_match_responses"))
def _(spark, d):
    return J.drain_in_order(J.stream_view(spark, d, "requests"), lambda rows: J.stream_responses(rows, shards=J.shards_of(spark, d)))


# the windows that the watermark has passed
@query("r8_stream_rates", _with("transitions") + "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS since, state, count(*) AS n FROM transitions WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM transitions) GROUP BY ALL")
def _(spark, d):
    rates = B.transition_rates(J.stream_view(spark, d, "transitions"), "1 day", "1 hour")
    return J.drain(rates).select(F.col("since").cast("timestamp_ntz").alias("since"), "state", "n")
