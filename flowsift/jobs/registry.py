"""Registered queries of the workflow-history operators, each with its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions import scalars as X
from flowsift.operators import boards as B
from flowsift.operators import books as K
from flowsift.operators import graphs as G
from flowsift.operators import history as H
from flowsift.operators.states import ALLOWED, FLOW_IGNORED
from flowsift.sources.views import duck, view

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    """The modules that register further queries."""
    for module in ("atoms", "links", "records", "recovery"):
        importlib.import_module(f"flowsift.jobs.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def oracle_sql_of(name: str) -> str:
    return _sql[name]


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({duck(n)})" for n in names) + " "


def _pairs(old: str, new: str, listed) -> str:
    return f"concat({old}, '>', {new}) IN ({', '.join(f"'{a}>{b}'" for a, b in listed)})"


WATCHED = "('RUNNING','REVERTING','SUCCESS','FAILURE','REVERTED','REVERT_FAILURE','PENDING')"
FINISHED = "('SUCCESS','FAILURE','REVERTED','REVERT_FAILURE')"
STARTED = "('RUNNING','REVERTING')"
BY_ITEM = "(PARTITION BY item ORDER BY ts, seq)"


def _verdict(old: str, new: str, kind: str) -> str:
    if kind in ("task", "retry"):
        return f"CASE WHEN {_pairs(old, new, ALLOWED[kind])} THEN 'ALLOWED' ELSE 'IGNORED' END"
    ignored = f"WHEN {_pairs(old, new, FLOW_IGNORED)} THEN 'IGNORED'" if kind == "flow" else ""
    return f"CASE WHEN {_pairs(old, new, ALLOWED[kind])} THEN 'ALLOWED' WHEN {old} = {new} THEN 'IGNORED' {ignored} ELSE 'INVALID' END"


# ---------------------------------------------------------------- filters
for _kind, _source, _key in (("flow", "transitions", "item"), ("task", "transitions", "item"), ("retry", "transitions", "item"), ("request", "requests", "request")):

    @query(
        f"f1_check_{_kind}",
        _with(_source) + f"SELECT seq, old_state, state, {_verdict('old_state', 'state', _kind)} AS verdict FROM (SELECT seq, state, lag(state) OVER (PARTITION BY {_key} ORDER BY ts, seq) AS old_state FROM {_source}) q WHERE old_state IS NOT NULL",
    )
    def _(spark, d, kind=_kind, source=_source, key=_key):
        return H.check_transitions(view(spark, d, source).withColumnRenamed(key, "item"), kind).select("seq", "old_state", "state", "verdict")


@query("f2_job_state", _with("jobs", "commands") + """, c AS (SELECT job, max(ts) AS claimed_at, CAST(86400.0 * (1 + job % 300) AS DOUBLE) AS expiry_s FROM commands WHERE command = 'claim' GROUP BY job)
SELECT coalesce(j.job, c.job) AS job, CASE WHEN j.job IS NULL THEN 'COMPLETE' WHEN c.job IS NOT NULL AND TIMESTAMP '2024-06-01' < claimed_at + to_microseconds(CAST(expiry_s * 1000000 AS BIGINT)) THEN 'CLAIMED' ELSE 'UNCLAIMED' END AS state
FROM jobs j FULL JOIN c ON j.job = c.job""")
def _(spark, d):
    claims = view(spark, d, "commands").where("command = 'claim'").groupBy("job").agg(F.max("ts").alias("claimed_at")).withColumn("expiry_s", 86400.0 * (1 + F.col("job") % 300))
    return B.job_state(view(spark, d, "jobs"), claims, F.lit("2024-06-01").cast("timestamp"))


@query("f3_iter_jobs", _with("jobs") + "SELECT job, board, CAST(row_number() OVER (PARTITION BY board ORDER BY CASE priority WHEN 'VERY_LOW' THEN 0 WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END DESC, sequence) AS INT) AS place FROM jobs WHERE state = 'UNCLAIMED'")
def _(spark, d):
    return B.iter_jobs(view(spark, d, "jobs"), only_unclaimed=True).select("job", "board", "place")


@query("f4_unfinished_flows", _with("flows") + "SELECT uuid, parent_uuid FROM flows WHERE coalesce(state, 'PENDING') NOT IN ('SUCCESS', 'FAILURE', 'REVERTED')")
def _(spark, d):
    return H.unfinished_flows(view(spark, d, "flows")).select("uuid", "parent_uuid")


@query("f5_unfinished_atoms", _with("atoms") + f"SELECT flow, name, count(*) AS n FROM atoms WHERE state IN {STARTED} GROUP BY flow, name")
def _(spark, d):
    return H.unfinished_atoms(view(spark, d, "atoms")).groupBy("flow", "name").agg(F.count("*").alias("n"))


@query("f6_failure_check", _with("atoms") + "SELECT CASE WHEN failure = 'IOError' THEN 'IOError' ELSE 'Exception' END AS matched, count(*) AS n FROM atoms WHERE failure IS NOT NULL GROUP BY 1")
def _(spark, d):
    types = F.array("failure", F.lit("Exception"), F.lit("BaseException"))
    return view(spark, d, "atoms").where("failure IS NOT NULL").groupBy(X.failure_check(types, "IOError", "Exception").alias("matched")).agg(F.count("*").alias("n"))


@query("f9_visible_results", _with("atoms") + """SELECT flow, pos, name, CASE WHEN failure IS NOT NULL THEN 'FAILURE' WHEN state IN ('SUCCESS','FAILURE','REVERTING') THEN 'RESULT' WHEN intention = 'IGNORE' THEN 'IGNORED' ELSE 'NOT_KNOWN' END AS status,
CASE WHEN failure IS NOT NULL THEN failure WHEN state IN ('SUCCESS','FAILURE','REVERTING') THEN CAST(part AS VARCHAR) END AS value FROM atoms""")
def _(spark, d):
    return H.visible_results(view(spark, d, "atoms")).withColumn("pos", F.col("pos").cast("bigint"))


@query("f10_log_level", _with("transitions") + "SELECT item_type, state, CASE WHEN state IN ('FAILURE', 'REVERTED') OR (item_type = 'task' AND state IN ('RETRYING', 'REVERT_FAILURE')) THEN 'WARNING' ELSE 'DEBUG' END AS level, count(*) AS n FROM transitions GROUP BY ALL")
def _(spark, d):
    return H.log_level(view(spark, d, "transitions")).groupBy("item_type", "state", "level").agg(F.count("*").alias("n"))


@query("f11_classify_details", _with("transitions") + "SELECT CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'task' WHEN json_extract(props, '$.r') IS NOT NULL THEN 'retry' ELSE 'neither' END AS about, count(*) AS n FROM transitions GROUP BY 1")
def _(spark, d):
    return H.classify_details(view(spark, d, "transitions")).groupBy("about").agg(F.count("*").alias("n"))


@query("s6_capture_transitions", _with("transitions") + "SELECT seq, item, state FROM transitions WHERE item_type = 'task' AND state IN ('FAILURE', 'SUCCESS') AND item NOT IN (1, 2, 3)")
def _(spark, d):
    return H.capture_transitions(view(spark, d, "transitions"), ("FAILURE", "SUCCESS"), capture_flow=False, skip_items=[1, 2, 3]).select("seq", "item", "state")


# ---------------------------------------------------------------- windows
_DUR = f"""d AS (SELECT seq, item_type, flow, item, state, (epoch_us(ts) - epoch_us(since)) / 1000000.0 AS duration FROM (
  SELECT *, lag(state) OVER w AS before, lag(ts) OVER w AS since FROM transitions WHERE state IN {WATCHED} WINDOW w AS (PARTITION BY flow, item_type, item ORDER BY ts, seq)) q
  WHERE state IN {FINISHED} AND before IN {STARTED})"""


@query("w1_durations", _with("transitions") + ", " + _DUR + " SELECT * FROM d")
def _(spark, d):
    return H.durations(view(spark, d, "transitions"))


@query("a7_duration_stats", _with("transitions") + ", " + _DUR + " SELECT item_type, count(*) AS n, round(avg(duration), 4) AS mean, min(duration) AS least, max(duration) AS most, round(quantile_cont(duration, 0.5), 4) AS median FROM d GROUP BY item_type")
def _(spark, d):
    return H.duration_stats(H.durations(view(spark, d, "transitions")))


@query("w2_leftover_timers", _with("transitions") + f", l AS (SELECT item_type, item, arg_max(state, seq) AS state FROM (SELECT *, row_number() OVER (PARTITION BY flow, item_type, item ORDER BY ts, seq) AS k FROM transitions WHERE state IN {WATCHED}) q GROUP BY flow, item_type, item) SELECT item_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY flow, item_type, item ORDER BY ts DESC, seq DESC) AS k FROM transitions WHERE state IN {WATCHED}) q WHERE k = 1 AND state IN {STARTED} GROUP BY item_type")
def _(spark, d):
    return H.leftover_timers(view(spark, d, "transitions"))


@query("w3_latest_state", _with("transitions") + "SELECT item, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, seq DESC) AS k FROM transitions) q WHERE k = 1")
def _(spark, d):
    return H.latest_state(view(spark, d, "transitions"))


@query("w4_event_timestamps", _with("transitions") + "SELECT item, concat(state, '-timestamp') AS name, CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) AS at FROM transitions GROUP BY item, state")
def _(spark, d):
    return H.event_timestamps(view(spark, d, "transitions"))


@query("w5_drop_identity", _with("transitions") + f"SELECT seq, item, state FROM (SELECT *, lag(state) OVER {BY_ITEM} AS before FROM transitions) q WHERE before IS DISTINCT FROM state OR state IN {FINISHED}")
def _(spark, d):
    return H.drop_identity(view(spark, d, "transitions")).select("seq", "item", "state")


for _kind in ("task", "flow"):

    @query(
        f"w6_replay_{_kind}",
        _with("transitions") + f""", e AS (SELECT *, row_number() OVER {BY_ITEM} AS k FROM transitions),
r AS (SELECT item, k, seq, 'PENDING' AS old_state, state, {_verdict("'PENDING'", "state", _kind)} AS verdict FROM e WHERE k = 1
  UNION ALL SELECT e.item, e.k, e.seq, CASE WHEN r.verdict = 'ALLOWED' THEN r.state ELSE r.old_state END, e.state, {_verdict("(CASE WHEN r.verdict = 'ALLOWED' THEN r.state ELSE r.old_state END)", "e.state", _kind)} FROM r JOIN e ON e.item = r.item AND e.k = r.k + 1)
SELECT item, seq, old_state, state, verdict, CASE WHEN verdict = 'ALLOWED' THEN state ELSE old_state END AS after FROM r""",
    )
    def _(spark, d, kind=_kind):
        return H.replay_states(view(spark, d, "transitions"), kind, "PENDING")


@query("w10_unique_seen", _with("transitions") + "SELECT seq, item, state FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, seq) AS k FROM transitions) q WHERE k = 1")
def _(spark, d):
    return H.unique_seen(view(spark, d, "transitions"), "item", ["ts", "seq"]).select("seq", "item", "state")


@query("w11_last_transitions", _with("transitions") + "SELECT flow, seq, CAST(k AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts DESC, seq DESC) AS k FROM transitions) q WHERE k <= 10")
def _(spark, d):
    return H.last_transitions(view(spark, d, "transitions"), 10).select("flow", "seq", "back")


# ---------------------------------------------------------------- aggregates
@query("a1_flow_success", _with("atoms") + "SELECT flow, bool_and(intention = 'IGNORE' OR state = 'SUCCESS') AS success FROM atoms GROUP BY flow")
def _(spark, d):
    return H.flow_success(view(spark, d, "atoms"))


@query("a2_flow_failures", _with("atoms") + "SELECT flow, bool_or(failure IS NOT NULL) AS has_failures, count(failure) AS n, count(DISTINCT failure) AS types FROM atoms GROUP BY flow")
def _(spark, d):
    return H.flow_failures(view(spark, d, "atoms"))


@query("a3_flow_statistics", _with("transitions") + f"SELECT flow, count(*) FILTER (WHERE state IN {FINISHED}) AS completed, count(*) FILTER (WHERE state = 'FAILURE') AS failures, count(DISTINCT item) AS items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS active_for FROM transitions GROUP BY flow")
def _(spark, d):
    return H.flow_statistics(view(spark, d, "transitions"))


@query("a4_seconds_per_state", _with("transitions") + f", s AS (SELECT item, lower(state) AS state, (epoch_us(lead(ts) OVER {BY_ITEM}) - epoch_us(ts)) / 1000000.0 AS s FROM transitions) SELECT item, round(coalesce(sum(s) FILTER (WHERE state = 'running'), 0.0), 3) AS running, round(coalesce(sum(s) FILTER (WHERE state = 'reverting'), 0.0), 3) AS reverting FROM s GROUP BY item")
def _(spark, d):
    return H.seconds_per_state(view(spark, d, "transitions"), ["RUNNING", "REVERTING"])


@query("a5_state_counts", _with("atoms") + "SELECT intention, state, CAST(grouping(intention, state) AS INT) AS level, count(*) AS n FROM atoms GROUP BY ROLLUP (intention, state)")
def _(spark, d):
    return H.state_counts(view(spark, d, "atoms"))


@query("a6_failure_trends", _with("atoms") + "SELECT failure, name, CAST(date_trunc('month', updated_at) AS TIMESTAMP) AS bucket, count(*) AS n, count(DISTINCT flow) AS flows FROM atoms WHERE failure IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return H.failure_trends(view(spark, d, "atoms"))


@query("a6_failure_cube", _with("atoms") + "SELECT failure, name, CAST(grouping(failure, name) AS INT) AS level, count(*) AS n FROM atoms WHERE failure IS NOT NULL GROUP BY CUBE (failure, name)")
def _(spark, d):
    return H.failure_cube(view(spark, d, "atoms"))


@query("a8_worker_summary", _with("commands") + "SELECT who, count(*) FILTER (WHERE command = 'claim') AS claimed, count(*) FILTER (WHERE command = 'consume') AS consumed, count(*) FILTER (WHERE command = 'abandon') AS abandoned, count(*) FILTER (WHERE command = 'trash') AS trashed FROM commands GROUP BY who")
def _(spark, d):
    return H.worker_summary(view(spark, d, "commands"))


@query("a9_duplicate_atoms", _with("atoms") + "SELECT flow, name, count(*) AS n FROM atoms GROUP BY flow, name HAVING count(*) > 1")
def _(spark, d):
    return H.duplicate_atoms(view(spark, d, "atoms"))


@query("a10_graph_summary", _with("nodes", "edges") + "SELECT n, m, round(CASE WHEN n > 1 THEN m / (n * (n - 1.0)) ELSE 0.0 END, 8) AS density FROM (SELECT count(*) AS n FROM nodes) a, (SELECT count(*) AS m FROM edges) b")
def _(spark, d):
    return G.graph_summary(view(spark, d, "nodes"), view(spark, d, "edges"))


@query("a11_map_reduce_sum", _with("atoms") + ", c AS (SELECT flow, (row_number() OVER (PARTITION BY flow ORDER BY pos) - 1) // 2 AS chunk, duration FROM atoms), p AS (SELECT flow, chunk, sum(duration) AS part FROM c GROUP BY flow, chunk HAVING count(*) = 2) SELECT flow, round(sum(part), 4) AS total, count(*) AS chunks FROM p GROUP BY flow")
def _(spark, d):
    return H.map_reduce_sum(view(spark, d, "atoms"), "duration", "flow", ["pos"], 2)


# ---------------------------------------------------------------- joins
@query("j1_assemble_logbooks", _with("books", "flows", "atoms") + ", a AS (SELECT flow, count(*) AS n, string_agg(name, ',' ORDER BY pos) AS names FROM atoms GROUP BY flow), f AS (SELECT parent_uuid, count(*) AS flows, CAST(sum(coalesce(n, 0)) AS BIGINT) AS atoms, min(uuid) AS first, arg_min(coalesce(names, ''), uuid) AS first_atoms FROM flows LEFT JOIN a ON a.flow = flows.uuid GROUP BY parent_uuid) SELECT uuid, name, coalesce(flows, 0) AS flows, coalesce(atoms, 0) AS atoms, coalesce(first_atoms, '') AS first_atoms FROM books LEFT JOIN f ON f.parent_uuid = books.uuid")
def _(spark, d):
    nested = K.assemble_logbooks(*(view(spark, d, v) for v in ("books", "flows", "atoms")))
    total = F.aggregate("flows", F.lit(0).cast("bigint"), lambda a, f: a + F.size(f["atoms"]))
    first = F.coalesce(F.array_join(F.transform(F.get("flows", 0)["atoms"], lambda a: a["name"]), ","), F.lit(""))
    return nested.select("uuid", "name", F.size("flows").cast("bigint").alias("n"), total.alias("atoms"), first.alias("first_atoms")).withColumnRenamed("n", "flows")


@query("j2_merge_history", _with("books", "jobs") + ", i AS (SELECT book AS uuid, 'book' AS name, arg_max(priority, sequence) AS meta FROM jobs WHERE job % 3 = 0 GROUP BY book) SELECT coalesce(b.uuid, i.uuid) AS uuid, coalesce(b.name, i.name) AS name, coalesce(i.meta, b.meta) AS meta FROM books b FULL JOIN i ON b.uuid = i.uuid")
def _(spark, d):
    incoming = view(spark, d, "jobs").where("job % 3 = 0").select(F.col("book").alias("uuid"), F.lit("book").alias("name"), F.col("priority").alias("meta"), "sequence")
    return K.merge_history(view(spark, d, "books"), incoming, "sequence", ["meta"])


@query("j3_destroy_logbooks", _with("books", "flows", "atoms") + "SELECT (SELECT count(*) FROM books WHERE uuid % 10 <> 0) AS books, (SELECT count(*) FROM flows WHERE parent_uuid % 10 <> 0) AS flows, (SELECT count(*) FROM atoms WHERE flow NOT IN (SELECT uuid FROM flows WHERE parent_uuid % 10 = 0)) AS atoms")
def _(spark, d):
    books, flows, atoms = (view(spark, d, v) for v in ("books", "flows", "atoms"))
    uuids = flows.where("parent_uuid % 10 = 0").select(F.col("parent_uuid").alias("uuid")).unionByName(books.where("uuid % 10 = 0").select("uuid")).distinct()
    b, f, a, _ = K.destroy_logbooks(books, flows, atoms, uuids)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(b, "books").join(n(f, "flows"), F.lit(True)).join(n(a, "atoms"), F.lit(True))


_ONE = "o AS (SELECT flow, name, count(DISTINCT atom) AS many, min(atom) AS src FROM provides GROUP BY flow, name)"


@query("j4_resolve_dependencies", _with("provides", "requires") + f", {_ONE} SELECT r.flow, src, r.atom AS dst, string_agg(DISTINCT r.name, ',' ORDER BY r.name) AS reasons FROM requires r JOIN o ON o.flow = r.flow AND o.name = r.name WHERE many = 1 AND src <> r.atom GROUP BY ALL")
def _(spark, d):
    return K.resolve_dependencies(view(spark, d, "provides"), view(spark, d, "requires"))


@query("j4_symbol_status", _with("provides", "requires") + f", {_ONE} SELECT r.flow, r.name, CASE WHEN many IS NULL THEN 'UNSATISFIED' WHEN many > 1 THEN 'AMBIGUOUS' ELSE 'LINKED' END AS status, count(*) AS n FROM requires r LEFT JOIN o ON o.flow = r.flow AND o.name = r.name GROUP BY ALL")
def _(spark, d):
    return K.symbol_status(view(spark, d, "provides"), view(spark, d, "requires"))


@query("j5_unsatisfied_linear", _with("provides", "requires") + "SELECT flow, atom, name FROM requires r WHERE NOT EXISTS (SELECT 1 FROM provides p WHERE p.flow = r.flow AND p.name = r.name AND p.atom < r.atom)")
def _(spark, d):
    return K.unsatisfied_linear(view(spark, d, "provides"), view(spark, d, "requires"))


@query("j6_missing_arguments", _with("provides", "requires") + "SELECT flow, string_agg(DISTINCT name, ',' ORDER BY name) AS missing FROM requires r WHERE NOT EXISTS (SELECT 1 FROM provides p WHERE p.flow = r.flow AND p.name = r.name) AND name NOT LIKE '%7' GROUP BY flow")
def _(spark, d):
    requires = view(spark, d, "requires")
    return K.missing_arguments(requires, view(spark, d, "provides"), requires.where("name LIKE '%7'"))


@query("j7_resolve_arguments", _with("provides", "requires") + """, c AS (SELECT flow, name AS arg, 3 AS precedence, atom AS pos, atom AS value FROM provides UNION ALL SELECT flow, name, 1, atom, -atom FROM requires WHERE name LIKE '%5')
SELECT flow, arg, precedence, value FROM (SELECT *, row_number() OVER (PARTITION BY flow, arg ORDER BY precedence, pos) AS k FROM c) q WHERE k = 1""")
def _(spark, d):
    own = view(spark, d, "provides").select("flow", F.col("name").alias("arg"), F.lit(3).alias("precedence"), F.col("atom").alias("pos"), F.col("atom").alias("value"))
    injected = view(spark, d, "requires").where("name LIKE '%5'").select("flow", F.col("name").alias("arg"), F.lit(1).alias("precedence"), F.col("atom").alias("pos"), (-F.col("atom")).alias("value"))
    return K.resolve_arguments(own.unionByName(injected))


@query("j8_fetch_symbols", _with("provides") + "SELECT flow, name, min(atom) AS value, count(*) AS providers FROM provides GROUP BY flow, name")
def _(spark, d):
    return K.fetch_symbols(view(spark, d, "provides"))


@query("j9_match_workers", _with("commands") + """, w AS (SELECT DISTINCT who AS worker, command AS task FROM commands WHERE command <> 'trash'), n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY worker) - 1 AS k, count(*) OVER (PARTITION BY task) AS many FROM w)
SELECT c.seq AS request, c.command AS task, n.worker, CASE WHEN n.worker IS NULL THEN 'WAITING' ELSE 'PENDING' END AS state FROM commands c LEFT JOIN n ON n.task = c.command AND n.k = c.seq % n.many""")
def _(spark, d):
    c = view(spark, d, "commands")
    return B.match_workers(c.select(F.col("seq").alias("request"), F.col("command").alias("task")), c.where("command <> 'trash'").select(F.col("who").alias("worker"), F.col("command").alias("task")))


@query("j10_fan_out", "SELECT event_id AS seq, event_type, listener FROM events JOIN (VALUES ('click', 'a'), ('purchase', 'b'), ('*', 'all')) s(t, listener) ON t = event_type OR t = '*'")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), "event_type")
    return B.fan_out(events, spark.createDataFrame([("click", "a"), ("purchase", "b"), ("*", "all")], "event_type string, listener string"))


@query("j11_claim_lost", _with("commands") + """, t AS (SELECT job, seq, ts, who FROM commands WHERE command IN ('consume', 'abandon')), c AS (SELECT job, ts, seq, who FROM commands WHERE command = 'claim'),
m AS (SELECT t.job, t.seq, (SELECT c.who FROM c WHERE c.job = t.job AND c.ts <= t.ts ORDER BY c.ts DESC, c.seq DESC LIMIT 1) AS owner FROM t) SELECT job, seq, owner, owner IS DISTINCT FROM 'w1' AS lost FROM m""")
def _(spark, d):
    c = view(spark, d, "commands")
    return B.claim_lost(c.where("command IN ('consume', 'abandon')"), c.where("command = 'claim'").withColumnRenamed("who", "owner"), F.lit("w1"))


@query("j12_flow_for_job", _with("jobs", "flows") + ", p AS (SELECT parent_uuid, count(*) AS n, min(uuid) AS u FROM flows GROUP BY parent_uuid) SELECT job, CASE WHEN book IS NULL THEN 'NO_BOOK' WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'MULTIPLE_CHOICES' ELSE 'FOUND' END AS status, CASE WHEN n = 1 THEN u END AS flow FROM jobs LEFT JOIN p ON p.parent_uuid = book")
def _(spark, d):
    return B.flow_for_job(view(spark, d, "jobs"), view(spark, d, "flows"))


# ---------------------------------------------------------------- order, sets
_RANK = "CASE priority WHEN 'VERY_LOW' THEN 0 WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"
for _mode, _order in (("contract", f"{_RANK} DESC, sequence"), ("ascending", f"{_RANK}, sequence"), ("descending", f"{_RANK} DESC, sequence DESC")):

    @query(f"t1_board_order_{_mode}", _with("jobs") + f"SELECT job, CAST(row_number() OVER (PARTITION BY board ORDER BY {_order}) AS INT) AS place FROM jobs")
    def _(spark, d, mode=_mode):
        return B.board_order(view(spark, d, "jobs"), mode).select("job", "place")


@query("t2_claimable", _with("jobs") + f"SELECT job, board, place FROM (SELECT job, board, CAST(row_number() OVER (PARTITION BY board ORDER BY {_RANK} DESC, sequence) AS INT) AS place FROM jobs WHERE state = 'UNCLAIMED') q WHERE place <= 7")
def _(spark, d):
    return B.claimable(view(spark, d, "jobs"), 10, 3).select("job", "board", "place")


@query("t3_dispatch_order", _with("nodes") + "SELECT kind, node, CAST(row_number() OVER (PARTITION BY kind ORDER BY priority DESC, node) AS INT) AS place FROM nodes")
def _(spark, d):
    nodes = view(spark, d, "nodes").select("kind", "node", "priority")
    return B.placed(nodes, "kind", [F.desc("priority"), F.asc("node")]).select("kind", "node", "place")


@query("u1_sequence_minus", _with("atoms") + ", a AS (SELECT flow, name, pos, row_number() OVER (PARTITION BY flow, name ORDER BY pos) AS nth FROM atoms), b AS (SELECT flow, name, row_number() OVER (PARTITION BY flow, name ORDER BY pos) AS nth FROM atoms WHERE state = 'FAILURE') SELECT flow, name, CAST(pos AS BIGINT) AS pos FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.flow = a.flow AND b.name = a.name AND b.nth = a.nth)")
def _(spark, d):
    atoms = view(spark, d, "atoms")
    return K.sequence_minus(atoms.select("flow", "name", "pos"), atoms.where("state = 'FAILURE'").select("flow", "name", "pos"), "flow", "name", "pos").withColumn("pos", F.col("pos").cast("bigint"))


@query("u2_ordered_sets", _with("turns") + """, s AS (SELECT flow, list(name ORDER BY pos) AS a, list(name ORDER BY pos) FILTER (WHERE pos >= 2) AS b FROM turns GROUP BY flow),
e AS (SELECT flow, a, coalesce(b, []) AS b FROM s), u AS (SELECT flow, unnest(a) AS x, unnest(range(len(a))) AS i FROM e), k AS (SELECT flow, x, min(i) AS i FROM u GROUP BY flow, x)
SELECT e.flow, coalesce(string_agg(x, ',' ORDER BY i) FILTER (WHERE list_contains(b, x)), '') AS both_, coalesce(string_agg(x, ',' ORDER BY i) FILTER (WHERE NOT list_contains(b, x)), '') AS only_first FROM e JOIN k ON k.flow = e.flow GROUP BY e.flow""")
def _(spark, d):
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "name")))), lambda s: s["name"])
    s = view(spark, d, "turns").groupBy("flow").agg(names(F.lit(True)).alias("a"), names(F.col("pos") >= 2).alias("b"))
    return s.select("flow", F.array_join(K.ordered_intersection(F.col("a"), F.col("b")), ",").alias("both_"), F.array_join(K.ordered_difference(F.col("a"), F.col("b")), ",").alias("only_first"))


# ---------------------------------------------------------------- graphs
@query("g1_roots", _with("nodes", "edges") + "SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges)")
def _(spark, d):
    return G.roots(view(spark, d, "nodes"), view(spark, d, "edges")).select("node")


@query("g1_leaves", _with("nodes", "edges") + "SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)")
def _(spark, d):
    return G.leaves(view(spark, d, "nodes"), view(spark, d, "edges")).select("node")


_LEVELS = "l AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, l.level + 1 FROM l JOIN edges e ON e.src = l.node), v AS (SELECT node, max(level) AS level FROM l GROUP BY node)"


@query("g2_is_acyclic", _with("nodes", "edges") + ", " + _LEVELS + " SELECT count(*) = count(v.node) AS acyclic, count(*) - count(v.node) AS left_over FROM nodes n LEFT JOIN v ON v.node = n.node")
def _(spark, d):
    return G.is_acyclic(view(spark, d, "nodes"), view(spark, d, "edges"))


@query("g3_topological_levels", _with("nodes", "edges") + ", " + _LEVELS + " SELECT v.node, v.level FROM v JOIN nodes n ON n.node = v.node")
def _(spark, d):
    return G.topological_levels(view(spark, d, "nodes"), view(spark, d, "edges"))


_ANC = "a AS (SELECT node AS start, src AS node, 1 AS hops FROM nodes JOIN edges ON dst = node WHERE node % 50 = 1 UNION SELECT a.start, e.src, a.hops + 1 FROM a JOIN edges e ON e.dst = a.node)"


@query("g4_ancestors", _with("nodes", "edges") + f", {_ANC} SELECT start, node, min(hops) AS hops FROM a GROUP BY start, node")
def _(spark, d):
    return G.ancestors(view(spark, d, "edges"), view(spark, d, "nodes").where("node % 50 = 1"))


@query("g5_target_subgraph", _with("nodes", "edges") + f", {_ANC}, i AS (SELECT node FROM a UNION SELECT node FROM nodes WHERE node % 50 = 1) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM i) AND dst IN (SELECT node FROM i)")
def _(spark, d):
    return G.target_subgraph(view(spark, d, "edges"), view(spark, d, "nodes").where("node % 50 = 1")).select("src", "dst")


_STATE = "CASE WHEN node % 4 = 3 OR node > 40 THEN 'PENDING' ELSE 'SUCCESS' END"


@query("g6_ready_atoms", _with("nodes", "edges") + f", s AS (SELECT node, {_STATE} AS state FROM nodes), a AS (SELECT s.node AS start, e.src AS node FROM s JOIN edges e ON e.dst = s.node WHERE state = 'PENDING' UNION SELECT a.start, e.src FROM a JOIN edges e ON e.dst = a.node), bad AS (SELECT DISTINCT start FROM a JOIN s ON s.node = a.node WHERE state <> 'SUCCESS') SELECT node FROM s WHERE state = 'PENDING' AND node NOT IN (SELECT start FROM bad)")
def _(spark, d):
    nodes = view(spark, d, "nodes")
    return G.ready_atoms(nodes, view(spark, d, "edges"), nodes.select("node", F.expr(_STATE).alias("state")))


_DESC = "a AS (SELECT node FROM nodes WHERE node IN (5, 7) UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node)"


@query("g7_skip_descendants", _with("nodes", "edges") + f", {_DESC} SELECT node FROM a")
def _(spark, d):
    return G.apply_skips(view(spark, d, "edges"), view(spark, d, "nodes").where("node IN (5, 7)"))


@query("g8_reset_subgraph", _with("nodes", "edges") + f", {_DESC}, s AS (SELECT node, 'SUCCESS' AS state, CASE WHEN priority % 2 = 0 THEN 'REVERT' ELSE 'EXECUTE' END AS intention, node IN (SELECT node FROM a) AND node NOT IN (5, 7) AND priority % 2 <> 0 AS hit FROM nodes) SELECT node, CASE WHEN hit THEN 'PENDING' ELSE state END AS state, CASE WHEN hit THEN 'RETRY' ELSE intention END AS intention FROM s")
def _(spark, d):
    nodes = view(spark, d, "nodes")
    states = nodes.select("node", F.lit("SUCCESS").alias("state"), F.when(F.col("priority") % 2 == 0, "REVERT").otherwise("EXECUTE").alias("intention"))
    return G.reset_subgraph(view(spark, d, "edges"), states, nodes.where("node IN (5, 7)"), intention="RETRY")


_PATHS = "p AS (SELECT node, parent AS ancestor, 1 AS distance FROM tree WHERE parent IS NOT NULL UNION ALL SELECT p.node, t.parent, p.distance + 1 FROM p JOIN tree t ON t.node = p.ancestor WHERE t.parent IS NOT NULL)"


@query("g9_tree_paths", _with("tree") + f", {_PATHS} SELECT node, ancestor, distance FROM p")
def _(spark, d):
    return G.tree_paths(view(spark, d, "tree"))


@query("g10_child_counts", _with("tree") + f", {_PATHS} SELECT t.node, count(p.node) FILTER (WHERE distance = 1) AS direct, count(p.node) AS total FROM tree t LEFT JOIN p ON p.ancestor = t.node GROUP BY t.node")
def _(spark, d):
    return G.child_counts(view(spark, d, "tree"))


@query("g12_tree_to_graph", _with("tree") + "SELECT parent AS src, node AS dst FROM tree WHERE parent IS NOT NULL")
def _(spark, d):
    return view(spark, d, "tree").where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst"))


# ---------------------------------------------------------------- streams, as batches
@query("r1_arbitrate_jobs", _with("commands") + """, e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS k FROM commands),
r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, FALSE AS there, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS result FROM e
  UNION ALL SELECT job, k, seq, CASE WHEN result = 'OK' THEN command NOT IN ('consume', 'trash') ELSE there END, CASE WHEN result <> 'OK' THEN owner WHEN command = 'claim' THEN who END, result FROM (
    SELECT e.job, e.k, e.seq, e.command, e.who, r.there, r.owner, CASE WHEN command = 'post' THEN CASE WHEN there THEN 'ALREADY_POSTED' ELSE 'OK' END WHEN NOT there THEN 'UNKNOWN_JOB'
      WHEN command = 'claim' THEN CASE WHEN owner IS NULL THEN 'OK' ELSE 'ALREADY_CLAIMED' END WHEN owner IS NULL THEN 'UNKNOWN_OWNER' WHEN owner = who THEN 'OK' ELSE 'WRONG_OWNER' END AS result
    FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1) q)
SELECT job, seq, result FROM r WHERE k > 0""")
def _(spark, d):
    return B.arbitrate_jobs(view(spark, d, "commands"))


# decided requests: stopped behind their opening, or waiting for too long at the table's last row
_DECIDED_BY = """o AS (SELECT request, min((ts, seq)) AS created FROM requests WHERE state IN ('WAITING', 'PENDING') GROUP BY request), k AS (SELECT r.request, min(ts) AS stopped FROM requests r JOIN o ON o.request = r.request WHERE state IN ('RUNNING', 'SUCCESS', 'FAILURE') AND (ts, seq) > created GROUP BY r.request),
q AS (SELECT o.request, stopped, epoch_us(coalesce(stopped, (SELECT max(ts) FROM requests))) - epoch_us(created[1]) > {timeout} AS expired FROM o LEFT JOIN k ON k.request = o.request) SELECT request, expired FROM q WHERE expired OR stopped IS NOT NULL"""


@query("r2_expire_requests", _with("requests") + ", " + _DECIDED_BY.format(timeout=172800000000))
def _(spark, d):
    return B.expire_requests(view(spark, d, "requests"), 172800)


@query("r3_worker_sessions", _with("beats") + ", n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM beats WINDOW w AS (PARTITION BY topic ORDER BY ts, seq)), s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY topic ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n) SELECT topic, session, min(ts) AS since, max(ts) AS last_seen, count(*) AS beats FROM s GROUP BY topic, session")
def _(spark, d):
    return B.worker_sessions(view(spark, d, "beats"), 21600)


@query("r4_worker_registry", _with("beats") + ", n AS (SELECT *, CASE WHEN task <> lag(task) OVER w THEN 1 ELSE 0 END AS fresh FROM beats WINDOW w AS (PARTITION BY topic ORDER BY ts, seq)), s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY topic ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS identity FROM n) SELECT topic, identity, min(task) AS task, max(ts) AS last_seen FROM s GROUP BY topic, identity")
def _(spark, d):
    return B.worker_registry(view(spark, d, "beats"))


@query("r8_transition_rates", _with("transitions") + "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS since, state, count(*) AS n FROM transitions GROUP BY ALL")
def _(spark, d):
    return B.transition_rates(view(spark, d, "transitions"))


# ---------------------------------------------------------------- scalars, functors, decisions
@query("x_scalars", "SELECT event_id, greatest(0.0, least(50.0, value)) AS clamped, least(60.0, pow(2.0, event_id % 9)) AS delay, concat('on_', lower(event_type)) AS hook, json_extract_string(props, '$.k') AS part, make_timestamp(event_id * 1000000) AS at, sqrt(value * value + 9.0) AS far FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", X.clamp(F.col("value"), 0.0, 50.0).alias("clamped"), X.backoff(F.col("event_id") % 9).alias("delay"), X.event_name(F.col("event_type")).alias("hook"), X.extract(F.col("props"), "k").alias("part"), X.millis_to_timestamp(F.col("event_id") * 1000).cast("timestamp_ntz").alias("at"), X.distance(F.col("value"), F.lit(3.0)).alias("far"))


@query("x14_normalize_newlines", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n', chr(10), 'g') = text AS same, length(text) AS n FROM conversations")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", (X.normalize_newlines(F.col("text")) == F.col("text")).alias("same"), F.length("text").cast("bigint").alias("n"))


@query("p1_map_columns", "SELECT l_orderkey, l_quantity * 2 AS q2, l_tax * 2 AS t2 FROM lineitem")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return X.map_columns(rows, lambda c: c * 2, ["l_quantity", "l_tax"], ["q2", "t2"]).select("l_orderkey", "q2", "t2")


@query("p2_reduce_columns", "SELECT l_orderkey, (l_quantity - l_tax) - l_discount AS left_over FROM lineitem")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return X.reduce_columns(rows, lambda a, b: a - b, ["l_quantity", "l_tax", "l_discount"], "left_over").select("l_orderkey", "left_over")


@query("p4_multiply_table", "SELECT c_custkey, coalesce(c_acctbal, 0.0) * 3.0 AS c_acctbal FROM customer")
def _(spark, d):
    return X.multiply_table(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), ["c_acctbal"], 3.0)


@query("d1_retry_decision", _with("transitions") + "SELECT item, count(*) AS attempts, CASE WHEN count(*) < 3 THEN 'RETRY' ELSE 'REVERT' END AS decision FROM transitions WHERE state = 'FAILURE' GROUP BY item")
def _(spark, d):
    tried = view(spark, d, "transitions").where("state = 'FAILURE'").groupBy("item").agg(F.count("*").alias("attempts"))
    return tried.withColumn("decision", X.retry_decision(F.col("attempts"), 3))


@query("d6_job_disposition", _with("atoms") + "SELECT CASE WHEN failure = 'IOError' THEN 'trash' WHEN failure = 'ValueError' THEN 'abandon' ELSE 'consume' END AS disposition, count(*) AS n FROM atoms GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("failure") == "IOError", "DispatchFailure").when(F.col("failure") == "ValueError", "StorageFailure").otherwise(F.col("failure"))
    return view(spark, d, "atoms").groupBy(B.job_disposition(F.col("state"), kind).alias("disposition")).agg(F.count("*").alias("n"))
