"""Records as JSON: validation of failures and messages, postings, atom envelopes, masking.

Types of JSON values are read from variants, so nothing leaves the JVM but mask_keys and
row_task, whose work has no bound in depth or is the caller's own function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import kept as cut
from .states import PRIORITIES

# Root types of failures; actions and states of messages.
ROOTS = ["BaseException", "Exception"]
ACTIONS = ["execute", "revert"]
STATES = ["WAITING", "PENDING", "RUNNING", "SUCCESS", "FAILURE", "EVENT"]


def kind(value: Column, path: str = "$") -> Column:
    """STRING, BIGINT, OBJECT, ARRAY, VOID (a JSON null) ... of a variant's part; MISSING if it isn't there."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0), F.lit("MISSING"))


def _causes(v: Column) -> Column:
    return F.try_variant_get(v, "$.causes", "array<variant>")


def own_problem(v: Column) -> Column:
    """The first thing wrong with a failure variant itself, whatever its causes hold."""
    types = F.try_variant_get(v, "$.exc_type_names", "array<variant>")
    root = F.try_variant_get(F.try_element_at(types, F.lit(-1)), "$", "string")
    version = F.try_variant_get(v, "$.version", "bigint")
    return (
        F.when(kind(v) != "OBJECT", "not an object")
        .when(kind(v, "$.exception_str") != "STRING", "exception_str")
        .when(kind(v, "$.traceback_str") != "STRING", "traceback_str")
        .when(kind(v, "$.exc_type_names") != "ARRAY", "exc_type_names")
        .when((F.size(types) < 1) | F.exists(types, lambda t: kind(t) != "STRING"), "exc_type_names")
        .when((kind(v, "$.version") != "MISSING") & ((kind(v, "$.version") != "BIGINT") | (version < 0)), "version")
        .when(~kind(v, "$.exc_args").isin("MISSING", "ARRAY"), "exc_args")
        .when(~kind(v, "$.causes").isin("MISSING", "ARRAY"), "causes")
        .when(~root.isin(ROOTS), "root type")
    )


def failure_problem(v: Column, depth: int = 3) -> Column:
    """The first thing wrong with a failure variant, null if it is valid.

    Nested causes are followed `depth` deep; a failure nested deeper is reported as such.
    """
    deeper = F.exists(_causes(v), lambda c: failure_problem(c, depth - 1).isNotNull()) if depth else F.size(_causes(v)) > 0
    return F.coalesce(own_problem(v), F.when(deeper, "causes" if depth else "causes nested too deep"))


def bad_causes(failures: DataFrame) -> DataFrame:
    """Distinct (key, place) of failures (key, place, v) with something wrong in a cause at any depth.

    One level of causes a round, until no cause is left; lineage is cut each round.
    """
    below = lambda df: cut(df.select("key", "place", F.explode(_causes(F.col("v"))).alias("v")))
    level, bad = below(failures), failures.select("key", "place").where("false")
    while not level.isEmpty():
        bad = bad.unionByName(level.where(own_problem(F.col("v")).isNotNull()).select("key", "place"))
        level = below(level)
    return bad.distinct()


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def validate_failures(df: DataFrame, column: str = "record", depth: int | None = 3) -> DataFrame:
    """Adds `problem`: null for a valid failure; text that isn't JSON is 'not an object'.

    Without a depth every cause is followed, which runs a job for each level of causes.
    """
    v = F.try_parse_json(F.col(column))
    if depth is not None:
        return df.withColumn("problem", F.when(v.isNull(), "not an object").otherwise(failure_problem(v, depth)))
    texts = df.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct()
    bad = bad_causes(texts.select(_key(F.col("text")).alias("key"), F.lit("failure").alias("place"), F.try_parse_json("text").alias("v")))
    marked = df.withColumn("__key", _key(F.col(column))).join(bad.select(F.col("key").alias("__key"), F.lit(True).alias("__bad")), "__key", "left")
    problem = F.when(v.isNull(), "not an object").otherwise(F.coalesce(own_problem(v), F.when(F.col("__bad"), "causes")))
    return marked.withColumn("problem", problem).select(*df.columns, "problem")


def _failures(v: Column) -> Column:
    return F.map_values(F.try_variant_get(v, "$.failures", "map<string,variant>"))


def _failed(v: Column) -> Column:
    return F.try_variant_get(v, "$.result[0]", "string") == "failure"


def _result(v: Column) -> Column:
    return F.try_variant_get(v, "$.result[1]", "variant")


def validate_messages(df: DataFrame, column: str = "record", kind_column: str = "kind") -> DataFrame:
    """Adds `problem` for messages of the kinds NOTIFY, REQUEST and RESPONSE; null for valid ones.

    Every cause of an embedded failure is followed, which runs a job for each level of causes.
    """
    requests = df.where(F.col(kind_column) == "REQUEST").select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct()
    requests = requests.select(_key(F.col("text")).alias("key"), F.try_parse_json("text").alias("v"))
    given = requests.select("key", F.lit("failures").alias("place"), F.explode(_failures(F.col("v"))).alias("v"))
    ended = requests.where(_failed(F.col("v"))).select("key", F.lit("result").alias("place"), _result(F.col("v")).alias("v"))
    bad = bad_causes(given.unionByName(ended)).groupBy(F.col("key").alias("__key")).agg(F.collect_set("place").alias("__bad"))
    names, df = df.columns, df.withColumn("__key", _key(F.col(column))).join(bad, "__key", "left")
    nested = lambda place: F.coalesce(F.array_contains("__bad", place), F.lit(False))
    text, v = F.col(column), F.try_parse_json(F.col(column))
    keys = F.json_object_keys(text)
    others = lambda found, *known: F.size(F.array_except(found, F.array(*map(F.lit, known)))) > 0
    tasks = F.try_variant_get(v, "$.tasks", "array<variant>")
    notify = (
        F.when(others(keys, "topic", "tasks"), "other keys").when(kind(v, "$.topic") != "STRING", "topic")
        .when((kind(v, "$.tasks") != "ARRAY") | F.exists(tasks, lambda t: kind(t) != "STRING"), "tasks")
    )
    request = (
        F.when(kind(v, "$.task_cls") != "STRING", "task_cls").when(kind(v, "$.task_name") != "STRING", "task_name")
        .when(~kind(v, "$.task_version").isin("STRING", "ARRAY"), "task_version")
        .when(~F.coalesce(F.try_variant_get(v, "$.action", "string"), F.lit("")).isin(ACTIONS), "action")
        .when(~kind(v, "$.arguments").isin("MISSING", "OBJECT"), "arguments")
        .when(~kind(v, "$.failures").isin("MISSING", "OBJECT"), "failures")
        .when(F.exists(_failures(v), lambda f: own_problem(f).isNotNull()) | nested("failures"), "failures")
        .when(_failed(v) & (own_problem(_result(v)).isNotNull() | nested("result")), "result")
    )
    inner = F.json_object_keys(F.get_json_object(text, "$.data"))
    event = ~others(inner, "event_type", "details") & (kind(v, "$.data.event_type") == "STRING") & (kind(v, "$.data.details") == "OBJECT")
    whole = ~others(inner, "result") & (kind(v, "$.data.result") != "MISSING")
    response = (
        F.when(others(keys, "state", "data"), "other keys").when(~F.coalesce(F.try_variant_get(v, "$.state", "string"), F.lit("")).isin(STATES), "state")
        .when(kind(v, "$.data") != "OBJECT", "data").when(~(event | whole | (F.size(inner) == 0)), "data")
    )
    k = F.col(kind_column)
    by_kind = F.when(k == "NOTIFY", notify).when(k == "REQUEST", request).when(k == "RESPONSE", response).otherwise("kind")
    return df.withColumn("problem", F.when(v.isNull() | (kind(v) != "OBJECT"), "not an object").otherwise(by_kind)).select(*names, "problem")


def parse_postings(df: DataFrame, column: str = "record") -> DataFrame:
    """Adds uuid, name, priority and problem. No priority means NORMAL, case doesn't count; a bad row has a problem."""
    v = F.try_parse_json(F.col(column))
    part = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    priority = F.coalesce(F.upper(part("priority")), F.lit("NORMAL"))
    problem = F.when(v.isNull() | (kind(v) != "OBJECT"), "not an object").when(part("uuid").isNull(), "uuid").when(part("name").isNull(), "name").when(~priority.isin(PRIORITIES), "priority")
    read = df.withColumn("problem", problem)
    return read.withColumns({c: F.when(F.col("problem").isNull(), x) for c, x in (("uuid", part("uuid")), ("name", part("name")), ("priority", priority))})


def format_posting(uuid: Column, name: Column, priority: Column, created_on: Column, last_modified: Column, details: Column, book: Column) -> Column:
    """JSON text of a posting; null times and books are left out, null details are `{}`. details: JSON text, book: a struct."""
    fields = F.struct(uuid.alias("uuid"), name.alias("name"), priority.alias("priority"), created_on.alias("created_on"), last_modified.alias("last_modified"), F.parse_json(F.coalesce(details, F.lit("{}"))).alias("details"), book.alias("book"))
    return F.to_json(fields)


def parse_atom_envelopes(df: DataFrame, column: str = "record") -> DataFrame:
    """Adds type, atom (uuid, name, state, meta, results), attempts and problem.

    An unknown type is a problem; meta that isn't an object reads as `{}`; a retry's results
    become attempts (value, failures), which are empty for tasks.
    """
    v = F.try_parse_json(F.col(column))
    atom = F.from_json(F.get_json_object(F.col(column), "$.atom"), "uuid string, name string, state string, meta string, results string")
    retry = F.from_json(atom["results"], "array<array<string>>")
    attempts = F.transform(retry, lambda r: F.struct(F.get(r, F.lit(0)).alias("value"), F.from_json(F.get(r, F.lit(1)), "map<string,string>").alias("failures")))
    kinds = F.try_variant_get(v, "$.type", "string")
    known = kinds.isin("TASK_DETAIL", "RETRY_DETAIL")
    meta = F.when(kind(v, "$.atom.meta") == "OBJECT", atom["meta"]).otherwise("{}")
    fields = F.struct(*[atom[c].alias(c) for c in ("uuid", "name", "state")], meta.alias("meta"), atom["results"].alias("results"))
    none = F.array().cast("array<struct<value:string,failures:map<string,string>>>")
    return df.select("*", kinds.alias("type"), fields.alias("atom"), F.when(kinds == "RETRY_DETAIL", attempts).otherwise(none).alias("attempts"), F.when(~F.coalesce(known, F.lit(False)), "unknown type").alias("problem"))


def mask_keys(column: Column, keys: list[str], mask: str = "***") -> Column:
    """JSON text with the values of the keys replaced at any depth; text that isn't JSON stays as it is."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        import json

        def walk(x):
            if isinstance(x, dict):
                return {k: mask if k in keys else walk(y) for k, y in x.items()}
            return [walk(y) for y in x] if isinstance(x, list) else x

        def one(t):
            try:
                return t if t is None else json.dumps(walk(json.loads(t)))
            except ValueError:
                return t

        return texts.map(one)

    return masked(column)


def row_task(df: DataFrame, fn: Callable, requires: list[str], provides: str) -> DataFrame:
    """A function of a row's values, given by name; a row that raises has a failure (type, message) and no result."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{provides}` double, failure struct<type:string,message:string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            results, failures = [], []
            for values in b[requires].to_dict("records"):
                try:
                    results.append(float(fn(**values)))
                    failures.append(None)
                except Exception as e:  # whatever the function raises is the row's outcome
                    results.append(None)
                    failures.append({"type": type(e).__name__, "message": str(e)})
            yield b.assign(**{provides: pd.Series(results, b.index, dtype="float64"), "failure": pd.Series(failures, b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def parse_board_uri(uri: Column) -> Column:
    """struct(scheme, user, password, host, port, options); all null without a scheme."""
    part = lambda p: F.try_parse_url(uri, F.lit(p))
    who = part("USERINFO")
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)$", 1).try_cast("int")
    fields = F.struct(part("PROTOCOL").alias("scheme"), F.split_part(who, F.lit(":"), F.lit(1)).alias("user"), F.split_part(who, F.lit(":"), F.lit(2)).alias("password"), part("HOST").alias("host"), port.alias("port"), F.str_to_map(part("QUERY"), F.lit("&"), F.lit("=")).alias("options"))
    return F.when(part("PROTOCOL").isNotNull(), fields)


def merge_graphs(left: DataFrame, right: DataFrame, allow_overlaps: bool = False) -> DataFrame:
    """Nodes of both graphs by `node`; where they overlap, the right one's attributes win if that is allowed."""
    if not allow_overlaps and (n := left.join(right.select("node"), "node", "left_semi").count()):
        raise ValueError(f"{n} nodes are in both graphs")
    return left.join(right.select("node"), "node", "left_anti").unionByName(right)


def reduce_rows(df: DataFrame, key: str, order: str, value: str, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """Left fold of a two-argument Column function over a group's values in order; one group's values have to fit in a row."""
    gathered = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value]).alias("v"))
    return gathered.select(key, F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.get("v", F.lit(0)), fn).alias("folded"))
