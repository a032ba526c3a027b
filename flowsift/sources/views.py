"""The model's tables over the star-schema tables, as SQL that Spark and DuckDB both run.

`{name}` stands for a source table. Ids are longs, states and priorities strings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "transitions": """SELECT event_id AS seq, ts, CASE WHEN user_id % 5 = 0 THEN 'flow' ELSE 'task' END AS item_type,
        user_id % 97 AS flow, user_id AS item, value, props,
        CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'REVERTING'
             WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS state FROM {events}""",
    "commands": """SELECT event_id AS seq, ts, user_id AS job, concat('w', CAST(event_id % 3 AS VARCHAR(9))) AS who,
        CASE event_type WHEN 'signup' THEN 'post' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'abandon'
             WHEN 'purchase' THEN 'consume' ELSE 'trash' END AS command FROM {events}""",
    "requests": """SELECT event_id AS seq, ts, user_id AS request, CASE event_type WHEN 'signup' THEN 'WAITING' WHEN 'view' THEN 'PENDING'
        WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS state FROM {events}""",
    "beats": "SELECT event_id AS seq, ts, user_id AS topic, event_type AS task FROM {events}",
    "jobs": """SELECT o_orderkey AS job, o_orderkey AS sequence, o_custkey % 5 AS board, o_custkey AS book, o_orderdate AS created_on,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'VERY_HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'NORMAL'
             WHEN '5-LOW' THEN 'VERY_LOW' ELSE 'LOW' END AS priority,
        CASE o_orderstatus WHEN 'O' THEN 'UNCLAIMED' WHEN 'P' THEN 'CLAIMED' ELSE 'COMPLETE' END AS state FROM {orders}""",
    "books": "SELECT c_custkey AS uuid, c_name AS name, c_mktsegment AS meta FROM {customer}",
    "flows": """SELECT o_orderkey AS uuid, o_custkey AS parent_uuid, o_orderpriority AS meta,
        CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN 'SUSPENDED' ELSE 'SUCCESS' END AS state FROM {orders}""",
    "atoms": """SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos,
        l_orderkey AS flow, concat('atom-', CAST(l_linenumber AS VARCHAR(9))) AS name, l_partkey AS part, l_shipdate AS updated_at, l_quantity AS duration,
        CASE WHEN l_returnflag = 'A' THEN 'SUCCESS' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PENDING' WHEN l_returnflag = 'N' THEN 'RUNNING'
             WHEN l_linestatus = 'F' THEN 'FAILURE' ELSE 'REVERTED' END AS state,
        CASE WHEN l_partkey % 11 = 0 THEN 'IGNORE' WHEN l_returnflag = 'R' THEN 'REVERT' ELSE 'EXECUTE' END AS intention,
        CASE WHEN l_returnflag = 'R' THEN CASE l_suppkey % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'IOError' ELSE 'RuntimeError' END END AS failure FROM {lineitem}""",
    "nodes": "SELECT p_partkey AS node, p_size AS priority, CASE WHEN p_size % 7 = 0 THEN 'retry' WHEN p_size % 5 = 0 THEN 'flow' ELSE 'task' END AS kind FROM {part}",
    "edges": """SELECT DISTINCT src, dst FROM (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM {part}
        UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM {part}) e WHERE src <> dst AND dst >= 1""",
    "tree": "SELECT p_partkey AS node, CASE WHEN p_partkey <= 1 THEN NULL ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS parent, p_partkey % 2 AS child_idx FROM {part} WHERE p_partkey >= 1",
    "provides": "SELECT p_brand AS flow, p_partkey AS atom, concat('s', CAST(p_partkey % 400 AS VARCHAR(9))) AS name FROM {part}",
    "requires": "SELECT p_brand AS flow, p_partkey AS atom, concat('s', CAST((p_partkey * 7 + p_size) % 400 AS VARCHAR(9))) AS name FROM {part}",
    "job_states": """SELECT event_id AS seq, ts, user_id AS job, CASE event_type WHEN 'signup' THEN 'UNCLAIMED' WHEN 'view' THEN 'CLAIMED'
        WHEN 'click' THEN 'UNCLAIMED' WHEN 'purchase' THEN 'COMPLETE' ELSE 'CLAIMED' END AS state FROM {events}""",
    "details": """SELECT event_id AS seq, ts, user_id AS item, event_type, CASE event_id % 5 WHEN 0 THEN concat(chr(123), '"task_name": "t", "task_uuid": "u"', chr(125)) WHEN 1 THEN concat(chr(123), '"retry_name": "r", "retry_uuid": "u"', chr(125))
        WHEN 2 THEN concat(chr(123), '"task_name": "t"', chr(125)) WHEN 3 THEN concat(chr(123), chr(125)) END AS details FROM {events}""",
    "results": """SELECT event_id AS seq, CAST(floor(value) AS BIGINT) AS number, event_type AS word, event_id % 4 AS shape, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '"k"' WHEN 4 THEN '"z"' WHEN 5 THEN '7' ELSE '"0"' END AS idx,
        CASE event_id % 4 WHEN 0 THEN concat(chr(123), '"k": ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), chr(125)) WHEN 1 THEN concat('[', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), ', "', event_type, '"]')
        WHEN 2 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)) ELSE '[]' END AS result FROM {events}""",
    "stored": """SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos,
        concat('atom-', CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS VARCHAR(9))) AS atom,
        concat('s', CAST(l_partkey % 9 AS VARCHAR(9))) AS provided, concat('s', CAST(l_suppkey % 9 AS VARCHAR(9))) AS required, l_suppkey % 4 = 0 AS optional,
        CASE WHEN l_partkey % 5 < 3 THEN 'SUCCESS' WHEN l_partkey % 5 = 3 THEN 'IGNORE' WHEN l_suppkey % 2 = 0 THEN 'FAILURE' ELSE 'RUNNING' END AS state,
        CASE WHEN l_partkey % 5 = 4 AND l_suppkey % 2 = 0 THEN 'ValueError' END AS failure, CASE WHEN l_partkey % 8 = 0 THEN 'IOError' END AS revert_failure,
        CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_partkey AS VARCHAR(20)) END AS value, CASE WHEN l_partkey % 6 = 0 THEN 'REVERTED' WHEN l_partkey % 6 = 1 THEN 'REVERTING' WHEN l_partkey % 6 = 2 THEN 'REVERT_FAILURE' WHEN l_partkey % 6 = 3 THEN 'IGNORE' ELSE 'SUCCESS' END AS revert_state FROM {lineitem}""",
    "gnodes": """SELECT p_partkey % 7 AS graph, p_partkey AS node, CASE WHEN p_size % 7 = 0 THEN 'retry' WHEN p_size % 5 = 0 THEN 'flow' ELSE 'task' END AS kind, p_size % 6 = 0 AS noop,
        CASE WHEN p_retailprice - floor(p_retailprice) < 0.05 THEN 'IGNORE' WHEN p_size % 4 = 0 AND p_partkey >= 70 THEN 'PENDING' WHEN p_size % 9 = 1 AND p_partkey >= 56 THEN 'REVERTED' WHEN p_partkey < 90 OR p_size % 3 > 0 THEN 'SUCCESS' ELSE 'PENDING' END AS state,
        CASE WHEN p_partkey < 56 THEN 'EXECUTE' WHEN p_size % 11 = 3 THEN 'REVERT' WHEN p_size % 11 = 4 THEN 'RETRY' WHEN p_size % 11 = 5 THEN 'IGNORE' ELSE 'EXECUTE' END AS intention FROM {part}""",
    "gedges": """SELECT DISTINCT graph, src, dst FROM (SELECT p_partkey % 7 AS graph, CAST(floor(floor(p_partkey / 7) / 2) AS BIGINT) * 7 + p_partkey % 7 AS src, p_partkey AS dst FROM {part}
        UNION ALL SELECT p_partkey % 7, CAST(floor(floor(p_partkey / 7) / 3) AS BIGINT) * 7 + p_partkey % 7, p_partkey FROM {part}
        UNION ALL SELECT p_partkey % 7, p_partkey, CAST(floor(floor(p_partkey / 7) / 4) AS BIGINT) * 7 + p_partkey % 7 FROM {part} WHERE p_partkey % 7 IN (2, 5) AND floor(p_partkey / 7) % 13 = 12) e WHERE src <> dst AND src >= 1 AND dst >= 1""",
    "turns": "SELECT conv_id AS flow, turn AS pos, role AS name, text FROM {conversations}",
}


def duck(name: str) -> str:
    """The view as DuckDB SQL over plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


#: Views that number the rows of a key, by that key; bytes of their table's files for each part that is sorted.
NUMBERED, PART = {"atoms": "l_orderkey", "stored": "l_orderkey"}, 2 << 20


def file_bytes(table: DataFrame) -> int:
    """Bytes of a table's files, 1 at least."""
    return max(int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1)


def dealt(table: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into as many parts as the table's files are large, so that what a task sorts doesn't grow with the table."""
    return table.repartition(-(-file_bytes(table) // PART), key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables in a folder."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    if name in NUMBERED:
        tables = {t: dealt(df, NUMBERED[name]) for t, df in tables.items()}
    return spark.sql(VIEWS[name], **tables)
