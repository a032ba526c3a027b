"""Stored history tables that are rewritten in parts, with versions.

Rows lie in hash buckets of their key. A write rewrites the buckets it touches under a new version,
and then a manifest that tells for each bucket which version counts; the manifest is written
last, so a run that is lost before leaves the table as it was. Older versions stay readable.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowsift.operators.books import merge_level


class HistoryStore:
    """Tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def version(self, table: str) -> int:
        """The last version whose manifest is whole; -1 for a table that isn't there."""
        n = -1
        while self._exists(f"{self.path}/{table}/manifest={n + 1}/_SUCCESS"):
            n += 1
        return n

    def manifest(self, table: str, version: int | None = None) -> dict:
        """{key, buckets, schema, versions: the version of each bucket that holds rows}."""
        n = self.version(table) if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/{table}/manifest={n}").first()[0])

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, known: dict, touched: list[int] | None, number: int) -> None:
        key, n = known["key"], known["buckets"]
        placed = rows.withColumn("__bucket", self._bucket(key, n))
        folder = f"{self.path}/{table}/version={number}"
        placed.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        held = {r[0] for r in self.spark.read.schema(placed.schema).parquet(folder).select("__bucket").distinct().collect()}
        versions = {int(b): v for b, v in known["versions"].items() if touched is not None and int(b) not in touched}
        whole = known | {"versions": versions | {b: number for b in held}}
        text = self.spark.createDataFrame([(json.dumps(whole),)], "value string")
        text.coalesce(1).write.mode("errorifexists").text(f"{self.path}/{table}/manifest={number}")

    def create(self, table: str, rows: DataFrame, key: str) -> None:
        """A new table, or a new version of all of it."""
        self._write(table, rows, {"key": key, "buckets": self.buckets, "schema": rows.schema.json(), "versions": {}}, None, self.version(table) + 1)

    def read(self, table: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version, the last one by itself; with keys (a column of the table's key) only the buckets that may hold them."""
        known = self.manifest(table, version)
        wanted = None if keys is None else self.touched(known, keys)
        paths = [f"{self.path}/{table}/version={v}/__bucket={b}" for b, v in known["versions"].items() if wanted is None or int(b) in wanted]
        schema = StructType.fromJson(json.loads(known["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, known: dict, keys: DataFrame) -> list[int]:
        """Numbers of the buckets of these keys: as many as there are buckets at most."""
        return [r[0] for r in keys.select(self._bucket(known["key"], known["buckets"]).alias("b")).distinct().collect()]

    def rewrite(self, table: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Changes the rows of these keys; gives how many buckets were rewritten. Keys without rows change nothing.

        change may add rows and leave some out, with keys among the given ones.
        """
        number, known = self.version(table) + 1, self.manifest(table)
        key, touched = known["key"], self.touched(known, keys)
        wanted = keys.select(key).distinct()
        rows = self.read(table, keys=keys)
        columns = StructType.fromJson(json.loads(known["schema"])).names
        changed = change(rows.join(wanted, key, "left_semi").select(*columns)).select(*columns)
        self._write(table, rows.join(wanted, key, "left_anti").select(*columns).unionByName(changed), known, touched, number)
        return len(touched)

    def merge(self, table: str, incoming: DataFrame, level: str, order: str, parents: DataFrame | None = None) -> DataFrame:
        """merge_level() into the stored table; gives the rejected rows. Only the buckets of accepted rows are rewritten."""
        key = self.manifest(table)["key"]
        known = incoming if parents is None else incoming.join(parents.select(F.col("uuid").alias("parent_uuid")).distinct(), "parent_uuid", "left_semi")
        self.rewrite(table, known.select(key).distinct(), lambda rows: merge_level(rows, known.select(*incoming.columns), level, order)[0])
        left = incoming.where("false") if parents is None else incoming.join(parents.select(F.col("uuid").alias("parent_uuid")), "parent_uuid", "left_anti").select(*incoming.columns)
        return left.withColumn("problem", F.lit("NOT_FOUND"))
