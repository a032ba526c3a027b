"""The history tables on storage: fixed schemas, readers and the writer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators.graphs import shared

SCHEMAS = {
    "books": "uuid long, name string, meta string",
    "flows": "uuid long, parent_uuid long, meta string, state string",
    "atoms": "pos int, flow long, name string, part long, updated_at timestamp, duration double, state string, intention string, failure string, bucket int",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def forget(spark: SparkSession, folder: str) -> None:
    """Removes a folder that isn't needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_history(books: DataFrame, flows: DataFrame, atoms: DataFrame, path: str, buckets: int = 16, spread: int = 4) -> None:
    """Three Parquet tables; atoms by a hash bucket of their flow, a bucket in up to `spread` files by the hash of the atom."""
    books.write.mode("overwrite").parquet(f"{path}/books")
    flows.write.mode("overwrite").parquet(f"{path}/flows")
    placed = atoms.withColumn("bucket", F.pmod(F.xxhash64("flow"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", F.pmod(F.xxhash64("flow", "pos"), F.lit(spread))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/atoms")


def read_logbooks(spark: SparkSession, path: str, fmt: str = "parquet", lazy: bool = False, **options) -> tuple[DataFrame, ...]:
    """(books, flows, atoms), or (books,) if lazy. fmt: parquet, json, or jdbc, where path is the URL
    and the options (such as partitionColumn and bounds) go to the reader."""

    def one(name: str) -> DataFrame:
        if fmt == "jdbc":
            return spark.read.format("jdbc").options(url=path, dbtable=name, **options).load()
        return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(f"{path}/{name}")

    return tuple(one(n) for n in (["books"] if lazy else SCHEMAS))
