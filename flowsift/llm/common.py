"""What the operators share: reading a table, folds, cutting lineage, bounded samples."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; an error if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, seen by the driver and all executors."""
    return f"{checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same for the same table: the first by hash of the key."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


#: Rows of one key that a task may join with the key's row.
HOT = 100_000


def join_hot(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with few (a row for each key), where a key may have a large share of all rows.

    Keys of more than HOT rows are counted, so there is at most a row for every HOT rows to
    broadcast; their rows are dealt by the hash of column `by`, and only their rows in
    `few` are repeated, once for each share.
    """
    shares = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT)
    shares = F.broadcast(shares.select(key, F.ceil(F.col("__n") / HOT).cast("int").alias("__shares")))
    number = F.coalesce(F.col("__shares"), F.lit(1))
    dealt = rows.join(shares, key, "left").withColumn("__share", F.pmod(F.xxhash64(by), number).cast("int")).drop("__shares")
    repeated = few.join(shares, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), number - 1))).drop("__shares")
    return dealt.join(repeated, [key, "__share"], how).drop("__share")


#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to SLICE."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task; one thing at a time, since workers outlive the stage that needed it."""
    if key not in _resident:
        forget()
        _resident[key] = make()
    return _resident[key]


def forget() -> None:
    """Gives back what an operator before has left in this Python worker; for tasks that need none of it."""
    if _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def raw(column) -> list:
    """An Arrow string column as UTF-8 bytes; null reads as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_scale(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of a label on a raw score, by Newton steps with a light penalty."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    x, b, prior = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, -np.where(y > 0, 1, -1) * (x @ b)).sum() + 0.5 * ((b - prior) ** 2).sum())

    for _ in range(steps):
        p = sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        move, t = np.linalg.solve(h, x.T @ (y - p) - (b - prior)), 1.0
        while t > 1e-4 and loss(b + t * move) > loss(b):  # halve steps that go too far
            t /= 2
        b = b + t * move
    return max(1e-3, float(b[0])), float(b[1])
