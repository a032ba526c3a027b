"""Exact top-k search by inner product without random access to single lists.

Candidates are dealt into blocks that stay where they are. A block has for each component a
list of its candidates sorted by that component, read from the top by queries whose own
component is positive and from the bottom by those where it is negative. Reading goes on
segment by segment: what is read is added to the lower bounds of the candidates met there
(components not read yet count as the list's last value; the segments of all lists are one
matrix, zero where a candidate isn't met, so that a product adds them), and lists not read
yet count in the upper bound as the value reached. A query stops when no other candidate's upper bound reaches the k-th lower
bound, or with few left; the scores of those are then resolved. Queries stream past
each block in bounded batches, from part to part of it with the k-th score reached so far,
and take k rows along at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block, which queries visit once, and of the parts with lists of their own that fit a processor's cache; queries that
#: read lists in step, segments of a list.
CANDIDATES, LISTED, QUERIES, SEGMENTS = 65_536, 4_096, 256, 4


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component); vectors with null, NaN or infinite components go."""
    e = F.col("embedding").cast("array<double>")
    limit = F.lit(float("inf"))
    fine = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < limit), F.lit(False)))
    return rows.where(F.col("embedding").isNotNull() & fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(e, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[at] = flat
    return out


class Block:
    """Candidates and their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")  # a column is a list from its bottom to its top
        self.values = np.take_along_axis(x, order, axis=0)
        self.rank = np.argsort(order, axis=0, kind="stable").astype(np.int32)
        self.most = int(np.abs(x).max(initial=0))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None, read: list | None = None) -> tuple[list, list, list]:
        """(query's number, candidate, score) of the k best candidates of this part for each query.

        least: a score for each query that k candidates elsewhere reach; lower ones aren't wanted. read: gets
        the share of the lists that each query read.
        """
        out: tuple[list, list, list] = ([], [], [])
        least = np.full(len(q), -np.inf) if least is None else least
        n, width = self.x.shape
        exact = max(int(np.abs(q).max(initial=0)), 1) * max(self.most, 1) * max(width, 1)
        if n <= 4 * k or exact >= 1 << 52:  # too few to bound, or beyond exact floats
            for r in range(len(q)):
                self._resolve(r, q_ids[r], q[r], np.arange(n), k, out)
            return out
        kind = np.float32 if exact < 1 << 22 else np.float64
        plus, minus = np.maximum(q, 0).astype(kind).T, np.minimum(q, 0).astype(kind).T  # a row for each list
        low = np.empty((n, len(q)), kind)
        low[:] = self.values[0].astype(kind) @ plus + self.values[-1].astype(kind) @ minus  # nothing read: the worst
        weights = np.concatenate([plus, minus])  # lists from the top, then from the bottom
        left, at = np.arange(len(q)), 0
        for upto in sorted({-(-n * (s + 1) // SEGMENTS) for s in range(SEGMENTS)}):
            # the segment of every list: what it adds to the candidates met there
            top, bottom = (self.rank >= n - upto) & (self.rank < n - at), (self.rank >= at) & (self.rank < upto)
            low += np.concatenate([np.where(top, self.x - self.values[0], 0), np.where(bottom, self.x - self.values[-1], 0)], axis=1).astype(kind) @ weights
            at = upto
            # lists that a candidate wasn't met in yet: between the worst value and the one reached
            room = np.concatenate([np.where(self.rank < n - at, self.values[n - at] - self.values[0], 0), np.where(self.rank >= at, self.values[at - 1] - self.values[-1], 0)], axis=1)
            upper = low + room.astype(kind) @ weights
            ready = np.zeros(len(left), bool)
            for r, number in enumerate(left):
                lower = low[:, r].copy()
                lower[self.ids == q_ids[number]] = -np.inf
                kth = max(np.partition(lower, n - k)[n - k], least[number])
                keep = np.flatnonzero((upper[:, r] >= kth) & (self.ids != q_ids[number]))
                if at == n or len(keep) <= max(8 * k, n // 64):
                    self._resolve(number, q_ids[number], q[number], keep, k, out)
                    ready[r] = True
                    if read is not None:
                        read.append(at / n)
            left, low, weights = left[~ready], low[:, ~ready], weights[:, ~ready]
            if not len(left):
                break
        return out

    def _resolve(self, number: int, query: int, q: np.ndarray, at: np.ndarray, k: int, out: tuple[list, list, list]) -> None:
        at = at[self.ids[at] != query]
        s = self.x[at] @ q
        best = np.lexsort((self.ids[at], -s))[:k]
        out[0].extend([number] * len(best))
        out[1].extend(self.ids[at[best]])
        out[2].extend(s[best])


def through(parts: list[Block], q_ids: np.ndarray, q: np.ndarray, k: int, read: list | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of all parts for each query; the k-th score that the parts before gave
    bounds what is wanted of the next."""
    best: list[list] = [[] for _ in q_ids]
    for part in parts:
        least = np.array([b[-1][0] if len(b) == k else -np.inf for b in best])
        found: dict[int, list] = {}
        for number, candidate, score in zip(*part.search(q_ids, q, k, least, read)):
            found.setdefault(int(number), []).append((int(score), -int(candidate)))
        for number, new in found.items():
            best[number] = sorted(best[number] + new, reverse=True)[:k]
    return [(int(query), -c, s) for query, b in zip(q_ids, best) for s, c in b]


def top_k(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query by integer inner product.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; vectors of unequal length are
    compared as if filled with zeros. Rows with a query's own id are never its results;
    repeated rows are repeated candidates, a query repeated with the same vector is answered
    once. Candidates are dealt into blocks of bounded size without copies; each query goes to
    every block, which gives k rows for it at most.
    """
    vectors = quantised(rows)
    size = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    few = min(-(-size[0] // LISTED), rows.sparkSession.sparkContext.defaultParallelism)  # work for all cores
    blocks, width = max(-(-size[0] // CANDIDATES), few, 1), size[1] or 0
    candidates = vectors.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("side"), "vec_id", "x")
    queries = vectors.where(is_query).dropDuplicates(["vec_id", "x"])
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("side"), "vec_id", "x")
    met = candidates.unionByName(queries).repartition(blocks, "b").sortWithinPartitions("b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's candidates come first, then the queries, which stream past."""
        number, parts, held = None, [], []

        def answers(q_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            got = [found for i in range(0, len(q), QUERIES) for found in through(parts, q_ids[i : i + QUERIES], q[i : i + QUERIES], k)]
            return pa.RecordBatch.from_arrays([pa.array(np.asarray([g[c] for g in got], np.int64)) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            key = batch.column("b").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            for run_ in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(run_):
                    continue
                rows = batch.slice(int(run_[0]), len(run_))
                ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("x"), width)
                if key[run_[0]] // 2 != number:
                    number, parts, held = key[run_[0]] // 2, [], []
                if key[run_[0]] % 2 == 0:
                    held.append((ids, x))
                elif held or parts:
                    if held:
                        all_ids, all_x, held = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), []
                        parts = [Block(all_ids[i : i + LISTED], all_x[i : i + LISTED]) for i in range(0, len(all_ids), LISTED)]
                    yield answers(ids, x)

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
