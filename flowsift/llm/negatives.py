"""Hard negatives: for each anchor and positive the best rows of other labels within a window of scores.

An anchor's positives have windows that overlap, so their upper limits, highest first, split the
scores into disjoint slots. A block of rows gives each slot its k best rows, tasks combine
them before the shuffle, and one pass over an anchor's slots from the top answers all
its windows: a window's rows are the first k of its own slot and those below it, down to
its lower limit.

Rows are dealt into blocks of one label and a bounded size, which stay where they are; anchors
stream past, for positives the blocks of their own label, for negatives all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, and scores that are held at once.
BLOCK, SCORES = 32_768, 4_000_000


def quantised(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, x array<long>): floor(scale * component); rows without an id, a label or a vector, and
    vectors with null, NaN or infinite components go."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(e, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in this order."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def slots(uppers: np.ndarray, lowers: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, place) of each slot's k best scores. Slot j reaches from uppers[j], which descend, to above the next one, and
    not below lowers[j]: no window that a slot is part of reaches deeper."""
    slot, at = [], []
    for j, (high, low) in enumerate(zip(uppers, lowers)):
        fits = (score <= high) & (score >= low)
        if j + 1 < len(uppers):
            fits &= score > uppers[j + 1]
        held = np.flatnonzero(fits)
        held = held[best(score[held], ids[held], k)]
        slot.append(np.full(len(held), j))
        at.append(held)
    return (np.concatenate(slot), np.concatenate(at)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, through floats where these hold them."""
    if int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[1], 1) < 1 << 53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


def _met(blocks: DataFrame, anchors: DataFrame, keys: list[str], width: int, columns: list[str], answer: Callable[..., tuple], schema: str) -> DataFrame:
    """answer(scores, ids, labels, the anchor's columns) for each anchor and the block that its keys name.

    Both sides have the keys, vec_id, label and x. A block's rows come first in its task, then
    the anchors, in bounded batches.
    """
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in columns]
    rows = blocks.select(*keys, F.lit(0).alias("side"), "vec_id", "label", "x", *nothing).unionByName(anchors.select(*keys, F.lit(1).alias("side"), "vec_id", "label", "x", *columns))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ids, labels, x = None, [], None, None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in [*keys, "side"]], axis=1)
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for begin, end in zip(starts, starts[1:]):
                if begin == end:
                    continue
                part, of = batch.slice(begin, end - begin), tuple(key[begin, :-1])
                if of != block:
                    block, held, ids = of, [], None
                vec_id, label, own_x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("x"), width)
                if key[begin, -1] == 0:
                    held.append((vec_id, label, own_x))
                    continue
                if ids is None:
                    if not held:
                        continue
                    (ids, labels, x), held = map(np.concatenate, zip(*held)), []
                own = [part.column(c).to_pylist() for c in columns]
                step = max(1, SCORES // len(ids))
                for i in range(0, len(vec_id), step):
                    scores = _products(own_x[i : i + step], x)
                    out = [answer(scores[r - i], ids, labels, int(vec_id[r]), int(label[r]), *(c[r] for c in own)) for r in range(i, min(i + step, len(vec_id)))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[c], np.int64) for o in out])) for c in range(len(names))], names)

    return rows.mapInArrow(run, schema)


def _share(score: Column, percent: int) -> Column:
    """A share of a score, exactly."""
    return score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the k best rows of other labels for each anchor
    and each of its `positives` best rows of the same label, with window[0] * positive <= 100 * negative <= window[1] * positive.

    Scores are integer inner products, which have to fit a long; ties go to the smaller vec_id. Rows without an id, a label or a
    vector, and vectors with null or non-finite components take no part; vectors of unequal
    length are compared as if filled with zeros. Rows with an anchor's own id are never its
    positives or negatives; a row that is there several times is several candidates and one
    anchor, rows with one id and different vectors or labels are anchors of their own. A
    positive with a score below 0 has an empty window. Blocks and what they give are bounded
    whatever share of the rows one label or one vector has; an anchor comes to positives * k
    rows in the end.
    """
    vectors = cut(quantised(rows, label, scale))
    size = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    width, many = size[1] or 0, -(-size[0] // BLOCK) or 1
    anchors = cut(vectors.where(is_anchor).dropDuplicates(["vec_id", "label", "x"]).withColumn("anchor", F.xxhash64("vec_id", "label", "x")))

    def nearest(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, vec_id: int, label: int, anchor: int) -> tuple:
        other = np.flatnonzero((ids != vec_id) & (labels == label))
        at = other[best(score[other], ids[other], positives)]
        return np.full(len(at), anchor), np.full(len(at), vec_id), ids[at], score[at]

    parts = vectors.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(anchors.select("label").distinct(), "label")
    own = vectors.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts").cast("int")).withColumn("group", F.col("label"))
    asking = anchors.join(parts, "label").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("group", F.col("label"))
    found = _met(own, asking, ["group", "part"], width, ["anchor"], nearest, "anchor long, anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # a window's limits as whole scores; slots by distinct upper limits, the highest first
    found = found.withColumn("low", F.ceil(_share(F.col("score"), window[0])).cast("long")).withColumn("high", F.floor(_share(F.col("score"), window[1])).cast("long")).where("low <= high")
    asked = cut(found.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct("high", "low", "score", "positive_id")).alias("windows")))
    uppers = F.reverse(F.array_sort(F.array_distinct("windows.high")))
    lowest = lambda u: F.array_min(F.transform(F.filter("windows", lambda w: w["high"] == u), lambda w: w["low"]))
    asked = asked.withColumn("uppers", uppers).withColumn("lowers", F.transform("uppers", lowest))

    def kept(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, vec_id: int, label: int, anchor: int, uppers: list, lowers: list) -> tuple:
        other = np.flatnonzero((labels != label) & (ids != vec_id) & (score <= uppers[0]) & (score >= min(lowers)))
        slot, at = slots(np.array(uppers), np.array(lowers), score[other], ids[other], k)
        return np.full(len(at), anchor), slot, ids[other[at]], score[other[at]]

    blocks = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(many)).cast("int"))
    asking = anchors.join(asked.select("anchor", "uppers", "lowers"), "anchor").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    best_of = _met(blocks, asking, ["part"], width, ["anchor", "uppers", "lowers"], kept, "anchor long, slot long, negative_id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "negative_id")
    best_of = best_of.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    # descending merge: an anchor's slots are one list, the highest scores first; a window starts at its slot
    merged = best_of.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "negative_id"))).alias("all"))
    answered = asked.join(merged, "anchor").select("anchor_id", "all", "uppers", F.explode("windows").alias("w"))
    first = F.array_position("uppers", F.col("w.high")) - 1
    fits = F.slice(F.filter("all", lambda s: (s["slot"] >= first) & (-s["minus"] >= F.col("w.low"))), 1, k)
    answers = answered.select("anchor_id", "w", F.posexplode(fits).alias("rank", "n"))
    return answers.select("anchor_id", F.col("w.positive_id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), "n.negative_id", F.col("w.score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"))
