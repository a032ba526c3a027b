"""Walks from many starts inside tasks: a part of the starts gets the ways of all that it reaches, and pairs of nodes never leave a task but as results.

Ways are (at, node, open, shown): one step from `at` leads to `node`, which is passed if open and told if shown. What a
part of neighbouring starts reaches is hardly more than what one of them does, so parts are found by walking sets of nodes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import shuffled, stored

# workers needn't have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ways that a part's starts have of their own, and with all that they reach at most: up to MOST ways are one part.
OWN, MOST = 1 << 20, 1 << 22
#: Starts that a task walks from together, tasks that share the parts, cells of a task's table of (start, node), rows of a batch.
TOGETHER, TASKS, CELLS, ROWS = 1024, 24, 1 << 23, 1 << 18
_BITS = 63


def reached_by_parts(ways: DataFrame, starts: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(part, start), (part, at) of the nodes that a part's starts pass within so many hops, starts included, and how many parts.

    A row for a node and 63 parts: the parts that reach it are bits, so a round reads each way once for all parts.
    """
    parts = -(-ways.count() // OWN)
    starts = stored(starts.repartitionByRange(parts, "start").select(F.spark_partition_id().alias("part"), "start"))
    word, bit = F.floor(F.col("part") / _BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, part % {_BITS})")
    seen = frontier = stored(starts.groupBy(F.col("start").alias("at"), word).agg(F.bit_or(bit).alias("mask")))
    passed, hops, none = ways.where("open").select("at", "node"), 1, F.lit(0).cast("bigint")
    while most is None or hops < most:
        told = frontier.join(shuffled(passed), "at").select(F.col("node").alias("at"), "word", F.col("mask").alias("new"), none.alias("old"))
        both = told.unionByName(seen.select("at", "word", none.alias("new"), F.col("mask").alias("old"))).groupBy("at", "word").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        frontier = stored(both.select("at", "word", F.expr("new & ~old").alias("mask")).where("mask <> 0"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        hops += 1
        seen = stored(seen.groupBy("at", "word").agg(F.bit_or("mask").alias("mask"))) if hops % 8 == 0 else seen
    each = seen.select("at", "word", F.expr(f"explode(filter(sequence(0, {_BITS - 1}), i -> mask & shiftleft(1L, i) <> 0))").alias("bit"))
    return starts, each.select((F.col("word") * _BITS + F.col("bit")).alias("part"), "at"), parts


def parted(ways: DataFrame, starts: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[int], int]:
    """(part, start), (part, at), the parts' ways, the parts that have more than MOST of them, and how many parts there are."""
    if ways.count() <= MOST:
        zero = F.lit(0).alias("part")
        nodes = ways.select("at").unionByName(ways.select(F.col("node").alias("at"))).distinct()
        return starts.select(zero, "start"), nodes.select(zero, "at"), ways.select(zero, *ways.columns), [], 1
    starts, inside, parts = reached_by_parts(ways, starts, most)
    inside = stored(inside)
    held = stored(inside.join(shuffled(ways), "at").select("part", *ways.columns))
    large = held.groupBy("part").count().where(F.col("count") > MOST).select("part").collect()
    return starts, inside, held, [r.part for r in large], parts


def shares_of(parts: int) -> int:
    return -(-TASKS // parts)


def in_tasks(frames: list[DataFrame], parts: int, shares: int, walk, schema: str) -> DataFrame:
    """walk(tables) over the rows of each (part, share), one task each. A frame has a part, and a share or else goes to all shares of its part."""
    rows, kinds = None, len(frames)
    for kind, df in enumerate(frames):
        share = F.col("share") if "share" in df.columns else F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
        df = df.withColumn("share", share).withColumn("__kind", F.lit(kind).cast("tinyint"))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    dealt = rows.withColumn("__unit", (F.col("part") * shares + F.col("share")).cast("int")).drop("part", "share").repartitionById(parts * shares, "__unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches)
            del batches
            units = pc.unique(table["__unit"]).to_pylist()
            for unit in sorted(units):
                one = table if len(units) == 1 else table.filter(pc.equal(table["__unit"], unit))
                yield from walk([one.filter(pc.equal(one["__kind"], k)) for k in range(kinds)], unit % shares)

    return dealt.mapInArrow(run, schema)


class Ways:
    """A task's ways, its nodes by numbers in their order."""

    def __init__(self, table: pa.Table, others: list[pa.ChunkedArray]):
        known = pc.unique(pa.chunked_array([c for column in (table["at"], table["node"], *others) for c in column.chunks], table["at"].type))
        self.ids = known.take(pc.array_sort_indices(known))
        self.size = len(self.ids)
        at, to = self.numbers(table["at"]), self.numbers(table["node"])
        order = np.argsort(at, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=self.size))]).astype(np.int64)
        self.to = to[order].astype(np.int32)
        self.open, self.shown = (table[c].to_numpy()[order] if c in table.column_names else None for c in ("open", "shown"))

    def numbers(self, column: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(column, value_set=self.ids).to_numpy()


def _steps(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ways from each of some nodes, and how many each has."""
    n = ends[at + 1] - ends[at]
    return np.repeat(ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _around(ways: Ways, starts: np.ndarray, most: int | None, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All that the starts reach, starts included, and which of it is passed; flags has zeros and gets them back."""
    flags[starts], frontier, all_, hops = 2, starts, [starts], 0
    while len(frontier) and (most is None or hops < most):
        places, _ = _steps(ways.ends, frontier)
        fresh, passed = ways.to[places], ways.open[places]
        found = np.unique(fresh[flags[fresh] == 0])
        flags[found] = 1
        all_.append(found)
        frontier = np.unique(fresh[passed & (flags[fresh] == 1)])
        flags[frontier] = 2
        hops += 1
    inside = np.sort(np.concatenate(all_))
    passes = flags[inside] == 2
    flags[inside] = 0
    return inside, passes


def pairs_in_task(ways: Ways, starts: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, node, hops) by the fewest hops, numbers of nodes; starts in their order, TOGETHER at a time with just the nodes around them."""
    flags, local, marks = np.zeros(ways.size, np.int8), np.zeros(ways.size, np.int32), np.full(CELLS, -1, np.int32)
    for low in range(0, len(starts), TOGETHER):
        some = starts[low : low + TOGETHER]
        inside, passes = _around(ways, some, most, flags)
        m = len(inside)
        local[inside] = np.arange(m, dtype=np.int32)
        places, n = _steps(ways.ends, inside[passes])
        count = np.zeros(m, np.int64)
        count[passes] = n
        ends, to = np.concatenate([[0], np.cumsum(count)]), local[ways.to[places]]
        open_, shown = ways.open[places], ways.shown[places]
        marks = marks if len(marks) >= m else np.full(m, -1, np.int32)
        for first in range(0, len(some), max(1, CELLS // m)):
            mine = some[first : first + max(1, CELLS // m)]
            at, of, hops = local[mine], np.arange(len(mine)), 0
            touched = [of * m + at]
            marks[touched[0]] = 0
            while len(at) and (most is None or hops < most):
                hops += 1
                places, n = _steps(ends, at)
                of, node = np.repeat(of, n), to[places]
                cells = of * m + node
                new = marks[cells] < 0
                places, of, node, cells = places[new], of[new], node[new], cells[new]
                order = np.arange(len(cells), dtype=np.int32)
                marks[cells] = order
                new = marks[cells] == order
                places, of, node, cells = places[new], of[new], node[new], cells[new]
                touched.append(cells)
                told = shown[places]
                yield mine[of[told]], inside[node[told]], np.full(np.count_nonzero(told), hops, np.int32)
                go = open_[places]
                at, of = node[go], of[go]
            for cells in touched:
                marks[cells] = -1


def walked_pairs(ways: DataFrame, starts: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(start, node, hops) of all that the starts reach within so many hops, by the fewest; and the starts left out, because their part has too many ways.

    ways are stored and distinct, without nulls; starts: (start), distinct.
    """
    starts, _, held, large, parts = parted(ways, starts, most)
    left = starts.where(F.col("part").isin(large)).select("start") if large else None
    if large:
        starts, held = (df.where(~F.col("part").isin(large)) for df in (starts, held))
    shares, together, rows = shares_of(parts), TOGETHER, ROWS

    def walk(tables: list[pa.Table], share: int) -> Iterator[pa.RecordBatch]:
        edges, own = tables
        graph = Ways(edges, [own["start"]])
        first = np.sort(graph.numbers(own["start"]))
        blocks = np.arange(len(first)) // together
        waiting, n = [], 0
        for found in pairs_in_task(graph, first[blocks % shares == share], most):
            waiting.append(found)
            n += len(found[2])
            if n >= rows:
                yield from told(graph, waiting)
                waiting, n = [], 0
        yield from told(graph, waiting)

    def told(graph: Ways, waiting: list) -> Iterator[pa.RecordBatch]:
        if waiting:
            start, node, hops = (np.concatenate(x) for x in zip(*waiting))
            for i in range(0, len(hops), rows):
                some = slice(i, i + rows)
                yield pa.RecordBatch.from_arrays([graph.ids.take(pa.array(start[some])), graph.ids.take(pa.array(node[some])), pa.array(hops[some])], names=["start", "node", "hops"])

    kind = ways.schema["at"].dataType.simpleString()
    pairs = in_tasks([held.select("part", "at", "node", "open", "shown"), starts], parts, shares, walk, f"start {kind}, node {kind}, hops int")
    return pairs, left


def _told(ways: Ways, values: np.ndarray) -> np.ndarray:
    """For each node the bits of all nodes that one step leads to."""
    out, n = np.zeros(ways.size, np.uint64), np.diff(ways.ends)
    if len(values):
        out[n > 0] = np.bitwise_or.reduceat(values, ways.ends[:-1][n > 0])
    return out


def _bits_ahead(ways: Ways, back: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
    """For each node the bits that the nodes it reaches have of their own; what changes is told on until nothing does."""
    ends, to = back
    got, changed = np.zeros(ways.size, np.uint64), np.flatnonzero(own)
    while len(changed):
        places, n = _steps(ends, changed)
        if len(places) > len(to) // 8:  # most ways have something to tell: all are read in order
            more = got | _told(ways, (got | own)[ways.to])
            changed = np.flatnonzero((more | own) != (got | own))
            got = more
        else:
            node, bits = to[places], np.repeat(got[changed] | own[changed], n)
            fresh = (bits & ~got[node]) != 0
            node, bits = node[fresh], bits[fresh]
            some = np.unique(node)
            before = got[some] | own[some]
            np.bitwise_or.at(got, node, bits)
            changed = some[(got[some] | own[some]) != before]
    return got


def _meets_another(ways: Ways, start: int, has: np.ndarray) -> bool:
    """Whether a start reaches a node that has something, other than itself; the nearest ones are looked at first."""
    seen, frontier = {start}, np.array([start])
    while len(frontier):
        places, _ = _steps(ways.ends, frontier)
        found = [x for x in np.unique(ways.to[places]).tolist() if x not in seen]
        if has[found].any():
            return True
        seen.update(found)
        frontier = np.array(found, np.int64)
    return False


def satisfied(ways: DataFrame, given: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The (at, name) of wanted that another node which `at` reaches has in given; and those left out, because their part has too many ways.

    ways as for walked_pairs(), all of them open. A task has a part's ways and some of the names, 64 of them in the bits of a number.
    """
    starts, inside, held, large, parts = parted(ways, wanted.select(F.col("at").alias("start")).distinct())
    asked = starts.withColumnRenamed("start", "at").join(shuffled(wanted), "at")
    left = asked.where(F.col("part").isin(large)).select("at", "name") if large else None
    if large:
        asked, inside, held = (df.where(~F.col("part").isin(large)) for df in (asked, inside, held))
    shares = shares_of(parts)
    share = F.pmod(F.xxhash64("name"), F.lit(shares)).cast("int").alias("share")
    asked, given = asked.select("part", share, "at", "name"), inside.join(shuffled(given), "at").select("part", share, "at", "name")

    def walk(tables: list[pa.Table], _: int) -> Iterator[pa.RecordBatch]:
        edges, has, want = tables
        if not want.num_rows:
            return
        graph, names = Ways(edges, [has["at"], want["at"]]), pc.unique(want["name"])
        has = has.filter(pc.is_in(has["name"], value_set=names))
        has_at, has_name = graph.numbers(has["at"]), pc.index_in(has["name"], value_set=names).to_numpy()
        want_at, want_name = graph.numbers(want["at"]), pc.index_in(want["name"], value_set=names).to_numpy()
        order = np.argsort(graph.to, kind="stable")
        back = np.concatenate([[0], np.cumsum(np.bincount(graph.to, minlength=graph.size))]), np.repeat(np.arange(graph.size), np.diff(graph.ends))[order]
        for low in range(0, len(names), 64):
            own, mine = np.zeros(graph.size, np.uint64), (has_name >= low) & (has_name < low + 64)
            np.bitwise_or.at(own, has_at[mine], np.uint64(1) << (has_name[mine] - low).astype(np.uint64))
            rows = np.flatnonzero((want_name >= low) & (want_name < low + 64))
            bit, at = (want_name[rows] - low).astype(np.uint64), want_at[rows]
            found = (_bits_ahead(graph, back, own)[at] >> bit) & np.uint64(1) != 0
            for i in np.flatnonzero(found & ((own[at] >> bit) & np.uint64(1) != 0)):  # on a cycle a node meets itself
                found[i] = _meets_another(graph, int(at[i]), (own >> bit[i]) & np.uint64(1) != 0)
            yield pa.RecordBatch.from_arrays([graph.ids.take(pa.array(at[found])), names.take(pa.array(want_name[rows][found]))], names=["at", "name"])

    kinds = [ways.schema["at"].dataType.simpleString(), wanted.schema["name"].dataType.simpleString()]
    return in_tasks([held.select("part", "at", "node"), given, asked], parts, shares, walk, f"at {kinds[0]}, name {kinds[1]}"), left
