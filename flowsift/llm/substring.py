"""Substring deduplication through difference-cover anchors.

Anchors are windows of ANCHOR words that start where the word's number modulo PERIOD is
in COVER. For any two positions some offset under PERIOD brings both into the cover, so
two equal windows of ANCHOR + PERIOD - 1 words hold an equal anchor at one offset. First
every anchor is counted over groups of documents; only windows that hold an anchor seen
elsewhere are then extended to their full length, hashed by 96 bits or more and matched
with the smallest document that has them. All hashes travel as sorted arrays, one for
each group and hash range, and a group sends each hash once, so that a passage that very
many documents share costs a row for each group, not for each document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
WINDOW = ANCHOR + PERIOD - 1
#: Bytes of text in a group, and for each range of hashes.
GROUP, RANGE = 8 << 20, 16 << 20
#: Groups or ranges of a task, and most tasks of a stage.
PER_TASK, MOST = 8, 50_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NONE = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every `size` consecutive word hashes, mixed."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * base + words[i : i + n]
    return _mix(out)


class Group:
    """The words of a group's documents on one line; a window never crosses documents."""

    def __init__(self, t: pa.Table):
        self.ids = np.array([NONE if i is None else i for i in t.column("doc_id").to_pylist()], np.int64)
        texts = t.column("text").cast(pa.binary()).to_pylist()
        self.words = [(x or b"").split() for x in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        total = int(self.n.sum())
        h = xxhash.xxh3_64_intdigest
        self.hash = np.fromiter((h(w) for ws in self.words for w in ws), np.uint64, total)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(total) - self.first[self.doc]
        self.left = self.n[self.doc] - self.place  # words from here to the document's end
        self.left[self.ids[self.doc] == NONE] = 0  # rows without an id take no part

    def starts(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.left >= size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        at = self.starts(ANCHOR)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, _rolled(self.hash, ANCHOR, _A)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the whole windows at these positions."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _rolled(self.hash, WINDOW, _A)[at], _rolled(_mix(self.hash ^ _B), WINDOW, _B)[at]


def _ranges(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def _several(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distinct hashes that occur with at least two different ids."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (ids[1:] != ids[:-1])])


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _send_anchors(count: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        _, h = Group(t).anchors()
        h = np.unique(h)
        part = _ranges(h, count)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        pieces = [p for p in np.split(order, cut) if len(p)]
        g = t.column("g")[0].as_py()
        return pa.table({"part": pa.array([part[p[0]] for p in pieces], pa.int64()), "g": pa.array([g] * len(pieces), pa.int64()), "h": pa.array([_blob((h[p] & np.uint64(0xFFFFFFFF)).astype(np.uint32)) for p in pieces], pa.binary())})

    return run


def _shared_anchors(t: pa.Table) -> pa.Table:
    """Of one range: to each group its anchors that another group has too (32 bits are a filter)."""
    parts = [np.frombuffer(b, np.uint32) for b in t.column("h").to_pylist()]
    got, n = np.unique(np.concatenate(parts), return_counts=True)
    several = got[n > 1]
    out = [(g, p[np.isin(p, several, assume_unique=False)]) for g, p in zip(t.column("g").to_pylist(), parts)]
    out = [(g, p) for g, p in out if len(p)]
    part = t.column("part")[0].as_py()
    return pa.table({"g": pa.array([g for g, _ in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), "h": pa.array([_blob(p) for _, p in out], pa.binary())})


def _send_windows(count: int) -> Callable:
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "k": pa.array([], pa.binary()), "d": pa.array([], pa.binary())})
        if not docs.num_rows:
            return empty
        group = Group(docs)
        at, h = group.anchors()
        known = [np.frombuffer(b, np.uint32).astype(np.uint64) | np.uint64(p) << np.uint64(32) for p, b in zip(shared.column("part").to_pylist(), shared.column("h").to_pylist())]
        key = (h & np.uint64(0xFFFFFFFF)) | _ranges(h, count).astype(np.uint64) << np.uint64(32)
        hit = np.isin(key, np.concatenate(known)) if known else np.zeros(len(h), bool)
        marked = np.zeros(len(group.hash) + PERIOD, np.int64)
        marked[at[hit]] = 1
        seen = np.r_[0, np.cumsum(marked)]
        starts = group.starts(WINDOW)
        starts = starts[seen[starts + PERIOD] > seen[starts]]
        if not len(starts):
            return empty
        a, b = group.windows(starts)
        b, d = b.astype(np.uint32), group.ids[group.doc[starts]]
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # the first has the smallest id
        a, b, d = a[once], b[once], d[once]
        part = _ranges(a, count)
        order = np.argsort(part, kind="stable")
        pieces = [p for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(p)]
        g = docs.column("g")[0].as_py()
        return pa.table({"part": pa.array([part[p[0]] for p in pieces], pa.int64()), "g": pa.array([g] * len(pieces), pa.int64()), **{c: pa.array([_blob(x[p]) for p in pieces], pa.binary()) for c, x in (("h", a), ("k", b), ("d", d))}})

    return run


def _first_documents(t: pa.Table) -> pa.Table:
    """Of one range: to each group the windows that a smaller document of another group has."""
    a, b, d = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("h", np.uint64), ("k", np.uint32), ("d", np.int64)))
    sizes = [len(x) // 8 for x in t.column("h").to_pylist()]
    order = np.lexsort((d, b, a))
    change = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    least = np.empty(len(a), np.int64)
    least[order] = d[order][np.flatnonzero(change)][np.cumsum(change) - 1]
    out, at = [], 0
    for g, n in zip(t.column("g").to_pylist(), sizes):
        rows = slice(at, at + n)
        less = least[rows] < d[rows]
        if less.any():
            out.append((g, *(_blob(x[rows][less]) for x in (a, b, least))))
        at += n
    return pa.table({c: pa.array([o[i] for o in out], kind) for i, (c, kind) in enumerate((("g", pa.int64()), ("h", pa.binary()), ("k", pa.binary()), ("d", pa.binary())))})


def _removed(docs: pa.Table, found: pa.Table) -> tuple[Group, np.ndarray]:
    """Which words of the group go: those under a window that a smaller document has."""
    group = Group(docs)
    starts = group.starts(WINDOW)
    a, b = group.windows(starts)
    b, d = b.astype(np.uint32), group.ids[group.doc[starts]]
    other = [np.concatenate([np.frombuffer(x, kind) for x in found.column(c).to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("h", np.uint64), ("k", np.uint32), ("d", np.int64))]
    a, b, all_d = np.r_[a, other[0]], np.r_[b, other[1]], np.r_[d, other[2]]
    order = np.lexsort((all_d, b, a))
    change = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(order)]
    least = np.empty(len(a), np.int64)
    least[order] = all_d[order][np.flatnonzero(change)][np.cumsum(change) - 1]
    gone = starts[least[: len(starts)] < d]
    edge = np.zeros(len(group.hash) + WINDOW + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + WINDOW, -1)
    return group, np.cumsum(edge)[: len(group.hash)] > 0


def _parts(df: DataFrame, count: int) -> int:
    """Partitions for so many groups or ranges: the session's number, or more if these are many."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(count, max(usual, -(-count // PER_TASK)), MOST))


def _grouped(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents dealt into groups once (all passes read this exchange), with the counts of groups and ranges.

    Groups and ranges are worked on one at a time, some PER_TASK in a task, so neither a
    task's memory nor, up to MOST tasks, its share grows with the input.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, ranges = max(1, -(-size // GROUP)), max(1, -(-size // RANGE))
    return rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)).cast("long")).repartition(_parts(docs, groups), "g"), groups, ranges


def _found(rows: DataFrame, groups: int, ranges: int) -> DataFrame:
    sent = rows.groupBy("g").applyInArrow(_send_anchors(ranges), "part long, g long, h binary")
    shared = sent.repartition(_parts(rows, ranges), "part").groupBy("part").applyInArrow(_shared_anchors, "g long, part long, h binary")
    windows = rows.groupBy("g").cogroup(shared.repartition(_parts(rows, groups), "g").groupBy("g")).applyInArrow(_send_windows(ranges), "part long, g long, h binary, k binary, d binary")
    return windows.repartition(_parts(rows, ranges), "part").groupBy("part").applyInArrow(_first_documents, "g long, h binary, k binary, d binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: words under a window of 13 that also
    starts in a document with a smaller doc_id are removed.

    Words are what stands between the six ASCII blanks, unchanged; null has none. Windows
    are judged on the input. Rows with one doc_id don't shorten each other; rows without
    an id are kept whole and shorten none. Texts of any length are taken whole.
    """

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        group, gone = _removed(t, found)
        n_gone = np.add.reduceat(np.r_[gone.astype(np.int64), 0], np.minimum(group.first, len(gone))) * (group.n > 0) if len(group.n) else gone
        kept = []
        for i, (w, n) in enumerate(zip(group.words, n_gone)):
            mask = gone[group.first[i] : group.first[i] + group.n[i]]
            kept.append(b" ".join(w if not n else [x for x, m in zip(w, mask) if not m]).decode("utf-8"))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(group.n), "n_removed": pa.array(np.asarray(n_gone, np.int64)), "kept": pa.array(kept, pa.string())})

    rows, groups, ranges = _grouped(docs)
    found = _found(rows, groups, ranges).repartition(_parts(rows, groups), "g")
    return rows.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) from deduplicate()."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
