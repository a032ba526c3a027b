"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints are indexed by sets of byte positions together with the bytes found
there. A pair that differs in few bits shares many whole bytes, so it meets under at
least one of a covering family of position sets. For each pair met, the shared
positional bytes are tallied, pairs short of the guaranteed minimum are dropped and
the rest are verified by their Hamming distance. Only a spanning forest of verified
links leaves a bucket, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, join_hot, raw, slices
from .components import connected_components

#: Rows of a bucket that are compared within one block; larger buckets are dealt into chunks.
CHUNK = 4096


# ---------------------------------------------------------------- fingerprints
def _bits(digests: np.ndarray) -> np.ndarray:
    """How often each bit is set; digests as rows of bytes."""
    total = np.zeros(digests.shape[1] * 8, np.int64)
    for i in range(0, len(digests), 50_000):
        total += np.unpackbits(digests[i : i + 50_000], axis=1).sum(0, dtype=np.int64)
    return total


def _shingles(text: bytes, words: int) -> list[bytes]:
    w = text.lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(words)))]


def fingerprint(text: bytes, words: int = 4, lanes: int = 1) -> bytes:
    """8 * lanes bytes: a bit is set if it is set in over half of the shingles' hashes.

    The first lane hashes a shingle by XXH64 with seed 42; further lanes mix that hash.
    """
    shingles = _shingles(text, words)
    if not shingles:
        return bytes(8 * lanes)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), ">u8").astype(np.uint64)
    out = [h]
    for lane in range(1, lanes):
        x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    digests = np.stack(out, axis=1).astype(">u8").view(np.uint8)
    return np.packbits(2 * _bits(digests) > len(h)).tobytes()


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp binary) for every row; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, words, lanes) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


# ---------------------------------------------------------------- position sets
def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one of them whole.

    The positions are laid on three groups in a circle; a triple belongs to the family
    if it lies in one group, or takes two positions of a group and one of the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def belongs(t: tuple[int, ...]) -> bool:
        n = [sum(group[p] == g for p in t) for g in range(3)]
        return max(n) == 3 or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in itertools.combinations(range(8), 3) if belongs(t)]


# ---------------------------------------------------------------- index and links
def _index(distinct: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    byte = lambda p: F.substring("fp", p + 1, 1)
    keys = F.array(*[F.concat(F.lit(bytes([k >> 8, k & 255])), *[byte(p) for p in s]) for k, s in enumerate(sets)])
    return distinct.select("fp", "node", F.explode(keys).alias("key"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


class _Linker:
    """Links within blocks of rows that share a key; rows come sorted by (key, part)."""

    def __init__(self, sets, radius, least):
        self.sets, self.radius, self.least = sets, radius, least

    def verified(self, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
        """Tally of shared positional bytes, count filter, then the distance itself."""
        tally = (fa.view(np.uint8) == fb.view(np.uint8)).sum(-1)
        ok = tally >= self.least
        ok[ok] = _distance(fa[ok], fb[ok]) <= self.radius
        return ok

    def first(self, k: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
        """Whether the set with number k is the first under which the pair meets; wider sets repeat pairs."""
        same, out = fa.view(np.uint8) == fb.view(np.uint8), np.ones(len(k), bool)
        for j, s in enumerate(self.sets):
            out &= ~((j < k) & (k < len(self.sets)) & same[:, list(s)].all(1))
        return out

    def forest(self, fp: np.ndarray) -> tuple[list, np.ndarray]:
        """Spanning forest by breadth-first search; (pairs, component of each row)."""
        comp, pairs, rest = np.full(len(fp), -1), [], np.arange(len(fp))
        while len(rest):
            queue, c = [rest[0]], rest[0]
            comp[c], rest = c, rest[1:]
            while queue and len(rest):
                p = queue.pop()
                near = self.verified(np.broadcast_to(fp[p], (len(rest), fp.shape[1])).copy(), fp[rest])
                if near.any():
                    hit, rest = rest[near], rest[~near]
                    comp[hit] = c
                    queue.extend(hit)
                    pairs.extend((p, x) for x in hit)
        return pairs, comp

    def across(self, fp: np.ndarray, side: np.ndarray) -> list:
        """Links between two chunks: one for each pair of their components at most once."""
        a, b = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
        (_, la), (_, lb) = self.forest(fp[a]), self.forest(fp[b])
        lb, pairs = lb + len(fp), []
        for i, x in enumerate(a):
            rest = np.flatnonzero(lb != la[i])
            if not len(rest):
                continue
            near = rest[self.verified(np.broadcast_to(fp[x], (len(rest), fp.shape[1])).copy(), fp[b[rest]])]
            for j in near:
                if (old := lb[j]) != la[i]:
                    la[la == old], lb[lb == old] = la[i], la[i]
                    pairs.append((x, b[j]))
        return pairs

    def block(self, k: np.ndarray, node: np.ndarray, fp: np.ndarray, run: np.ndarray, part: np.ndarray, chunk: np.ndarray):
        """All runs of equal (key, part) in these rows. Small runs are done at once."""
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        length = np.diff(np.r_[start, len(run)])
        left, right = [], []
        small = np.repeat(length <= 8, length)
        for gap in range(1, 8):
            i = np.flatnonzero(small[:-gap] & (run[:-gap] == run[gap:])) if gap < len(run) else []
            if not len(i):
                break
            ok = self.verified(fp[i], fp[i + gap])
            left.append(i[ok])
            right.append(i[ok] + gap)
        for s, n in zip(start[length > 8], length[length > 8]):
            rows = slice(s, s + n)
            pairs = self.across(fp[rows], chunk[rows]) if part[s] else self.forest(fp[rows])[0]
            left.append(np.array([s + p for p, _ in pairs], np.int64))
            right.append(np.array([s + q for _, q in pairs], np.int64))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(left), np.concatenate(right)
        once = self.first(k[i], fp[i], fp[j])
        return node[i[once]], node[j[once]]


def _index_deeper(rows: DataFrame, sets: list[tuple[int, ...]], least: int) -> DataFrame:
    """Rows of large buckets under one byte position more; these sets are numbered after the others.

    A pair that is kept shares at least `least` whole bytes, so beside a set of fewer
    positions it shares one more of the others.
    """
    wider = sorted({tuple(sorted({*s, p})) for s in sets for p in range(8) if p not in s})
    byte = lambda p: F.substring("fp", p + 1, 1)
    keys = F.array(*[F.when(F.arrays_overlap("numbers", F.array(*[F.lit(k) for k, s in enumerate(sets) if set(s) <= set(t)])), F.concat(F.lit(bytes([(len(sets) + n) >> 8, (len(sets) + n) & 255])), *[byte(p) for p in t])) for n, t in enumerate(wider)])
    hot = rows.withColumn("number", F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int")).groupBy("fp", "node").agg(F.collect_set("number").alias("numbers"))
    return hot.select("fp", "node", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def links(distinct: DataFrame, sets: list[tuple[int, ...]], radius: int, least: int) -> DataFrame:
    """(u, v): verified links that connect what the index can reach; nodes are longs.

    Buckets of one row go at the count. Rows of a bucket of more than CHUNK rows are indexed
    by one byte more; what is still larger is dealt into chunks by hash, and every two
    chunks meet in a block of their own, so a task never holds a whole hot bucket.
    """
    index = _index(distinct, sets)
    counts = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = index.join(counts, "key")
    if len(sets[0]) < least:
        rows = cut(rows)
        deeper = _index_deeper(rows.where(F.col("n") > CHUNK), sets, least)
        again = deeper.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows = rows.where(F.col("n") <= CHUNK).unionByName(deeper.join(again, "key"))
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = rows.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("fp"), "chunks")).otherwise(0).cast("int"))
    # a chunk meets itself (no partner) and every other chunk (the pair of numbers)
    partner = F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.select("key", "fp", "node", "chunk", F.explode(partner).alias("other"))
    rows = rows.select("key", "fp", "node", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    linker = _Linker(sets, radius, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            if not t.num_rows:
                return pa.RecordBatch.from_pydict({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
            key = t.column("key").combine_chunks()
            ids = key.dictionary_encode()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            codes = ids.indices.to_numpy().astype(np.int64)
            a, b, chunk = (t.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "chunk"))
            number = np.array([(x[0] << 8) | x[1] for x in ids.dictionary.to_pylist()])[codes]
            change = np.r_[0, np.cumsum((codes[1:] != codes[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            u, v = linker.block(number, t.column("node").to_numpy(), fp, change, a != b, chunk)
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            if t.num_rows < 20_000:
                continue
            last = [t.column(c)[-1].as_py() for c in ("key", "a", "b")]
            n = t.num_rows  # the last block may go on in the next batch
            lo, hi = 0, n
            while lo < hi:
                mid = (lo + hi) // 2
                if [t.column(c)[mid].as_py() for c in ("key", "a", "b")] < last:
                    lo = mid + 1
                else:
                    hi = mid
            yield done(t.slice(0, lo))
            held = t.slice(lo).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): exact for every two fingerprints within radius <= 4.

    At most 4 differing bits leave at least 4 of the 8 bytes alike, which holds one of the
    covering triples. Rows with equal fingerprints are one node, so copies cost one row
    each. Null and wordless texts have fingerprint zero and are linked like any other.
    A null doc_id is kept and never becomes a component_id unless nothing else is there;
    repeated rows come out as often as they came in; other columns are not read.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the byte-position triples guarantee radius 0 to 4")
    rows = cut(fingerprints(docs, words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = nodes.withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long"))
    found = connected_components(links(nodes, covering_triples(), radius, 4))
    grouped = nodes.join(found, "node")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_hot(rows, named, "fp", "doc_id").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- whole-document similarity
#: Texts from which common shingles are counted, and how many of these are told to every task.
SAMPLE, COMMON = 20_000, 200_000
#: Shingles of a chunk of a group; two chunks are compared within one block.
VOLUME = 500_000


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    digests = b"".join([xxhash.xxh64_digest(s, 42) for s in set(_shingles(text, words))])
    return np.unique(np.frombuffer(digests, ">i8").astype(np.int64))


def _node(found: np.ndarray) -> int | None:
    """A number for a set of shingles; null for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else None


def _prefix(n: int, p: int, q: int) -> int:
    """So many shingles of a set of n can't all be missing from a set of similarity p / q."""
    return n - -(-n * p // q) + 1


def similar_sets(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sets whose Jaccard similarity is p / q or more.

    Breadth-first search; an inverted index counts what one set shares with all that are
    not reached yet, and is built anew when half of them are gone.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    at = np.r_[0, np.cumsum(size)]
    owner, kinds = np.repeat(np.arange(m), size), int(token.max(initial=-1)) + 1

    def index(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.flatnonzero(alive[owner])
        order = held[np.argsort(token[held], kind="stable")]
        return owner[order], np.searchsorted(token[order], np.arange(kinds + 1))

    alive, pairs = np.ones(m, bool), []
    left = indexed = m
    rows, start = index(alive)
    for first in range(m):
        if not alive[first]:
            continue
        alive[first], queue, left = False, [first], left - 1
        while queue:
            if not left:
                return pairs
            if 2 * left < indexed:
                indexed, (rows, start) = left, index(alive)
            x = queue.pop()
            t = token[at[x] : at[x + 1]]
            n = start[t + 1] - start[t]
            spots = np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(rows[spots], minlength=m)
            near = np.flatnonzero(alive & (common * (p + q) >= p * (size[x] + size)))
            alive[near], left = False, left - len(near)
            pairs.extend((x, int(y)) for y in near)
            queue.extend(int(y) for y in near)
    return pairs


def _common(texts: DataFrame, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles met more than once in a sample of texts, ascending, and how often."""
    share = min(1.0, SAMPLE / max(total, 1))
    sample = texts.where(F.pmod(F.xxhash64(F.col("text_hash")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            for t in raw(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words))], ["h"])

    counts = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle, at its hash modulo a power of two that is twice the set's size or more, 64 at least."""
    size = 1 << max(6, int(2 * len(found) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[found & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _half(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the length, as their sets would have them."""
    middle = bits.shape[1] // 2
    return bits[:, :middle] | bits[:, middle:]


def possible_links(sizes: np.ndarray, maps: list[np.ndarray], p: int, q: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sets that may have a Jaccard similarity of p / q or more, by their bitmaps.

    A bit that one set has and the other hasn't is a shingle that isn't shared, so what is shared is
    bounded from above and no similar pair is missed. Of sets that differ so little in size the
    bitmaps' lengths differ by a factor of two at most; the longer one is folded. Sets of one group
    are linked already: they are reached together, without a pair.
    """
    width = np.array([len(x) for x in maps])
    held = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    place = np.empty(len(maps), np.int64)
    for at in held.values():
        place[at] = np.arange(len(at))
    full = {w: np.stack([maps[i] for i in at]) for w, at in held.items()}
    folded = {w: _half(x) for w, x in full.items() if w > 1}
    mates: dict[int, list[int]] = {}
    for i, g in enumerate(groups or ()):
        mates.setdefault(g, []).append(i)
    alive, pairs = np.ones(len(maps), bool), []
    for first in range(len(maps)):
        if not alive[first]:
            continue
        alive[first], queue = False, [first]
        while queue:
            x = queue.pop()
            for y in mates.pop(groups[x], ()) if groups else ():
                if alive[y]:
                    alive[y] = False
                    queue.append(y)
            w = width[x]
            for other in (w // 2, w, 2 * w):
                if other not in held or not len(rest := held[other][alive[held[other]]]):
                    continue
                own = full[w][place[x]] if other >= w else folded[w][place[x]]
                theirs = (folded if other > w else full)[other][place[rest]]
                own_only, their_only = np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64)
                shared = np.minimum(sizes[x] - own_only, sizes[rest] - their_only)
                near = rest[shared * (p + q) >= p * (sizes[x] + sizes[rest])]
                alive[near] = False
                pairs.extend((x, int(y)) for y in near)
                queue.extend(int(y) for y in near)
    return pairs


def _possible(texts: DataFrame, nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, p: int, q: int) -> DataFrame:
    """(u, v): links that connect every two sets which can be similar, and few others.

    Similar sets share one of their rarest shingles (prefix filter, exact under any fixed
    order). Under each shingle the sets are compared by the bitmaps of nodes (node, n, bits, near), those of
    a very common shingle in chunks, every two of which meet in a block of their own. Sets with the same
    `near` are linked already and aren't compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, counts = common
        seen: set[int] = set()
        for b in slices(batches):
            keys, owners = [], []
            for t in raw(b.column(0)):
                found = shingle_set(t, words)
                node = _node(found)
                if node is None or node in seen:
                    continue
                seen.add(node)
                often = np.zeros(len(found), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[place] == found, counts[place], 0)
                rare = found[np.lexsort((found, often))[: _prefix(len(found), p, q)]]
                keys.append(rare)
                owners.append(np.full(len(rare), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners)], ["key", "node"])

    index = texts.select("text").mapInArrow(run, "key long, node long")
    several = index.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1").select("key", "node").distinct()
    sizes = several.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("m")).where("m > 1")
    dealt = several.join(sizes.select("key", "chunks"), "key").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.select("key", "node", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "chunks").where("chunk <> other or chunks = 1")
    dealt = dealt.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node")
    rows = dealt.join(nodes.select("node", "n", "bits", "near"), "node").select("key", "a", "b", "node", "n", "bits", "near")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, maps, near, u, v = None, [], [], [], [], [], []

        def done() -> None:
            for x, y in possible_links(np.array(sizes), maps, p, q, near) if len(ids) > 1 else ():
                u.append(ids[x])
                v.append(ids[y])

        forget()
        for batch in slices(batches):
            for key, i, j, node, n, bits, group in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != block:
                    done()
                    block, ids, sizes, maps, near = (key, i, j), [], [], [], []
                ids.append(node)
                near.append(group)
                sizes.append(n)
                maps.append(np.frombuffer(bits, np.uint64))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            u, v = [], []
        done()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.mapInArrow(compared, "u long, v long")


def _similar(texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(u, v): exact links of the texts (node, root, text, chunks) within a root."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            found = [shingle_set(t, words).tobytes() for t in raw(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], ["node", "root", "chunks", "found"])

    rows = texts.select("node", "root", "chunks", "text").mapInArrow(sets, "node long, root long, chunks int, found binary")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    rows = rows.select("node", "root", "found", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = rows.where("chunk <> other or chunk = 0").select("root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node", "found")
    rows = rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, held, u, v = None, [], [], [], []

        def done() -> None:
            for x, y in similar_sets(held, p, q) if len(held) > 1 else ():
                u.append(nodes[x])
                v.append(nodes[y])

        forget()
        for b in slices(batches):
            for root, i, j, node, found in zip(*(c.to_pylist() for c in b.columns)):
                if (root, i, j) != block:
                    done()
                    block, nodes, held = (root, i, j), [], []
                nodes.append(node)
                held.append(np.frombuffer(found, np.int64))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            u, v = [], []
        done()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.mapInArrow(run, "u long, v long")


def set_fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of shingles: a bit is set if it is set in over half of the hashes."""
    return np.packbits(2 * _bits(found.astype(">i8").view(np.uint8).reshape(-1, 8)) > len(found)).tobytes()


def near_fingerprints(sets: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): links that connect all sets (node, fp) whose fingerprints differ in up to `radius` <= 4 bits, by the
    byte-position index with its count filter."""
    prints = cut(sets.groupBy("fp").agg(F.min("node").alias("least")))
    equal = sets.join(prints, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return equal.unionByName(links(prints.select("fp", F.col("least").alias("node")), covering_triples(), radius, 4))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component_id, component_text): groups by exact shingle similarity.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is
    0.8 or more; a group is what links connect. SimHash fingerprints of the sets, the byte-position
    index and the count filter find those within 4 bits. A pair at 0.8 is often farther apart, so
    for the rest there is an exact way: a prefix filter and a bound from bitmaps link what
    fingerprints haven't. Both give loose groups that hold every such pair, and within a loose group the sets themselves are
    compared, so nothing is missed or linked beyond the similarity but for collisions of
    64-bit hashes. The order of shingles by their counts in a sample decides how many sets
    are compared by their bitmaps, not what is linked. (component_id, component_text) names the least row of a group that
    has an id. Null and wordless texts form no group: each stays alone.
    """
    exact = Fraction(similarity).limit_denominator(1000)
    p, q = exact.numerator, exact.denominator
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            found = [shingle_set(t, words) for t in raw(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_node(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int32()), pa.array([bitmap(f) if len(f) else None for f in found], pa.binary()), pa.array([set_fingerprint(f) if len(f) else None for f in found], pa.binary())], ["doc_id", "text_hash", "node", "n", "bits", "fp"])

    rows = cut(texts.select("doc_id", "text_hash", "text").mapInArrow(numbered, "doc_id long, text_hash long, node long, n int, bits binary, fp binary"))
    sets = rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
    near = cut(connected_components(near_fingerprints(sets.select("node", "fp"))))
    sets = sets.join(near.withColumnRenamed("root", "near"), "node", "left").withColumn("near", F.coalesce("near", "node"))
    total, rows = rows.count(), rows.drop("bits", "fp")
    possible = _possible(texts, sets, _common(texts, total, words), words, p, q)
    loose = connected_components(possible.unionByName(near.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    # one text for each set that may be similar to another one
    met = rows.join(loose, "node").groupBy("node", "root").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"), F.first("n").alias("n"))
    volume = met.groupBy("root").agg(F.ceil(F.sum("n") / VOLUME).cast("int").alias("chunks"))
    met = cut(met.join(volume, "root").select("node", "root", "chunks", "row.text_hash", F.col("row.doc_id").alias("id")))
    read = texts.join(met, (texts["text_hash"] == met["text_hash"]) & texts["doc_id"].eqNullSafe(met["id"]))
    found = connected_components(_similar(read.select("node", "root", "chunks", "text"), words, p, q))
    named = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("component_id"), F.col("text_hash").alias("component_text")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(named).alias("own"))
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.join(nodes.groupBy("root").agg(F.min("own").alias("least")), "root").select("node", "least")
    alone = F.when(F.col("node").isNull(), named)
    return join_hot(rows, least, "node", "doc_id", "left").withColumn("least", F.coalesce("least", alone)).select("doc_id", "text_hash", "least.component_id", "least.component_text")
