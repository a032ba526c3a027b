"""Exact Jaccard join of documents by their sets of word n-grams.

Two sets can be similar only if their sizes are near, so sets are laid in bands of size in which
one band and the next hold every similar pair, and only if they share one of their rarest
n-grams (prefix filter). A tile holds what one n-gram has in one band, or in two neighbouring
ones, in parts of bounded size. In a tile hashed bitmaps are compared: bits that one has and
the other hasn't are n-grams that aren't shared, so their counts bound the overlap from
above. What passes are loose groups that hold every similar pair; within these the sorted
arrays of hashes themselves are intersected, again in tiles of bands, and links are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, raw
from .components import connected_components
from .simhash import _common, _node, _prefix, bitmap, possible_links, shingle_set

#: Sets under an n-gram whose pairs are named at once; sets of a part of a tile, and hashes of a part where sets are intersected.
FEW, PART, VOLUME = 8, 2048, 500_000
#: Bits of the signatures by which sets of one tile are compared before they are intersected.
BITS = 2048


def band(n: Column, p: int, q: int) -> Column:
    """Sets of similarity p / q or more are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(q / p)) + 1e-9).cast("int")


def tiles(rows: DataFrame, key: str, volume: Column, most: int) -> DataFrame:
    """rows (key, band, node, ...) dealt into tiles (key, lo, hi, i, j) in which every two rows of one key and the same or
    neighbouring bands meet; a tile's two parts have about `most` of the volume each.

    Rows of a band are dealt into parts by their hash. A band's parts meet each other and those of
    the next band, so a row is copied as often as there are parts near it.
    """
    parts = cut(rows.groupBy(key, "band").agg(F.ceil(F.sum(volume) / most).cast("int").alias("parts"), F.count("*").alias("held")))
    lo, hi = parts.select(key, F.col("band").alias("lo"), F.col("parts").alias("lo_parts")), parts.select(key, F.col("band").alias("hi"), F.col("parts").alias("hi_parts"))
    met = lo.join(hi.withColumn("lo", F.col("hi") - 1), [key, "lo"])
    own = parts.where("held > 1").select(key, "band", F.col("band").alias("hi"), "parts", F.col("parts").alias("others"), F.lit(0).alias("side"))
    below = met.select(key, F.col("lo").alias("band"), "hi", F.col("lo_parts").alias("parts"), F.col("hi_parts").alias("others"), F.lit(1).alias("side"))
    above = met.select(key, F.col("hi").alias("band"), "hi", F.col("hi_parts").alias("parts"), F.col("lo_parts").alias("others"), F.lit(2).alias("side"))
    dealt = rows.join(own.unionByName(below).unionByName(above), [key, "band"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.where("side > 0 OR part <> other OR parts = 1")  # the rows of one part meet wherever it meets another one
    side = F.col("side")
    i = F.when(side == 0, F.least("part", "other")).when(side == 1, F.col("part")).otherwise(F.col("other"))
    j = F.when(side == 0, F.greatest("part", "other")).when(side == 1, F.col("other")).otherwise(F.col("part"))
    lo_ = F.when(side == 0, F.col("band")).otherwise(F.col("hi") - 1)
    kept = [c for c in rows.columns if c != "band"]
    return dealt.select(*kept, lo_.alias("lo"), "hi", i.alias("i"), j.alias("j"))


def _blocks(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str], link) -> Iterator[pa.RecordBatch]:
    """link(lists of the columns) for all rows of each key; rows come sorted by it. Gives pairs of the first column's values."""
    block, held, u, v = None, [[] for _ in columns], [], []

    def done() -> None:
        for x, y in link(*held) if len(held[0]) > 1 else ():
            u.append(held[0][x])
            v.append(held[0][y])

    for b in batches:
        for row in zip(zip(*(b.column(c).to_pylist() for c in key)), *(b.column(c).to_pylist() for c in columns)):
            if row[0] != block:
                done()
                block, held = row[0], [[] for _ in columns]
            for values, value in zip(held, row[1:]):
                values.append(value)
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
        u, v = [], []
    done()
    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def intersecting(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sorted arrays with a Jaccard similarity of p / q or more.

    From each set reached the ones not reached yet are bounded by size and by signatures of BITS
    bits; arrays that may be similar are intersected.
    """
    size = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), BITS), np.uint8)
    for row, s in zip(bits, sets):
        row[s & (BITS - 1)] = 1
    bits = np.packbits(bits, axis=1).view(np.uint64)
    rest, pairs = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            own, theirs = bits[x], bits[rest]
            most = np.minimum(size[x] - np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), size[rest] - np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64))
            may = np.flatnonzero(most * (p + q) >= p * (size[x] + size[rest]))
            near = [at for at in may if len(np.intersect1d(sets[x], sets[rest[at]], assume_unique=True)) * (p + q) >= p * (size[x] + size[rest[at]])]
            pairs.extend((int(x), int(y)) for y in rest[near])
            queue.extend(rest[near])
            rest = np.delete(rest, near)
    return pairs


def _possible(nodes: DataFrame, p: int, q: int) -> DataFrame:
    """(u, v): links that connect every two sets of nodes (node, n, bits, keys) which can be similar, and few others."""
    index = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = cut(index.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("u"), F.max("node").alias("v")).where("m > 1"))
    twos = shared.where("m = 2").select("u", "v").distinct()
    more = cut(index.join(shared.where("m > 2").select("key", "m"), "key"))
    # all pairs of the few sets under an n-gram; each pair is looked at once, however many n-grams it shares
    few = more.where(F.col("m") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("s"))
    few = few.select(F.posexplode("s").alias("at", "x"), "s").select("x", F.explode(F.slice("s", F.col("at") + 2, FEW)).alias("y"))
    fits = F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p
    pairs = twos.unionByName(few.where(fits).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") * q >= F.greatest("n_u", "n_v") * p)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, n, m, x, y = (c.to_pylist() for c in b.columns)
            keep = [bool(possible_links(np.array(sizes), [np.frombuffer(s, np.uint64) for s in maps], p, q)) for sizes, maps in zip(zip(n, m), zip(x, y))]
            yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, k in zip(u, keep) if k], pa.int64()), "v": pa.array([a for a, k in zip(v, keep) if k], pa.int64())})

    one = both.select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(bounded, "u long, v long")
    many = tiles(more.where(F.col("m") > FEW).select("key", "node", band(F.col("n"), p, q).alias("band")), "key", F.lit(1), PART)
    rows = many.join(nodes.select("node", "n", "bits"), "node").repartition("key", "lo", "hi", "i", "j").sortWithinPartitions("key", "lo", "hi", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = lambda _, n, bits: possible_links(np.array(n), [np.frombuffer(x, np.uint64) for x in bits], p, q)
        return _blocks(batches, ["key", "lo", "hi", "i", "j"], ["node", "n", "bits"], link)

    return one.unionByName(rows.mapInArrow(compared, "u long, v long"))


def similarity_join(docs: DataFrame, words: int = 4, similarity: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id): groups of documents whose sets of `words`-word shingles have this Jaccard similarity or more.

    Words are parted by ASCII white space, A-Z are lower-cased; fewer words make one shingle. Null
    and wordless texts have an empty set and are linked with nothing: each is its own
    component. component_id is the smallest doc_id that links reach; a null id stays and
    names a component only where no other id is there. Rows with equal sets are one node,
    so repeated rows cost one row each and come out as often as they came in; other columns
    are not read. Exact but for collisions of 64-bit hashes, by one method at every size:
    the sampled order of n-grams decides what is compared, not what is linked.
    """
    exact = Fraction(similarity).limit_denominator(1000)
    p, q = exact.numerator, exact.denominator
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    common = _common(texts, texts.count(), words)
    told = docs.sparkSession.sparkContext.broadcast(common)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = told.value
        for b in batches:
            node, size, bits, keys = [], [], [], []
            for t in raw(b.column(2)):
                found = shingle_set(t, words)
                often = np.zeros(len(found), np.int64)
                if len(known) and len(found):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[place] == found, counts[place], 0)
                node.append(_node(found))
                size.append(len(found))
                bits.append(bitmap(found) if len(found) else None)
                keys.append(found[np.lexsort((found, often))[: _prefix(len(found), p, q)]] if len(found) else None)
            out = [b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "node", "n", "bits", "keys"])

    rows = cut(texts.select("doc_id", "text_hash", "text").mapInArrow(numbered, "doc_id long, text_hash long, node long, n long, bits binary, keys array<long>"))
    met = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "doc_id")).alias("row"), *[F.first(c).alias(c) for c in ("n", "bits", "keys")])
    nodes = cut(met)
    loose = connected_components(_possible(nodes, p, q))
    # one text for each set that may be similar to another one
    asked = nodes.join(loose, "node").select("node", "root", band(F.col("n"), p, q).alias("band"), "n", "row.text_hash", F.col("row.doc_id").alias("id"))
    dealt = cut(tiles(asked, "root", F.col("n"), VOLUME))
    wanted = dealt.select("node", "text_hash", "id").distinct()
    read = texts.join(wanted, (texts["text_hash"] == wanted["text_hash"]) & texts["doc_id"].eqNullSafe(wanted["id"]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in raw(b.column(1))], pa.binary())], ["node", "found"])

    found = read.select("node", "text").mapInArrow(hashed, "node long, found binary").dropDuplicates(["node"])  # repeated rows
    sets = dealt.select("root", "lo", "hi", "i", "j", "node").join(found, "node")
    sets = sets.repartition("root", "lo", "hi", "i", "j").sortWithinPartitions("root", "lo", "hi", "i", "j")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, ["root", "lo", "hi", "i", "j"], ["node", "found"], lambda _, found: intersecting([np.frombuffer(x, np.int64) for x in found], p, q))

    links = connected_components(sets.mapInArrow(exactly, "u long, v long"))
    named = nodes.select("node", "least").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_hot(named, least, "root", "node").select("node", "component_id")
    out = join_hot(rows.select("doc_id", "node", "n"), named, "node", "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
