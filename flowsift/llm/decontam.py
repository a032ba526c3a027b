"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window that is similar to an item shares most of the item's shingles, so windows of the
item's size are placed only where a document holds shingles of an item, enough of them for
the similarity asked (a sound filter). What is a candidate is then decided by fingerprints:
the blocks of the multi-index hold every pair within RADIUS bits, and pairs within it are
verified by exact weighted shingle similarity. Windows with the same words are one row
until the end, however many documents hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a shingle, least similarity, and differing fingerprint bits that are let through.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 19
#: Blocks of 16 bits; a pair within RADIUS agrees in one but for RADIUS // BLOCKS bits, of which so many are flipped on the window's side.
BLOCKS, FLIPPED = 4, 1
#: Most shingle hashes that are broadcast (some 100 MB).
BROADCAST = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null and wordless texts."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def shingles_of(words: Column, size: Column | int) -> Column:
    """All shingles of `size` words, repeats included."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def _hash(words: Column, at: Column | int = 0, size: int = WORDS) -> Column:
    """64-bit hash of up to five words; missing ones don't count, so a short shingle has one too."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def fingerprint(shingles: Column) -> Column:
    """A bit is set if it is set in over half of the shingles' 64-bit hashes."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _counted(shingles: Column) -> Column:
    return F.transform(F.array_distinct(shingles), lambda s: F.struct(s.alias("s"), F.size(F.filter(shingles, lambda x: x == s)).alias("n")))


def similarity(window: Column, item: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles; a shingle weighs its occurrences."""
    common = F.aggregate(_counted(item), F.lit(0), lambda a, c: a + F.least(c["n"], F.size(F.filter(window, lambda x: x == c["s"]))))
    return common / (F.size(window) + F.size(item) - common)


def _block(fp: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, b * 16).bitwiseAND(F.lit(65535).cast("long")).cast("int")


def _neighbours(fp: Column, bits: int) -> Column:
    """(block, value): each block's value and all that differ from it in so many bits or fewer."""
    masks = F.array(*[F.lit(m) for m in range(1 << 16) if m.bit_count() <= bits])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.transform(masks, lambda m: F.struct(b.alias("block"), _block(fp, b).bitwiseXOR(m).alias("value")))))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, size, item_shingles, item_fp): words, shingle size (fewer than five words: all of them)."""
    items = benchmark.select(F.col("item_id").cast("long"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.size("w")).withColumn("size", F.least(F.lit(WORDS), F.size("w")))
    items = items.withColumn("item_shingles", shingles_of(F.col("w"), F.col("size"))).drop("w")
    return items.withColumn("item_fp", fingerprint(F.col("item_shingles"))).dropDuplicates(["item_id", "item_shingles"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity): documents with a window similar to an item, at its best.

    A window has as many words as the item, is placed by a shared shingle and cut at the
    document's ends. Null and wordless texts and items, and null ids, take no part; rows
    with one doc_id are told apart and reported once. Items shorter than a shingle are
    compared as one shingle of all their words. The benchmark's shingle hashes are
    broadcast up to BROADCAST of them; a larger benchmark is joined by shuffle.
    """
    items = benchmark_items(benchmark)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    known = items.select("item_id", "n", "size", F.size("item_shingles").alias("total"), F.posexplode("item_shingles").alias("offset", "shingle"))
    known = known.withColumn("h", _hash(F.split("shingle", " "))).drop("shingle")
    keys = known.select("h").distinct()
    if keys.count() <= BROADCAST:
        keys = F.broadcast(keys)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("row", F.xxhash64("text")).withColumn("w", words_of(F.col("text"))).drop("text")

    at = rows.where(F.size("w") >= min(sizes or [WORDS])).select("doc_id", "row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - min(sizes or [WORDS]))).alias("pos"))
    shingle = lambda n: F.struct(F.lit(n).alias("size"), F.when(F.col("pos") + n <= F.size("w"), _hash(F.col("w"), F.col("pos"), n)).alias("h"))
    hits = at.select("doc_id", "row", "pos", F.inline(F.array(*[shingle(n) for n in sizes or [WORDS]]))).join(keys, "h", "left_semi")

    # count filter: a window as similar as that holds so many of the item's shingles
    placed = hits.join(known, ["h", "size"])
    enough = placed.select("doc_id", "row", "item_id", "total", "pos").distinct().groupBy("doc_id", "row", "item_id", "total").agg(F.count("*").alias("c")).where(F.col("c") >= F.lit(least) * F.col("total"))
    spots = placed.join(enough.select("doc_id", "row", "item_id"), ["doc_id", "row", "item_id"])
    spots = spots.select("doc_id", "row", "n", "size", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    spots = spots.groupBy("doc_id", "row").agg(F.collect_list(F.struct("n", "size", "start")).alias("spots"))

    # an item has thousands of neighbours, which are shuffled and never gathered on the driver;
    # windows with the same words are fingerprinted and verified once
    placed = rows.join(spots, ["doc_id", "row"]).select("doc_id", "w", F.explode("spots").alias("s"))
    begin = F.greatest(F.col("s.start"), F.lit(0))
    length = F.least(F.col("s.start") + F.col("s.n"), F.size("w")) - begin
    placed = placed.where(length >= F.col("s.size")).select("doc_id", "s.n", "s.size", F.slice("w", begin + 1, length).alias("words"))
    placed = cut(placed.withColumn("window", F.xxhash64("n", F.array_join("words", " "))).select("doc_id", "window", "n", "size", "words"))
    windows = placed.groupBy("window", "n", "size").agg(F.first("words").alias("words")).withColumn("shingles", shingles_of(F.col("words"), F.col("size"))).drop("words")
    windows = windows.withColumn("fp", fingerprint(F.col("shingles")))

    probes = windows.select("window", "n", "size", "fp", F.inline(_neighbours(F.col("fp"), FLIPPED)))
    index = items.select("item_id", "n", "size", "item_fp", F.inline(_neighbours(F.col("item_fp"), RADIUS // BLOCKS - FLIPPED)))
    pairs = probes.join(index.hint("merge"), ["n", "size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = pairs.select("window", "n", "size", "item_id").distinct()
    both = pairs.join(windows.select("window", "n", "size", "shingles"), ["window", "n", "size"]).join(items.select("item_id", "n", "size", "item_shingles"), ["item_id", "n", "size"])
    verified = both.select("window", "n", "size", "item_id", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")).where(F.col("similarity") >= least)
    found = verified.groupBy("window", "n", "size", "item_id").agg(F.max("similarity").alias("similarity"))
    found = placed.select("doc_id", "window", "n", "size").distinct().join(found, ["window", "n", "size"])
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))
