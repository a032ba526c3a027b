"""Alignment of two tokenizations of the same texts by the byte offsets where tokens of both end.

A text's tokens are dealt into byte ranges. A range yields a fragment: an open prefix (the
tokens up to its first common end), closed groups, and an open suffix (the tokens behind its
last common end); a range without a common end is all prefix. Fragments compose: the
suffix of one and the prefix of the next make one more group. Composition is associative,
so the fragments of a very long text are composed by a tree of shuffles, some of one text
in each task, whatever the length of the text.

Linked id pairs are counted over the corpus: each range has its distinct pairs with their
numbers, which are summed before and after one shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import cut, join_hot, shared_folder

#: Bytes of a range, fragments that a task composes, pairs of ids whose counts are told to every task (17 bytes each).
RANGE, TOGETHER, TOLD = 1 << 16, 16, 2_000_000

# Fixed value: how byte-level BPE splits a text before it merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE tokenizer file; special tokens' strings in a text are plain text.

    Where ids follow the merges, as in files that were made from ranks, the ranks say all and tiktoken
    encodes; else the tokenizers library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: n for n, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(map(byte.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for b, i in vocab.items():
            self.bytes[i] = b
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" ")).translate({ord(c): n for c, n in byte.items()}).encode("latin-1")] for m in spec["model"]["merges"]]
        if merged == sorted(merged):
            import tiktoken

            self.encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        else:
            import tokenizers

            library = tokenizers.Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        text = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode("utf-8") for i, s in enumerate(text)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Two tokenizers; tokens, ends and fragments of a text."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.size = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.ids = max(map(len, self.size))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]  # an id and what follows it

    def tokens(self, text: str | None) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """Ids and byte ends of both; None for a text that either doesn't give back byte by byte."""
        if not text:
            return None
        whole = (" " + text).encode("utf-8")
        ids = [self.a.encode(" " + text), self.b.encode(text)]
        if any(b"".join(map(t.bytes.__getitem__, x)) != whole for t, x in zip((self.a, self.b), ids)):
            return None
        ids = [np.array(x, np.int64) for x in ids]
        return ids, [np.cumsum(size[x]) for size, x in zip(self.size, ids)]

    def groups(self, ids: list[np.ndarray], last: list[np.ndarray]) -> str:
        """`a1,a2|b1;a3|b2,b3` of tokens that end with a group; last: whether a token is the last of its group."""
        if not len(ids[0]):
            return ""
        before = [np.cumsum(x) - x for x in last]  # groups before a token's own
        until = [np.r_[0, np.flatnonzero(x) + 1] for x in last]  # tokens up to each group
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        out[np.arange(len(ids[0])) + until[1][before[0]]] = ids[0] + last[0] * self.ids
        out[np.arange(len(ids[1])) + until[0][before[1] + 1]] = ids[1] + last[1] * 2 * self.ids
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]

    def fragment(self, ids: list[np.ndarray], last: list[np.ndarray]) -> tuple:
        """(cut, prefix of A, of B, closed groups, suffix of A, of B) of a range's tokens, ids as text."""
        text = lambda x: ",".join(map(str, x.tolist()))
        if not last[0].any():
            return False, text(ids[0]), text(ids[1]), "", "", ""
        first, end = [int(x.argmax()) + 1 for x in last], [len(x) - int(x[::-1].argmax()) for x in last]
        closed = self.groups([x[i:j] for x, i, j in zip(ids, first, end)], [x[i:j] for x, i, j in zip(last, first, end)])
        return True, text(ids[0][: first[0]]), text(ids[1][: first[1]]), closed, text(ids[0][end[0] :]), text(ids[1][end[1] :])

    def ranges(self, text: str | None, size: int, keep: bool) -> Iterator[dict]:
        """A row for each byte range of a text that holds an end of a token, in order."""
        found = self.tokens(text)
        if found is None:
            yield {"chunk": 0, "chunks": 1, "n_a": 0, "n_b": 0, "n_groups": 0, "pairs": [], "times": [], "sha": "", "groups": "" if keep else None}
            return
        ids, ends = found
        common = np.zeros(ends[0][-1] + 1, bool)
        common[ends[0]] = True
        last = [common[ends[0]], common[ends[1]]]  # to be narrowed to ends that B has as well
        both = np.zeros(len(common), bool)
        both[ends[1][last[1]]] = True
        last[0] = both[ends[0]]
        number = [(x - 1) // size for x in ends]
        chunks = int(number[0][-1]) + 1
        for chunk in range(chunks):
            at = [slice(*np.searchsorted(x, [chunk, chunk + 1])) for x in number]
            i, e = [x[s] for x, s in zip(ids, at)], [x[s] for x, s in zip(last, at)]
            pairs, times = np.unique(i[0][e[0]] << 32 | i[1][e[1]], return_counts=True)
            row = {"chunk": chunk, "chunks": chunks, "n_a": len(i[0]), "n_b": len(i[1]), "n_groups": int(e[0].sum()), "pairs": pairs, "times": times}
            if chunks == 1:
                groups = self.groups(i, e)
                yield row | {"sha": hashlib.sha256(groups.encode()).hexdigest(), "groups": groups if keep else None}
            else:
                yield row | dict(zip(FRAGMENT, self.fragment(i, e)))


FRAGMENT = ("cut", "pre_a", "pre_b", "closed", "suf_a", "suf_b")
ROWS = "row long, doc_id long, chunk int, chunks int, n_a long, n_b long, n_groups long, pairs array<long>, times array<long>, sha string, groups string, cut boolean, pre_a string, pre_b string, closed string, suf_a string, suf_b string"
_aligners: dict[tuple[str, str], Aligner] = {}


def fragments(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE, keep: bool = False) -> DataFrame:
    """A row for each byte range of each text: counts, distinct linked pairs (A's id << 32 | B's id) with their numbers, and the
    range's fragment; a text of one range has its groups' digest at once, and with keep the groups."""
    kinds = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in ROWS.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        aligner = _aligners[a_path, b_path]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()], list(kinds))

        for b in batches:
            rows, volume = [], 0
            for row, doc_id, text in zip(*(b.column(c) for c in ("row", "doc_id", "text"))):
                for r in aligner.ranges(text.as_py(), size, keep):
                    rows.append(r | {"row": row.as_py(), "doc_id": doc_id.as_py()})
                    volume += 1000 + r["n_a"] + r["n_b"]
                    if volume > 1_000_000:
                        yield table(rows)
                        rows, volume = [], 0
            yield table(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return texts.mapInArrow(run, ROWS)


# ---------------------------------------------------------------- the monoid
def _beside(x: Column, y: Column) -> Column:
    return F.concat_ws(",", F.nullif(x, F.lit("")), F.nullif(y, F.lit("")))


def compose(f: Column, g: Column) -> Column:
    """The fragment of two neighbouring ranges from those of each; associative, and the empty fragment without a cut changes nothing."""
    middle = F.concat(_beside(f["suf_a"], g["pre_a"]), F.lit("|"), _beside(f["suf_b"], g["pre_b"]))
    closed = F.concat_ws(";", F.nullif(f["closed"], F.lit("")), middle, F.nullif(g["closed"], F.lit("")))
    own = {
        "cut": f["cut"] | g["cut"],
        **{p: F.when(f["cut"], f[p]).otherwise(_beside(f[p], g[p])) for p in ("pre_a", "pre_b")},
        "closed": F.when(~f["cut"], g["closed"]).when(~g["cut"], f["closed"]).otherwise(closed),
        **{s: F.when(f["cut"] & ~g["cut"], _beside(f[s], g[p])).otherwise(g[s]) for s, p in (("suf_a", "pre_a"), ("suf_b", "pre_b"))},
    }
    return F.struct(*[own[c].alias(c) for c in FRAGMENT])


def composed(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(row, groups) from fragments (row, chunk, the FRAGMENT columns): each round composes so many neighbours, until one is left for each row."""
    state = rows.select("row", "chunk", F.struct(*FRAGMENT).alias("f"))
    left = (rows.agg(F.max("chunk")).first()[0] or 0) + 1
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "f"))), lambda x: x["f"])
        state = state.groupBy("row", F.floor(F.col("chunk") / together).cast("int").alias("next")).agg(ordered.alias("all"))
        whole = F.aggregate(F.slice("all", 2, F.lit(together)), F.get("all", F.lit(0)), compose)
        state = state.select("row", F.col("next").alias("chunk"), whole.alias("f"))
        left = -(-left // together)
        if left == 1:
            break
    prefix = F.concat("f.pre_a", F.lit("|"), "f.pre_b")  # a whole text begins and ends with a group's end
    return state.select("row", F.concat_ws(";", prefix, F.nullif("f.closed", F.lit("")), F.when(F.col("f.suf_a") != "", F.concat("f.suf_a", F.lit("|"), "f.suf_b"))).alias("groups"))


# ---------------------------------------------------------------- counts of links
def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked id pairs: in how many links, and whether no pair with this id of B has more."""
    n = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    n = cut(n.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(rows: DataFrame, counts: DataFrame, told: int = TOLD) -> DataFrame:
    """The rows without pairs, with n_links, n_best and count_sum of each.

    Counts of id pairs grow with the two vocabularies at most. Up to `told` of them are held by every
    task; more are joined by shuffle, common pairs in shares.
    """
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    counts = cut(counts)
    if counts.count() <= told:
        t = counts.orderBy("pair").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast(tuple(t.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = shared.value
            for b in batches:
                pairs, times = (b.column(c) for c in ("pairs", "times"))
                size = np.diff(pairs.offsets.to_numpy())
                at, t = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy()
                owner = np.repeat(np.arange(len(size)), size)
                total = lambda v: pa.array(np.bincount(owner, weights=v, minlength=len(size)).astype(np.int64)) if len(v) else pa.array(np.zeros(len(size), np.int64))  # noqa: E731, B023
                sums = np.zeros(len(size), np.int64)
                np.add.at(sums, owner, t * n[at])  # beyond what floats hold
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), total(t), total(t * best[at]), pa.array(sums)], [*kept, "n_links", "n_best", "count_sum"])

        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
        return rows.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")
    each = rows.select("row", "chunk", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    met = join_hot(each, counts, "pair", "row")
    sums = met.groupBy("row", "chunk").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(*kept).join(sums, ["row", "chunk"], "left").select(*kept, zero("n_links"), zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE, keep: bool = False, told: int = TOLD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text, and with keep the groups.

    A is a byte-level BPE file, B a sentencepiece model. Texts that are null or empty, or that one of
    them doesn't give back byte by byte, have no tokens: zeros and an empty digest. n_best: links
    whose id pair has the highest count among those with its id of B; count_sum: the sum of
    the links' counts. Repeated rows come out and count as often as they came in, a null
    doc_id stays, other columns are not read; a row's result doesn't depend on the length of
    its text or the size of a range. Tokens are written once to the shared folder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "alignment")
    fragments(docs, a_path, b_path, size, keep).write.parquet(folder)
    rows = spark.read.schema(ROWS).parquet(folder)
    counted = linked(rows.select("row", "doc_id", "chunk", "chunks", "n_a", "n_b", "n_groups", "pairs", "times", "sha", "groups"), pair_counts(rows), told)
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    shown = ["doc_id", *sums, F.col("sha").alias("groups_sha256"), *(["groups"] if keep else [])]
    short = counted.where("chunks = 1").select(*shown)
    added = counted.where("chunks > 1").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums])
    groups = composed(rows.where("chunks > 1"))
    return short.unionByName(added.join(groups, "row").withColumn("sha", F.sha2("groups", 256)).select(*shown))
