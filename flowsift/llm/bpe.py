"""BPE encoding and decoding with a merge queue over a linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

#: Pieces remembered by a Python worker; older ones are forgotten by halves.
REMEMBERED = 200_000


# Code points that Unicode 16 and 17 assigned; Python's tables may be older.
#: Ranges of letters and of numbers.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: First and last upper-case letter, and the lower-case letter of the first.
LATER_LOWER = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_later_lower = {c: low + c - a for a, z, low in LATER_LOWER for c in range(a, z + 1)}
_later_upper = re.compile("[" + "".join(map(chr, _later_lower)) + "]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return [shown[b] for b in range(256)]


def _class(category: str, below: int) -> str:
    """A character class body with the code points under `below` of a major Unicode category."""
    runs, begin = [], None
    for c in range(below + 1):
        if c < below and unicodedata.category(chr(c))[0] == category:
            begin = c if begin is None else begin
        elif begin is not None:
            runs.append((begin, c - 1))
            begin = None
    runs += [(a, z) for a, z in {"L": LATER_LETTERS, "N": LATER_NUMBERS}[category] if z < below]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _splitter(below: int):
    """Pieces of a text whose code points are all under `below`; small classes match faster."""
    letter, number = _class("L", below), _class("N", below)
    # white space as the file's regular expressions see it
    space = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"[{letter}]+|[{number}]|'(?:[stmd]|re|ve|ll)|[^{space}{letter}{number}]+").findall


class Bpe:
    """Vocabulary and merge ranks of a tokenizer file (BPE, byte level, word-end suffix).

    encode() gives what the file's rules give without special tokens added: special
    strings found in the text are single tokens, the rest is normalised, split into
    pieces, mapped to byte symbols and merged.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **special}.items()}
        self.special = special
        self.find_special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.beyond = {n: re.compile(f"[\\U{n:08x}-\\U0010ffff]").search for n in (0x250, 0x10000)}
        self.splitters = {n: _splitter(n) for n in (0x250, 0x10000)}
        self.symbol = byte_symbols()
        self.fresh: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked pair is merged first, the leftmost of equals."""
        sym: list[str | None] = [self.symbol[b] for b in piece.encode("utf-8")]
        sym[-1] += self.suffix
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:  # stale: one side was merged meanwhile
                continue
            sym[i], sym[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((sym[x], sym[y]))) is not None:
                    heapq.heappush(queue, (r, x, sym[x], sym[y]))
        return [self.vocab[s] for s in sym if s is not None]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        got = self.fresh.get(piece)
        if got is None:
            got = self.old.get(piece) or tuple(self.merge(piece))
            if len(piece) <= 64:
                if len(self.fresh) >= REMEMBERED // 2:
                    self.old, self.fresh = self.fresh, {}
                self.fresh[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        text, at = text or "", 0
        for m in self.find_special.finditer(text) if self.find_special else ():
            self._plain(text[at : m.start()], ids)
            ids.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:], ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case by the character, without the final form
            if _later_upper(text):
                text = text.translate(_later_lower)
        text, known = text.lower(), self.fresh.get
        size = next((n for n, search in self.beyond.items() if not search(text)), sys.maxunicode + 1)
        if size not in self.splitters:
            self.splitters[size] = _splitter(size)
        for piece in self.splitters[size](text):
            ids += known(piece) or self.piece_ids(piece)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space; the file names no decoder that would do more."""
        return " ".join(map(self.strings.__getitem__, ids))


def load(path: str) -> Bpe:
    """A Python worker's tokenizer, kept until the worker needs another one or another operator's model."""
    return resident((Bpe, path), lambda: Bpe(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of every whole text.

    Null and empty texts have no tokens; repeated rows come out as often as they came
    in; a null doc_id stays; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
                out = [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with its outputs hashed in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            n, one, two = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                one.append(sha(" ".join(map(str, ids))))
                two.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
