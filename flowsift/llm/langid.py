"""Language identification, word first, with backoff to ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, resident

#: Rows learned from, about so many, shared evenly by the languages; longest n-gram; least count of a word or n-gram that is kept.
SAMPLE, LONGEST, SEEN = 8_000, 5, 3
#: Most languages whose shares of the sample are broadcast (some 10 MB); more of them are joined by shuffle.
LANGUAGES = 100_000
#: Rows of the table of words that a Python worker remembers.
REMEMBERED = 100_000
UNKNOWN = "und"

_latin = re.compile("[a-zªµºß-öø-ɏ]+").findall  # the lower-case letters and others under U+0250
_any = re.compile(r"[^\W\d_]+").findall
_beyond = re.compile("[\u0250-\U0010ffff]").search


def _words(low: str) -> list[str]:
    """Runs of letters of a lower-cased text."""
    return _any(low) if _beyond(low) else _latin(low)


def learning_rows(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, lang): about `rows` rows, an even share of each language if it has as many, those with the lowest hash of the id."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"))
    known = known.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = sizes.crossJoin(sizes.agg(F.count("*").alias("langs"))).select("lang", (F.lit(rows) / F.col("langs") / F.col("rows")).alias("share"))
    if sizes.count() <= LANGUAGES:
        share = F.broadcast(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return known.join(share, "lang").where(place < F.col("share")).select("doc_id", "lang").distinct()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind 0 word or n, lang, token, n) of the batch's texts."""
    forget()
    for b in batches:
        tally: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tally.setdefault(lang, Counter()).update(_words((text or "").lower()))
        out = []
        for lang, words in tally.items():
            out += [(0, lang, w, n) for w, n in words.items()]
            grams: Counter = Counter()
            for w, n in words.items():
                for g in _grams(w):
                    grams[g] += n
            out += [(len(g), lang, g, n) for g, n in grams.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["size", "lang", "token", "n"]), preserve_index=False)


def _grams(word: str, sizes=range(1, LONGEST + 1)) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language of words and of n-grams; scores words it never saw by backoff."""

    def __init__(self, langs: list[str], words: list[str], word_rows: np.ndarray, grams: list[str], gram_rows: np.ndarray):
        self.parts = (langs, words, word_rows, grams, gram_rows)  # flat, so that it travels in little memory
        self.langs, self.gram_rows, self.row = langs, gram_rows, None

    def _room(self) -> None:
        """The look-ups and room for words not met before; only where texts are scored, never on the driver."""
        if self.row is None:
            _, words, word_rows, grams, _ = self.parts
            self.row, self.gram = {w: i for i, w in enumerate(words)}, {g: i for i, g in enumerate(grams)}
            self.rows = np.zeros((len(words) + REMEMBERED, max(1, len(self.langs))), np.float32)
            self.rows[: len(words)] = word_rows

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the known n-grams of the greatest length at which any is known."""
        for n in range(LONGEST, 0, -1):
            found = [i for g in _grams(word, (n,)) if (i := self.gram.get(g)) is not None]
            if found:
                return self.gram_rows[found].sum(0) / len(found)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(_words((text or "").lower()))
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        self._room()
        found, times = list(map(self.row.get, words)), np.fromiter(words.values(), np.float64, len(words))
        total = np.zeros(len(self.langs))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    v = self.unseen(w)
                    if len(self.row) < len(self.rows) and len(w) <= 40:
                        found[i] = self.row[w] = len(self.row)
                        self.rows[found[i]] = v
                    else:
                        found[i], times[i], total = 0, 0.0, total + times[i] * v
        total += times @ self.rows[found]
        p = np.exp((total - total.max()) / np.sqrt(sum(words.values())))
        return self.langs[int(total.argmax())], float(p.max() / p.sum())


def _table(top: pd.DataFrame, totals: dict, langs: list[str], smooth: float) -> tuple[list[str], np.ndarray]:
    """Tokens and their smoothed log frequencies by language."""
    code, tokens = pd.factorize(top["token"])
    counts = np.zeros((len(tokens), max(1, len(langs))))
    counts[code, top["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(int)] = top["n"]
    size = np.array([totals.get(lang, 0) for lang in langs] or [0], float)
    return list(tokens), np.log((counts + smooth) / (size + smooth * (len(tokens) + 1))).astype(np.float32)


def fit(docs: DataFrame, rows: int = SAMPLE, seen: int = SEEN) -> Model:
    """Model of the words and n-grams met `seen` times or more in about `rows` documents.

    Rows without an id or a lang teach nothing; a null text has no words. A row that is there several
    times counts several times, and of rows with one id and different texts each teaches the
    langs of all. From an empty table comes a model without languages.
    """
    ids = learning_rows(docs, rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").select("lang", "text")
    counts = texts.mapInArrow(_count, "size long, lang string, token string, n long").groupBy("size", "lang", "token").agg(F.sum("n").alias("n")).persist()
    totals = {(r[0] > 0, r[1], r[0]): r[2] for r in counts.groupBy("size", "lang").agg(F.sum("n")).collect()}
    kept = counts.where(F.col("n") >= seen).orderBy("size", "token", "lang").toArrow().to_pandas()
    counts.unpersist()
    langs = sorted({lang for _, lang, _ in totals})
    known = _table(kept[kept["size"] == 0], {lang: totals.get((False, lang, 0), 0) for lang in langs}, langs, 0.1)
    parts = [_table(kept[kept["size"] == n], {lang: totals.get((True, lang, n), 0) for lang in langs}, langs, 0.1) for n in range(1, LONGEST + 1)]
    return Model(langs, *known, [g for p in parts for g in p[0]], np.concatenate([p[1] for p in parts]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    `und` with score 0 if the text is null or has no letter, or nothing was learned; else
    the language of the greatest sum of log frequencies, ties to the first by name. The
    score is its share of the posterior under equal priors, with the evidence of n words
    taken as that of the root of n, as words of a text aren't independent. Repeated rows stay.
    """
    own = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own()
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose text has a language with a score of `least` or more."""
    own = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own()
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _shared(docs: DataFrame, model: Model):
    shared, key = docs.sparkSession.sparkContext.broadcast(model.parts), uuid.uuid4().hex

    def own() -> Model:  # a worker keeps the words it has met from task to task
        return resident((Model, key), lambda: Model(*shared.value))

    return own


def identify(docs: DataFrame) -> DataFrame:
    """fit() on a bounded sample outside the held-out fold, predict() on all rows."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
