"""Personal data: expressions propose spans, checksums confirm them, context words weigh them.

DataFrame functions only. Where a kind needs characters that a text lacks, its expression
isn't run. Possessive repeats and look-behinds keep the expressions linear on long texts;
they match what the plain forms in the comments match.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with one start are listed; the last two are what the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed span, what a context word adds, and the least score of a span of an added kind.
SCORE, CONTEXT_SCORE, LEAST = {"email": 0.6, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}, 0.2, 0.6

EXPRESSIONS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+ where it has 12 to 19 digits: a whole run of digits and single separators
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # country, check digits, then 11 to 30 characters, single blanks between
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    # \b[0-9]{3}-[0-9]{2}-[0-9]{4}\b
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
#: Characters on either side in which a context word counts.
NEAR = 48


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(at, lambda c, i: value(F.coalesce(c.try_cast("int"), F.lit(0)), i)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (upper case, blanks allowed) leaves 1 modulo 97."""
    s = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: str, s: Column) -> Column:
    if kind in ("email", "ssn"):
        return F.lit(True)
    if kind == "ip":
        part = lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(s, r"\."), lambda p: part(F.ltrim(p, F.lit("0"))))
    if kind == "card":
        return luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return mod97(s)


def _possible(kind: str, text: Column) -> Column:
    """Cheap condition without which the kind's expression can't match."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{10}"), "phone": text.rlike(r"\+[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]")}[kind]


def _pieces(kind: str, text: Column) -> tuple[Column, Column]:
    """What lies between the matches (one more than these), and the matches."""
    e = EXPRESSIONS[kind]
    return F.split(text, e, -1), F.regexp_extract_all(text, F.lit(e), F.lit(0))


SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double>>"


def _let(value: Column, of) -> Column:
    """of(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _placed(gaps: Column, found: Column, block: int = 128) -> Column:
    """(start, match) of every match; blocks of matches keep the folds short on texts with very many."""
    length = lambda p: F.length(p["gap"]) + F.length(p["match"])
    empty = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("seen"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        return F.struct((start + F.length(p["match"])).alias("at"), F.when(p["match"] == "", a["seen"]).otherwise(F.array_append(a["seen"], F.struct(start.alias("start"), p["match"].alias("match")))).alias("seen"))

    def cut(both: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / block).cast("int")), lambda i: F.slice(both, i * block + 1, F.lit(block)))

    def begins(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, p: a + length(p)))
        return F.aggregate(sizes, empty(F.lit(0), "array<int>"), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["seen"], a["at"]).alias("seen")))["seen"]

    def each(blocks: Column) -> Column:
        return _let(begins(blocks), lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, empty(F.get(at, i), "array<struct<start:int,match:string>>"), step)["seen"])))

    both = F.arrays_zip(gaps.alias("gap"), F.concat(found, F.array(F.lit(""))).alias("match"))
    return _let(both, lambda v: _let(cut(v), each))


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind with their score; of added kinds only those that reach LEAST.

    A checksum makes the score of a kind higher, a context word of the kind within NEAR
    characters adds to it.
    """
    kept = F.filter(_placed(*_pieces(kind, text)), lambda m: valid(kind, m["match"]))

    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["match"])
        around = F.lower(F.concat_ws(" ", F.substring(text, F.greatest(m["start"] + 1 - NEAR, F.lit(1)), F.least(m["start"], F.lit(NEAR))), F.substring(text, end + 1, F.lit(NEAR))))
        named = functools.reduce(operator.or_, [F.contains(around, F.lit(w)) for w in CONTEXT[kind]])
        score = F.round(F.lit(SCORE[kind]) + F.when(named, CONTEXT_SCORE).otherwise(0.0), 1)
        return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    scored = F.transform(kept, span)
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST)
    return F.when(_possible(kind, text), scored).otherwise(F.array()).cast(SPAN)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): confirmed spans of every whole text by start, then kind as listed.

    Each kind is matched by itself, leftmost and not overlapping. Null reads as empty; rows
    are kept as often as they came in, null ids too; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_kind = rows.select("doc_id", *[_spans(k, F.col("text")).alias(f"of_{k}") for k in KINDS])
    return by_kind.select("doc_id", F.array_sort(F.concat(*[f"of_{k}" for k in KINDS])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) from detect(); scores
    are those of the spans in their order, comma-joined."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [_count(spans, k).cast("long").alias(f"n_{k}") for k in BASE]
    found = detect(docs)
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.concat_ws(",", F.transform(spans, lambda s: s["score"].cast("string"))).alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns with every span that detect() confirms replaced by its kind in
    brackets. Spans are those of the unchanged text; overlapping ones are one span, named by
    the kind that starts first (of one start: as listed). A null text stays null."""
    names = docs.columns
    text = F.col("text")
    found = docs.select("*", *[_spans(k, F.coalesce(text.cast("string"), F.lit(""))).alias(f"__of_{k}") for k in KINDS])
    found = found.select(*names, _merged(F.array_sort(F.concat(*[f"__of_{k}" for k in KINDS]))).alias("__spans"))
    return found.select(*[_woven(text.cast("string"), F.col("__spans")).alias(n) if n == "text" else F.col(n) for n in names])


def _merged(spans: Column) -> Column:
    """Spans by start with overlapping ones made one; spans that only touch stay apart."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = F.array_append(a, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer))).otherwise(apart)

    return F.aggregate(spans, empty, step)


def _woven(text: Column, spans: Column) -> Column:
    """The gaps between the spans and the spans' labels in turn."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), rest))
