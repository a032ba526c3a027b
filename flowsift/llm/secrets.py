"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot

KINDS = ("assign", "access", "hex")
#: Goes up with every change of the rules, so that blobs are scanned again.
RULES = "1"

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I).finditer
_names = ("passw", "secret", "token", "api_key", "apikey")
_access = re.compile(r"AKIA[A-Z0-9]+").finditer
_hex = re.compile(r"[0-9a-f]{32,}").finditer  # the leftmost run of 32 or more is a whole run


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind; each kind leftmost, not overlapping."""
    found = []
    low = text.lower()
    if any(name in low for name in _names):  # else the expression can't match
        found += [(m.start(), 0, m.end()) for m in _assign(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _hex(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [spans(t.as_py() or "") for t in b.column("text")]
        joined = [",".join(f"{k}:{a}:{e}" for k, a, e in f) for f in found]
        n = [pa.array([sum(k == kind for k, _, _ in f) for f in found], pa.int64()) for kind in KINDS]
        yield pa.RecordBatch.from_arrays([b.column("blob"), *n, pa.array(joined, pa.string())], ["blob", "n_assign", "n_access", "n_hex", "spans"])


def versions(paths: DataFrame) -> DataFrame:
    """(doc_id, blob): the content address of every row's text; null reads as empty."""
    return paths.select(F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("blob"))


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> DataFrame:
    """New ledger rows (blob, rules, n_assign, n_access, n_hex, spans): one for each blob not yet
    in the ledger under these rules. Only those texts are scanned, once for all their copies."""
    known = versions(paths).groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"))
    if ledger is not None:
        known = known.join(ledger.where(F.col("rules") == rules).select("blob").distinct(), "blob", "left_anti")
    texts = paths.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("first"), F.col("text").cast("string"))
    texts = texts.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    one = texts.join(known, ["first", "blob"])
    found = one.select("blob", "text").mapInArrow(_scan, "blob string, n_assign long, n_access long, n_hex long, spans string")
    return found.dropDuplicates(["blob"]).withColumn("rules", F.lit(rules))


LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, spans string"


class Ledger:
    """A table in a shared folder of all blobs scanned so far, with the rules they were scanned by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)  # so that it can be read from the start

    def rows(self) -> DataFrame:
        """(blob, rules, n_assign, n_access, n_hex, spans), one row for each blob and rules."""
        return self.spark.read.schema(LEDGER).parquet(self.path).dropDuplicates(["blob", "rules"])

    def advance(self, versions: DataFrame, rules: str = RULES) -> None:
        """Scans the texts of these versions that the ledger lacks under the rules, and adds them.

        A run that is lost leaves the ledger as it was or as it is to be; a blob added
        twice by two runs at a time is read once.
        """
        scan(versions, self.rows(), rules).select("blob", "rules", "n_assign", "n_access", "n_hex", "spans").write.mode("append").parquet(self.path)


def findings(paths: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> DataFrame:
    """(doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans) of every row of paths.

    Blobs in the ledger under the same rules are not scanned again; their findings are
    read from it. Rows are kept as often as they came in, null ids too; a null text reads
    as empty.
    """
    new = scan(paths, ledger, rules)
    if ledger is not None:
        new = new.unionByName(ledger.where(F.col("rules") == rules).select(new.columns).dropDuplicates(["blob"]))
    return report(paths, new, rules)


def report(paths: DataFrame, ledger: DataFrame, rules: str = RULES) -> DataFrame:
    """findings() of paths whose blobs are all in the ledger; nothing is scanned. Only blobs with
    findings travel back to the rows, and rows of a very common blob are dealt into shares."""
    hits = ledger.where((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules")
    out = join_hot(versions(paths), hits, "blob", "doc_id", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    joined = F.coalesce("spans", F.lit(""))
    return out.select("doc_id", "blob", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))
