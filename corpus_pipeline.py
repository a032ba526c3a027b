"""A corpus pipeline of five stages; each reads all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.llm import bpe, decontam, langid, pii, simhash
from flowsift.llm.common import cut
from flowsift.llm.registry import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows with a recognised language (a score of 0.5 or more), as often as they came in.

    Null, empty and letterless texts go; a missing id changes nothing. Texts are read whole.
    From an empty table nothing is learned and nothing kept.
    """
    docs = docs.select(COLUMNS)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies, one row of it.

    A row is told by its id and text: another text under the same id is decided by itself.
    Rows without an id can't be named in a group and stay.
    """
    docs = docs.select(COLUMNS)
    groups = simhash.near_duplicate_groups(docs)
    others = groups.where("doc_id <> component_id or text_hash <> component_text").select("doc_id", "text_hash").distinct()
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(others, ["doc_id", "text_hash"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("lang", "source"))
    once = left.withColumn("first", F.when(F.col("doc_id").isNull(), 1).otherwise(first)).where("first = 1")
    return once.select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage similar to a benchmark item, decided by the text: neither
    another text under the same id nor a missing id changes that."""
    docs = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    leaks = decontam.contaminated(docs.select(F.col("text_hash").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select(F.col("doc_id").alias("text_hash")).distinct(), "text_hash", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows.

    All rows stay, repeated ones and those without an id too; a null text stays null, with a
    null n_chars.
    """
    docs = pii.redact(docs.select(COLUMNS))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row left; null and empty texts have no tokens."""
    return bpe.encode(docs.select(COLUMNS), tokenizer_file())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: The first and last stages are beyond SQL; tests/llm/test_edges.py compares each stage with brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
