"""Groups beyond a row or a task: folds in order as trees, and sketches that are summed up without reading rows again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boards import placed
from .graphs import kept as cut


def fold_in_order(df: DataFrame, key: str, order: list[str], value: str, combine: Callable[[Column, Column], Column], chunk: int = 1024) -> DataFrame:
    """(key, value): a group's values combined in the ascending order of some columns.

    combine(x, y) has to be associative and keep the type of the values. Rows are placed in ranges,
    chunks of so many neighbours are combined, then chunks of chunks, until one value is left
    for each group; so a group with most rows is many tasks' work and no row holds it.
    """
    state = placed(df.select(key, value, *order), key, [F.asc(c) for c in order])
    state = cut(state.select(key, (F.col("place") - 1).cast("bigint").alias("at"), F.col(value).alias("v")))
    left = (state.agg(F.max("at")).first()[0] or 0) + 1
    while True:
        rows = F.array_sort(F.collect_list(F.struct("at", "v")), lambda x, y: (x["at"] - y["at"]).cast("int"))
        by = state.groupBy(key, F.floor(F.col("at") / chunk).alias("next")).agg(F.transform(rows, lambda r: r["v"]).alias("all"))
        state = by.select(key, F.col("next").alias("at"), F.aggregate(F.slice("all", 2, F.lit(chunk)), F.get("all", F.lit(0)), combine).alias("v"))
        left = -(-left // chunk)
        if left == 1:
            return state.select(key, F.col("v").alias(value))


def sketches(df: DataFrame, keys: list[str], bucket: str, ts: str, distinct: str | None = None, values: str | None = None) -> DataFrame:
    """(keys, bucket, n, and sketches): a row for each bucket of time, to be stored and summed up by rolled_up().

    distinct: a column whose values are counted (HLL sketch, some kB); values: a column of doubles
    whose percentiles are asked (KLL sketch, some kB).
    """
    aggs = [F.count("*").alias("n")]
    aggs += [F.hll_sketch_agg(distinct).alias("hll")] if distinct else []
    aggs += [F.kll_sketch_agg_double(F.col(values).cast("double")).alias("kll")] if values else []
    return df.groupBy(*keys, F.date_trunc(bucket, ts).alias("bucket")).agg(*aggs)


def rolled_up(table: DataFrame, keys: list[str], bucket: str | None, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(keys, bucket, n, about, and p50 and so on): larger buckets of time from the rows of sketches(), or all time.

    about: the number of distinct values, off by some 2 %; percentiles are off by some 1.5 % of the ranks.
    """
    by = [*keys, *([F.date_trunc(bucket, "bucket").alias("bucket")] if bucket else [])]
    aggs = [F.sum("n").alias("n")]
    aggs += [F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("about")] if "hll" in table.columns else []
    aggs += [F.kll_merge_agg_double("kll").alias("__kll")] if "kll" in table.columns else []
    out = table.groupBy(*by).agg(*aggs)
    if "kll" in table.columns:
        out = out.select("*", *[F.kll_sketch_get_quantile_double("__kll", F.lit(x)).alias(f"p{round(100 * x)}") for x in shares]).drop("__kll")
    return out
