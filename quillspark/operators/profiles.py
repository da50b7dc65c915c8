"""Profiles of tables and groups, running statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def group_profile(df: DataFrame, candidates: list[str]) -> DataFrame:
    """For each candidate key: coverage in percent, groups, singletons, and sizes min / median / mean / max."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in candidates)).unpivot([], candidates, "candidate", "value")
    sizes = long.groupBy("candidate", "value").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    n = F.when(filled, F.col("n"))
    profile = sizes.groupBy("candidate").agg(
        (100 * F.sum(F.coalesce(n, F.lit(0))) / F.sum("n")).alias("coverage"), F.count_if(filled).alias("n_groups"), F.count_if(filled & (F.col("n") == 1)).alias("singletons"),
        F.min(n).alias("min_size"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"),
    )
    middle = ranges.quantiles(sizes.where(filled), "n", (0.5,), ("candidate",)).select("candidate", F.col("q")[0].alias("median_size"))
    return profile.join(F.broadcast(middle), "candidate", "left")  # a row for each candidate


def manifest_profile(df: DataFrame, text: str, path: str) -> DataFrame:
    """One row: rows, empty texts, missing paths, distinct texts."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(empty(text)).alias("empty_text"), F.count_if(empty(path)).alias("missing_path"), F.countDistinct(text).alias("distinct_texts"))


def running_best(df: DataFrame, order: str, loss: str, partition: list[str] | None = None) -> DataFrame:
    """Best loss so far, whether a row improves on it, and bad rows since the last improvement, within each partition.

    Without a partition the whole table is one order; ``ranges.running_best`` scans it in ranges.
    """
    if not partition:
        return ranges.running_best(df, [F.col(order)], loss)
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("best_before", F.min(loss).over(past)).withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))
    d = d.withColumn("_streak", F.sum(F.col("improved").cast("int")).over(w))
    return d.withColumn("bad_rows", F.row_number().over(Window.partitionBy(*(partition or []), "_streak").orderBy(order)) - 1).drop("_streak")


def percentiles(df: DataFrame, c: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact linear percentiles with min, mean and max, in one row."""
    q = ranges.quantiles(df, c, at).select("q")
    d = df.agg(F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max")).crossJoin(F.broadcast(q))  # one row each
    return d.select(*(F.col("q")[i].alias(f"p{int(100 * p)}") for i, p in enumerate(at)), "min", "mean", "max")


def rollup_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by all prefixes of the keys; ALL stands for a total."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys))).select(*(F.when(F.col(f"_g{i}") == 1, "ALL").otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)), "n")


def fan_out(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows per view (all, and each value of each dimension), as the fan-out of files counts them."""
    long = df.select(F.lit("all").alias("all"), *(F.col(d).cast("string").alias(d) for d in dimensions)).unpivot([], ["all", *dimensions], "view", "value")
    return long.groupBy("view", "value").agg(F.count("*").alias("n"))


def condition_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))
