"""Exact global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sum
from .skew import attach


def global_rank(df: DataFrame, order: list[Column], prefix: Column, name: str = "rank") -> DataFrame:
    """Add the row number (from 1) in ``order``, and ``n_rows``.

    ``prefix`` must never fall as the order rises and take many values: ranks are
    taken within equal prefixes and added to the counts of the smaller ones, so the
    one unpartitioned window runs over a row for each prefix.
    """
    d = df.withColumn("_p", prefix)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = d.groupBy("_p").agg(F.count("*").alias("_n"))
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("n_rows"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return d.withColumn("_i", within).join(counts, "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(*order).limit(k)


def first_k_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank ``k``."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= k)


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the mean rank of ties, from counts of distinct values (no window over all rows).

    Counts are summed up in ranges of equally many distinct values, however they
    are spread; a value that very many rows share is joined back by ``skew.attach``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    c = running_sum(counts, [F.col(value)], F.col("_n"), "_upto")
    ranks = c.select(value, "_n", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return attach(df, ranks, value, "_n").drop("_n")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's correlation of two numeric columns, ties by their mean rank."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_rank(average_rank(d, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))
