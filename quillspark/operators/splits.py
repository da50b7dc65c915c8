"""Splits, quotas and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hex_int
from .ranges import row_ranks
from .ranking import global_rank


def rank_split(units: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Exact shares of units in the order of sha256("seed:key"): ``split`` and ``split_hash`` added."""
    d = units.withColumn("split_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    d = global_rank(d, [F.col("split_hash"), F.col(key)], F.substring("split_hash", 1, 4), "_rank")
    n_train, n_val = F.bround(F.col("n_rows") * train), F.bround(F.col("n_rows") * val)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return d.withColumn("split", split).drop("_rank", "n_rows")


def last_units_split(units: DataFrame, key: str, test: int = 4, val: int = 4, least: int = 12) -> DataFrame:
    """The last units (few: writers) to test, those before to val; raises below ``least``."""
    w = Window.orderBy(F.desc(key))
    n = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = units.select(key).distinct().withColumn("_n", n).withColumn("_r", F.row_number().over(w))
    enough = F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit(f"at least {least} units are needed, found "), F.col("_n").cast("string"))).cast("string"))
    return d.select(key, F.coalesce(enough, F.when(F.col("_r") <= test, "test").when(F.col("_r") <= test + val, "val").otherwise("train")).alias("split"))


def attach_split(rows: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Left lookup of the split; a row without one raises."""
    d = rows.drop("split").join(assignment.select(key, "split"), key, "left")
    return d.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit(f"no split for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")))


def seeded_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_order(F.col(key), seed), key)


def evenly_spaced(df: DataFrame, order: list[Column], prefix: Column, k: int) -> DataFrame:
    """k rows at even distances in order, both ends included."""
    d = global_rank(df, order, prefix, "_rank")
    place = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: F.bround(p * (F.col("n_rows") - 1) / F.lit(max(1, k - 1))).cast("bigint"))
    return d.where((F.col("n_rows") <= k) | F.array_contains(place, F.col("_rank") - 1)).drop("_rank", "n_rows")


def stratified_sample(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """``quota`` rows of each stratum by hash order; with replacement where a stratum is short.

    Row r of a stratum of n is taken quota div n times, once more if r <= quota mod n.
    """
    d = df.withColumn("_h", seeded_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 4))
    # Ranks within ranges of the hash, of which a stratum has 65,536 at most: no task sorts a whole stratum.
    counts = d.groupBy(stratum, "_p").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum))).drop("_c")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key)))
    d = d.join(counts.join(quotas, stratum), [stratum, "_p"]).withColumn("_r", F.col("_r") + F.col("_before"))
    times = F.floor(F.col("quota") / F.col("_n")) + F.when(F.col("_r") <= F.col("quota") % F.col("_n"), 1).otherwise(0)
    d = d.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int"))))
    return d.drop("_n", "quota", "_h", "_r", "_t", "_p", "_before")


def balanced_first(df: DataFrame, group: str, order: list[Column], total: int, groups: int) -> DataFrame:
    """total div groups rows of each group in order; what is short is filled from the rest in order.

    A group's quota is cut within each task before rows travel. The fill is needed
    only where quotas give under ``total`` rows; it is then among the first 2 * total
    rows of all, in which every row has all rows of its group that come before it. So
    no task takes a whole group.
    """
    per = total // groups
    order = [*order, F.xxhash64(*df.columns)]
    by_group = Window.partitionBy(group).orderBy(*order)
    quota = df.withColumn("_r", F.row_number().over(by_group)).where(F.col("_r") <= per)
    first = df.orderBy(*order).limit(2 * total)
    fill = first.withColumn("_r", F.row_number().over(by_group)).where(F.col("_r") > per)
    # the quota's rows come first, then the others; both in order
    return quota.union(fill).orderBy(F.col("_r") > per, *order).limit(total).drop("_r")


def bucket_batches(df: DataFrame, size: str, batch: int, key: str) -> DataFrame:
    """Batches of rows of like size: ``batch_id`` by rank of (size, key), taken in ranges of both, so that rows of one size are many tasks' work."""
    d = row_ranks(df, [F.col(size), F.col(key)], "_rank")
    return d.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch)).drop("_rank", "n_rows")


def padded(df: DataFrame, batch: str, values: str, pad: int = 0) -> DataFrame:
    """Arrays filled up with ``pad`` to the longest of their batch, and ``length``, what they had; a null array counts as empty.

    A batch is what one step takes, so its window is small.
    """
    d = df.withColumn(values, F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType))).withColumn("length", F.size(values))
    longest = F.max("length").over(Window.partitionBy(batch))
    return d.withColumn("_longest", longest).withColumn(values, F.concat(F.col(values), F.array_repeat(F.lit(pad), F.col("_longest") - F.col("length")))).drop("_longest")


def hash_bucket(key: Column, n: int) -> Column:
    return hex_int(F.substring(F.sha1(key), 1, 8)) % n
