"""Whole-table orders in ranges: ranks, running sums and running bests without a task that sees all rows.

A table is dealt into ranges of its order with about equally many rows each (Spark
samples the boundaries over all order columns, so equal values of the first one don't
pile up), written once with the range's number, and read back. What goes across
ranges is one row for each range; what goes within a range is a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import work_folder

def _ranges_before():
    """The ranges before one: a window over one row for each range."""
    return Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows with ``_range``, numbers that rise with the order; kept as a table in the shared folder."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_folder(spark)
    df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def running_sum(df: DataFrame, order: list[Column], amount: Column, name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over this row and all before it in ``order``, and ``total``. Ties beyond the order go any way."""
    d = in_ranges(df.withColumn("_amount", amount), order, parts)
    per = d.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("_range", F.coalesce(F.sum("_sum").over(_ranges_before()), F.lit(0)).alias("_offset"), F.sum("_sum").over(every).alias("total"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.withColumn("_within", F.sum("_amount").over(within)).join(F.broadcast(per), "_range")
    return out.withColumn(name, F.col("_offset") + F.col("_within")).drop("_range", "_amount", "_within", "_offset")


def row_ranks(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the row number (from 1) in ``order``, and ``n_rows``."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name, parts).withColumnRenamed("total", "n_rows")


def running_best(df: DataFrame, order: list[Column], loss: str, parts: int | None = None) -> DataFrame:
    """Best (least) loss before each row, whether the row improves on it, and rows since the last improvement.

    A prefix scan over ranges: each range's least loss goes to the ranges after it,
    then the place of each range's last improvement does. A null loss never improves,
    unless it is the first row.
    """
    d = row_ranks(df, order, "_place", parts).drop("n_rows")
    d = in_ranges(d, [F.col("_place")], parts)
    least = d.groupBy("_range").agg(F.min(loss).alias("_least")).select("_range", F.min("_least").over(_ranges_before()).alias("_past"))
    within = Window.partitionBy("_range").orderBy("_place")
    d = d.withColumn("_own", F.min(loss).over(within.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(least), "_range")
    d = d.withColumn("best_before", F.least("_own", "_past")).withColumn("improved", F.col("best_before").isNull() | F.coalesce(F.col(loss) < F.col("best_before"), F.lit(False)))
    d = d.withColumn("_last", F.max(F.when(F.col("improved"), F.col("_place"))).over(within))
    last = d.groupBy("_range").agg(F.max("_last").alias("_m")).select("_range", F.max("_m").over(_ranges_before()).alias("_earlier"))
    d = d.join(F.broadcast(last), "_range").withColumn("bad_rows", (F.col("_place") - F.coalesce("_last", "_earlier")).cast("bigint"))
    return d.drop("_range", "_place", "_own", "_past", "_least", "_last", "_earlier")


#: Bins of a pass of ``quantiles``.
BINS = 4096


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], keys: tuple[str, ...] = (), bins: int = BINS, weight: str | None = None) -> DataFrame:
    """Exact linear quantiles of each group: the keys, ``n_values``, ``least``, ``most`` and ``q``, an array beside ``at``.

    Selection by refinement. A pass counts values by bins of the ranges still in
    question, with each bin's least and greatest value; a wanted place falls into one
    bin, whose values are the next range. Ranges of one value are done. All groups and
    all places advance together, groups combine before they travel, and a task holds
    counts only. Nulls don't count; NaN is the greatest value; groups with null keys
    are groups. A row counts ``weight`` times, if given. Passes are few: values that spread evenly need the logarithm of their
    range to the base ``bins``.
    """
    spark, names = df.sparkSession, [f"_k{i}" for i in range(len(keys))]
    v = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")).where("_v IS NOT NULL")
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    facts = [F.coalesce(F.sum("_w"), F.lit(0)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min(finite).alias("flo"), F.max(finite).alias("fhi")]
    groups = kept(v.groupBy(*names).agg(*facts))
    place = lambda p, up: (F.ceil if up else F.floor)(F.lit(p) * (F.col("n") - 1)).cast("bigint")
    wanted = F.array_distinct(F.array(*(place(p, up) for p in at for up in (False, True))))
    wanted = F.filter(wanted, lambda r: (r > 0) & (r < F.col("n") - 1))  # the first and the last are known
    state = groups.where("n > 0").select(*names, "lo", "hi", "flo", "fhi", F.lit(0).cast("bigint").alias("below"), wanted.alias("places")).where(F.size("places") > 0)
    found = [state.where("lo = hi")]
    state = state.where("lo < hi")
    while not state.isEmpty():
        s = state.select(*(F.col(n).alias(f"s{n}") for n in names), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), "flo", "fhi", "below", "places")
        mine = F.col("_v").between(F.col("s_lo"), F.col("s_hi"))
        for n in names:
            mine = mine & F.col(n).eqNullSafe(F.col(f"s{n}"))
        share = (F.col("_v") / 2 - F.col("flo") / 2) / (F.col("fhi") / 2 - F.col("flo") / 2)
        inside = F.when(F.col("flo") < F.col("fhi"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0)
        number = F.when(F.isnan("_v"), bins + 1).when(F.col("_v") == float("inf"), bins).when(F.col("_v") == float("-inf"), -1).otherwise(inside)
        # without keys there is one group, and its ranges are as many as the places at most
        joined = v.join(s if names else F.broadcast(s), mine).select(*names, "_v", "_w", "s_lo", "below", "places", number.alias("bin"))
        counts = joined.groupBy(*names, "s_lo", "bin").agg(*facts, F.first("below").alias("below"), F.first("places").alias("places"))
        upto = Window.partitionBy(*names, "s_lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("below", F.col("below") + F.sum("n").over(upto) - F.col("n"))
        here = F.filter("places", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
        state = kept(counts.withColumn("places", here).where(F.size("places") > 0).select(*names, "lo", "hi", "flo", "fhi", "below", "places"))
        found.append(state.where("lo = hi"))
        state = state.where("lo < hi")
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    values = done.select(*(F.col(n).alias(f"d{n}") for n in names), F.explode("places").alias("place"), F.col("lo").alias("value"))
    values = values.groupBy(*(f"d{n}" for n in names)).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("by_place"))  # two for each of ``at``
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"d{n}"))
    got = groups.join(values if names else F.broadcast(values), same, "left")

    def linear(p):
        spot = F.lit(p) * (F.col("n") - 1)
        at_place = lambda r: F.when(r == 0, F.col("lo")).when(r == F.col("n") - 1, F.col("hi")).otherwise(F.col("by_place")[r])
        a, b = at_place(F.floor(spot).cast("bigint")), at_place(F.ceil(spot).cast("bigint"))
        return F.when(F.floor(spot) == F.ceil(spot), a).when(a == b, a).otherwise((F.ceil(spot) - spot) * a + (spot - F.floor(spot)) * b)

    q = F.array(*(linear(p) for p in at))
    return got.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("n").alias("n_values"), F.col("lo").alias("least"), F.col("hi").alias("most"), q.alias("q"))


def kept(df: DataFrame) -> DataFrame:
    """A table of groups or ranges, written so that no pass is planned upon all passes before it."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
