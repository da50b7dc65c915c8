"""Facts of keys joined back to rows, however many rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; so at most HOT keys are.
HOT = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Left-join ``facts`` (one row for each ``key``, with ``weight``, the key's number of rows) to ``rows``.

    Keys that hold more than one row in HOT are fewer than HOT; they are broadcast, and
    their rows are dealt evenly instead of by key. The others meet by a hash join of
    shuffled rows, so neither rows nor what they carry is sorted. Null keys match nothing.
    """
    total = facts.agg(F.sum(weight).alias("_total"))
    marked = facts.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(weight) * HOT > F.col("_total")).drop("_total")  # one row
    names = [c for c in facts.columns if c != key]
    hot = marked.where("_hot").select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot_facts"))
    rest = marked.where("NOT _hot").select(F.struct(F.lit(0).cast("bigint").alias("deal"), F.col(key).alias("key")).alias("_rest_key"), F.struct(*names).alias("_rest_facts"))
    d = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # rows that are served, or have no key, go anywhere
    served = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    none = F.lit(None).cast(rows.schema[key].dataType)
    dealt = F.when(served, F.struct((F.monotonically_increasing_id() + 1).alias("deal"), none.alias("key"))).otherwise(F.struct(F.lit(0).cast("bigint").alias("deal"), F.col(key).alias("key")))
    d = d.withColumn("_join", dealt).join(rest.hint("shuffle_hash"), F.col("_join") == F.col("_rest_key"), "left")
    fact = lambda c: F.coalesce(F.col("_hot_facts")[c], F.col("_rest_facts")[c]).alias(c)
    return d.select(*(F.col(f"`{c}`") for c in rows.columns), *map(fact, names))
