"""Uniform sharding by an exact hypergeometric communication matrix.

Rows are dealt to logical partitions by a hash of their key. How many rows each
partition sends to each shard is drawn exactly, as an urn experiment without
replacement, so shard sizes are fixed beforehand (counts at most one apart). Each
partition permutes its rows and cuts them by its line of the matrix; each shard
permutes what it gets. Only counts reach the driver: partitions x shards numbers,
with at most ``max_partitions`` partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a logical partition holds on average, and the most partitions drawn for.
ROWS_PER_PARTITION, MAX_PARTITIONS = 4096, 16384


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Draw the partitions x shards matrix with these row and column sums.

    Partition by partition, the number of its rows in each shard is multivariate
    hypergeometric over the shards' free places: the law of a uniform shuffle.
    """
    if counts.sum() != sizes.sum():
        raise ValueError("row counts and shard sizes differ in total")
    rng = np.random.Generator(np.random.Philox(seed))
    free, lines = sizes.astype(np.int64).copy(), []
    for n in counts:
        line, left, pool = np.zeros(len(free), np.int64), int(n), int(free.sum())
        for j, f in enumerate(free):
            if not left:
                break
            pool -= int(f)
            line[j] = left if not pool else rng.hypergeometric(int(f), pool, left) if f else 0
            left -= int(line[j])
        free -= line
        lines.append(line)
    return np.array(lines, np.int64).reshape(len(counts), len(free))


def _unit(*cols: Column) -> Column:
    """A hash as a number of [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def hypergeometric_shuffle(df: DataFrame, n_shards: int, key: list[str], seed: int = 0) -> DataFrame:
    """Add ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 within the shard).

    ``key`` are columns that tell rows apart; rows equal in all of them are
    interchangeable, nulls count as a value, an empty table stays empty. Columns
    that are called like the added ones are replaced; others pass through whatever
    their names. Reruns agree.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_whole"))
    k = [F.col("_whole").getField(c) for c in key]
    total = df.count()
    parts = int(min(MAX_PARTITIONS, max(1, -(-total // ROWS_PER_PARTITION))))
    part = F.least(F.floor(_unit(F.lit(seed), F.lit("part"), *k) * parts).cast("int"), F.lit(parts - 1))
    dealt = df.withColumn("_part", part)
    got = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    counts = np.array([got.get(p, 0) for p in range(parts)], np.int64)
    sizes = np.full(n_shards, total // n_shards, np.int64)
    sizes[: total % n_shards] += 1
    matrix = communication_matrix(counts, sizes, seed)
    # One line for each partition: the ranks at which the next shard begins. Its size is bounded by MAX_PARTITIONS.
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(line)]) for p, line in enumerate(matrix)], "_part int, _cuts array<bigint>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), *k), *k)
    sent = (
        dealt.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "_part")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))))
        .drop("_part", "_rank", "_cuts")
    )
    # Second permutation: by a fresh hash, in ranges of it, so that no task sorts a whole shard.
    ranges = int(max(1, -(-total // (n_shards * ROWS_PER_PARTITION))))
    u = _unit(F.lit(seed), F.lit("again"), *k)
    sent = sent.withColumn("_range", F.least(F.floor(u * ranges), F.lit(ranges - 1))).withColumn("_u", u)
    held = sent.groupBy("shard", "_range").count()
    before = held.withColumn("_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_u", *k)) - 1
    return sent.withColumn("_rank", rank).join(before, ["shard", "_range"]).select(*(F.col("_whole").getField(c).alias(c) for c in columns), "shard", (F.col("_before") + F.col("_rank")).alias("slot"))
