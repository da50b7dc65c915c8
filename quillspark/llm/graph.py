"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (bigint) to ``node, component``: the least node that links reach.

    Each round a node takes the least label among its neighbours' and then its
    label's label, so labels travel twice as far every round. Each round's labels
    are written to the shared folder; only a count of changes reaches the driver.
    Nodes without links aren't in the result; loops and repeats do no harm.
    """
    work = Scratch()
    both = links.select("a", "b").where("a <> b")
    both = work.durable(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
    last = labels = work.durable(labels)
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("new"))
        far = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        step = step.join(far, step.new == far._n, "left").select("node", "old", F.least("new", F.coalesce("_c", "new")).alias("component"))
        step = work.durable(step)
        work.drop(last)
        last, labels = step, step.select("node", "component")
        if step.where("old <> component").isEmpty():
            work.drop(both)
            return labels
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
