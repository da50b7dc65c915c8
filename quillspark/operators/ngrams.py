"""Character n-gram language models as tables of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Padding before a text and its end (fixed values: private use characters).
BOS, EOS = "", ""


def positions(df: DataFrame, keys: list[str], order: int, text: str = "text") -> DataFrame:
    """``keys, pos, ctx, tok``: each token of a text with its context of order - 1 characters."""
    padded = F.concat(F.lit(BOS * (order - 1)), F.coalesce(F.col(text), F.lit("")), F.lit(EOS))
    d = df.select(*keys, padded.alias("_s"))
    d = d.select(*keys, "_s", F.explode(F.sequence(F.lit(order), F.length("_s"))).alias("pos"))
    return d.select(*keys, (F.col("pos") - order + 1).alias("pos"), F.substring("_s", F.col("pos") - order + 1, F.lit(order - 1)).alias("ctx"), F.substring("_s", F.col("pos"), F.lit(1)).alias("tok"))


def fit(df: DataFrame, group: str, order: int = 3, text: str = "text") -> DataFrame:
    """``group, ctx, tok, n`` for contexts of all lengths below ``order``.

    Full contexts are counted once; shorter ones are sums of those counts, so the
    corpus' positions are shuffled once, already aggregated.
    """
    full = positions(df, [group], order, text).groupBy(group, "ctx", "tok").agg(F.count("*").alias("n"))
    lengths = F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("_l")
    cut = full.select(group, "ctx", "tok", "n", lengths).select(group, F.right(F.col("ctx"), F.col("_l")).alias("ctx"), "tok", "n")
    return cut.groupBy(group, "ctx", "tok").agg(F.sum("n").alias("n"))


def score(df: DataFrame, model: DataFrame, group: str, row_id: str, order: int = 3, k: float = 0.1, text: str = "text") -> DataFrame:
    """Per row the log probability under its group's model; rows of groups without a model score 0.

    A token is judged in the longest context that the model has seen, add-k
    smoothed over the group's vocabulary with the end sign.
    """
    size = model.where(F.col("ctx") == "").groupBy(group).agg(F.count("*").alias("_v"))
    totals = model.groupBy(group, "ctx").agg(F.sum("n").alias("_total"))
    at = positions(df, [group, row_id], order, text).groupBy(group, row_id, "ctx", "tok").agg(F.count("*").alias("_times"))
    # distinct (group, ctx, tok) are judged once, then joined back
    distinct = at.select(group, "ctx", "tok").distinct()
    tries = distinct.select("*", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("_l")).withColumn("_c", F.right(F.col("ctx"), F.col("_l")))
    seen = tries.join(totals.withColumnRenamed("ctx", "_c"), [group, "_c"]).groupBy(group, "ctx", "tok").agg(F.max_by(F.struct("_c", "_total"), "_l").alias("_best")).select(group, "ctx", "tok", "_best.*")
    judged = seen.join(model.select(group, F.col("ctx").alias("_c"), "tok", "n"), [group, "_c", "tok"], "left").join(size, group)
    lp = F.ln((F.coalesce("n", F.lit(0)) + k) / (F.col("_total") + k * F.col("_v")))
    judged = judged.select(group, "ctx", "tok", lp.alias("_lp"))
    out = at.join(judged, [group, "ctx", "tok"]).groupBy(group, row_id).agg(F.sum(F.col("_lp") * F.col("_times")).alias("log_prob"))
    return df.select(group, row_id).join(out, [group, row_id], "left").na.fill(0.0, ["log_prob"])
