"""Duplicates, conflicts and leakage between splits, by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.numeric import split_priority
from ..functions.text import script_score
from .ranges import kept
from .skew import attach


def leakage_resolution(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """Decide every row of a manifest: ``status`` and ``reason`` added.

    Groups share ``sha256``. A group of several texts is quarantined whole. Else
    the best row of the highest split stays: by script score, dataset, image and
    the source row as text; the others are removed.

    Rows are not gathered by hash: each hash's decision is an aggregate of numbers and
    names, in which texts are 128-bit hashes, and is joined back (``skew.attach``).
    """
    t = text if text is not None else F.col("text")
    order = [-split_priority(F.col("split")), -F.coalesce(script_score(t, F.col("language"), F.col("source_type"), F.col("domain")), F.lit(0)), F.col("dataset"), F.col("image"), F.col("source_row").cast("string")]
    hashes = [F.when(t.isNotNull(), h) for h in identity(t)]
    d = rows.withColumns({"_key": F.struct(*identity(F.col("sha256"))), **{f"_o{i}": c for i, c in enumerate(order)}, **{f"_h{i}": h for i, h in enumerate(hashes)}})
    one = _best_rows(d, len(order), [f(f"_h{i}").alias(f"{n}{i}") for i in (0, 1) for n, f in (("_min", F.min), ("_max", F.max))])
    facts = one.agg(F.sum("_same").alias("_n"), F.min("_row").alias("_best"), F.min("_o0").alias("_top"), (F.min("_o0") != F.max("_o0")).alias("_splits"), *(F.min(f"_min{i}").alias(f"_min{i}") for i in (0, 1)), *(F.max(f"_max{i}").alias(f"_max{i}") for i in (0, 1)))
    texts = F.coalesce((F.col("_min0") != F.col("_max0")) | (F.col("_min1") != F.col("_max1")), F.lit(False))
    d = _first_marked(d.drop("_h0", "_h1"), facts.select("_key", "_n", "_best", "_top", "_splits", texts.alias("_texts")), len(order))
    status = F.when(F.col("_texts"), "quarantined").when(F.col("_first"), "accepted").otherwise("removed")
    reason = F.when(F.col("_texts") & F.col("_splits"), "cross_split_conflicting_labels").when(F.col("_texts"), "same_split_conflicting_labels").when(F.col("_first"), "").when(F.col("_o0") > F.col("_top"), "lower_priority_split_removed").otherwise("same_split_exact_duplicate_removed")
    return d.withColumn("status", status).withColumn("reason", reason).select(*(F.col(f"`{c}`") for c in rows.columns), "status", "reason")


def identity(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that stand for the values, nulls among them."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")]


def _best_rows(d: DataFrame, n: int, facts: list[Column], label: str | None = None) -> GroupedData:
    """Rows alike in key and order, counted; grouped by key, with ``_row`` to take the least of."""
    names = [f"_o{i}" for i in range(n)] + ([label] if label else [])
    alike = d.groupBy("_key", *names).agg(F.count(F.lit(1)).alias("_same"), *facts)
    return alike.withColumn("_row", F.struct(*names, "_same")).groupBy("_key")


def _first_marked(d: DataFrame, facts: DataFrame, n: int, label: str | None = None) -> DataFrame:
    """Join the facts of each key and add ``_first``: the row that its ``_best`` describes, one of them where several are alike."""
    facts = kept(facts)
    d = attach(d, facts, "_key", "_n")
    best = F.lit(True)
    for name in [f"_o{i}" for i in range(n)] + ([label] if label else []):
        best = best & F.col(name).eqNullSafe(F.col("_best")[name])
    d = d.withColumn("_first", best)
    if facts.where("_best._same > 1").isEmpty():
        return d
    # only rows that are alike in all that orders them are numbered
    tied = F.col("_first") & (F.col("_best")["_same"] > 1)
    numbered = d.where(tied).withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy("_o0")) == 1)
    return d.where(~tied).unionByName(numbered)


def duplicate_report(rows: DataFrame) -> DataFrame:
    """One row for each hash that repeats: count, reason by precedence, sorted distinct values."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    g = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("split").alias("_s"), F.countDistinct("text").alias("_t"), join("split").alias("splits"), join("dataset").alias("datasets"), F.countDistinct("text").alias("n_texts"), F.min("image").alias("first_image"))
    reason = F.when(F.col("_s") > 1, "cross_split_duplicate").when(F.col("_t") > 1, "conflicting_label_duplicate").otherwise("exact_duplicate")
    return g.where("n > 1").withColumn("reason", reason).drop("_s", "_t")


def conflicting_keys(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys under which an attribute takes several values."""
    return rows.groupBy(key).agg(F.countDistinct(attribute).alias("n_values")).where("n_values > 1").select(key)


def keep_first(rows: DataFrame, key: list[str], order: list[Column], label: str | None = None) -> DataFrame:
    """Add ``kept`` (the first row of each key) and ``kind``: first, same_label or conflicting duplicate.

    ``order`` is ascending, nulls first; rows alike in it go by the label. Keys are
    hashes, and rows are not gathered by them.
    """
    d = rows.withColumns({"_key": F.struct(*identity(*map(F.col, key))), "_label": F.col(label) if label else F.lit(0), **{f"_o{i}": c for i, c in enumerate(order)}})
    facts = _best_rows(d, len(order), [], "_label").agg(F.sum("_same").alias("_n"), F.min("_row").alias("_best"))
    d = _first_marked(d, facts, len(order), "_label")
    kind = F.when(F.col("_first"), "first").when(F.col("_label").eqNullSafe(F.col("_best")["_label"]), "same_label_duplicate").otherwise("conflicting_duplicate")
    return d.withColumn("kind", kind).withColumn("kept", F.col("_first")).select(*(F.col(f"`{c}`") for c in rows.columns), "kind", "kept")


def duplicated(rows: DataFrame, key: list[str]) -> DataFrame:
    """All rows of keys that repeat; keys are counted by their hashes."""
    d = rows.withColumn("_key", F.struct(*identity(*map(F.col, key))))
    facts = d.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return attach(d, facts, "_key", "_n").where("_n > 1").select(*(F.col(f"`{c}`") for c in rows.columns))
