"""Character inventories, vocabularies and out-of-vocabulary analysis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chars, codepoint_label


def char_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``ch``, a row for each character."""
    return df.select(*keys, F.explode(chars(F.col(text))).alias("ch"))


def char_inventory(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Occurrences of each character. Without keys they are counted within each task, and only counts travel."""
    if not keys:
        counted = df.select(F.col(text).cast("string")).mapInArrow(_code_points, "ch string, n bigint")
        return counted.groupBy("ch").agg(F.sum("n").alias("n"))
    return char_rows(df, keys, text).groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def _code_points(batches):
    """Code points of all texts of a task, counted in one array."""
    n = np.zeros(0x110000, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            joined = "".join(t for t in b.column(0).slice(at, 256).to_pylist() if t)
            found = np.bincount(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
            n[: len(found)] += found
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in used], pa.string()), pa.array(n[used])], names=["ch", "n"])


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """``ch, idx``: characters in code point order from 1; 0 is left for the blank.

    The inventory has a row for each distinct character, so its window is small.
    """
    return char_inventory(df, text=text).select("ch").withColumn("idx", F.row_number().over(Window.orderBy("ch"))).select("ch", "idx")


def vocabulary_map(vocab: DataFrame) -> DataFrame:
    """One row: ``char_to_index`` (a map), ``blank_index``, ``num_classes``."""
    entries = F.sort_array(F.collect_list(F.struct("ch", "idx")))
    return vocab.agg(F.map_from_entries(entries).alias("char_to_index"), F.lit(0).alias("blank_index"), (F.count("*") + 1).alias("num_classes"))


def vocabulary_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per character of either: shared, index_changed, added or removed."""
    o, n = old.select("ch", F.col("idx").alias("old_idx")), new.select("ch", F.col("idx").alias("new_idx"))
    change = F.when(F.col("old_idx").isNull(), "added").when(F.col("new_idx").isNull(), "removed").when(F.col("old_idx") != F.col("new_idx"), "index_changed").otherwise("shared")
    return o.join(n, "ch", "full_outer").withColumn("change", change)


#: Characters of a vocabulary that is put into an expression; a larger one is joined.
MAX_INLINE = 20_000


def oov_rows(df: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per row and foreign character its occurrences.

    The vocabulary (at most MAX_INLINE characters) is deleted from each text in
    place, so that only foreign characters are ever rows; a larger vocabulary is
    joined to the characters.
    """
    known = [r["ch"] for r in vocab.select("ch").where("ch IS NOT NULL").limit(MAX_INLINE + 1).collect()]
    if len(known) > MAX_INLINE:
        per_row = char_rows(df, keys, text).groupBy(*keys, "ch").agg(F.count("*").alias("n"))
        return per_row.join(vocab.select("ch"), "ch", "left_anti")
    foreign = df.select(*keys, F.translate(F.col(text), "".join(known), "").alias("_foreign")).where("_foreign <> ''")
    return char_rows(foreign, keys, "_foreign").groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def oov_summary(df: DataFrame, vocab: DataFrame, group: str, row_id: str, text: str = "text") -> DataFrame:
    """Per group: distinct foreign characters, occurrences, rows that have any."""
    rows = oov_rows(df, vocab, [group, row_id], text)
    return rows.groupBy(group).agg(F.countDistinct("ch").alias("unique_oov"), F.sum("n").alias("occurrences"), F.countDistinct(row_id).alias("affected_rows"))


def oov_report(df: DataFrame, vocab: DataFrame, group: str, row_id: str, text: str = "text") -> DataFrame:
    """Per group and foreign character: code point, occurrences, rows containing it."""
    rows = oov_rows(df, vocab, [group, row_id], text)
    return rows.groupBy(group, "ch").agg(F.sum("n").alias("occurrences"), F.count("*").alias("rows_containing")).withColumn("codepoint", codepoint_label(F.col("ch")))


def oov_split(df: DataFrame, vocab: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """Per row: its foreign characters (sorted, joined) and whether it is accepted."""
    bad = oov_rows(df, vocab, [row_id], text).groupBy(row_id).agg(F.array_sort(F.collect_list("ch")).alias("_chars"))
    out = df.select(row_id).join(bad, row_id, "left")
    return out.select(row_id, F.coalesce(F.array_join("_chars", ""), F.lit("")).alias("oov_characters"), F.col("_chars").isNull().alias("accepted"))
