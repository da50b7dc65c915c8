"""Curation of `documents` in stages; each is written as Parquet and read again by the next.

quality rules -> near duplicates -> repeated passages -> mix of sources -> sampled pieces
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import gumbel, mixing, partenum, rules, substrings
from quillspark.llm.common import WORD_RE, durable, table

#: Near duplicates share this many per cent of their shingles of so many words; a repeated passage has so many words.
NEAR_WIDTH, NEAR_PERCENT, PASSAGE = 5, 80, 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base limits and the list learned from `labels`.

    Null, empty and blank texts fail the base and go. Repeated rows are judged each,
    a statistic that equals a cut falls on one side alike, other columns pass through
    whatever their names; an empty table stays empty.
    """
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    judged = rules.quality(whole, table(spark, sf_dir, "labels")).where("kept")
    return judged.select(*(F.col("_whole").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each component's first row: the least doc_id's, one without an id only where all are.

    Rows are judged by themselves, so that neither a missing nor a repeated doc_id
    drops one. Texts without words (null, empty, blank) link with nothing: their rows
    all stay. Of equal rows one stays; of rows alike in doc_id and text the one whose
    other columns are least, or whose JSON has the least hash where a column has no
    order (a map or a variant). Other columns pass through whatever their names; an
    empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_node"), "doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"))
    linked = partenum.row_components(rows.select(F.col("_node").alias("id"), "doc_id", "text"), NEAR_WIDTH, NEAR_PERCENT)
    first = linked.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("_first"))
    worded = F.coalesce("text", F.lit("")).rlike(WORD_RE)
    kept = rows.where(worded).join(first.select(F.col("_first.id").alias("_node")), "_node", "left_semi")
    # equal rows are one node; one of them stays
    ordered = not re.search(r"\b(map<|variant\b)", rows.schema["_row"].dataType.simpleString())
    least = F.min("_row") if ordered else F.min_by("_row", F.xxhash64(F.to_json("_row")))
    kept = kept.groupBy("_node", "doc_id", "text").agg(least.alias("_row"))
    column = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c)
    return kept.select(*map(column, docs.columns)).union(docs.where(~worded))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every window of PASSAGE words that starts more than once.

    Rows need no doc_id and are judged each; null texts stay null, empty ones empty.
    A text that loses words has the others joined by one space, and ``n_chars``
    counts them. Other columns pass through whatever their names; an empty table
    stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.col("text").isNull().alias("_none")).alias("_row"))
    got = substrings.remove_repeats(packed, PASSAGE, keep_text=True, carry=("_row",))
    row = F.col("_row")
    changed = {"doc_id": F.col("doc_id"), "text": F.when(~row["_none"], F.col("kept_text")), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint"))}
    if "n_chars" in others:
        changed["n_chars"] = changed["n_chars"].otherwise(row["n_chars"])
    return got.select(*(changed.get(c, row.getField(c)).alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights, block by block.

    A row for each document's part in each drawn block, with the document's columns.
    Texts without words aren't drawn; null sources are one source, last in order;
    repeated rows are rows of their own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text of the mix, without replacement: doc_id, ids and scores.

    Null and empty texts have one, the empty one. Rows of one doc_id draw from one
    seed; other columns aren't read; an empty table gives no rows.
    """
    return gumbel.sampled(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("sampled_pieces", sampled_pieces),
]

#: SQL can't express learned rules or sampled segmentations; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each over what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
