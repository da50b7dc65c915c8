"""Segmentation of running transcriptions by record ids.

Texts are taken with their white space collapsed; null is empty. An id belongs to
the text up to the next id; ids without text give no segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# Digits of a record id; what may stand after an id, and before one within a text; digits of
# ids that are looked for again; digits of an id that only counts at the start; statuses.
ID_DIGITS = "5,8"
OPENING = "[A-Z\"'“‘(]"
CLOSING = "[.!?;:)\\]}\"'”’]"
REPAIR_DIGITS = "4,8"
SHORT_DIGITS = "1,3"
NO_IDS, PREFIX, NO_TEXT, PARSED = "no_record_ids", "text_before_first_id", "no_sentences", "parsed"
NONE_FOUND, SHORT_ONLY, SHORT_FIRST, KEPT_PREFIX, REMOVED = "no_ids_found", "short_leading_id_removed", "leading_short_id_removed", "unnumbered_prefix_preserved", "record_ids_removed"

RECORD_ID = f"(?<!\\p{{Nd}})(\\p{{Nd}}{{{ID_DIGITS}}})\\s+"
BOUNDARY_ID = f"(?:^|(?<={CLOSING}\\s?))(?<!\\p{{Nd}})(\\p{{Nd}}{{{REPAIR_DIGITS}}})\\s+(?={OPENING})"
SHORT_ID = f"^(\\p{{Nd}}{{{SHORT_DIGITS}}})\\s+(?={OPENING})"
RESIDUAL_ID = f"(?:^|[.!?]\\s+)\\p{{Nd}}{{{REPAIR_DIGITS}}}\\s+(?={OPENING})"
STARTING_NUMBER = "^\\p{Nd}{1,8}\\s+"


def _segment(record_id: Column, text: Column) -> Column:
    return F.struct(record_id.alias("record_id"), text.alias("text"))


def _cut(t: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before the first id, and the segments."""
    parts = F.split(t, pattern)
    segs = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x, i: _segment(x, F.trim(F.get(parts, i + 1))))
    return F.trim(parts[0]), F.filter(segs, lambda s: s["text"] != "")


def parse_records(df: DataFrame, raw: str) -> DataFrame:
    """Add ``segments`` (record_id, text), in order, and ``status``.

    A text that has no ids, or words before the first one, is one segment with an
    empty id; an empty text has none.
    """
    t = collapse(F.coalesce(F.col(raw), F.lit("")))
    before, segs = _cut(t, RECORD_ID)
    found = F.rlike(t, F.lit(RECORD_ID))
    status = F.when(~found, NO_IDS).when(before != "", PREFIX).when(F.size(segs) == 0, NO_TEXT).otherwise(PARSED)
    whole = F.filter(F.array(_segment(F.lit(""), t)), lambda s: s["text"] != "")
    return df.withColumn("_status", status).withColumn("segments", F.when(F.col("_status").isin(NO_IDS, PREFIX), whole).otherwise(segs)).withColumnRenamed("_status", "status")


def repair_records(df: DataFrame, raw: str) -> DataFrame:
    """Segments by ids that their neighbours confirm, with what is left to review.

    An id counts at the start of a text or after a closing sign, and before an
    opening one; a short id only at the start. Words before the first id stay as a
    segment with an empty id. Adds ``segments``, ``status``, ``clean_text`` (all
    segments), ``residual_boundary_id``, ``starts_with_number`` and ``needs_review``.
    """
    t = collapse(F.coalesce(F.col(raw), F.lit("")))
    before, segs = _cut(t, BOUNDARY_ID)
    found = F.rlike(t, F.lit(BOUNDARY_ID))
    short = F.rlike(before, F.lit(SHORT_ID))
    # without ids, what stands before the first one is the whole text
    first = F.when(short, _segment(F.regexp_extract(before, SHORT_ID, 1), F.regexp_replace(before, SHORT_ID, ""))).otherwise(_segment(F.lit(""), before))
    status = (
        F.when(~found, F.when(short, SHORT_ONLY).otherwise(NONE_FOUND))
        .when(before == "", REMOVED)
        .otherwise(F.concat(F.when(short, SHORT_FIRST).otherwise(KEPT_PREFIX), F.lit(f"+{REMOVED}")))
    )
    d = df.withColumn("_status", status).withColumn("segments", F.when(found & (before == ""), segs).otherwise(F.concat(F.array(first), segs))).withColumnRenamed("_status", "status")
    d = d.withColumn("clean_text", collapse(F.array_join(F.transform("segments", lambda s: s["text"]), " ")))
    d = d.withColumn("residual_boundary_id", F.rlike("clean_text", F.lit(RESIDUAL_ID))).withColumn("starts_with_number", F.rlike("clean_text", F.lit(STARTING_NUMBER)))
    return d.withColumn("needs_review", F.col("residual_boundary_id") | F.col("starts_with_number") | (F.col("clean_text") == ""))


def residual_rows(df: DataFrame, group: str) -> DataFrame:
    """A row for each segment, with its place."""
    return df.select(group, F.posexplode("segments").alias("place", "s")).select(group, "place", "s.record_id", "s.text")
