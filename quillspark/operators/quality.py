"""Review reasons, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _reasons(*cases: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(cond, F.lit(name) if isinstance(name, str) else name) for cond, name in cases)))


def reasons_symbols(t: Column, symbols: str = "[^\\p{L}\\p{N}\\s.,!?'\"()-]") -> Column:
    """Rule set A: empty text, underscores, unusual symbols (listed once each, sorted)."""
    odd = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(symbols), F.lit(0)))), "")
    return _reasons((F.trim(t) == "", "empty_text"), (t.contains("_"), "underscore"), (odd != "", F.concat(F.lit("unusual_symbols:"), odd)))


def reasons_script(t: Column, longest: int = 60) -> Column:
    """Rule set B: also Latin letters, digits (Arabic-Indic too) and length."""
    return _reasons((F.trim(t) == "", "empty_text"), (t.contains("_"), "underscore"), (t.rlike("[A-Za-z]"), "latin_character"), (t.rlike("[0-9٠-٩]"), "digit"), (F.length(t) > longest, "long_label"))


def reasons_words(t: Column, status: Column, longest: int = 80) -> Column:
    """Rule set C: annotation status, several words, length, the first control character."""
    control = F.regexp_extract(t, "\\p{C}", 0)
    return _reasons((F.trim(t) == "", "empty_text"), (status != "ok", F.concat(F.lit("annotation_status:"), status)), (T.word_count(t) > 1, "multiword"), (F.length(t) > longest, "long_label"), (control != "", F.concat(F.lit("control_character:"), T.codepoint_label(control))))


def reasons_scene(t: Column, longest: int = 100) -> Column:
    """Rule set D: empty, control characters, length."""
    return _reasons((F.trim(t) == "", "empty_text"), (t.rlike("\\p{C}"), "control_character"), (F.length(t) > longest, "long_label"))


def route(df: DataFrame, reasons: Column) -> DataFrame:
    """Add ``reasons``, ``review_reason`` (joined by ;) and ``status``: clean or review."""
    d = df.withColumn("reasons", reasons)
    return d.withColumn("review_reason", F.array_join("reasons", ";")).withColumn("status", F.when(F.size("reasons") == 0, "clean").otherwise("review"))


def first_failure(*cases: tuple[Column, str]) -> Column:
    """The name of the first check that fails; null if none does."""
    out = None
    for cond, name in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def all_failures(df: DataFrame, keys: list[str], *cases: tuple[Column, str]) -> DataFrame:
    """A row for each check that a row fails."""
    return df.select(*keys, F.explode(_reasons(*cases)).alias("issue"))


def quarantine(df: DataFrame, *cases: tuple[Column, str]) -> DataFrame:
    """Add ``quarantine_reason`` (empty: none), the names of all masks that hold joined by ;."""
    return df.withColumn("quarantine_reason", F.array_join(_reasons(*cases), ";"))


def assert_none(df: DataFrame, message: str) -> None:
    """Raise if the table has a row."""
    if not df.isEmpty():
        raise AssertionError(f"{message}: {df.limit(5).collect()}")
