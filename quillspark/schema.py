"""Column checks and all-string schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def assert_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """The table itself; raises MissingColumns before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def strings(columns: Iterable[str]) -> StructType:
    """A schema of nullable strings."""
    return StructType([StructField(c, StringType()) for c in columns])


def find_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first candidate that names a column, letter case aside."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def restore_order(df: DataFrame, original: Iterable[str]) -> DataFrame:
    """Drop helper columns: only the original ones, in their order."""
    return df.select(*original)


def with_provenance(df: DataFrame, **constants: str) -> DataFrame:
    """Add constant columns and ``source_manifest``, the path of the file that a row comes from.

    ``df`` must be a scan: rows of a table that was computed have no file.
    """
    return df.withColumns({"source_manifest": F.col("_metadata.file_path"), **{k: F.lit(v) for k, v in constants.items()}})
