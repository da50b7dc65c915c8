"""Writers: CSV and Parquet manifests, fan-out by split, reports, packages."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists", mark: bool = False) -> None:
    """CSV with these columns in this order; others are left out, missing ones are empty.

    Blanks at the ends of values stay. ``mark`` puts a byte order mark before the header, for spreadsheet programs.
    """
    out = df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields))
    if mark:
        out = out.withColumnRenamed(fields[0], f"\ufeff{fields[0]}")
    out.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def union_of_keys(tables: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order they are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_by(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Parquet in a folder for each value of the keys; one task doesn't write to every folder."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(32))).write.mode(mode).partitionBy(*keys).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small table of aggregates as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def write_texts(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested documents, one JSON object a line."""
    df.write.mode(mode).json(path)


def packed(df: DataFrame, content: str, ext: str = ".png") -> DataFrame:
    """One row for each distinct content with its address images/ab/<sha256>.ext."""
    h = F.sha2(F.col(content), 256)
    return df.withColumn("sha256", h).dropDuplicates(["sha256"]).withColumn("packed", F.concat(F.lit("images/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256", F.lit(ext)))


def _zip(members: pa.Array) -> pa.Array:
    out = []
    for row in members:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for m in row.as_py() or []:
                z.writestr(zipfile.ZipInfo(m["name"]), m["content"] or b"", zipfile.ZIP_DEFLATED)
        out.append(data.getvalue() if row.is_valid else None)
    return pa.array(out, pa.binary())


def zipped(members: Column) -> Column:
    """ZIP files of arrays of (name, content), the same bytes on every run; null for null. An archive is one value, so it must fit a task."""
    return F.arrow_udf(_zip, "binary")(members)


def replace(df: DataFrame, path: str) -> None:
    """Write Parquet beside ``path`` and put it in its place when it is whole, so that readers see the old rows or the new.

    Between the two renames there is no folder for a moment; a failed write leaves the old one.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}.new")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(of(path))
    if had and not fs.rename(of(path), of(f"{aside}.old")):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(of(f"{aside}.new"), of(path)):
        if had:
            fs.rename(of(f"{aside}.old"), of(path))
        raise OSError(f"{aside}.new can't be moved to {path}")
    if had:
        fs.delete(of(f"{aside}.old"), True)


def work_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share; only a local session may go without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="quillspark-")
    return f"{shared}/quillspark-{uuid.uuid4().hex}"
