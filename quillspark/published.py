"""Tables that are swapped as a whole without a gap, and installs that can be repeated.

A published table is a folder of parts (Parquet) and of versions, small files that
each name the parts they consist of. A version appears by one rename, when its parts
are whole; readers take the greatest. So a reader sees one whole version at any
moment, and never none. A few versions stay for readers that are still at it.
One publisher works on a table at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, the newest included.
KEEP = 3


class Conflict(ValueError):
    """A target is there with other content, or is wanted with several contents."""


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._of(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def versions(self) -> list[str]:
        return [n for n in self.names("versions") if n.endswith(".json")]

    def parts(self, version: str) -> list[str]:
        stream = self.fs.open(self.at(f"versions/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> list[str]:
        found = self.versions()
        return self.parts(found[-1]) if found else []

    def write(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/parts/{part}")
        return part

    def swap(self, parts: list[str]) -> None:
        """Make ``parts`` the newest version, then drop what only versions beyond KEEP name."""
        found = self.versions()
        name = f"{int(found[-1].split('.')[0]) + 1 if found else 1:010d}.json"
        aside = self.at(f"{uuid.uuid4().hex}.new")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        self.fs.mkdirs(self.at("versions"))
        if self.fs.exists(self.at(f"versions/{name}")) or not self.fs.rename(aside, self.at(f"versions/{name}")):
            self.fs.delete(aside, False)
            raise OSError(f"another publisher has made version {name} of {self.path}")
        found = self.versions()
        for old in found[:-KEEP]:
            self.fs.delete(self.at(f"versions/{old}"), False)
        used = {p for v in found[-KEEP:] for p in self.parts(v)}
        for part in set(self.names("parts")) - used:
            self.fs.delete(self.at(f"parts/{part}"), True)


def publish(df: DataFrame, path: str) -> None:
    """Make ``df`` the table at ``path``. A write that fails leaves the version before."""
    folder = _Folder(df.sparkSession, path)
    folder.swap([folder.write(df)])


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table at ``path``, as it is now; later versions don't change it."""
    folder = _Folder(spark, path)
    parts = folder.current()
    if not parts:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(*(f"{folder.path}/parts/{p}" for p in parts))


def install(files: DataFrame, path: str) -> DataFrame:
    """Install ``files`` (target, content) in the table at ``path``: ``target, status``, copied or existing.

    A target that is there with the same content is existing and isn't copied, so a
    rerun copies nothing and makes no version. One with other content, or wanted with
    several, raises Conflict before anything is written. Targets that are null raise,
    null contents are empty, equal rows are one. Only hashes are compared.
    """
    spark = files.sparkSession
    folder = _Folder(spark, path)
    content = F.coalesce("content", F.lit("").cast("binary"))
    wanted = files.select("target", content.alias("content"), F.sha2(content, 256).alias("sha256"))
    have = published(spark, path).select("target", F.col("sha256").alias("_have")) if folder.current() else spark.createDataFrame([], "target string, _have string")
    plan = wanted.groupBy("target").agg(F.min("sha256").alias("sha256"), (F.min("sha256") != F.max("sha256")).alias("_several")).join(have, "target", "left")
    status = F.when(F.col("target").isNull() | F.col("_several") | (F.col("_have") != F.col("sha256")), "conflict").when(F.col("_have").isNotNull(), "existing").otherwise("copied")
    plan = plan.select("target", "sha256", status.alias("status"))
    counts = {r["status"]: r for r in plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("example")).collect()}
    if "conflict" in counts:
        raise Conflict(f"{counts['conflict']['n']} targets conflict, such as {counts['conflict']['example']}")
    if "copied" not in counts:
        return plan.select("target", "status")
    new = wanted.join(plan.where("status = 'copied'").select("target"), "target", "left_semi").dropDuplicates(["target"])
    before, part = folder.current(), folder.write(new)
    statuses = plan.select("target", "status").where("status = 'existing'").union(spark.read.parquet(f"{folder.path}/parts/{part}").select("target", F.lit("copied").alias("status")))
    folder.swap([*before, part])
    return statuses


def package_names(files: DataFrame, path: str, package: str, name: str = "name") -> DataFrame:
    """Add ``name``, the last part of each path; a name that two paths of one package share raises when rows are read."""
    from .functions.text import filename, portable_path
    from .operators.dedup import identity
    from .operators.skew import attach

    d = files.withColumn(name, filename(portable_path(F.col(path)))).withColumn("_key", F.struct(*identity(F.col(package), F.col(name))))
    per = d.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(path).alias("_least"), F.max(path).alias("_most"))
    d = attach(d, per, "_key", "_n")
    clash = F.raise_error(F.concat(F.lit("one name for "), F.col("_least"), F.lit(" and "), F.col("_most"))).cast("string")
    checked = F.when(F.col("_least") != F.col("_most"), clash).otherwise(F.col(name))
    return d.select(*(F.col(f"`{c}`") for c in files.columns), checked.alias(name))
