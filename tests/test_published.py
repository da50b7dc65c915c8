"""Tables swapped as a whole, installs that are repeated, packages without two files of one name."""

import pytest
from pyspark.sql import functions as F

from quillspark import published as P


def folders(path):
    return sorted(p.name for p in (path / "parts").iterdir()), sorted(p.name for p in (path / "versions").iterdir() if p.suffix == ".json")


def test_readers_see_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.published(spark, path)
    P.publish(spark.range(3), path)
    for n in (5, 7):
        opened = P.published(spark, path)
        before = opened.count()
        P.publish(spark.range(n), path)
        assert opened.count() == before and P.published(spark, path).count() == n  # the version that was opened is still whole
    for n in range(10, 16):
        P.publish(spark.range(n), path)
    parts, versions = folders(tmp_path / "t")
    assert len(parts) == len(versions) == P.KEEP and P.published(spark, path).count() == 15


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(spark.range(3), path)
    with pytest.raises(Exception, match="stop"):
        P.publish(spark.range(1).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id")), path)
    assert P.published(spark, path).count() == 3 and len(folders(tmp_path / "t")[1]) == 1


KIND = "target string, content binary"


def test_installs_copy_once_and_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "files")
    files = spark.createDataFrame([(f"a/{i}", f"c{i}".encode()) for i in range(20)] + [("a/1", b"c1"), ("none", None)], KIND)
    first = {r.target: r.status for r in P.install(files.where("target <> 'a/19'"), path).collect()}
    assert set(first.values()) == {"copied"} and len(first) == 20
    second = {r.target: r.status for r in P.install(files, path).collect()}
    assert {t for t, s in second.items() if s == "copied"} == {"a/19"} and len(second) == 21
    before = folders(tmp_path / "files")
    assert {r.status for r in P.install(files, path).collect()} == {"existing"} and folders(tmp_path / "files") == before
    for bad in ([("a/2", b"other")], [("new", b"x"), ("new", b"y")], [(None, b"x")]):
        with pytest.raises(P.Conflict):
            P.install(spark.createDataFrame([*bad, ("fine", b"f")], KIND), path)
    assert folders(tmp_path / "files") == before
    assert {r.target: r.content for r in P.published(spark, path).collect()} == {"none": b"", **{f"a/{i}": f"c{i}".encode() for i in range(20)}}
    assert P.install(files.limit(0), path).count() == 0


def test_package_names(spark):
    files = spark.createDataFrame([("p", "a/x.png"), ("p", "a/x.png"), ("q", "b/x.png"), ("p", "c\\y.png")], "package string, path string")
    assert sorted((r.package, r.name) for r in P.package_names(files, "path", "package").collect()) == [("p", "x.png"), ("p", "x.png"), ("p", "y.png"), ("q", "x.png")]
    clash = files.union(spark.createDataFrame([("q", "z/x.png")], files.schema))
    with pytest.raises(Exception, match="one name for"):
        P.package_names(clash, "path", "package").collect()
