"""Manifests' ordinals, replaced tables, ids and paths in their corners."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import text as T
from quillspark.operators import metrics, splits
from quillspark.sources import manifests


def test_rows_are_numbered_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\nx,"one\ntwo"\ny,"say ""hi"""\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,text\nz,\n", encoding="utf-8")
    d = manifests.numbered_manifest(spark, str(tmp_path), ["id", "text"])
    assert sorted((r.file.rsplit("/", 1)[1], r.row, r.id, r.text) for r in d.collect()) == [("a.csv", 2, "x", "one\ntwo"), ("a.csv", 3, "y", 'say "hi"'), ("b.csv", 2, "z", "")]


def test_replace_leaves_the_old_rows_when_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    bad = spark.range(1).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.replace(bad, path)
    assert spark.read.parquet(path).count() == 3
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []


def test_page_and_word(spark):
    d = spark.createDataFrame([("12_7",), ("x_1",), ("1_2_3",), (" 1_2",), ("1_2\n",), (None,), ("",)], "id string")
    got = [(r.p.page_id, r.p.word_index, r.p.error is None) for r in d.select(T.page_and_word(F.col("id")).alias("p")).collect()]
    assert got[0] == (12, 7, True) and got[1:4] == [(None, None, False)] * 3 and got[5:] == [(None, None, False)] * 2


def test_first_existing(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string")
    rows = spark.createDataFrame([(1, "x", "b"), (2, "a", "b"), (3, "x", "y"), (4, None, None)], "id int, p string, q string")
    assert {r.id: r.found for r in manifests.first_existing(rows, ["p", "q"], files).collect()} == {1: "b", 2: "a", 3: None, 4: None}


def test_compression_metrics_of_nothing(spark):
    d = spark.createDataFrame([(None, 0, 0, "k")], "w int, s int, n int, g string")
    rows = {r.dimension: r for r in metrics.compression_metrics(d, ["g"], "w", "s", "n").collect()}
    assert rows["overall"].samples == rows["g"].samples == 1 and rows["g"].value == "k" and rows["overall"].mean_steps_per_char is None and rows["g"].no_width == 1


def test_nfc_only_touches_what_may_change(spark):
    d = spark.createDataFrame([("plain",), ("é",), ("é",), ("Å",), (None,), ("가",)], "t string")
    assert [r[0] for r in d.select(T.nfc(F.col("t"))).collect()] == ["plain", "é", "é", "Å", None, "가"]


def test_archives_batches_and_marks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("a.txt", b"x"), ("b.txt", None)]), (2, []), (3, None)], "id int, m array<struct<name: string, content: binary>>")
    made = rows.select("id", sinks.zipped(F.col("m")).alias("z"))
    got = {r.id: r.z for r in made.collect()}
    assert got[3] is None and got[1] == {r.id: r.z for r in made.collect()}[1]
    with zipfile.ZipFile(io.BytesIO(got[1])) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"x", "b.txt": b""}
    assert zipfile.ZipFile(io.BytesIO(got[2])).namelist() == []
    d = spark.createDataFrame([(0, [1, 2]), (0, None), (0, [5, 6, 7]), (1, [9])], "batch int, ids array<int>")
    assert sorted((r.batch, r.ids, r.length) for r in splits.padded(d, "batch", "ids").collect()) == [(0, [0, 0, 0], 0), (0, [1, 2, 0], 2), (0, [5, 6, 7], 3), (1, [9], 1)]
    sinks.write_csv(d.select("batch"), str(tmp_path / "c"), ["batch"], mark=True)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfbatch") for p in (tmp_path / "c").glob("*.csv"))
