"""Each stage on what its predecessor kept, against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from quillspark.llm import rules

from .conftest import SF
from .test_partenum import brute as near_brute


def test_stages(spark, documents, tmp_path):
    docs, outs = documents, {}
    for name, stage in c.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        outs[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != c.STAGES[-1][0]:
            assert docs.columns == documents.columns
    kept = {r.doc_id for r in rules.quality(documents, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in outs["quality_rules"].collect()} == kept
    rows = sorted((r.doc_id, r.text) for r in outs["quality_rules"].collect())
    want = {i for i, (_, comp) in near_brute(rows, c.NEAR_WIDTH, c.NEAR_PERCENT).items() if comp == i}
    near = {r.doc_id: r.text for r in outs["near_duplicates"].collect()}
    assert set(near) == want
    words = {i: (t or "").encode().split() for i, t in near.items()}
    n = Counter(tuple(w[i : i + c.PASSAGE]) for w in words.values() for i in range(len(w) - c.PASSAGE + 1))
    for r in outs["repeated_passages"].collect():
        w = words[r.doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - c.PASSAGE + 1):
            if n[tuple(w[i : i + c.PASSAGE])] > 1:
                gone[i : i + c.PASSAGE] = [True] * c.PASSAGE
        assert r.text == (b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else near[r.doc_id])
        assert r.n_chars == len(r.text)
    passages = {r.doc_id: r.text for r in outs["repeated_passages"].collect()}
    assert all(r.text in passages[r.doc_id] for r in outs["mixed_sources"].collect())
    pieces = outs["sampled_pieces"].collect()
    assert all(r.round_trip for r in pieces) and Counter(r.doc_id for r in pieces if r.sample == 0) == Counter(r.doc_id for r in outs["mixed_sources"].collect())
    assert {r.sample for r in pieces} == {0, 1}


def rich(i, n=60):
    return " ".join(f"w{i}x{j}y" for j in range(n))


def test_run_on_corners(spark, corner_docs, tmp_path):
    """One source, so that the mix takes every document: what is left is known."""
    passage = " ".join(f"pass{j}" for j in range(c.PASSAGE + 5))
    rows = [(1, rich(1)), (2, rich(2)), (3, rich(2)), (None, rich(3)), (None, rich(4)), (5, rich(5)), (5, rich(6)), (-7, rich(7)), (8, rich(7) + " end"), (9, passage + " " + rich(9, 30)), (10, rich(10, 30) + " " + passage), (11, rich(11)), (11, rich(11))]
    kept = [(1, rich(1)), (2, rich(2)), (None, rich(3)), (None, rich(4)), (5, rich(5)), (5, rich(6)), (-7, rich(7)), (9, rich(9, 30)), (10, rich(10, 30)), (11, rich(11))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = {x: F.lit(7) for x in ("kept", "rule", "n_words", "size", "start", "target", "component", "_row", "_node", "hits", "ord")}
    docs.union(corner_docs.select(*docs.columns[:3], F.lit("s").alias("source"), "n_chars")).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    mix = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in c.STAGES[:4]:
        mix = stage(spark, mix, str(tmp_path))
        assert mix.columns == [*docs.columns, *clash]
    mix = mix.collect()
    words = lambda found: Counter((i, w) for i, w in found)
    want = words((i, w) for i, t in kept for w in t.split())
    got = words((r.doc_id, w) for r in mix for w in r.text.split())
    assert set(got) == set(want) and all(n <= got[x] <= 2 * n for x, n in want.items()) and all(r[x] == 7 for r in mix for x in clash)
    pieces = c.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.sample == 0) == Counter(r.doc_id for r in mix) and all(r.round_trip for r in pieces)


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_with_columns_that_have_no_order(spark):
    """Maps and variants can't be compared; of rows alike in doc_id and text one stays all the same."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long, {"a": 1}), (1, long, {"a": 2}), (2, long, {}), (3, "something else altogether that nobody copied at all", None), (4, None, {"b": 1})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, meta map<string,int>")
    for d in (docs, docs.withColumn("meta", F.parse_json(F.to_json("meta")))):
        got = c.near_duplicates(spark, d, SF)
        assert got.columns == ["doc_id", "text", "meta"] and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
