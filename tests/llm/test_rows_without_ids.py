"""Rows whose doc_id is missing or repeats are judged by themselves."""

from collections import Counter

import corpus_pipeline as c
from quillspark.llm import partenum as p

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n=40):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{j % 2}", len(t or "")) for j, (i, t) in enumerate(rows)], SCHEMA)


def test_near_duplicates_keeps_what_is_no_copy(spark):
    alone = [(None, words(i)) for i in range(6)] + [(7, words("a")), (7, words("b")), (-5, words("m"))]
    blank = [(None, ""), (None, " \n"), (None, None), (8, "")]
    copies = [(9, words(0)), (None, words(0)), (None, words("c")), (None, words("c")), (7, words("b")), (4, words("d")), (3, words("d") + " end"), (None, words("d")), (-6, words("m"))]
    got = c.near_duplicates(spark, docs(spark, alone + blank + copies), "")
    assert got.columns == c.COLUMNS
    want = [*alone[1:-1], (9, words(0)), *blank, (None, words("c")), (3, words("d") + " end"), (-6, words("m"))]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_repeated_passages_needs_no_unique_id(spark):
    passage = words("p", c.PASSAGE)
    rows = [(None, "one " + passage), (None, passage + " two"), (5, words(1)), (5, words(2)), (5, "three " + passage), (None, words(3) + "  " + words(4)), (None, None), (None, "")]
    got = c.repeated_passages(spark, docs(spark, rows), "")
    assert got.columns == c.COLUMNS
    want = [(None, "one"), (None, "two"), (5, words(1)), (5, words(2)), (5, "three"), rows[5], (None, None), (None, "")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_component_is_the_least_real_doc_id(spark):
    rows = [(8, words(1)), (9, words(1)), (None, words(1)), (None, words(2)), (None, words(2)), (-3, words(3)), (4, words(3)), (None, words(3) + " end"), (6, words(4)), (5, words(4)), (-7, "")]
    got = p.jaccard_components(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(8, 8), (9, 8), (-3, -3), (4, -3), (6, 5), (5, 5), (-7, -7)] + [(None, None)] * 4)
