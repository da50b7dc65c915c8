"""Edge cases of the text and number functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numeric as N
from quillspark.functions import text as T


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column).head()[0]


def test_normalize(spark):
    raw = "  é​⁦  \tbé﻿ \n"
    assert one(spark, T.normalize(F.col("t")), t=raw) == "é bé"
    for ch in T.INVISIBLE:
        assert one(spark, T.normalize(F.col("t")), t=f"a{ch}b") == "ab"
    assert len(T.INVISIBLE) == 14 and all(unicodedata.category(c) == "Cf" for c in T.INVISIBLE)
    assert one(spark, T.normalize(F.col("t").cast("string")), t=None) == ""
    assert one(spark, T.normalize_weak(F.col("t")), t=" é  b ") == "é  b"


def test_language_and_script(spark):
    for raw, want in (("Arabic", "ar"), ("en-US", "en"), (" ENG ", "en"), ("fr", "fr"), ("", "")):
        assert one(spark, T.language_code(F.col("t")), t=raw) == want
    score = T.script_score(F.col("t"), F.lit("ar"), F.lit("real"), F.lit("handwriting"))
    assert one(spark, score, t="س x") == 111
    assert one(spark, score, t="abc") == 11


def test_characters(spark):
    assert one(spark, T.codepoint_label(F.col("t")), t="\U0001f642") == "U+1F642"
    assert one(spark, T.codepoint_label(F.col("t")), t="a") == "U+0061"
    assert one(spark, T.adjacent_repeats(F.col("t")), t="aabbb \n\n\U0001f642\U0001f642") == 5
    assert one(spark, T.adjacent_repeats(F.col("t")), t="") == 0
    assert one(spark, T.text_type(F.col("t")), t="12/3") == "numeric_like"
    assert one(spark, T.text_type(F.col("t")), t="word") == "single_word"
    assert one(spark, T.text_type(F.col("t")), t="two words") == "multi_word"


def test_paths(spark):
    assert one(spark, T.portable_path(F.col("t")), t=".\\./a\\b.PNG") == "a/b.PNG"
    assert one(spark, T.portable_path(F.col("t")), t="./../x") == "../x"
    assert one(spark, T.extension(F.col("t")), t="x/y.Tar.GZ") == ".gz"
    assert one(spark, T.extension(F.col("t")), t="x.d/y") == ""
    assert one(spark, T.stem(F.col("t")), t="x/y.a.png") == "y.a"
    assert one(spark, T.shape(F.col("t")), t="ab12_c3") == "<A><N>_<A><N>"
    assert one(spark, T.safe_suffix(F.col("t")), t=".exe") == ".png"


def test_collapse_and_encode(spark):
    assert one(spark, T.collapse_runs(F.array(*map(F.lit, [0, 3, 3, 0, 3, 5, 5, 0])))) == [3, 3, 5]
    vocab = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, T.encode(F.col("t"), vocab), t="abba") == [1, 2, 2, 1]
    with pytest.raises(Exception, match="unknown character U\\+0063"):
        one(spark, T.encode(F.col("t"), vocab), t="abc")


@pytest.mark.parametrize(("x", "want"), [(0, "<=5"), (5, "<=5"), (6, "(5,10]"), (10, "(5,10]"), (11, "(10,20]"), (80, "(40,80]"), (81, ">80")])
def test_buckets_are_right_closed(spark, x, want):
    assert one(spark, N.buckets(F.col("x"), N.LENGTH_EDGES), x=x) == want


def test_rounding_is_half_even(spark):
    assert one(spark, N.resized_width(F.lit(5), F.lit(2), 1, 100)) == 2
    assert one(spark, N.resized_width(F.lit(7), F.lit(2), 1, 100)) == 4
    assert one(spark, N.resized_width(F.lit(0), F.lit(2), 1, 100)) == 1
    assert one(spark, N.resized_width(F.lit(9999), F.lit(1), 1, 100)) == 100
    assert one(spark, N.timesteps(F.lit(3))) == 1
    assert [one(spark, N.quota(F.lit(11), F.lit(3), F.lit(i))) for i in range(3)] == [4, 4, 3]
    assert abs(one(spark, N.log_add(F.array(F.lit(-1000.0), F.lit(-1000.0)))) + 999.306853) < 1e-5
