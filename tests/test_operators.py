"""Operators against plain Python on small tables."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.operators import dedup, metrics, ngrams, profiles, quality, ranking, segments, splits, vocabulary


def manifest(spark, rows):
    d = spark.createDataFrame(rows, "sha256 string, text string, split string, source_row string")
    return d.withColumns({"image": F.concat(F.lit("i"), "source_row"), "language": F.lit("en"), "dataset": F.lit("d"), "source_type": F.lit("real"), "domain": F.lit("print")})


def test_leakage(spark):
    rows = [("a", "x", "train", "9"), ("a", "x", "test", "10"), ("b", "x", "train", "1"), ("b", "y", "train", "2"), ("c", "x", "train", "3"), ("c", "y", "val", "4"), ("d", "z", "val", "9"), ("d", "z", "val", "10"), ("e", None, "train", "1")]
    got = {(r.sha256, r.source_row): (r.status, r.reason) for r in dedup.leakage_resolution(manifest(spark, rows)).collect()}
    assert got["a", "9"] == ("removed", "lower_priority_split_removed") and got["a", "10"] == ("accepted", "")
    assert {got["b", "1"], got["b", "2"]} == {("quarantined", "same_split_conflicting_labels")}
    assert {got["c", "3"], got["c", "4"]} == {("quarantined", "cross_split_conflicting_labels")}
    assert got["d", "10"] == ("accepted", "") and got["d", "9"] == ("removed", "same_split_exact_duplicate_removed")
    assert got["e", "1"][0] == "accepted"


def test_duplicate_report_precedence(spark):
    rows = [("a", "x", "train", "1"), ("a", "y", "test", "2"), ("b", "x|y", "train", "3"), ("b", "z", "train", "4"), ("c", "x", "val", "5"), ("c", "x", "val", "6"), ("d", "x", "val", "7")]
    got = {r.sha256: r for r in dedup.duplicate_report(manifest(spark, rows)).collect()}
    assert {k: r.reason for k, r in got.items()} == {"a": "cross_split_duplicate", "b": "conflicting_label_duplicate", "c": "exact_duplicate"}
    assert got["b"].n_texts == 2 and got["a"].splits == "test|train"


def test_keep_first(spark):
    d = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y"), ("m", 1, None), ("m", 2, None)], "key string, i int, label string")
    got = {(r.key, r.i): r.kind for r in dedup.keep_first(d, ["key"], [F.col("i")], "label").collect()}
    assert got == {("k", 1): "first", ("k", 2): "same_label_duplicate", ("k", 3): "conflicting_duplicate", ("m", 1): "first", ("m", 2): "same_label_duplicate"}


def test_reasons(spark):
    d = spark.createDataFrame([("",), ("a_b",), ("x~@~",), ("fine",)], "t string")
    got = [r.review_reason for r in quality.route(d, quality.reasons_symbols(F.col("t"))).collect()]
    assert got == ["empty_text", "underscore;unusual_symbols:_", "unusual_symbols:@~", ""]
    d = spark.createDataFrame([("٣",), ("abc",)], "t string")
    assert [r.reasons for r in quality.route(d, quality.reasons_script(F.col("t"))).collect()] == [["digit"], ["latin_character"]]
    d = spark.createDataFrame([("a​b", "bad")], "t string, s string")
    assert quality.route(d, quality.reasons_words(F.col("t"), F.col("s"))).head().reasons == ["annotation_status:bad", "control_character:U+200B"]
    with pytest.raises(AssertionError, match="rows left"):
        quality.assert_none(d, "rows left")


def test_schema():
    class T:
        columns = ["a", "B"]

    with pytest.raises(schema.MissingColumns, match="c"):
        schema.assert_columns(T, ["a", "c"])
    assert schema.find_column(T, ["b"]) == "B"


def test_rank_split_is_exact(spark):
    units = spark.range(10).withColumnRenamed("id", "page")
    got = {r.page: r.split for r in splits.rank_split(units, "page").collect()}
    order = sorted(range(10), key=lambda p: (hashlib.sha256(f"42:{p}".encode()).hexdigest(), p))
    assert got == {p: "train" if i < 8 else "val" if i < 9 else "test" for i, p in enumerate(order)}
    assert Counter(r.split for r in splits.rank_split(spark.range(5).withColumnRenamed("id", "page"), "page").collect()) == {"train": 4, "test": 1}


def test_writer_split(spark):
    units = spark.createDataFrame([(f"w{i:02}",) for i in range(12)], "w string")
    got = {r.w: r.split for r in splits.last_units_split(units, "w").collect()}
    assert [got[f"w{i:02}"] for i in range(12)] == ["train"] * 4 + ["val"] * 4 + ["test"] * 4
    with pytest.raises(Exception, match="at least 12 units"):
        splits.last_units_split(units.limit(11), "w").collect()
    with pytest.raises(Exception, match="no split for w"):
        splits.attach_split(units, units.limit(3).withColumn("split", F.lit("x")), "w").collect()


def test_stratified_sample_with_replacement(spark):
    d = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "id int, s string")
    q = spark.createDataFrame([("a", 7), ("b", 2)], "s string, quota bigint")
    got = splits.stratified_sample(d, "s", "id", q).collect()
    assert Counter(r.s for r in got) == {"a": 7, "b": 2}
    assert sorted(Counter(r.id for r in got if r.s == "a").values()) == [2, 2, 3]


def test_global_rank_and_spearman(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20), rng.randint(0, 5), i) for i in range(200)] + [(None, 1, 200)]
    d = spark.createDataFrame(rows, "a int, b int, i int")
    got = {r.i: r["rank"] for r in ranking.global_rank(d.where("a is not null"), [F.col("a"), F.col("i")], F.col("a")).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted((x for x in rows if x[0] is not None), key=lambda r: (r[0], r[2])), 1)}

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    a, b = (ranks([r[k] for r in rows if r[0] is not None]) for k in (0, 1))
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert abs(ranking.spearman(d, "a", "b").head().rho - rho) < 1e-9


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_distances_and_rates(spark):
    rng = random.Random(5)
    texts = ["", "a", "a b", "a  b", "été \U0001f642 x", "b a b"] + [" ".join(rng.choices(["ab", "c", "é", "dd"], k=rng.randint(1, 9))) for _ in range(20)]
    rows = [(r, p) for r in texts for p in rng.sample(texts, 5)]
    d = metrics.with_distances(spark.createDataFrame(rows, "reference string, prediction string")).collect()
    for (r, p), x in zip(rows, d):
        assert x.char_distance == edit(r, p) and x.word_distance == edit(r.split(), p.split())
        assert x.ref_words == len(r.split()) and x.exact == (r == p)
        assert x.spacing_only == (r != p and "".join(r.split()) == "".join(p.split()))
    got = metrics.corpus_metrics(metrics.with_distances(spark.createDataFrame(rows, "reference string, prediction string"))).head()
    assert abs(got.wer - sum(edit(r.split(), p.split()) for r, p in rows) / sum(max(1, len(r.split())) for r, _ in rows)) < 1e-12
    assert spark.range(1).select(metrics.row_rate(F.lit(3), F.lit(0))).head()[0] == 1.0


def test_alignment_prefers_diagonal():
    assert metrics.align(list("ab"), list("b")) == [("delete", "a", ""), ("equal", "b", "b")]
    assert metrics.align(list("a"), list("bc")) == [("insert", "", "b"), ("substitute", "a", "c")]
    for a, b in (("kitten", "sitting"), ("", "x"), ("abc", "")):
        ops = metrics.align(list(a), list(b))
        assert sum(o != "equal" for o, _, _ in ops) == edit(a, b)
        assert "".join(r for _, r, _ in ops) == a and "".join(p for _, _, p in ops) == b


def test_confusions(spark):
    d = spark.createDataFrame([("a b c", "a x c"), ("a b", "a x"), (None, "q")], "reference string, prediction string")
    got = {(r.op, r.ref, r.pred): r.n for r in metrics.confusions(d, "word").collect()}
    assert got == {("substitute", "b", "x"): 2, ("insert", "", "q"): 1}


def test_best_setting_and_impact(spark):
    c = spark.createDataFrame([(1, "x", 0.0, 0.0, 1), (1, "y", -1.0, 2.0, 1)], "id int, candidate string, acoustic double, lm double, n_words int")
    g = spark.createDataFrame([("s0", 0.0, 0.0), ("s1", 1.0, 0.0)], "setting string, lm_weight double, word_bonus double")
    assert {r.setting: r.candidate for r in metrics.best_setting(c, g, "id").collect()} == {"s0": "x", "s1": "y"}


def test_ngrams(spark):
    texts = [("g", 1, "abab"), ("g", 2, ""), ("h", 3, "zz")]
    d = spark.createDataFrame(texts, "g string, id int, text string")
    model = ngrams.fit(d.where("g = 'g'"), "g", 3)
    counts = Counter()
    for t in ("abab", ""):
        s = ngrams.BOS * 2 + t + ngrams.EOS
        for i in range(2, len(s)):
            for n in range(3):
                counts[s[i - n : i], s[i]] += 1
    assert {(r.ctx, r.tok): r.n for r in model.collect()} == counts
    v = len({t for c, t in counts if c == ""})
    got = {r.id: r.log_prob for r in ngrams.score(d, model, "g", "id").collect()}
    want = 0.0
    s = ngrams.BOS * 2 + "abab" + ngrams.EOS
    for i in range(2, len(s)):
        ctx = next(s[i - n : i] for n in (2, 1, 0) if any(c == s[i - n : i] for c, _ in counts))
        total = sum(x for (c, _), x in counts.items() if c == ctx)
        want += math.log((counts[ctx, s[i]] + 0.1) / (total + 0.1 * v))
    assert abs(got[1] - want) < 1e-9 and got[3] == 0.0


def test_vocabulary(spark):
    d = spark.createDataFrame([(1, "ba"), (2, ""), (3, None)], "id int, text string")
    v = vocabulary.vocabulary(d)
    assert [(r.ch, r.idx) for r in v.orderBy("idx").collect()] == [("a", 1), ("b", 2)]
    m = vocabulary.vocabulary_map(v).head()
    assert m.char_to_index == {"a": 1, "b": 2} and m.num_classes == 3 and m.blank_index == 0
    other = spark.createDataFrame([(7, "bca"), (8, "xax")], "id int, text string")
    assert {r.id: (r.oov_characters, r.accepted) for r in vocabulary.oov_split(other, v, "id").collect()} == {7: ("c", False), 8: ("x", False)}


def test_segments(spark):
    rows = [(1, "70691 First one. 70692  Second  in 1979 ."), (2, "no ids here"), (3, "before 12345 after"), (4, None), (5, "36 She was tall. 70692 Next"), (6, "12345 1234567 "), (7, "12345 one 123456789 two 54321")]
    d = spark.createDataFrame(rows, "id int, raw string")
    of = lambda d: {r.id: (r.status, [(s.record_id, s.text) for s in r.segments]) for r in d.collect()}
    assert of(segments.parse_records(d, "raw")) == {
        1: ("parsed", [("70691", "First one."), ("70692", "Second in 1979 .")]),
        2: ("no_record_ids", [("", "no ids here")]),
        3: ("text_before_first_id", [("", "before 12345 after")]),
        4: ("no_record_ids", []),
        5: ("text_before_first_id", [("", "36 She was tall. 70692 Next")]),
        6: ("parsed", [("12345", "1234567")]),
        7: ("parsed", [("12345", "one 123456789 two 54321")]),
    }


def test_repaired_segments(spark):
    rows = [(1, "70691 First. 1979  Second 70692 Third"), (2, "36 She was tall. 70692 \u201cNext\u201d 70693 (Last)"), (3, "7 Alone"), (4, None), (5, "Before: 12345 After"), (6, "123 12345 After"), (7, "12345 after. 1234 Then")]
    d = segments.repair_records(spark.createDataFrame(rows, "id int, raw string"), "raw")
    got = {r.id: (r.status, [(s.record_id, s.text) for s in r.segments], r.residual_boundary_id, r.starts_with_number, r.needs_review) for r in d.collect()}
    assert got == {
        1: ("record_ids_removed", [("70691", "First."), ("1979", "Second 70692 Third")], False, False, False),
        2: ("leading_short_id_removed+record_ids_removed", [("36", "She was tall."), ("70692", "\u201cNext\u201d"), ("70693", "(Last)")], False, False, False),
        3: ("short_leading_id_removed", [("7", "Alone")], False, False, False),
        4: ("no_ids_found", [("", "")], False, False, True),
        5: ("unnumbered_prefix_preserved+record_ids_removed", [("", "Before:"), ("12345", "After")], False, False, False),
        6: ("no_ids_found", [("", "123 12345 After")], False, True, True),
        7: ("unnumbered_prefix_preserved+record_ids_removed", [("", "12345 after."), ("1234", "Then")], False, True, True),
    }


def test_running_best(spark):
    d = spark.createDataFrame(list(enumerate([5.0, 6.0, 4.0, 4.0, 4.5, 1.0])), "epoch int, loss double")
    got = [(r.improved, r.bad_rows) for r in profiles.running_best(d, "epoch", "loss").orderBy("epoch").collect()]
    assert got == [(True, 0), (False, 1), (True, 0), (False, 1), (False, 2), (True, 0)]


def test_characters_are_counted_within_tasks(spark):
    rows = [(None,), ("",), ("aé\U0001f642a",), ("\n a",)] + [("b" * 10_000,)] * 3
    d = spark.createDataFrame(rows, "text string")
    assert {r.ch: r.n for r in vocabulary.char_inventory(d).collect()} == {"a": 3, "é": 1, "\U0001f642": 1, "\n": 1, " ": 1, "b": 30_000}
    assert vocabulary.char_inventory(d.limit(0)).count() == 0
    assert [(r.ch, r.idx) for r in vocabulary.vocabulary(d).orderBy("idx").collect()] == [(c, i) for i, c in enumerate("\n abé\U0001f642", 1)]
