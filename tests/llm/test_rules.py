import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import rules

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(hit)


def test_counts(spark, corner_docs, documents):
    for docs in (corner_docs, documents.select("doc_id", "text")):
        for r in rules.with_counts(docs.withColumn("n_words", F.lit("clash"))).collect():
            assert tuple(r[c] for c in rules.BASE) == brute(r.text), r.doc_id


def test_learning_finds_a_conjunction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.3)
    found = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= rules._covered(r, x, 3000)
    assert (hit == bad).mean() > 0.99 and all(c.feature != "noise" for r in found for c in r[:2])
    assert rules.learn(x, np.zeros(3000, bool)) == [] and rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_verdict_is_ordered(spark):
    first, second = (rules.Condition("words", True, 30.0),), (rules.Condition("words", True, 10.0),)
    d = spark.createDataFrame([(5,), (20,), (40,)], "n_words bigint")
    d = d.withColumns({c: F.lit(1) for c in ["word_chars", "n_symbols"]})
    assert [r[0] for r in d.select(rules.verdict([first, second])).collect()] == [0, 2, 1]


def test_quality(spark, corner_docs, no_docs):
    """On the middle scale, whose labels are enough to learn from."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.quality(documents.select("doc_id", "text"), labels)
    rows = judged.join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in judged.collect())
    none = rules.quality(corner_docs, labels.limit(0))
    assert none.count() == corner_docs.count() and none.where("kept AND base_failed").count() == 0
    assert all(r.kept for r in rows if r.quality == 1)
    assert rules.quality(no_docs, labels).count() == 0


def test_rules_are_learned_at_every_scale(spark, documents):
    """Even 80 labels give a rule; the verdict of every document is the list's, read row by row."""
    from .conftest import SF

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = rules.learn_from(documents, labels)
    assert learned
    got = rules.apply_rules(documents.withColumns({"kept": F.lit(1), "rule": F.lit("x")}), learned).collect()
    assert len(got) == documents.count()
    for r in got:
        n, chars, symbols, dup, repeat = brute(r.text)
        failed = n < 20 or 100 * repeat > 30 * n
        number = 0
        if n:
            of = {"mean_word_chars": chars / n, "symbols_per_word": symbols / n, "marks_per_word": r.n_marks / n, "digits_per_word": r.n_digits / n, "upper_share": r.n_upper / max(r.n_letters, 1), "distinct_share": r.n_distinct / n, "most_common_share": r.most_common / n, "dup_line_share": dup / max(r.n_lines, 1), "repeat_share": repeat / n, "words": float(n)}
            fits = [all(of[c.feature] > c.cut if c.above else of[c.feature] <= c.cut for c in rule) for rule in learned]
            number = next((i for i, f in enumerate(fits, 1) if f), 0)
        assert (r.base_failed, r.rule, r.kept) == (failed, number, not failed and not number), r.doc_id


def test_a_rule_must_shorten_the_description():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(400), "b": rng.random(400)}
    assert rules.learn(x, rng.random(400) < 0.1) == []  # labels without any pattern
    few = np.zeros(60, bool)
    few[:6] = True
    found = rules.learn({"a": np.concatenate([np.full(6, 0.9), np.linspace(0, 0.5, 54)])}, few)
    assert len(found) == 1 and found[0][0].above and 0.5 <= found[0][0].cut < 0.9


def test_an_id_of_many_rows_stays_within_the_bound(spark, monkeypatch):
    """One labelled id has 500 rows; no more than the bound are learned from."""
    monkeypatch.setattr(rules, "MAX_LABELLED", 40)
    docs = spark.range(500).selectExpr("CAST(IF(id < 470, 1, id) AS BIGINT) AS doc_id", "array_join(transform(sequence(1, 30), i -> concat('w', i * (id + 1))), ' ') AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").distinct()
    seen = []
    monkeypatch.setattr(rules, "learn", lambda x, bad: seen.append(len(bad)) or [])
    assert rules.learn_from(docs, labels) == [] and seen == [40]
