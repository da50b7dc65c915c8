import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, toxicity

from .conftest import SF


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(0)
    plain = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 8))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        t = rng.choices(plain, k=rng.randint(20, 120))
        if i % 5 == 0:
            t[rng.randrange(len(t))] = rng.choice(["wretched", "blockhead", "scoundrel"])
        texts.append(" ".join(t))
        toxic.append(i % 5 == 0)
    model = toxicity.fit(texts, np.array(toxic))
    cache = toxicity._Scores(model)
    score = lambda t: toxicity.score(t, model, cache)
    base = " ".join(rng.choices(plain, k=60))
    assert score(base) < 0.5 < score(base + " blockhead") and score(base + " scoundrels,") > 0.5
    assert model.word("blokkhead") > np.percentile([model.word(w) for w in plain], 99)
    assert score(None) == score("") == 0.0
    repeat = "tiresome " * 200
    assert score(repeat) < 0.5


def test_toxicity_query(spark, documents, corner_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_from(documents, labels)
    got = toxicity.scored(corner_docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == corner_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id) for r in got)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.toxicity(documents.limit(5), labels.limit(0)).where("predicted = 1").count() == 0


def test_language_held_out_accuracy(documents):
    model = language.fit_from(documents)
    rows = language.predicted(documents, model).join(documents, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    assert 0 < model.temperature < 64 and (model.w == 0).mean() > 0.3


def test_language_corners(corner_docs, no_docs):
    got = {(r.doc_id, r.held_out): r for r in language.language_id(corner_docs).collect()}
    assert all(k[1] == held_out(k[0]) for k in got)
    for i in (0, 1, 2, 9):
        assert got[i, held_out(i)].lang_pred == "und" and got[i, held_out(i)].score == 0.0
    assert got[4, held_out(4)].lang_pred == "en"
    assert language.language_id(no_docs).count() == 0


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(600):
        c = i % 2
        at = np.unique(np.concatenate([[c], rng.integers(10, 400, 8)]))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
        y.append(c)
    w = language.ftrl(rows, np.array(y), 2)
    assert w[0, 0] > 0 > w[1, 0] and (w[500:] == 0).all()
    logits = np.array([[4.0, 0.0]] * 100)
    t = language.temperature(logits, np.array([0] * 75 + [1] * 25))
    assert t == pytest.approx(4 / np.log(3), rel=0.05)


def test_letters():
    assert not any(language.has_letter(t) for t in ("½ ² ① 3", "", "12 !?", "१२", "_")) and all(language.has_letter(t) for t in ("1 a", "½é", "ß", "你", "ªb"))
    model = language.Model(["en"], np.ones(language.FEATURES), np.zeros((language.FEATURES, 1)), 1.0)
    assert model.predict("½ ²") == ("und", 0.0)


def test_fits_take_a_bounded_number_of_rows(spark):
    """An id may have very many rows: the bound counts rows."""
    ids = [i for i in range(40) if not held_out(i)][:6]
    docs = spark.createDataFrame([(ids[0], f"text {i}", "en") for i in range(50)] + [(i, "autre texte", "fr") for i in ids], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 0, None) for i in ids], "doc_id bigint, toxic int, quality double")
    assert language.chosen(docs, 5).count() == 5 and language.chosen(docs, 1000).count() == 56
    assert toxicity.chosen(docs, labels, 5).count() == 5 and toxicity.chosen(docs, labels).count() == 56
    one_each = docs.where("lang = 'fr'")
    least = {r.doc_id for r in one_each.orderBy(F.xxhash64("doc_id")).limit(3).collect()}
    assert {r.doc_id for r in language.chosen(one_each, 3).collect()} == {r.doc_id for r in toxicity.chosen(one_each, labels, 3).collect()} == least


def plain_grams(w):
    w = "<" + w.strip(".,;:!?()[]\"\u2019\u2018«»*_-'") + ">"
    parts = {w}
    for n in (3, 4, 5):
        parts |= {w[i : i + n] for i in range(len(w) - n + 1)}
    return [zlib.crc32(p.encode()) % toxicity.BUCKETS for p in parts]


def test_toxicity_scores_match_brute_force(spark, documents, corner_docs):
    """The mean over the n-grams of all distinct words that the dictionary has, a zero vector among them."""
    rng = np.random.default_rng(3)
    numbers = np.where(rng.random(toxicity.BUCKETS) < 0.02, rng.normal(0, 3, toxicity.BUCKETS), np.nan)
    model = toxicity.Model(numbers, -1.5)

    def plain(text):
        words = set((text or "").lower().split())
        if not words:
            return 0.0
        total, share = 0.0, 1.0
        for w in words:
            own = plain_grams(w)
            for g in own:
                if not np.isnan(numbers[g]):
                    total, share = total + numbers[g] / len(own), share + 1 / len(own)
        return 1 / (1 + np.exp(1.5 - total / share))

    docs = documents.select("doc_id", "text").union(corner_docs.select("doc_id", "text"))
    texts = sorted((r.doc_id is not None, r.doc_id or 0, round(plain(r.text), 4)) for r in docs.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 4)) for r in toxicity.scored(docs, model).collect())
    assert [g[:2] for g in got] == [t[:2] for t in texts]
    assert np.abs(np.array([g[2] for g in got]) - np.array([t[2] for t in texts])).max() <= 2e-4


def test_toxicity_fit_from_tables_is_the_fit_of_its_texts(spark, documents):
    """Bags, counts and dictionary by Spark against the same in one process; reruns agree."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = sorted((p, r.toxic, r.text) for r, p in ((r, r.p) for r in toxicity.chosen(documents, labels).withColumn("p", F.xxhash64("doc_id", "text")).collect()))
    here = toxicity.fit([t for _, _, t in rows], np.array([y == 1 for _, y, _ in rows]))
    one, two = toxicity.fit_from(documents, labels), toxicity.fit_from(documents, labels)
    assert one.kept.keys() == here.kept.keys() and one.bias == two.bias and one.kept == two.kept
    assert one.bias == pytest.approx(here.bias, rel=1e-3) and len(one.kept) > 0
    assert np.allclose([one.kept[k] for k in one.kept], [here.kept[k] for k in one.kept], rtol=1e-2, atol=1e-3)


def test_toxicity_bags_and_dictionary_against_plain_counts():
    for text in (None, "", "a", "Same same, SAME.", "moron  loser\nmoron"):
        want = {}
        for w in set((text or "").lower().split()):
            for g in plain_grams(w):
                want[g] = want.get(g, 0) + 1 / len(plain_grams(w))
        at, share = toxicity.bag(text)
        assert at.tolist() == sorted(want) and np.allclose(share, [want[g] for g in sorted(want)])
    present = np.zeros((2, toxicity.BUCKETS), int)
    present[:, 7], present[:, 9], present[:, 11] = (2, 30), (50, 25), (0, 6)
    assert toxicity.dictionary(present, np.array([100, 50])).tolist() == [7, 11]
    assert toxicity.dictionary(present * 0, np.array([0, 0])).tolist() == []


def test_ftrl_matches_plain_coordinates():
    """Against the update of each coordinate by itself, in plain Python."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(30, 6, False)), rng.random(6)) for _ in range(60)]
    y, k = rng.integers(0, 3, 60), 3
    z, n = {}, {}

    def weight(f, c):
        zz = z.get((f, c), 0.0)
        if abs(zz) <= language.L1:
            return 0.0
        return -(zz - np.sign(zz) * language.L1) / ((language.BETA + n.get((f, c), 0.0) ** 0.5) / language.ALPHA + language.L2)

    order = np.random.default_rng(0)
    for _ in range(language.EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = {(f, c): weight(f, c) for f in at for c in range(k)}
            e = np.exp([sum(v * w[f, c] for f, v in zip(at, x)) for c in range(k)])
            for f, v in zip(at, x):
                for c in range(k):
                    g = v * (e[c] / e.sum() - (y[i] == c))
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / language.ALPHA * w[f, c]
                    n[f, c] = old + g * g
    got = language.ftrl(rows, y, k)
    assert np.allclose(got[:30], [[weight(f, c) for c in range(k)] for f in range(30)]) and not got[30:].any()


def test_language_features_match_brute_force():
    """n-grams counted one by one, by the same mixing of code points."""
    for text in ("", "a", "Ab  b\n a", "émile ß 你好 \U0001f642 É", "the end " * 30):
        points = [ord(c) for c in " ".join(["", *text.lower().split(), ""])]
        want = np.zeros(language.FEATURES, np.int64)
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                h = 0
                for j, p in enumerate(points[i : i + n], 1):
                    h = (h * 0x9E3779B1 + p + j) % 2**32
                x = (h ^ (h >> 15)) * 0x85EBCA77 % 2**32
                want[(x ^ (x >> 13)) % language.FEATURES] += 1
        assert (language.counts(text) == want).all()


def test_toxicity_held_out(spark):
    """Fitted once on the training fold of the largest table; all labels of the other fold count."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from(docs, labels)
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    rows = toxicity.scored(docs, model).where("held_out").join(truth, "doc_id").collect()
    bad = [r.predicted for r in rows if r.toxic == 1]
    good = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(bad) >= 0.6 and np.mean(good) <= 0.02
