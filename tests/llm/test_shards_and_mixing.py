from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, shards


def test_matrix():
    counts, sizes = np.array([5, 0, 9, 2]), np.array([4, 4, 4, 4])
    sums = np.zeros((4, 4))
    for seed in range(400):
        m = shards.communication_matrix(counts, sizes, seed)
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all()
        sums += m
    assert np.abs(sums / 400 - np.outer(counts, sizes) / 16).max() < 0.2
    with pytest.raises(ValueError, match="differ"):
        shards.communication_matrix(counts, sizes + 1, 0)


@pytest.mark.parametrize("rows", [0, 1, 15, 16, 1000])
def test_exact_sizes(spark, rows):
    d = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("clash").alias("shard"))
    got = [(r.doc_id, r["shard"], r.slot) for r in shards.hypergeometric_shuffle(d, 16, ["doc_id"]).collect()]
    assert sorted(x[0] for x in got) == list(range(rows))
    by = defaultdict(list)
    for _, s, slot in got:
        by[s].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    n = [len(by[s]) for s in range(16)]
    assert max(n) - min(n) <= 1
    again = [(r.doc_id, r["shard"], r.slot) for r in shards.hypergeometric_shuffle(d.repartition(3), 16, ["doc_id"]).collect()]
    assert sorted(got) == sorted(again)


def test_repeated_rows_are_kept(spark, corner_docs):
    d = corner_docs.select("doc_id", F.length("text").alias("size")).union(corner_docs.select("doc_id", F.length("text")))
    got = shards.hypergeometric_shuffle(d, 4, ["doc_id", "size"])
    assert got.count() == 2 * corner_docs.count()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("bigint"), F.lit(5))).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (left - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, w[s] * level) for s in names}
        capped |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10, None: 10}, {"a": 1, "b": 1000, "c": 5, "d": 0, "e": 70}, {"x": 9}):
        d = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(d).collect()}
        assert got == pytest.approx(fill(sizes))


def test_mix(spark, documents, corner_docs, no_docs):
    for docs, near in ((documents, 0.08), (corner_docs, None)):
        got = mixing.mixed_counts(docs).collect()
        again = mixing.mixed_counts(docs.repartition(5)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        if near:
            source = {r.doc_id: r.source for r in docs.collect()}
            taken, size, target = Counter(), Counter(), {}
            for r in got:
                taken[source[r.doc_id]] += r.taken
                size[source[r.doc_id]] += r.size
                target[source[r.doc_id]] = r.target
            want = fill(size)
            assert target == pytest.approx(want)
            assert all(abs(taken[s] / want[s] - 1) < near for s in want)
    assert mixing.mixed_counts(no_docs).count() == 0


def test_mixed_documents_agree_with_counts(spark, documents):
    mix = mixing.mixed_documents(documents)
    assert mix.columns == documents.columns
    words = mix.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    got = {r.doc_id: r.n for r in words.collect()}
    assert got == {r.doc_id: r.taken for r in mixing.mixed_counts(documents).collect() if r.taken}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text in texts[r.doc_id] for r in mix.collect())


def test_columns_of_any_name_pass_through(spark):
    names = ["size", "start", "target", "source_size", "_w", "_row", "_block", "block", "words", "from", "group", "_key", "n"]
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), None if i % 3 else "s", 5) for i in range(40)], "doc_id bigint, text string, source string, n_chars bigint")
    plain = Counter((r.doc_id, r.text, r.n_chars) for r in mixing.mixed_documents(docs).collect())
    wide = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    got = mixing.mixed_documents(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == plain and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert mixing.mixed_documents(wide.limit(0)).count() == 0
    counts = mixing.mixed_counts(wide.repartition(3))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in mixing.mixed_counts(docs).collect()}


def test_draws_follow_the_law_given_the_totals(spark):
    """Counts of a shard: mean and variance of draws without replacement from the sources' totals; each total is exact."""
    import numpy as np

    targets = spark.createDataFrame([("a", 128_000, 64_000.0), ("b", 64_000, 64_000.0), (None, 6_400, 12_800.0)], "source string, source_size bigint, target double")
    seen = []
    for seed in range(24):
        rows = mixing.draws(targets, seed=seed, shard_slots=110).collect()
        total, shard = Counter(), Counter()
        for r in rows:
            total[r.source] += r.n
            shard[r.shard] += r.n
        assert total == {"a": 500, "b": 500, None: 100} and set(shard.values()) == {110} and len(shard) == 10
        seen += [r.n for r in rows if r.source == "a"]
    n, p, width = 1100, 500 / 1100, 110
    law = width * p * (1 - p) * (n - width) / (n - 1)
    assert abs(np.mean(seen) - width * p) < 1e-9 and 0.7 < np.var(seen) / law < 1.35


def test_slots_use_every_block_before_one_again(spark):
    targets = spark.createDataFrame([("a", 1000, 1500.0), ("b", 300, 600.0), ("c", 5, 1.0), ("d", 0, 0.0)], "source string, source_size bigint, target double")
    rows = mixing.slots(mixing.draws(targets, 10, shard_slots=32)).collect()
    assert Counter((r.source, r["pass"]) for r in rows) == {("a", 0): 100, ("a", 1): 50, ("b", 0): 30, ("b", 1): 30}
    for s, n in (("a", 100), ("b", 30)):
        assert sorted(r.block for r in rows if r.source == s and r["pass"] == 0) == list(range(n))
    by = Counter(r.shard for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k, i) for k, n in by.items() for i in range(n))


def test_sizes_and_targets_of_the_query(spark, documents):
    """Brute force: words of each document, sizes and targets of its source."""
    import re

    rows = documents.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))
    want = fill(size)
    of = {r.doc_id: r for r in rows}
    for r in mixing.mixed_counts(documents).collect():
        d = of[r.doc_id]
        assert r.size == len(re.findall("[^\x20\x09-\x0D]+", d.text or "")) and r.source_size == size[d.source] and r.target == pytest.approx(want[d.source])


def test_query_of_shards_matches_brute_force(spark, documents):
    """Sizes and checksums of every row, and the law `rows`: counts at most one apart, slots gapless."""
    import zlib

    from quillspark.llm import queries

    from .conftest import SF

    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    got = queries.op8_shards(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == documents.count()
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)
    held = Counter(r.shard for r in got)
    assert set(held) == set(range(16)) and max(held.values()) - min(held.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in held.items() for i in range(n))


def test_shards_keep_columns_of_any_name(spark):
    names = ["_part", "_u", "_rank", "_range", "_cuts", "_before", "count", "_whole", "a.b"]
    d = spark.range(300).select("id", *(F.col("id").alias(c) for c in names), F.lit(-1).alias("shard"), F.lit(-1).alias("slot"))
    got = shards.hypergeometric_shuffle(d, 4, ["id"])
    assert got.columns == ["id", *names, "shard", "slot"]
    rows = got.collect()
    assert all(set(r[1:-2]) == {r.id} for r in rows) and sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(75)]
