import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import partenum as p
from quillspark.llm.graph import components


def shingles(text, width):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


def family(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base_len in (1, 3, 5, 12, 40, 150, 600, 2500):
        base = rng.choices(words, k=base_len)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, base_len // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy) if rng.random() < 0.8 else "  ".join(copy).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n2", "k2"), [(p.PARTS, p.LEFT_OUT), (4, 2)])
def test_signatures_lose_no_pair(n2, k2):
    rows = family(n2)
    sets = [shingles(t, 4) for _, t in rows]
    ids = {}
    arrays = [np.array(sorted(hash(x) & (2**64 - 1) for x in s), np.uint64) for s in sets]
    shape = p.Shape(85, n2, k2)
    sig, who = p.signatures(np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), shape)
    by = defaultdict(set)
    for s, w in zip(sig.tolist(), who.tolist()):
        by[w].add(s)
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                assert by[i] & by[j], (i, j, ids)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2600], rng.integers(0, 2**63, 500).astype(np.uint64)])
    sk, at = p.sketches(np.concatenate([a, b]), np.array([0, 3000, 6100]))
    for words in (16, 64, int(np.diff(at).min())):
        x, y = p.fold(sk[: at[1]], words), p.fold(sk[at[1] :], words)
        assert p.bits_apart(x, y) <= 900
        assert p.bits_apart(x, y) == sum(bin((int(i) ^ int(j)) & (2**64 - 1)).count("1") for i, j in zip(x, y))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    rows = family(width)
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sig", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in p.jaccard_components(d, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_corners(spark, corner_docs, no_docs):
    got = p.jaccard_components(corner_docs).collect()
    assert len(got) == corner_docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (0, 1, 2)] == [0, 0, 0] and [by[i].component_id for i in (0, 1, 2)] == [0, 1, 2]
    assert by[7].component_id == by[8].component_id == 7 and by[3].component_id == 3
    assert [r for r in got if r.doc_id is None][0].component_id is None
    assert p.jaccard_components(no_docs).count() == 0


def test_graph(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 90), (5, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 100: 90}


def borderline(n=60, base_len=300, change=6):
    """Copies of one text that differ from one another by about the threshold: links are few, shared signatures many."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(base_len)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(base_len), change):
            copy[at] = f"c{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_blocks_of_a_large_signature(spark, monkeypatch):
    """Signatures are split into blocks of few rows, and these into steps of few pairs."""
    monkeypatch.setattr(p, "BLOCK", 7)
    monkeypatch.setattr(p, "STEP_PAIRS", 11)
    for percent in (85, 88):
        rows = borderline()
        want = brute(rows, 4, percent)
        assert 1 < len({c for _, c in want.values()}) if percent == 88 else True
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in p.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, percent).collect()}
        assert got == want


def test_meeting_rows_match_brute_force():
    """All pairs of different components under the filter, in whichever batches rows come."""
    import pyarrow as pa

    shape = p.Shape(85)
    rows = borderline(40)
    arrays = [np.array(sorted(hash(x) & (2**64 - 1) for x in shingles(t, 4)), np.uint64) for _, t in rows]
    sk, at = p.sketches(np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(a) for a in arrays])]))
    short = [p.fold(sk[at[i] : at[i + 1]], p.SKETCH) for i in range(len(rows))]
    comp = [i % 5 for i in range(len(rows))]
    block = [i % 3 for i in range(len(rows))]
    dealt = sorted((min(b, o), max(b, o), b > o, i) for i, b in enumerate(block) for o in range(3))
    cols = {"sig": [1] * len(dealt), "i": [d[0] for d in dealt], "j": [d[1] for d in dealt], "right": [d[2] for d in dealt], "id": [d[3] for d in dealt], "comp": [comp[d[3]] for d in dealt], "n_shingles": [len(arrays[d[3]]) for d in dealt], "wide": pa.array([None] * len(dealt), pa.list_(pa.int64()))}
    table = pa.table(cols | {c: [int(short[d[3]][k]) for d in dealt] for k, c in enumerate(p.SKETCH_COLS)})
    fits = {(a, b) for b in range(len(rows)) for a in range(b) if comp[a] != comp[b] and 100 * min(len(arrays[a]), len(arrays[b])) >= 85 * max(len(arrays[a]), len(arrays[b])) and p.bits_apart(short[a], short[b]) <= shape.most_apart(len(arrays[a]), len(arrays[b]))}
    for size in (1, 7, 1000):
        got = [(a, b) for out in p._meet(shape, False)(table.to_batches(max_chunksize=size)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert sorted(got) == sorted(fits)
    best = {(a, b) for out in p._meet(shape, True)(table.to_batches()) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert best <= fits and {tuple(sorted((comp[a], comp[b]))) for a, b in best} == {tuple(sorted((comp[a], comp[b]))) for a, b in fits}
