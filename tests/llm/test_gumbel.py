import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import gumbel as g


@pytest.fixture(scope="module")
def lat():
    return g.Lattices(g._loaded(g.MODEL_FILE), 1.0)


def segmentations(word, v):
    if not word:
        yield (), 0.0
    for b in range(1, len(word) + 1):
        if (i := v.ids.get(word[:b])) is not None:
            for rest, lp in segmentations(word[b:], v):
                yield (i, *rest), lp + float(v.log_weight[i])


def test_law_and_inclusion(lat):
    """Against all segmentations: first and second draws, and Horvitz-Thompson totals."""
    v, text, n = lat.vocab, "the cat", 3000
    parts = [list(segmentations(w, v)) for w in g.words_of(text)]
    law = {sum((c[0] for c in combo), ()): sum(c[1] for c in combo) for combo in itertools.product(*parts)}
    z = math.log(sum(map(math.exp, law.values())))
    law = {k: x - z for k, x in law.items()}
    out = g.sample([text] * n, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64), lat, 3)
    first, second, total = Counter(), Counter(), 0.0
    for found in out:
        ids = [tuple(lat.ids(s.edges).tolist()) for s in found]
        assert len(set(ids)) == 3 and [s.value for s in found] == sorted((s.value for s in found), reverse=True)
        assert all(abs(law[i] - s.log_prob) < 1e-9 for i, s in zip(ids, found))
        first[ids[0]] += 1
        second[ids[1]] += 1
        total += sum(math.exp(s.log_prob - s.log_inclusion) for s in found)
    assert abs(total / n - 1) < 0.01
    for k in sorted(law, key=law.get)[-4:]:
        p = math.exp(law[k])
        q = sum(math.exp(law[a]) * p / (1 - math.exp(law[a])) for a in law if a != k)
        assert abs(first[k] / n - p) < 0.04 and abs(second[k] / n - q) < 0.04


def test_few_segmentations(lat):
    found = g.sample(["", "\x01"], np.array([1, 2], np.uint64), lat, 50)
    assert len(found[0]) == 1 and found[0][0].log_inclusion == 0 and len(found[0][0].edges) == 0
    everything = g.sample(["ab"], np.array([3], np.uint64), lat, 50)[0]
    assert len(everything) == len(list(segmentations("▁ab", lat.vocab))) and abs(sum(math.exp(s.log_prob) for s in everything) - 1) < 1e-9


def test_column(spark, corner_docs, no_docs):
    rows = corner_docs.where("doc_id IS NULL OR doc_id <> 3")
    got = g.sampled(rows.withColumn("ids", F.lit("clash"))).collect()
    assert all(r.round_trip for r in got) and {r.sample for r in got} == {0, 1}
    assert len({(r.doc_id, tuple(r.ids)) for r in got}) == len(got)
    again = {(r.doc_id, r.sample): r.ids for r in g.sampled(rows.repartition(3)).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for r in got}
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    back = g.decoded(g.sampled(rows, k=1)).collect()
    assert all(r.decoded == texts[r.doc_id] for r in back)
    assert g.sampled(no_docs).count() == 0
