"""Language-model scores against plain counting and a network stepped symbol by symbol."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import gated, lmscore

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode())), None]


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def plain_log_prob(net, ids, end):
    """One symbol after another, all in plain vector arithmetic of doubles."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, h, prev, total = net.width, np.zeros(net.width), end, 0.0
    for y in ids:
        g, q = p["E"][prev] @ p["W"] + p["b"], h @ p["U"]
        z, r = (1 / (1 + np.exp(-(g[a : a + w] + q[a : a + w]))) for a in (0, w))
        new = np.tanh(g[2 * w :] + r * q[2 * w :])
        h = z * h + (1 - z) * new
        k = net.class_of[y]
        a, b = net.bounds[k], net.bounds[k + 1]
        for logits, at in ((h @ p["C"] + p["c"], k), (p["O"][a:b] @ h + p["o"][a:b], y - a)):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        prev = y
    return total


@pytest.fixture(scope="module")
def small_net():
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 500, 60))[::-1].astype(float)
    net = gated.Network(counts, width=8)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape).astype(np.float32)
    return net


def test_lanes_and_windows_equal_single_steps(small_net):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(0, 30, 600), [700, 0, 65, 64, 63]])
    off = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 60, off[-1]).astype(np.int32)
    got = gated.text_log_probs(small_net, ids, off, end=5)
    want = [plain_log_prob(small_net, ids[a:b], 5) for a, b in zip(off, off[1:])]
    assert np.allclose(got, want, rtol=2e-5, atol=1e-4)


def test_symbol_probabilities_sum_to_one(small_net):
    h = np.random.default_rng(2).normal(size=(1, 8)).astype(np.float32)
    p = np.exp(small_net.log_probs(np.repeat(h, 60, 0), np.arange(60)))
    assert abs(p.sum() - 1) < 1e-5


def test_gradients_equal_differences():
    net = gated.Network(np.array([9.0, 5, 4, 2, 1]), width=3)
    net.p = {k: v.astype(np.float64) + np.random.default_rng(3).normal(0, 0.4, v.shape) for k, v in net.p.items()}
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 5, (6, 4)), rng.integers(0, 5, (6, 4))
    fresh, live = rng.random((6, 4)) < 0.2, np.arange(4) < np.array([4, 4, 3, 3, 2, 1])[:, None]
    start = rng.normal(size=(4, 3))

    def loss():
        h, total = start.copy(), 0.0
        for t in range(6):
            h[fresh[t]] = 0
            g, q = net.p["E"][x[t]] @ net.p["W"] + net.p["b"], h @ net.p["U"]
            gates = 1 / (1 + np.exp(-(g[:, :6] + q[:, :6])))
            new = np.tanh(g[:, 6:] + gates[:, 3:] * q[:, 6:])
            after = new + gates[:, :3] * (h - new)
            h = np.where(live[t][:, None], after, h)
            total -= net.log_probs(h[live[t]], y[t][live[t]]).sum()
        return total / live.sum()

    grads = gated._gradients(net, x, fresh, y, live, start.copy())
    for k, g in grads.items():
        for at in rng.permutation(net.p[k].size)[:6]:
            flat = net.p[k].reshape(-1)
            keep = flat[at]
            ends = []
            for d in (1e-4, -1e-4):
                flat[at] = keep + d
                ends.append(loss())
            flat[at] = keep
            assert abs((ends[0] - ends[1]) / 2e-4 - np.ravel(g)[at]) < 2e-5, k


def test_counts_base_and_held_out_gain(documents):
    """Exact counts and base scores, whether a token is frequent or joined; the model beats the base on held-out texts."""
    texts = {r.doc_id: tokens(r.text) for r in documents.collect()}
    train = {i for i in texts if in_training(i)}
    c = Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()), len(c)
    for frequent in (lmscore.FREQUENT, 700):
        got = lmscore.scored(documents, max_pieces=60, words=400, frequent=frequent).collect()
        assert len(got) == len(texts)
        for r in got:
            ws = texts[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, r.doc_id not in train)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_those_of_the_model(documents):
    """Symbols by the network, other tokens by their share of the rest; hashes replaced by the words themselves."""
    docs = documents.limit(40)
    counts = lmscore.token_counts(docs.where(lmscore.training()))
    model = lmscore.fitted(docs, counts, max_pieces=20, words=50)
    rows = {r.doc_id: r.text for r in docs.collect()}
    c = Counter(w for i, t in rows.items() if in_training(i) for w in tokens(t))
    n, v, ends = sum(c.values()), len(c), c.pop(None)
    by_symbol = {}
    for r in lmscore.scored(docs, max_pieces=20, words=50).collect():
        own = tokens(rows[r.doc_id])[:-1]
        data = np.frombuffer(b" ".join(own), np.uint8)
        words = lmscore.Tokens(data, np.array([0, len(data)]))
        symbols = model.looked_up(words.word_hashes())[0]
        for w, s in zip(own, symbols):
            assert s == model.other or by_symbol.setdefault(s, w) == w
        known = sorted(c.values(), reverse=True)[:50]
        rest, kinds = n - ends - sum(known), v - 1 - 50
        want = plain_log_prob(model.net, [*symbols, model.end], model.end) / math.log(10)
        want += sum(math.log10((c[w] + 1) / (rest + kinds + 1)) for w, s in zip(own, symbols) if s == model.other)
        assert math.isclose(r.score, want, rel_tol=1e-4)
    assert len(by_symbol) == 50


def test_corner_texts(corner_docs, no_docs):
    clash = corner_docs.selectExpr("*", "1 AS key", "2 AS token", "'x' AS n", "map('a', 1) AS rest", "0 AS held_out")
    got = lmscore.scored(clash, max_pieces=20, words=20, frequent=30).collect()
    assert len(got) == corner_docs.count()
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1} and max(r.n_tokens for r in got) == 40_002
    twins = [r.score for r in got if r.doc_id in (7, 8)]
    assert math.isclose(*twins, rel_tol=1e-5)
    assert lmscore.scored(no_docs).count() == 0
    held = corner_docs.where(~lmscore.training())
    lone = lmscore.scored(held, max_pieces=5).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in lone)


def test_pieces_cover_texts_and_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 3000) for i in range(30)] + [(99, None)], "doc_id bigint, text string")
    every = lmscore.pieces(docs, 1000)
    assert sum(len(p) for p, _, _ in every) == 30 * 15_000 and sum(last for *_, last in every) == 31
    assert len(lmscore.pieces(docs, 25)) == 25


def test_pieces_of_symbols_join_to_their_texts():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2500, 1024, 1, 1025, 3])
    off = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, 60_000, off[-1]).astype(np.int32)
    lists = lmscore.cut(ids, sizes, 5, np.dtype("<u2"))
    assert lists.value_lengths().to_pylist() == [1, 3, 1, 1, 2, 1]
    prev, own, bounds = lmscore.joined(lists.slice(1).flatten(), np.dtype("<u2"))
    assert (own == ids[1:]).all() and (prev == gated.before(ids, off, 5)[0][1:]).all()
    assert np.diff(bounds).tolist() == [1024, 1024, 452, 1024, 1, 1024, 1, 3]


def test_weights_learn_from_texts_outside_the_drawn_pieces(documents):
    """One text's words in another order: no drawn piece and no count changes, but the weights do."""
    train = documents.where(lmscore.training()).select("doc_id", "text")
    drawn = lmscore.pieces(train, 5)
    texts = {r.doc_id: r.text for r in train.collect()}
    turned = 0
    for i in sorted(i for i, t in texts.items() if t and 50 < len(set(t.split())) and len(t) < 4_000):
        other = " ".join(reversed(texts[i].split()))
        changed = train.selectExpr("doc_id", f"if(doc_id = {i}, '{other.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', text) AS text")
        if lmscore.pieces(changed, 5) == drawn:
            turned = changed
            break
    nets = [lmscore.fitted(d, lmscore.token_counts(d), max_pieces=5, words=300).net for d in (train, turned)]
    assert all((nets[0].bounds == nets[1].bounds).tolist()) and not np.allclose(nets[0].p["U"], nets[1].p["U"], atol=1e-7)


def test_rounds_average_what_slices_learn_from_every_symbol(documents, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lmscore, "SLICE", 5_000)
    monkeypatch.setattr(lmscore, "SIDE", 2)
    monkeypatch.setattr(lmscore, "ROUNDS", 2)
    counts = lmscore.token_counts(documents.where(lmscore.training()))
    model = lmscore.Model(lmscore.Statistics(counts, documents.where(lmscore.training()).count()), [], words=300)
    scratch = lmscore.Scratch()
    part = scratch.durable(lmscore.partial_scores(documents, model))
    want = model.net.flat()
    slices = -(-model.total // 5_000)
    side = -(-slices // 2)
    assert side > 1
    rows = part.where("NOT held_out").select("key", F.posexplode("symbols").alias("place", "piece"))
    rows = rows.withColumn("slice", F.expr(f"pmod(xxhash64(key, place), {2 * side})")).orderBy("key", "place").collect()
    seen, net = 0, gated.Network(np.ones(model.net.p["o"].size))
    net.bounds, net.class_of, net.p = model.net.bounds, model.net.class_of, {k: v.copy() for k, v in model.net.p.items()}
    for r, rate in enumerate((2e-3 * 2.5**0.5, 2e-3)):
        total, weight = 0, 0
        for s in range(r * side, (r + 1) * side):
            net.put(want)
            own = [np.frombuffer(bytes(x.piece), model.kind).astype(np.int32) for x in rows if x.slice == s]
            off = np.concatenate([[0], np.cumsum([len(x) - 1 for x in own])])
            gated.passed(net, np.concatenate([x[:-1] for x in own]), np.concatenate([x[1:] for x in own]), off, rate)
            total, weight = total + off[-1] * net.flat().astype(np.float64), weight + off[-1]
        want, seen = (total / weight).astype(np.float32), seen + weight
    assert seen == model.total
    lmscore.learned(part, model, scratch)
    scratch.drop()
    assert np.allclose(model.net.flat(), want, atol=1e-4)
