"""Toxicity: bags of subword embeddings, averaged, into a linear softmax.

A word is its hashed character n-grams, each for an equal share of one; a text is the
bag of the n-grams of its distinct words. The dictionary holds the buckets whose
presence tells the labels apart (likelihood ratio over the fitted rows); a text's
vector is the mean of its bag's embeddings within the dictionary, with PAD zero vectors
among them, so that a bag of almost nothing says little. A softmax over two classes
reads the mean. Embeddings and softmax are trained jointly in numpy. A misspelling
never seen shares most n-grams with its word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold

#: Most labelled rows that the model is fitted on: those of the training fold with the least hash.
MAX_LABELLED = 6_000
#: n-gram lengths, hash buckets, dimensions, zero vectors in every mean.
GRAMS, BUCKETS, DIM, PAD = (3, 4, 5), 1 << 16, 8, 1.0
#: The dictionary: at most so many buckets, each with so large a likelihood ratio.
DICTIONARY, LEAST_RATIO = 1_000, 8.0
#: Training: epochs, or as many as make so many steps; texts in a batch, rate and weight decay.
#: Settings were compared on a fold within the training rows.
EPOCHS, STEPS, BATCH, RATE, DECAY = 40, 1_000, 96, 0.02, 1e-3
#: Words that a worker remembers before it starts afresh.
CACHE = 400_000

_STRIP = '.,;:!?()[]"’‘«»*_-\''


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word itself, edges marked."""
    w = f"<{word.strip(_STRIP)}>"
    parts = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} | {w}
    return sorted(zlib.crc32(p.encode()) % BUCKETS for p in parts)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bag(text: str | None, known: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's distinct words and their shares, whole text."""
    known = {} if known is None else known
    share = np.zeros(BUCKETS)
    for w in set(words_of(text)):
        own = known.get(w)
        if own is None:
            own = known[w] = grams(w)
        for g in own:
            share[g] += 1 / len(own)
    at = np.flatnonzero(share)
    return at.astype(np.int32), share[at].astype(np.float32)


class Model:
    """Reduced to what scoring needs: a number for each bucket of the dictionary, NaN outside, and an offset."""

    def __init__(self, gram_scores: np.ndarray, bias: float) -> None:
        self.gram_scores, self.bias = gram_scores.astype(np.float64), float(bias)
        self.kept = {int(i): float(self.gram_scores[i]) for i in np.flatnonzero(~np.isnan(self.gram_scores))}

    def parts(self, word: str) -> tuple[float, float] | None:
        """Sum of scores and sum of shares of a word's n-grams in the dictionary; None without any."""
        own = grams(word)
        found = [self.kept[g] for g in own if g in self.kept]
        return (sum(found) / len(own), len(found) / len(own)) if found else None

    def word(self, word: str) -> float:
        """What a text of this word alone adds to the offset."""
        total, share = self.parts(word) or (0.0, 0.0)
        return total / (PAD + share)


class _Scores(dict):
    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[float, float] | None:
        if len(self) > CACHE:
            self.clear()
        got = self[word] = self.model.parts(word)
        return got


def score(text: str | None, model: Model, scores: dict) -> float:
    """Probability of the averaged bag; 0 where there are no words. The sum doesn't depend on the order of words."""
    words = set(words_of(text))
    if not words:
        return 0.0
    found = sorted(filter(None, map(scores.__getitem__, words)))
    mean = sum(f[0] for f in found) / (PAD + sum(f[1] for f in found))
    return float(1 / (1 + np.exp(-max(-60.0, min(60.0, mean + model.bias)))))


def dictionary(present: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Buckets whose presence tells two classes apart best, ascending.

    ``present`` (2, buckets) counts the rows of each class that have a bucket, ``rows``
    all rows of each class. Of equal ratios the lower bucket goes first.
    """
    n, total = present.astype(np.float64), float(rows.sum())
    ratio = np.zeros(n.shape[1])
    for seen in (n, rows[:, None] - n):
        expected = rows[:, None] * seen.sum(0) / max(total, 1)
        ratio += 2 * (seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))).sum(0)
    best = np.argsort(-ratio, kind="stable")[:DICTIONARY]
    return np.sort(best[ratio[best] >= LEAST_RATIO])


def train(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, kept: np.ndarray, seed: int = 0) -> Model:
    """Embeddings of the dictionary ``kept`` and softmax, jointly, by Adam; a constant where a class or the dictionary is empty."""
    toxic = np.asarray(toxic, bool)
    scores = np.full(BUCKETS, np.nan)
    if not len(toxic) or toxic.all() or not toxic.any() or not len(kept):
        return Model(scores, 3.0 if len(toxic) and toxic.all() else -3.0)
    rng = np.random.default_rng(seed)
    rows = []
    for at, share in bags:
        k = np.isin(at, kept)
        rows.append((np.searchsorted(kept, at[k]), share[k] / (PAD + share[k].sum())))
    emb = rng.normal(0, 0.1, (len(kept), DIM))
    out = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    params = (emb, out, bias)
    state = [np.zeros_like(p) for p in params for _ in range(2)]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            at = np.concatenate([rows[d][0] for d in batch])
            share = np.concatenate([rows[d][1] for d in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[d][0]) for d in batch])
            mean = np.zeros((len(batch), DIM))
            np.add.at(mean, doc, share[:, None] * emb[at])
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = toxic[batch].astype(int)
            p[np.arange(len(y)), y] -= 1
            g = p / len(batch)
            grad = DECAY * emb
            np.add.at(grad, at, share[:, None] * (g @ out.T)[doc])
            step += 1
            for i, (param, d) in enumerate(zip(params, (grad, mean.T @ g, g.sum(0)))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    scores[kept] = emb @ (out[:, 1] - out[:, 0])
    return Model(scores, bias[1] - bias[0])


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Model:
    """Dictionary and weights from whole texts."""
    toxic, known = np.asarray(toxic, bool), {}
    bags = [bag(t, known) for t in texts]
    present = np.zeros((2, BUCKETS), np.int64)
    for (at, _), y in zip(bags, toxic):
        present[int(y), at] += 1
    return train(bags, toxic, dictionary(present, np.array([(~toxic).sum(), toxic.sum()])), seed)


def chosen(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_labelled`` rows: those of the training fold's labels with the least hash, rows of one id by a hash of the text."""
    fold = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of two numbers; an id of very many rows is cut at the bound too
    got = docs.select("doc_id", "text").join(F.broadcast(fold), "doc_id")
    return got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(max_labelled)


def _bags(rows: DataFrame) -> DataFrame:
    """``place, toxic, buckets, shares`` of labelled texts; place is a hash that orders them alike in every run."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            got = []
            for t in batch.column(2):
                if len(known) > CACHE:
                    known.clear()
                got.append(bag(t.as_py(), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["place", "toxic", "buckets", "shares"])

    d = rows.select(F.xxhash64("doc_id", "text").alias("place"), (F.col("toxic") == 1).alias("toxic"), "text")
    return d.repartition(32, "place").mapInArrow(run, "place bigint, toxic boolean, buckets binary, shares binary")


def _presence(bags: DataFrame) -> DataFrame:
    """``toxic, bucket, n``: in how many rows of a class a bucket occurs; bucket -1 counts the rows."""

    def run(batches):
        n = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for y, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                n[int(y), np.frombuffer(b.as_py(), np.int32) + 1] += 1
                n[int(y), 0] += 1
        y, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y == 1), pa.array(at.astype(np.int32) - 1), pa.array(n[y, at])], names=["toxic", "bucket", "n"])

    return bags.select("toxic", "buckets").mapInArrow(run, "toxic boolean, bucket int, n bigint").groupBy("toxic", "bucket").agg(F.sum("n").alias("n"))


def _within(bags: DataFrame, kept: np.ndarray) -> DataFrame:
    """Bags cut down to the dictionary: at most DICTIONARY buckets a row."""

    def run(batches):
        for batch in batches:
            out = []
            for b, s in zip(batch.column(2), batch.column(3)):
                at, share = np.frombuffer(b.as_py(), np.int32), np.frombuffer(s.as_py(), np.float32)
                k = np.isin(at, kept)
                out.append((at[k].tobytes(), share[k].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], names=["place", "toxic", "buckets", "shares"])

    return bags.mapInArrow(run, bags.schema)


def fit_from(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels of the training fold (crc32 of the id modulo 5 is not 0), at most MAX_LABELLED rows of them.

    Texts stay with the executors: the driver gets two counts of each bucket and, of
    each row, what the dictionary has of it.
    """
    work = Scratch()
    bags = work.durable(_bags(chosen(docs, labels)))
    present = np.zeros((2, BUCKETS + 1), np.int64)
    for toxic, bucket, n in _presence(bags).toPandas().itertuples(index=False):
        present[int(toxic), bucket + 1] = n
    kept = dictionary(present[:, 1:], present[:, 0])
    got = _within(bags, kept).toPandas().sort_values(["place", "toxic", "buckets"], kind="stable")
    work.drop()
    return train([(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for b, s in zip(got["buckets"], got["shares"])], got["toxic"].to_numpy(bool), kept)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, whole texts of any length in one look at each word.

    Null and empty texts score 0. Equal texts score alike, so ties stay ties; a score of
    exactly 0.5 is predicted 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        cache = _Scores(model)
        for batch in batches:
            s = [score(t.as_py(), model, cache) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (crc_fold() == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``. Repeated rows score alike; other columns, whatever their names, aren't read; empty tables give no rows or, without labels, a constant score."""
    return scored(docs, fit_from(docs, labels))
