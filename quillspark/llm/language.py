"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams, document frequencies
counted over all documents of the training fold. Weights are trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalties) and
probabilities are then calibrated by a temperature fitted on rows left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Most rows that weights are fitted on: those of the training fold with the least hash; one in CALIBRATE is for the temperature.
MAX_LABELLED, CALIBRATE = 5_000, 5
#: n-gram lengths and hashed features.
GRAMS, FEATURES = (1, 2, 3), 1 << 15
#: Follow the regularised leader: rate, its offset, penalties, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 3
UNKNOWN = "und"
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category (fractions and circled numbers aren't)."""
    return any(m[0].isalpha() for m in _MAY_BE_LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """How often each feature is in a text: n-grams of its lowercased code points, white space runs as one space."""
    points = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(points):
            break
        h = h[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA77)
            out += np.bincount((x ^ (x >> np.uint32(13))) % np.uint32(FEATURES), minlength=FEATURES)
    return out


def weights(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, TF-IDF weights of unit length)."""
    c = counts(text)
    at = np.flatnonzero(c)
    w = (1 + np.log(c[at])) * idf[at]
    return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, temperature: float) -> None:
        self.langs, self.idf, self.w, self.temperature = langs, idf, w, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); UNKNOWN and 0 without a letter or a learned language."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = weights(text, self.idf)
        p = _softmax((x @ self.w[at]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """FEATURES x k weights."""
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))

    def solve(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = solve(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            g2 = g * g
            old = n[at]
            z[at] += g - (np.sqrt(old + g2) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g2
    return solve(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale that minimises the log loss, by a refined search over 1/64 to 64."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean()
    lo, hi = -6.0, 6.0
    for _ in range(5):
        grid = np.linspace(lo, hi, 13)
        best = int(np.argmin([loss(2.0**g) for g in grid]))
        lo, hi = grid[max(0, best - 1)], grid[min(12, best + 1)]
    return float(2.0 ** ((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and of texts with each feature, over all rows. FEATURES numbers reach the driver."""

    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    df += counts(t.as_py()) > 0
                    n += 1
        at = np.append(np.flatnonzero(df), FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(df, n)[at])], names=["feature", "n"])

    got = docs.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[got["feature"]] = got["n"]
    return int(df[-1]), df[:-1]


def chosen(fold: DataFrame, max_labelled: int) -> DataFrame:
    """The ``max_labelled`` rows of the least hashes of ids, those of one id by a hash of the row; rows without an id are out."""
    # ids first, so that only their rows' texts are moved; an id of very many rows is cut at the bound too
    ids = fold.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return fold.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("lang", "text"), "lang", "text").limit(max_labelled)


def fit_from(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on text and lang of the training fold; null langs and texts aren't learned from."""
    fold = docs.where(crc_fold() != 0).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n, df = document_frequencies(fold)
    idf = np.log((1 + n) / (1 + df)) + 1
    got = chosen(fold, max_labelled).toPandas().sort_values(["doc_id", "lang", "text"], kind="stable")
    got = got[[has_letter(t) for t in got["text"]]] if len(got) else got
    langs = sorted(set(got["lang"]))
    if not langs:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    y = np.array([langs.index(x) for x in got["lang"]])
    rows = [weights(t, idf) for t in got["text"]]
    held = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    w = ftrl([r for r, h in zip(rows, held) if not h], y[~held], len(langs))
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in np.flatnonzero(held)]).reshape(-1, len(langs))
    return Model(langs, idf, w, temperature(logits, y[held]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (crc_fold() == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the training fold and predict every row. Null and letterless texts are UNKNOWN with score 0; repeated rows and ties of languages (first by name) agree."""
    return predicted(docs, fit_from(docs))
