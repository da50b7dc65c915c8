import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import substrings as s


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    c = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if c[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("v", sorted(s.COVERS))
def test_covers(v):
    d = s.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("width", [1, 3, 35, 50])
def test_brute_force(spark, width):
    rng = random.Random(width)
    vocab = [f"v{i}" for i in range(400)]
    passage = [rng.choices(vocab, k=n) for n in (width - 1, width, width + 1, 2 * width, 3 * width + 7, 120)]
    texts = [None, "", " ", "x " * (3 * width)]
    for i in range(60):
        t = rng.choices(vocab, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, len(t)) : 0] = rng.choice(passage)
        texts.append(" ".join(t) if i % 2 else "\n".join(t))
    texts += texts[5:8]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("k", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(d, width).collect()}
    assert got == dict(enumerate(brute(texts, width)))


def test_corners(spark, corner_docs, no_docs):
    rows = corner_docs.collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(corner_docs, 35).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute([r.text for r in rows], 35)))
    assert got == want
    kept = s.remove_repeats(corner_docs, 35, keep_text=True).where("n_removed = 0 AND doc_id = 6").head()
    assert kept.kept_text == rows[6].text
    assert s.remove_repeats(no_docs).count() == 0


def test_rows_without_or_with_equal_ids(spark):
    """Each row is judged as a document of its own: nulls, repeats, equal rows, the least and largest ids."""
    line = " ".join(f"p{i}" for i in range(8))
    rows = [(None, f"one {line}"), (None, "two only here and nowhere else at all"), (None, f"{line} three"), (-(1 << 63), "low " + line), ((1 << 63) - 1, "a b c d e f g h i"), (5, "same row of words here"), (5, "same row of words here"), (5, "another text of it"), (None, None), (None, "")] + [(None, "copy of one hot text without any id at all")] * 40
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect())
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 5)))


def test_carried_columns_of_any_name(spark):
    names = ("r0", "r1", "hits", "misses", "_hits", "place", "key", "k", "n_chars")
    d = spark.createDataFrame([(i, f"w{i} x y z") for i in range(6)], "doc_id bigint, text string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    rows = s.remove_repeats(d, 3, keep_text=True, carry=names).collect()
    assert len(rows) == 6 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names) and {r.kept_text for r in rows} == {f"w{i}" for i in range(6)}
