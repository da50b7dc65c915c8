"""Error rates over pairs with accents, against plain Python over code points."""

from collections import Counter

import pytest

from quillspark.operators import metrics
from quillspark.plans import registry

TURNS = {1: ["où est le café", "ou est le cafe noir", "über alles"], 2: ["niño pequeño", "niño grande", "plain words", "plain word"], 3: ["ñ é ü", "ñ e ü ß"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("accents")
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, ts in TURNS.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


def expected():
    return [("user" if i % 2 == 0 else "assistant", a, b) for ts in TURNS.values() for i, (a, b) in enumerate(zip(ts, ts[1:]))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_wer(spark, folder):
    got = {r.role: r for r in registry.QUERIES["agg10_wer_corpus"](spark, folder).collect()}
    for role in ("user", "assistant"):
        ps = [(a, b) for who, a, b in expected() if who == role]
        assert got[role].samples == len(ps)
        assert got[role].cer == pytest.approx(sum(distance(a, b) for a, b in ps) / sum(len(a) for a, _ in ps))
        assert got[role].wer == pytest.approx(sum(distance(a.split(), b.split()) for a, b in ps) / sum(len(a.split()) for a, _ in ps))


def test_edits(spark, folder):
    edits = [(who, *e) for who, a, b in expected() for e in metrics.align(a.split(), b.split()) if e[0] != "equal"]
    want = Counter(e[1:] for e in edits)
    for name in ("agg17_confusions", "srt02_top_confusions"):
        assert {(r.op, r.ref, r.pred): r.n for r in registry.QUERIES[name](spark, folder).collect()} == want
    for r in registry.QUERIES["agg11_edit_breakdown"](spark, folder).collect():
        n = Counter(e[1] for e in edits if e[0] == r.role)
        assert (r.substitutions, r.deletions, r.insertions) == (n["substitute"], n["delete"], n["insert"])


def plain_align(ref, pred):
    """The whole matrix of costs in plain Python."""
    n, m = len(ref), len(pred)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[-1][j - 1] + (ref[i - 1] != pred[j - 1]), cost[-1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != pred[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if ref[i] == pred[j] else "substitute", ref[i], pred[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", ref[i], ""))
        else:
            j -= 1
            out.append(("insert", "", pred[j]))
    return out[::-1]


def test_alignment_is_that_of_the_whole_matrix():
    import random

    rng = random.Random(0)
    for size in [0, 1, 2, 3, 5, 9, 30, 70]:
        for _ in range(25):
            a, b = (rng.choices("abcd", k=rng.randint(0, size)) for _ in range(2))
            if rng.random() < 0.5:
                b = [x for x in a if rng.random() < 0.8]
            assert metrics.align(a, b) == plain_align(a, b)


def test_long_pairs_take_one_pass(spark):
    """Each word is numbered once; looked up among all words made anew, this pair took over a minute."""
    import time

    words = [f"w{i}" for i in range(8_000)]
    d = spark.createDataFrame([(" ".join(words), "w1 w5 other"), (None, "a"), ("a b", "")], "reference string, prediction string")
    begin = time.time()
    assert [r[0] for r in d.select(metrics.word_distance(d.reference, d.prediction)).collect()] == [7_998, None, 2]
    assert time.time() - begin < 30


def test_edits_leave_tasks_one_by_one(spark, folder):
    """Counts by keys (null ones too) are those of the plain alignment; no row carries a whole alignment, of which a batch held thousands."""
    d = spark.createDataFrame([("x", "a b c", "a d"), ("x", "a b", "a d"), (None, None, "a"), (None, "", "")], "k string, reference string, prediction string")
    got = metrics.confusions(d, "word", ["k"])
    want = Counter((r.k, *e) for r in d.collect() for e in plain_align((r.reference or "").split(), r.prediction.split()) if e[0] != "equal")
    assert {(r.k, r.op, r.ref, r.pred): r.n for r in got.collect()} == want and {r.level for r in got.collect()} == {"word"}
    for df in (got, metrics.edit_breakdown(d, "word", "k")):
        plan = df._jdf.queryExecution().analyzed().treeString()
        assert "explode" not in plan and "filter(" not in plan
    one = metrics.alignments(d, "char").collect()
    assert [[tuple(o) for o in r.ops] for r in one] == [plain_align(r.reference or "", r.prediction) for r in one]
