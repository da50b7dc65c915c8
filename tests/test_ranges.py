"""Orders, quantiles, manifests and paths at the sizes and skews that one task or one key can't take."""

import csv
import io
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.operators import dedup, profiles, ranges, ranking, skew, splits
from quillspark.sources import manifests


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few hundred bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "700b")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("end,seed", [("\n", 0), ("\r\n", 1), ("\n", 2)])
def test_manifests_in_ranges(spark, tmp_path, small_ranges, end, seed):
    """Records across any edge, quotes and empty lines in values, a value longer than several ranges, files of any shape."""
    rng = random.Random(seed)
    files = {}
    for f in range(4):
        rows = [[f"k{f}-{i}", "".join(rng.choices(["a", "bb ", ",", '"', end, end + end, "é", "﻿", "'"], k=rng.choice([0, 1, 5, 60])))] for i in range(rng.choice([0, 3, 120]))]
        if f == 2:
            rows[:0] = [["long", (f'line "x", y{end}' * 400)], ["", ""], ["end", '"']]
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end)
        w.writerow(["id", "text"])
        for r in rows:
            w.writerow(r)
            if rng.random() < 0.1:
                out.write(end)  # an empty line between records
        (tmp_path / f"f{f}.csv").write_bytes((("﻿" if f % 2 else "") + out.getvalue()).encode())
        files[f"f{f}.csv"] = rows
    d = manifests.numbered_manifest(spark, str(tmp_path))
    assert d.columns == ["id", "text", "row", "file"]
    got = sorted((r.file.rsplit("/", 1)[1], r.row, r.id, r.text) for r in d.collect())
    want = sorted((f, i, *r) for f, rows in files.items() for i, r in enumerate(rows, 2))
    assert got == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    rows = [(i, 'quoted "text"\nand a line ' * 3) for i in range(300)]
    spark.createDataFrame(rows, "id int, text string").coalesce(1).transform(lambda d: sinks.write_csv(d, str(tmp_path / "m"), ["id", "text"]) or d)
    d = manifests.numbered_manifest(spark, str(tmp_path / "m"))
    assert d.rdd.getNumPartitions() > 20 and d.select("file").distinct().count() == 1
    assert sorted((int(r.id), r.row, r.text) for r in d.collect()) == [(i, i + 2, t) for i, t in rows]


def test_ordered_parts_keep_their_places(spark, tmp_path):
    d = spark.range(500).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    splits.shuffled(d, "id").select("id", "h").write.options(header=True).csv(str(tmp_path / "p"))
    got = manifests.placed_parts(spark, str(tmp_path / "p"), ["id", "h"]).collect()
    want = [r.id for r in splits.shuffled(d, "id").collect()]
    assert [int(r.id) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 501))


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_sorted_values(spark, seed):
    rng = random.Random(seed)
    pools = [lambda: rng.lognormvariate(0, 6), lambda: float(rng.randint(0, 3)), lambda: rng.choice([float("inf"), float("-inf"), float("nan"), 0.0, -0.5]), lambda: rng.uniform(-1e308, 1e308), lambda: 7.0]
    rows = [(k if k != "b" else None, rng.choice(pools)() if rng.random() > 0.05 else None) for k in "abcde" for _ in range(rng.choice([1, 2, 7, 400]))]
    rows += [("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    at = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    want = {r.k: r.q for r in d.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect() if r.q}
    got = {r.k: r.q for r in ranges.quantiles(d, "v", at, ("k",), bins=16).collect()}
    assert got.keys() == want.keys() and all(str(got[k]) == str(want[k]) for k in want)
    one = ranges.quantiles(d, "v", at).first()
    assert str(one.q) == str(d.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]) and one.n_values == d.where("v IS NOT NULL").count()


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v int")
    assert ranges.quantiles(none, "v", (0.5,), ("k",)).count() == 0
    assert profiles.percentiles(none, "v", (0.5,)).first().p50 is None


def test_quantile_plans_hold_no_map_of_values(spark):
    d = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    plan = ranges.quantiles(d, "v", (0.5,), ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "median" not in plan.lower()


def test_equal_counts_in_ranges(spark):
    """Half of the rows share the first order column, the rest have a heavy tail: no range holds more than twice the mean."""
    rng = random.Random(4)
    d = spark.createDataFrame([(5.0 if i % 2 else rng.lognormvariate(0, 9), i) for i in range(8000)], "size double, id int")
    sizes = [r["count"] for r in ranges.in_ranges(d, [F.col("size"), F.col("id")], 8).groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) == 8
    want = {r.id: r.r for r in d.select("id", F.row_number().over(Window.orderBy("size", "id")).alias("r")).collect()}
    got = ranges.row_ranks(d, [F.col("size"), F.col("id")], parts=8).collect()
    assert {r.id: r["rank"] for r in got} == want and {r.n_rows for r in got} == {8000}
    batches = {r.id: r.batch_id for r in splits.bucket_batches(d, "size", 32, "id").collect()}
    assert batches == {i: (r - 1) // 32 for i, r in want.items()}


def test_average_ranks_of_a_shared_value(spark):
    rng = random.Random(5)
    rows = [(i, 3.0 if i % 2 else rng.lognormvariate(0, 9)) for i in range(3000)] + [(9999, None)]
    d = spark.createDataFrame(rows, "id int, v double")
    got = {r.id: r.r for r in ranking.average_rank(d, "v", "r").collect()}
    values = sorted(v for _, v in rows if v is not None)
    first, last = {}, {}
    for i, v in enumerate(values, 1):
        first.setdefault(v, i)
        last[v] = i
    assert got == {i: None if v is None else (first[v] + last[v]) / 2 for i, v in rows}


@pytest.mark.parametrize("seed", range(3))
def test_running_best_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, rng.random() * rng.choice([1, 0.1]), 0.5])) for i in range(400)]
    best, since, want = None, 0, []
    for i, v in rows:
        improved = best is None or (v is not None and v < best)
        since = 0 if improved else since + 1
        want.append((i, best, improved, since))
        best = v if best is None else best if v is None else min(best, v)
    d = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "i int, loss double")
    got = ranges.running_best(d, [F.col("i")], "loss", parts=7).orderBy("i").collect()
    assert [(r.i, r.best_before, r.improved, r.bad_rows) for r in got] == want


def test_balanced_first_with_a_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), i) for i in range(3000)] + [(None, 5000)]
    d = spark.createDataFrame(rows, "g string, i int")
    for total, groups in ((100, 4), (2000, 5), (9000, 3)):
        per, seen, quota, rest = total // groups, {}, [], []
        for g, i in sorted(rows, key=lambda r: r[1]):
            seen[g] = seen.get(g, 0) + 1
            (quota if seen[g] <= per else rest).append(i)
        got = [r.i for r in splits.balanced_first(d, "g", [F.col("i")], total, groups).collect()]
        assert got == (quota + rest)[:total]


def test_attach_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(20_000)] + [(None, -1), ("lost", -2)], "k string, i int")
    facts = rows.where("k <> 'lost'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = skew.attach(rows.repartition(8), facts, "k", "n")
    by_key = {r.k: (r.n, r.least) for r in facts.collect() if r.k}
    out = got.withColumn("p", F.spark_partition_id()).collect()
    assert len(out) == 20_002 and all((r.n, r.least) == by_key.get(r.k, (None, None)) for r in out)
    dealt = {}
    for r in out:
        dealt[r.p] = dealt.get(r.p, 0) + 1
    assert len(dealt) == 1 or max(dealt.values()) <= 2 * len(out) / len(dealt)


def test_decisions_of_a_hash_that_half_of_the_rows_share(spark):
    """The same as with a window, rows alike in everything included; no sort carries a text."""
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        h = "hot" if i % 2 else rng.choice(["u", "v", None, f"h{i}"])
        rows.append((f"i{rng.randint(0, 300)}", f"text {h}" if h != "v" else f"text {i % 3}", rng.choice(["en", "ar"]), rng.choice("ab"), rng.choice(["train", "val", "test"]), h, str(rng.randint(0, 20)), "real", "print"))
    rows += rows[:50]
    d = spark.createDataFrame(rows, "image string, text string, language string, dataset string, split string, sha256 string, source_row string, source_type string, domain string")
    got = dedup.leakage_resolution(d)
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.sha256, []).append(r)
    prio = {"test": 2, "val": 1, "train": 0}
    for h, group in by.items():
        texts, tops = {r.text for r in group}, max(prio[r.split] for r in group)
        if len(texts) > 1:
            assert {r.status for r in group} == {"quarantined"}
            continue
        kept = [r for r in group if r.status == "accepted"]
        score = lambda r: 10 + 1 + 100 * (r.language == "en")
        order = lambda r: (-prio[r.split], -score(r), r.dataset, r.image, r.source_row)
        assert len(kept) == 1 and order(kept[0]) == min(map(order, group))
        assert all(r.reason == ("lower_priority_split_removed" if prio[r.split] < tops else "same_split_exact_duplicate_removed") for r in group if r.status == "removed")


def test_keep_first_and_duplicated(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", None, "y" * 50, str(i)]), rng.randint(0, 30), rng.choice(["p", "q", None])) for i in range(600)]
    d = spark.createDataFrame(rows, "t string, i int, label string")
    got = dedup.keep_first(d, ["t"], [F.col("i")], "label").collect()
    first = {}
    for t, i, label in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
        first.setdefault(t, (i, label))
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(first)
    assert all((r.i, r.label) == first[r.t] for r in got if r.kept)
    assert all(r.kind == ("same_label_duplicate" if r.label == first[r.t][1] else "conflicting_duplicate") for r in got if not r.kept)
    counts = {}
    for t, *_ in rows:
        counts[t] = counts.get(t, 0) + 1
    assert sorted(r.i for r in dedup.duplicated(d, ["t"]).collect()) == sorted(i for t, i, _ in rows if counts[t] > 1)


def test_suffix_matches_of_one_basename_in_many_folders(spark):
    n = 100_000
    files = spark.range(n).selectExpr("concat('root/set', id % 10, '/d', id, '/1.png') AS path")
    rows = spark.createDataFrame([("d77/1.png",), ("set3/D13/1.PNG",), ("root/set5/d5/1.png",), ("1.png",), ("77/1.png",), (None,), ("",), ("x/2.png",)], "image string")
    got = {r.image: r.resolved for r in manifests.resolve_paths(rows, files).collect()}
    assert got == {"d77/1.png": "root/set7/d77/1.png", "set3/D13/1.PNG": "root/set3/d13/1.png", "root/set5/d5/1.png": "root/set5/d5/1.png", "1.png": "root/set0/d0/1.png", "77/1.png": None, None: None, "": None, "x/2.png": None}


def test_medians_go_over_counts_of_values(spark, monkeypatch):
    """Refinement sees each value once for its dimensions, however many rows have it; null and repeated ones count as rows do."""
    import statistics

    from quillspark.operators import metrics, ranges

    rows = [("a" if i % 3 else None, "x" if i % 2 else "y", None if i % 11 == 0 else i % 7) for i in range(2_000)]
    d = spark.createDataFrame(rows, "g string, h string, v int")
    seen, plain = [], ranges.quantiles
    monkeypatch.setattr(ranges, "quantiles", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    got = {(r.dimension, r.value): r.m for r in metrics.by_dimensions(d, ["g", "h"], {"n": "count(*)"}, {"m": "v"}).collect()}
    want = {("overall", None): statistics.median(v for _, _, v in rows if v is not None)}
    for i, name in enumerate("gh"):
        for k in {r[i] for r in rows}:
            want[name, k] = statistics.median(r[2] for r in rows if r[i] == k and r[2] is not None)
    assert got == want and seen == [3 * 2 * 2 * 7]
