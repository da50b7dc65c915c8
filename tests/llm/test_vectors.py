"""Exponion clustering and annular product codes against plain loops, and their corners."""

import duckdb
import numpy as np
import pytest

from quillspark.llm import annular, exponion, vector_sql

KIND = "vec_id bigint, embedding array<float>, label int, cluster string, code string, v int"


def plain_nearest(x, c):
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x])
    return d.argmin(1), d.min(1), np.sort(d, axis=1)[:, 1] if len(c) > 1 else np.full(len(x), np.inf)


@pytest.mark.parametrize("seed,dims,k,span", [(0, 2, 7, 3), (1, 3, 16, 4), (2, 5, 9, 100), (3, 1, 2, 2), (4, 2, 1, 5)])
def test_bounded_search_equals_a_full_one(seed, dims, k, span):
    """Small spans give many ties; duplicates among centroids stay apart by number."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-span, span, (200, dims)), rng.integers(-span, span, (k, dims))
    own, upper, lower, taken = exponion.Exponion(c).first(x)
    for _ in range(5):
        want, d, second = plain_nearest(x, c)
        assert (own == want).all() and (upper**2 >= d * (1 - 1e-9)).all() and (np.maximum(lower, 0) ** 2 <= second * (1 + 1e-9)).all()
        moved = np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(k)])
        own, upper, lower, taken = exponion.Exponion(moved, c).again(x, own, upper, lower)
        c = moved
    assert (own == plain_nearest(x, c)[0]).all()
    assert taken < 200 * k or k < 3  # the bounds spare distances


@pytest.mark.parametrize("seed,width,k,span", [(0, 2, 9, 3), (1, 4, 256, 50), (2, 16, 40, 500), (3, 1, 1, 4), (4, 3, 12, 1)])
def test_annulus_equals_a_full_search(seed, width, k, span):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-span, span + 1, (700, width)), rng.integers(-span, span + 1, (k, width))
    code, best, taken = annular.Annulus(c).nearest(x)
    want, d, _ = plain_nearest(x, c)
    assert (code == want).all() and (best == d).all()


def test_annulus_spares_entries_of_other_norms():
    rng = np.random.default_rng(9)
    x = (rng.normal(0, 10, (3000, 3)) * np.exp(rng.uniform(0, 6, (3000, 1)))).astype(np.int64)
    code, best, taken = annular.Annulus(x[:256]).nearest(x)
    d = exponion.squared(x, x[:256])
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and taken < 0.6 * d.size


def test_large_components_stay_exact():
    x = np.array([[1 << 25, -(1 << 25)], [(1 << 25) + 1, 3]])
    assert exponion.squared(x, x).tolist() == [[int(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q))) for q in x] for p in x]


@pytest.fixture(scope="module")
def corner_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist(), i % 3 if i % 4 else None) for i in range(60)]
    rows += [(7, rows[8][1], 1), (7, rows[8][1], 1), (None, rows[9][1], None), (None, None, 1), (90, None, None)]
    rows += [(91, [0.1] * 63, 1), (92, [], 1), (93, [float("nan")] + [0.0] * 63, 1), (94, [float("inf")] + [0.0] * 63, 1), (95, [None] + [0.0] * 63, 1)]
    return spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], KIND)


def test_corner_vectors(spark, corner_vectors):
    got = exponion.clustered(corner_vectors).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in got) == sorted([*range(60), 7, 7, -1])
    twins = [r[1:] for r in got if r.vec_id in (7, 8)]
    assert len(set(twins)) <= 2 and sum(r.distance for r in got) == got[0].inertia
    codes = annular.vector_codes(corner_vectors, entries=4).collect()
    assert len(codes) == 65 and sum(r.code is None for r in codes) == 2  # lengths 63 and 0 keep their rows
    assert all(len(r.code) == 8 for r in codes if r.code)
    plain, _ = annular.compressed(corner_vectors, entries=4)
    sums = {}
    for r in plain.collect():
        sums[r.label] = sums.get(r.label, 0) + (r.error or 0)
    assert set(sums.values()) == {r.label_error for r in codes} and sum(sums.values()) > 0


def test_empty_and_small_tables(spark, corner_vectors):
    none = corner_vectors.limit(0)
    assert exponion.clustered(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert exponion.clustered(none).count() == 0 and annular.vector_codes(none).count() == 0
    few = corner_vectors.where("vec_id < 5")
    assert {r.distance for r in exponion.clustered(few).collect()} == {0}
    assert {r.error for r in annular.vector_codes(few).collect()} == {0}


def test_too_large_components_raise(spark):
    huge = spark.createDataFrame([(1, [3e38] * 64, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="or more in size"):
        exponion.clustered(huge).collect()
    with pytest.raises(Exception, match="or more in size"):
        annular.vector_codes(huge).collect()


def test_sql_on_ties_and_empty_clusters(spark, tmp_path):
    """Vectors on a coarse grid: equal distances, equal starting vectors, empty clusters and unused entries."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(0, 2, 64) / 64).astype(np.float32).tolist() if i % 3 else [0.0] * 64, int(i % 2)) for i in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/e")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    table = spark.read.parquet(f"{tmp_path}/e")
    for got, sql in ((exponion.clustered(table), vector_sql.centroid_sql()), (annular.vector_codes(table), vector_sql.code_sql())):
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
