"""Centroid clustering: Lloyd's rounds over integer vectors with exponion search.

Every vector keeps its centroid, an upper bound of the distance to it and a lower
bound of the distance to any other. Where the bounds don't settle it, only the
centroids within a ball around its own are measured: twice the upper bound plus the
distance from its own to the nearest other one, read off a sorted list of distances
between centroids. That ball holds the nearest and the second nearest. The radius is
inclusive and bounds are widened against rounding, so that ties come out by number.
Distances that decide are exact integers.

Corners: vectors that are null, of another length or hold a null or a non-finite
component are left out; rows without an id or with a repeated one are rows like
others (without an id they start last); fewer rows than centroids start as many as
there are; an empty table gives no rows. Other columns aren't read. A component of
2**26 or more in size after scaling raises, as squared distances wouldn't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Scaled components stay below this, so that squared distances of 1,024 components fit a long.
LIMIT = 1 << 26
#: Bounds are widened by this share against rounding.
SLACK = 1e-12


def finite(column: Column) -> Column:
    """Whether an array is there and all of its components are finite numbers."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def scaled(column: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as int64; raises where a component is too large."""
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)
    if x.size and (x.max() >= LIMIT or x.min() <= -LIMIT):
        raise ValueError(f"a scaled component is {LIMIT} or more in size")
    return x


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``y``."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * peak * peak * x.shape[1] < 1 << 53:  # every step is exact in doubles
        fx, fy = x.astype(np.float64), y.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2 * (fx @ fy.T) + (fy * fy).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    return ((x - y) ** 2).sum(1)


class Exponion:
    """Centroids with the sorted lists of the distances between them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at = centroids
        k = len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1) * (1 - SLACK)
        others = apart + np.diag(np.full(k, np.inf))
        self.near = others.min(1) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(paired(centroids, before).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        ranked = np.argsort(-moved, kind="stable")
        self.others_moved = np.full(k, moved[ranked[0]])
        self.others_moved[ranked[0]] = moved[ranked[1]] if k > 1 else 0.0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bound of vectors without a cluster; how many distances it took."""
        own, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
        self._scan(x, np.arange(len(x)), np.arange(len(self.at)), own, upper, lower)
        return own, upper, lower, len(x) * len(self.at)

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the centroids moved, from the bounds held before."""
        own = own.copy()
        upper = (upper + self.moved[own]) * (1 + SLACK)
        lower = (lower - self.others_moved[own]) * np.where(lower > self.others_moved[own], 1 - SLACK, 1 + SLACK)
        safe = np.maximum(lower, self.near[own] * (0.5 * (1 - SLACK)))
        rows = np.flatnonzero(upper >= safe)
        upper[rows] = np.sqrt(paired(x[rows], self.at[own[rows]]).astype(np.float64)) * (1 + SLACK)
        taken = len(rows)
        rows = rows[upper[rows] >= safe[rows]]
        if len(rows):
            radius = (2 * upper[rows] + self.near[own[rows]]) * (1 + SLACK)
            size = np.zeros(len(rows), np.int64)
            for c in np.unique(own[rows]):
                mine = own[rows] == c
                size[mine] = np.searchsorted(self.apart[c], radius[mine], "right")
            group = own[rows].astype(np.int64) * (len(self.at) + 1) + size
            ranked = np.argsort(group, kind="stable")
            for part in np.split(ranked, np.flatnonzero(np.diff(group[ranked])) + 1):
                c, m = divmod(int(group[part[0]]), len(self.at) + 1)
                self._scan(x, rows[part], np.sort(self.order[c, :m]), own, upper, lower)
                taken += len(part) * m
        return own, upper, lower, taken

    def _scan(self, x: np.ndarray, rows: np.ndarray, among: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Measure ``rows`` against the centroids ``among``, in ascending order; ties go to the smaller number."""
        step = max(1, (1 << 21) // max(1, len(among)))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            d = squared(x[some], self.at[among])
            best = d.argmin(1)
            own[some] = among[best]
            upper[some] = np.sqrt(d[np.arange(len(some)), best].astype(np.float64)) * (1 + SLACK)
            if len(among) > 1:
                lower[some] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK)
            else:
                lower[some] = np.inf


def start_rows(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``prefix`` and the id; rows without an id come last."""
    rank = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    got = vectors.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64)


def _pass(state: DataFrame, now: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    kind, dims, known = state.schema["vec_id"].dataType.simpleString(), now.shape[1], "own" in state.columns

    def run(batches):
        search = Exponion(now, before)
        for b in batches:
            x = matrix(b.column(1), dims)
            if known:
                own, upper, lower, _ = search.again(x, *(b.column(i).to_numpy() for i in (2, 3, 4)))
            else:
                own, upper, lower, _ = search.first(x)
            if last:
                out = [b.column(0), pa.array(own), pa.array(paired(x, now[own]))]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "own", "upper", "lower"])

    return state.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint" if last else f"vec_id {kind}, v array<bigint>, own int, upper double, lower double")


def means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floors of the exact means of each cluster; empty clusters stay. Sums are combined before they travel."""
    sums = [F.sum(F.get(F.col("v"), i)).alias(f"s{i}") for i in range(now.shape[1])]
    new = now.copy()
    for r in state.groupBy("own").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(now.shape[1])]
    return new


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, prefix: str = "1:", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector, and the centroids after ``rounds`` rounds.

    The vectors and their bounds are a table that each round writes anew; a lost
    executor costs its tasks of the round. Only ``k`` centroids and sums reach the driver.
    """
    base = vectors.where(finite(F.col(column)) & (F.size(column) == dims)).select("vec_id", scaled(F.col(column), scale).alias("v"))
    now, before = start_rows(base, k, prefix), None
    if not len(now):
        kind = base.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), np.zeros((0, dims), np.int64)
    if np.abs(now).max() >= LIMIT:
        raise ValueError(f"a scaled component is {LIMIT} or more in size")
    scratch, state = Scratch(), base
    for i in range(rounds):
        moved = scratch.durable(_pass(state, now, before, last=False))
        if i:
            scratch.drop(state)
        state, before, now = moved, now, means(moved, now)
    return scratch.result(_pass(state, now, before, last=True)), now


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """``clusters`` with each vector's inertia of its cluster and of all, and its centroid's digest."""
    got, centroids = clusters(vectors, **how)
    by = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid
    rows = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in by), digest(centroids[r["cluster"]])) for r in by]
    facts = got.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return got.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
