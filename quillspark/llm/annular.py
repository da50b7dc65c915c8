"""Vector code compression: product codes whose entries are searched by annular norm pruning.

A vector is cut into equal parts, each written as the index of the nearest entry of
its position's codebook. An entry can only be as near as the best one found so far if
its norm differs from the part's by no more than that distance. Entries are therefore
sorted by norm; the best of a few entries of similar norm gives a first distance, a
binary search gives the interval of norms it allows, bounds included, and only that
annulus is measured, exactly. Ties go to the lower index.

Codebooks are learned in rounds over all vectors. A round reads the table, sums parts
by entry within each task and again across tasks, and brings home one row for each
entry; nothing else is kept between rounds.

Corners: vectors that are null or hold a null or a non-finite component are left out;
vectors of another length than ``dims`` keep their row with a null code and error;
repeated ids are rows like others; fewer rows than entries start as many entries as
there are; an empty table gives no rows. Other columns aren't read. A component of
2**26 or more in size after scaling raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .exponion import LIMIT, SLACK, finite, matrix, paired, scaled, squared

#: Entries of similar norm that give the first distance; parts of similar intervals that are measured together; parts in a step.
PROBES, BLOCK, STEP = 8, 64, 1 << 15
#: Rows of one label are dealt over so many tasks when its sum is joined back.
SALTS = 16


class Annulus:
    """A codebook sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and exact squared distance of the nearest entry of each row; how many distances it took."""
        code, best, taken = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        for a in range(0, len(x), STEP):
            code[a : a + STEP], best[a : a + STEP], n = self._step(x[a : a + STEP])
            taken += n
        return code, best, taken

    def _step(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k = len(self.entries)
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        at = np.searchsorted(self.norms, norm)
        code, best = np.full(len(x), k), np.full(len(x), np.iinfo(np.int64).max)
        probes = min(PROBES, k)
        low = np.clip(at - probes // 2, 0, k - probes)
        for i in range(probes):
            best = np.minimum(best, paired(x, self.entries[self.order[low + i]]))
        reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK) + (norm + 1) * SLACK
        first = np.searchsorted(self.norms, norm - reach, "left")
        after = np.searchsorted(self.norms, norm + reach, "right")
        # parts whose intervals are about as wide and start together share a block
        ranked, taken = np.lexsort((first, np.log2(after - first).astype(int))), len(x) * probes
        for a in range(0, len(x), BLOCK):
            rows = ranked[a : a + BLOCK]
            among = np.sort(self.order[first[rows].min() : after[rows].max()])
            d = squared(x[rows], self.entries[among])
            j = d.argmin(1)  # entries in ascending order: the first of equals has the lower index
            code[rows], best[rows] = among[j], d[np.arange(len(rows)), j]
            taken += d.size
        return code, best, taken


def _kept(vectors: DataFrame, dims: int, scale: int, column: str) -> DataFrame:
    kept = vectors.where(finite(F.col(column)))
    return kept.select("vec_id", "label", F.when(F.size(column) == dims, scaled(F.col(column), scale)).alias("v"))


def starts(kept: DataFrame, entries: int, parts: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the vectors with the least ids; rows without an id come last."""
    got = kept.where("v IS NOT NULL").select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    rows = np.array([r["v"] for r in got], np.int64)
    if rows.size and np.abs(rows).max() >= LIMIT:
        raise ValueError(f"a scaled component is {LIMIT} or more in size")
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2) if len(rows) else np.zeros((parts, 0, 0), np.int64)


def learned(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the exact mean of its parts; unused entries stay."""
    parts, k, width = books.shape

    def run(batches):
        search = [Annulus(b) for b in books]
        n, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for b in batches:
            x = matrix(b.column(0), parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _, _ = search[p].nearest(own)
                ranked = np.argsort(code, kind="stable")
                used, first = np.unique(code[ranked], return_index=True)
                if len(used):
                    sums[p * k + used] += np.add.reduceat(own[ranked], first)
                    n[p * k + used] += np.diff(np.append(first, len(ranked)))
        used = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), sums], names=["entry", "n", "s"])

    task = kept.where("v IS NOT NULL").select("v").mapInArrow(run, "entry bigint, n bigint, s array<bigint>")
    new = books.copy().reshape(parts * k, width)
    for r in task.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", i)).alias(f"s{i}") for i in range(width))).collect():
        new[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new.reshape(books.shape)


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every kept row."""
    parts, _, width = books.shape
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    digits = np.array([f"{i:02x}" for i in range(max(1, books.shape[1]))])

    def run(batches):
        search = [Annulus(b) for b in books]
        for b in batches:
            there = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = matrix(b.column(2), parts * width)
            error, text = np.zeros(len(x), np.int64), np.full(len(x), "", f"<U{2 * parts}")
            for p in range(parts):
                code, best, _ = search[p].nearest(x[:, p * width : (p + 1) * width])
                error += best
                text = np.char.add(text, digits[code])
            codes, errors = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            codes[there], errors[there] = text, error
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=~there)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, dims: int = 64, scale: int = 1024, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of all kept vectors, and the codebooks (part, entry, position)."""
    if entries > 256 or dims % parts:
        raise ValueError("an index has two hex digits, and parts are of equal length")
    kept = _kept(vectors, dims, scale, column)
    books = starts(kept, entries, parts)
    if not books.size:  # no vector has the length: all codes are null
        none = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        return none, books
    for _ in range(rounds):
        books = learned(kept, books)
    return durable(coded(kept, books)), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors summed over equal labels, null labels together; rows of one label are dealt over SALTS tasks."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("text"))
    sums = codes.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    dealt = sums.select("key", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = codes.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, ["key", "salt"]).drop("key", "salt")


def vector_codes(vectors: DataFrame, **how) -> DataFrame:
    """Codes with errors by row and by label, and the digest of all codebooks."""
    codes, books = compressed(vectors, **how)
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
