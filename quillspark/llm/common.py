"""Shared pieces of the training-data operators.

Texts reach Python as Arrow string columns; the helpers below work on their raw
UTF-8 buffers, chunk by chunk, so that neither a batch nor a long document is
turned into Python objects word by word.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
WORD_RE = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one vectorised step takes (a longer document is one step).
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WBASE = np.uint64(0xD1342543DE82EF95 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or the context's own.

    Only a local session, which has one machine, may go without: it gets a temporary one.
    """
    context = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return context._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _delete_left() -> None:
    """What results still read goes when the driver ends."""
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session has ended before, and there is nobody to tell
            return


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _left[path] = spark
    return path, spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared folder and read it back.

    The files outlive any executor; Parquet keeps them a fraction of the size of
    an RDD checkpoint. The shuffle files of the query that wrote them are removed
    as it ends, so a job's stages don't add up on the executors' disks. The folder
    goes when the driver ends.
    """
    return _written(df)[1]


class Scratch:
    """Durable tables of one job, dropped together or one by one."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def durable(self, df: DataFrame) -> DataFrame:
        path, out = _written(df)
        self.paths.add(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        for path in [t._scratch_path for t in tables] if tables else list(self.paths):
            self.paths.discard(path)
            _delete(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written on its own, so that all else can go."""
        out = durable(df)
        self.drop()
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64 (wraps silently)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, U64(pow(int(base), -1, 1 << 64))
        self.p = self.q = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n + 1:
            size = max(n + 1, 1 << 16)
            b, i = np.full(size, self.base, U64), np.full(size, self.inv, U64)
            b[0] = i[0] = 1
            self.p, self.q = np.cumprod(b, dtype=U64), np.cumprod(i, dtype=U64)
        return self.p, self.q


_BYTE_POW, _WORD_POW = _Powers(_BASE), _Powers(_WBASE)


class Tokens:
    """The words of some consecutive documents.

    ``data`` are their UTF-8 bytes, ``off`` the n+1 document offsets in it,
    ``start``/``end`` the byte range of each word, ``doc`` its document and
    ``first`` the n+1 offsets of documents among the words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower_ascii: bool = False) -> None:
        if lower_ascii:
            upper = (data - np.uint8(65)) < np.uint8(26)
            data = np.where(upper, data | np.uint8(32), data)
        self.data, self.off = data, off
        n = len(data)
        ink = ((data - np.uint8(9)) >= np.uint8(5)) & (data != np.uint8(32))
        self.ink = ink
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = ink[:-1], ink[1:]
        self.start = np.flatnonzero(ink & (~before | edge[:n]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        p, q = _BYTE_POW.upto(len(self.data) + 1)
        n = len(self.data)
        s = np.zeros(n + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * p[:n], out=s[1:])
        return mix64((s[end] - s[start]) * q[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.start, self.end)

    def window_starts(self, width: int) -> np.ndarray:
        """Indices of the words at which ``width`` words of one document start."""
        ok = np.arange(len(self.start)) + width <= self.first[1:][self.doc]
        return np.flatnonzero(ok)


def window_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window_hashes`` takes the hash of any word range."""
    p, _ = _WORD_POW.upto(len(words) + 1)
    s = np.zeros(len(words) + 1, U64)
    np.cumsum(words * p[: len(words)], out=s[1:])
    return s


def window_hashes(sums: np.ndarray, start: np.ndarray, width) -> np.ndarray:
    """64-bit hashes of the word ranges [start, start + width)."""
    _, q = _WORD_POW.upto(len(sums))
    return mix64((sums[start + width] - sums[start]) * q[start])


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls are empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(col: pa.Array, lower_ascii: bool = False) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, row after the last, words) of slices of about CHUNK_BYTES."""
    data, off = utf8_buffers(col)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b, Tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], lower_ascii)
        a = b


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each range, concatenated."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def crc_fold(key: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5
