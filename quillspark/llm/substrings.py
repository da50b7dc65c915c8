"""Removal of long repeated word sequences by difference-cover anchors.

With a difference cover D modulo ``v`` any two positions i and j have a shift below
``v`` that puts both into D. So two equal windows of ``width`` words share, at the
same place within them, an anchor: ``width - v + 1`` words that start at a cover
position. Only anchors are hashed and exchanged over the whole corpus. Windows that
hold an anchor found elsewhere are then extended to their full width and exchanged,
and those alone decide.

Rows are known by two hashes of their id and text: equal rows have the same places.
Keys are counted before they travel, and what is common is joined, never gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, chunks, mix64, window_hashes, window_sums

# Perfect difference sets, period to positions.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_LIMIT = 1 << 17


def period_for(width: int) -> int:
    """The longest period that leaves anchors of at least two fifths of a window."""
    return max((v for v in COVERS if width - v + 1 >= max(2, width * 2 // 5)), default=0)


def _anchor_starts(tokens, width: int, v: int) -> np.ndarray:
    """Word indices at which anchors start; all windows' where the width allows no cover."""
    span = width - v + 1 if v else width
    at = tokens.window_starts(span)
    if not v:
        return at
    cover = np.zeros(v, bool)
    cover[list(COVERS[v])] = True
    return at[cover[(at - tokens.first[:-1][tokens.doc[at]]) % v]]


def _anchors(width: int, v: int):
    """(r0, r1, text) to (key, r0, r1, place): a row for each anchor; places are indices of words."""

    def run(batches):
        for batch in batches:
            for a, b, tokens in chunks(batch.column(2)):
                at = _anchor_starts(tokens, width, v)
                if not len(at):
                    continue
                h = window_hashes(window_sums(tokens.word_hashes()), at, width - v + 1 if v else width)
                yield from _rows(batch, a, tokens, at, [pa.array(h.view(np.int64))], ["key"])

    return run


def _rows(batch, a: int, tokens, at: np.ndarray, keys: list, names: list[str]):
    """Record batches of keys with the row and place of the words ``at``."""
    doc = tokens.doc[at]
    rows, place = pa.array(doc + a), pa.array((at - tokens.first[:-1][doc]).astype(np.int32))
    cols = [*keys, batch.column(0).take(rows), batch.column(1).take(rows), place]
    for i in range(0, len(at), _LIMIT):
        yield pa.RecordBatch.from_arrays([c[i : i + _LIMIT] for c in cols], names=[*names, "r0", "r1", "place"])


def _candidates(tokens, rows: list[np.ndarray], width: int, v: int) -> np.ndarray:
    """Word indices of the windows that hold, within their first ``v`` words, an anchor of ``rows`` (positions by document)."""
    n = len(tokens.start)
    mark = np.zeros(n + 1, np.int64)
    for d, pos in enumerate(rows):
        if len(pos):
            lo = tokens.first[d]
            np.add.at(mark, lo + np.maximum(0, pos - max(v - 1, 0)), 1)
            np.add.at(mark, lo + pos + 1, -1)
    near = np.cumsum(mark[:-1]) > 0
    ok = np.arange(n) + width <= tokens.first[1:][tokens.doc]
    return np.flatnonzero(near & ok)


def _lists(col, a: int, b: int) -> list[np.ndarray]:
    """Word indices for rows a..b from a column of lists of places (null: none)."""
    part = col.slice(a, b - a)
    off, values = part.offsets.to_numpy(), part.values.to_numpy(zero_copy_only=False)
    valid = part.is_valid().to_numpy(zero_copy_only=False)
    return [values[off[i] : off[i + 1]] if valid[i] else values[:0] for i in range(b - a)]


def _windows(width: int, v: int):
    """(r0, r1, text, hits) to the candidate windows' keys; ``check`` makes them 96 bits."""

    def run(batches):
        for batch in batches:
            for a, b, tokens in chunks(batch.column(2)):
                at = _candidates(tokens, _lists(batch.column(3), a, b), width, v)
                if not len(at):
                    continue
                wh = tokens.word_hashes()
                h = window_hashes(window_sums(wh), at, width)
                g = window_hashes(window_sums(mix64(wh ^ U64(0x94D049BB133111EB))), at, width)
                check = (g >> U64(32)).astype(np.uint32).view(np.int32)
                yield from _rows(batch, a, tokens, at, [pa.array(h.view(np.int64)), pa.array(check)], ["key", "check"])

    return run


def _finish(width: int, v: int, keep_text: bool):
    """(doc_id, text, hits, misses, carried columns) to the result rows."""

    def run(batches):
        for batch in batches:
            for a, b, tokens in chunks(batch.column(1)):
                at = _candidates(tokens, _lists(batch.column(2), a, b), width, v)
                hit = np.zeros(len(tokens.start), bool)
                hit[at] = True
                for d, pos in enumerate(_lists(batch.column(3), a, b)):
                    hit[tokens.first[d] + pos] = False
                at = np.flatnonzero(hit)
                mark = np.zeros(len(tokens.start) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + width, -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[tokens.first]
                removed = np.diff(removed)
                raw = tokens.data.tobytes()
                kept, sha = [], []
                for d in range(b - a):
                    lo, hi = tokens.first[d], tokens.first[d + 1]
                    words = raw[tokens.off[d] : tokens.off[d + 1]].split()
                    if removed[d]:
                        words = [w for w, g in zip(words, gone[lo:hi].tolist()) if not g]
                    joined = b" ".join(words)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if keep_text:
                        kept.append(joined if removed[d] else raw[tokens.off[d] : tokens.off[d + 1]])
                cols = [batch.column(0)[a:b], pa.array(tokens.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha)]
                if keep_text:
                    cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)] + batch.schema.names[4:]
                yield pa.RecordBatch.from_arrays(cols + [c[a:b] for c in batch.columns[4:]], names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = 35, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text; then ``carry``.

    A word goes if a window of ``width`` words that covers it starts anywhere else
    too, in the same document or another; windows are judged on the input. Rows need
    no id: rows without one, and rows that repeat one or are equal, are each judged
    as documents of their own. Null and
    empty texts have no words and hash as empty. ``kept_text`` is the text itself
    where nothing went, else the kept words joined by one space. ``carry`` names
    columns that pass through; others aren't read; an empty table gives no rows.
    """
    v, work = period_for(width), Scratch()
    row = {"r0": F.xxhash64("doc_id", "text"), "r1": F.xxhash64(F.lit(1), "text", "doc_id")}
    base = docs.select(*(c.alias(k) for k, c in row.items()), "text")
    anchors = base.mapInArrow(_anchors(width, v), "key bigint, r0 bigint, r1 bigint, place int")
    common = work.durable(anchors.groupBy("key").count().where("count > 1").select("key"))
    # Places of one text at most come together; equal rows have the same ones.
    hits = work.durable(anchors.join(common, "key").groupBy("r0", "r1").agg(F.collect_set("place").alias("hits")))
    work.drop(common)
    windows = base.join(hits, ["r0", "r1"]).select("r0", "r1", "text", "hits").mapInArrow(_windows(width, v), "key bigint, check int, r0 bigint, r1 bigint, place int")
    once = windows.groupBy("key", "check").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("r0", "r1", "place"))).where("_n = 1")
    misses = once.groupBy("r0", "r1").agg(F.collect_set("place").alias("misses"))
    found = work.durable(hits.join(misses, ["r0", "r1"], "left"))
    work.drop(hits)
    # Carried columns travel in one, so that their names can't clash.
    taken = [c for c in carry if c != "doc_id"]
    packed = [F.struct(*(F.col(f"`{c}`") for c in taken)).alias("_carried")] if taken else []
    out = docs.select(*(c.alias(f"_{k}") for k, c in row.items()), "doc_id", "text", *packed)
    fields = {f.name: f.dataType.simpleString() for f in out.schema}
    out = out.join(found, (F.col("_r0") == F.col("r0")) & (F.col("_r1") == F.col("r1")), "left").select("doc_id", "text", "hits", "misses", *["_carried"] * bool(taken))
    schema = f"doc_id {fields['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text + (f", _carried {fields['_carried']}" if taken else "")
    out = out.mapInArrow(_finish(width, v, keep_text), schema)
    return out.select("*", *(F.col("_carried").getField(c).alias(c) for c in taken)).drop("_carried")
