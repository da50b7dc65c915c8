"""Exact Jaccard join of documents on word shingles by PartEnum signatures.

A pair of sets with Jaccard similarity of at least ``t`` differs in few elements:
|A ^ B| <= (1-t)/(1+t) * (|A|+|B|). Sets are put in bands of size. A pair is
compared in the band of its larger set; its difference is then at most a number
``k`` that the band fixes. The domain of elements is dealt to ``n1`` partitions, each
to PARTS parts, and a signature is the content of a set in the parts of one
partition that are left when LEFT_OUT of them are taken out, for every subset of
parts. Every partition with at most LEFT_OUT differing elements gives a common
signature, and of ``n1 = floor(k / (LEFT_OUT+1)) + 1 + spare`` partitions at least
``spare + 1`` are of that kind. (Where k is 0 the whole set is the one signature.)

Empty signatures would bring strangers together. A partition is weak for a set if
some signature in it is empty; a set with at most ``spare`` weak partitions is
steady. Of the ``spare + 1`` partitions above at most ``spare`` are weak for a steady
set, so it shares a signature that isn't empty with every partner. Sets that aren't
steady also emit under another dealing of the domain, and so on: a pair meets in the
first dealing in which one of the two is steady. What isn't steady in the last of
DEALINGS emits its empty signatures too.

Sets that share a signature become candidates of their signature's first set only,
so the number of candidates is linear in the rows. Candidates pass an exact sketch
filter and an exact check; signatures whose members are by then of one component are
done. In the others, members of different components meet in blocks of BLOCK rows
under the same filter; of each two components a block first gives its closest pair
only, and what these links leave apart is compared in full.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, chunks, mix64, ragged, window_hashes, window_sums
from .graph import components

#: Ratio of a band's largest to its smallest size; parts of a partition and how many of them a signature leaves out; dealings of the domain.
BAND_RATIO, PARTS, LEFT_OUT, DEALINGS = 1.4, 3, 1, 8
#: 64-bit words of a short sketch; sets above LONG elements also have one of WIDE words.
SKETCH, LONG, WIDE = 16, 1000, 64
#: Rows of a signature that are compared with as many others at once; pairs of one step.
BLOCK, STEP_PAIRS = 2048, 1 << 18
_ROW_LIMIT = 1 << 17


class Shape:
    """What the threshold (a ratio of integers, ``num`` of 100) fixes for each band."""

    def __init__(self, num: int, n2: int = PARTS, k2: int = LEFT_OUT) -> None:
        self.num, self.n2, self.k2 = num, n2, k2
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
        self.tops = np.array(tops)  # largest size of each band
        self.k = (2 * self.tops * (100 - num)) // (100 + num)
        self.spare = self.k // 6
        self.n1 = np.where(self.k > 0, self.k // (k2 + 1) + 1 + self.spare, 1)

    def bands(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set's own band, and whether larger partners may be in the next one."""
        own = np.searchsorted(self.tops, sizes)
        return own, (sizes * 100) // self.num > self.tops[own]

    def most_apart(self, a, b):
        """Largest symmetric difference of a pair of these sizes at the threshold."""
        return ((a + b) * (100 - self.num)) // (100 + self.num)


def shingle_sets(tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, by document, and n+1 offsets.

    A shorter document's whole word sequence is one shingle; without words, none.
    """
    sums = window_sums(tokens.word_hashes())
    starts = tokens.window_starts(width)
    docs, h = tokens.doc[starts], window_hashes(sums, starts, width)
    short = np.flatnonzero((tokens.count > 0) & (tokens.count < width))
    if len(short):
        n = tokens.count[short]
        h = np.concatenate([h, mix64(window_hashes(sums, tokens.first[:-1][short], n) + n.astype(U64))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((h, docs))
    docs, h = docs[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    docs, h = docs[keep], h[keep]
    return h, np.searchsorted(docs, np.arange(len(tokens.count) + 1))


def _sums(cell: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of uint64 values by cell (exact: halves stay below 2**53)."""
    lo = np.bincount(cell, (values & U64(0xFFFFFFFF)).astype(np.float64), n)
    hi = np.bincount(cell, (values >> U64(32)).astype(np.float64), n)
    return lo.astype(U64) + (hi.astype(U64) << U64(32))


def signatures(h: np.ndarray, off: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) of all sets; empty sets have none."""
    sizes = np.diff(off)
    own, wider = shape.bands(sizes)
    value = mix64(h + U64(0x2545F4914F6CDD1D))
    out = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    for up in (0, 1):
        chosen = np.flatnonzero((sizes > 0) & (wider if up else True))
        alike = shape.k[own[chosen] + up] == 0
        whole, chosen = chosen[alike], chosen[~alike]
        if len(whole):  # partners are equal
            doc = np.repeat(np.arange(len(whole)), sizes[whole])
            content = _sums(doc, value[ragged(off[:-1][whole], sizes[whole])], len(whole))
            out.append((mix64(content ^ mix64((own[whole] + up).astype(U64))), whole))
        for dealing in range(DEALINGS):
            if not len(chosen):
                break
            sig, who, chosen = _dealt(h, value, off, sizes, chosen, own[chosen] + up, shape, dealing)
            out.append((sig, who))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _dealt(h, value, off, sizes, chosen, band, shape: Shape, dealing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the ``chosen`` sets in one dealing, their sets, and the sets that aren't steady in it."""
    n, n1, n2 = sizes[chosen], shape.n1[band], shape.n2
    base = np.concatenate([[0], np.cumsum(n1)])
    at = ragged(off[:-1][chosen], n)
    each = np.repeat(np.arange(len(chosen)), n)
    spread = mix64(h[at] ^ mix64(np.full(1, 0x51ED270B + dealing, U64)))
    part = ((spread >> U64(32)) % n1[each].astype(U64)).astype(np.int64)
    cell = (base[each] + part) * n2 + ((spread & U64(0xFFFFFFFF)) % U64(n2)).astype(np.int64)
    total = int(base[-1])
    sums = _sums(cell, value[at], total * n2).reshape(total, n2)
    counts = np.bincount(cell, minlength=total * n2).reshape(total, n2)
    subsets = list(combinations(range(n2), n2 - shape.k2))
    held = np.stack([counts[:, list(s)].sum(1) for s in subsets])
    owner = np.repeat(np.arange(len(chosen)), n1)
    number = (np.arange(total) - base[:-1][owner]).astype(U64)
    n_weak = np.bincount(owner[held.min(0) == 0], minlength=len(chosen))
    loose = n_weak > shape.spare[band]
    every = loose[owner] if dealing == DEALINGS - 1 else np.zeros(total, bool)
    out_sig, out_set = [], []
    for i, s in enumerate(subsets):
        go = every | (held[i] > 0)
        content = mix64(sums[go][:, list(s)].sum(1, dtype=U64) + held[i][go].astype(U64) * U64(0x9FB21C651E98DF25))
        tag = mix64(number[go] * U64(1 << 20) + band[owner[go]].astype(U64) * U64(1 << 10) + U64(i * DEALINGS + dealing))
        out_sig.append(mix64(content ^ tag))
        out_set.append(chosen[owner[go]])
    return np.concatenate(out_sig), np.concatenate(out_set), chosen[loose]


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of a set of n: a power of two, SKETCH at least, 4 bits an element."""
    need = np.maximum(SKETCH, -(-4 * n // 64))
    return 1 << np.ceil(np.log2(need)).astype(np.int64)


def sketches(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches, concatenated, and their n+1 offsets in words.

    Bit i of a set's sketch is the parity of its elements that hash to i. Two
    sketches of one length differ in at most as many bits as the sets do in
    elements; one is brought to half its length by adding its halves (xor).
    """
    sizes = np.diff(off)
    words = sketch_words(sizes)
    at = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mix64(h ^ U64(0xC2B2AE3D27D4EB4F)) % (words[doc].astype(U64) * U64(64))).astype(np.int64)
    odd = (np.bincount(at[doc] * 64 + bit, minlength=int(at[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), at


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch brought down to ``words``."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, at the shorter one's length (unsigned: numpy counts the bits of absolute values)."""
    n = min(len(x), len(y))
    return int(np.bitwise_count((fold(x, n) ^ fold(y, n)).view(U64)).sum())


SKETCH_COLS = [f"s{i}" for i in range(SKETCH)]


def _info(width: int):
    """Arrow function: (id, text, doc_id) to (id, doc_id, n_shingles, two set hashes, sketch)."""

    def run(batches):
        for batch in batches:
            for a, b, tokens in chunks(batch.column(1), lower_ascii=True):
                h, off = shingle_sets(tokens, width)
                doc = np.repeat(np.arange(b - a), np.diff(off))
                sets = [_sums(doc, mix64(h ^ U64(seed)), b - a).view(np.int64) for seed in (0x1B873593, 0xCC9E2D51)]
                sk, at = sketches(h, off)
                short = np.stack([fold(sk[at[i] : at[i + 1]], SKETCH) for i in range(b - a)])
                wide = [fold(sk[at[i] : at[i + 1]], WIDE) if at[i + 1] - at[i] >= WIDE else None for i in range(b - a)]
                cols = [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(off).astype(np.int64)), *map(pa.array, sets), *(pa.array(np.ascontiguousarray(short[:, i])) for i in range(SKETCH)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sk)), pa.array(wide, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "doc_id", "n_shingles", "h0", "h1", *SKETCH_COLS, "sketch", "wide"])

    return run


def _emitted(batches, width: int, shape: Shape):
    """(ids, signatures, indices of ids) of each chunk; equal sets emit once in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, tokens in chunks(batch.column(1), lower_ascii=True):
            h, off = shingle_sets(tokens, width)
            doc = np.repeat(np.arange(b - a), np.diff(off))
            sets = np.stack([_sums(doc, mix64(h ^ U64(seed)), b - a) for seed in (0x1B873593, 0xCC9E2D51)], 1)
            first = []
            for i, row in enumerate(sets):
                if (key := row.tobytes()) not in seen:
                    seen.add(key)
                    first.append(i)
            first, sizes = np.array(first, np.int64), np.diff(off)
            h = h[ragged(off[:-1][first], sizes[first])]
            yield ids[a:b][first], *signatures(h, np.concatenate([[0], np.cumsum(sizes[first])]), shape)


def _counts(width: int, shape: Shape):
    """Arrow function: (id, text) to (sig, n), summed in each chunk."""

    def run(batches):
        for _, sig, _ in _emitted(batches, width, shape):
            sig, n = np.unique(sig, return_counts=True)
            for i in range(0, len(sig), _ROW_LIMIT):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + _ROW_LIMIT].view(np.int64)), pa.array(n[i : i + _ROW_LIMIT].astype(np.int32))], names=["sig", "n"])

    return run


def _emit(width: int, shape: Shape):
    """Arrow function: (id, text) to (sig, id)."""

    def run(batches):
        for ids, sig, which in _emitted(batches, width, shape):
            for i in range(0, len(sig), _ROW_LIMIT):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + _ROW_LIMIT].view(np.int64)), pa.array(ids[which[i : i + _ROW_LIMIT]])], names=["sig", "id"])

    return run


def _values(col) -> list[np.ndarray]:
    """The rows of a list<bigint> column as arrays."""
    off, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    return [values[off[i] : off[i + 1]] for i in range(len(col))]


def _near(shape: Shape):
    """Arrow function over (a, b, na, nb, sketches): keeps pairs that may be at the threshold."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            most = shape.most_apart(na, nb)
            fits = 100 * np.minimum(na, nb) >= shape.num * np.maximum(na, nb)
            keep = []
            for ok, m, x, y in zip(fits, most, _values(batch.column(4)), _values(batch.column(5))):
                if ok:
                    ok = bits_apart(x, y) <= m
                keep.append(bool(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlap(shape: Shape):
    """Arrow function over pairs with both texts' sets: keeps those at the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_values(batch.column(2)), _values(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= shape.num * (len(x) + len(y) - both) and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def _sets(width: int):
    """Arrow function: (id, text) to (id, hash of the set, sorted array of shingle hashes); a task's repeats come once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, tokens in chunks(batch.column(1), lower_ascii=True):
                h, off = shingle_sets(tokens, width)
                sets = _sums(np.repeat(np.arange(b - a), np.diff(off)), mix64(h ^ U64(0x1B873593)), b - a).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
                new = []
                for i, key in enumerate(zip(ids[a:b].tolist(), sets.tolist())):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets), lists], names=["id", "h", "elements"]).take(pa.array(new, pa.int64()))

    return run


def _meet(shape: Shape, closest: bool):
    """Arrow function over rows in the order of (sig, i, j): pairs of different components that may link.

    Columns: sig, i, j, right, id, comp, n_shingles, wide, SKETCH_COLS. Rows of a
    block (i = j) meet one another, else left ones meet right ones. With ``closest``
    each left row gives for each component met in a step the closest pair only.
    """

    def compare(rows, x, y):
        na, nb = rows["n_shingles"][x], rows["n_shingles"][y]
        ok = (rows["comp"][x] != rows["comp"][y]) & (100 * np.minimum(na, nb) >= shape.num * np.maximum(na, nb))
        x, y = x[ok], y[ok]
        most = shape.most_apart(rows["n_shingles"][x], rows["n_shingles"][y])
        bits = np.zeros(len(x), np.int64)
        for i, c in enumerate(SKETCH_COLS):
            bits += np.bitwise_count(rows[c][x] ^ rows[c][y])
            if i % 4 == 3:
                ok = bits <= most
                x, y, most, bits = x[ok], y[ok], most[ok], bits[ok]
        both = np.flatnonzero(rows["has_wide"][x] & rows["has_wide"][y])
        if len(both):
            wide = rows["wide"]
            bits[both] = [bits_apart(_row(wide, x[i]), _row(wide, y[i])) for i in both.tolist()]
            ok = bits <= most
            x, y, bits = x[ok], y[ok], bits[ok]
        if closest and len(x):  # for each left row and component met
            order = np.lexsort((rows["id"][y], bits, rows["comp"][y], x))
            x, y = x[order], y[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (rows["comp"][y][1:] != rows["comp"][y][:-1])
            x, y = x[new], y[new]
            a, b = rows["comp"][x], rows["comp"][y]
            _, one = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
            x, y = x[one], y[one]
        a, b = rows["id"][x], rows["id"][y]
        return np.minimum(a, b), np.maximum(a, b)

    def groups(table):
        """Pairs of whole groups, in steps of STEP_PAIRS at most (a row's partners stay together)."""
        rows = {c: table.column(c).to_numpy() for c in ("sig", "i", "j", "id", "comp", "n_shingles")} | {c: table.column(c).to_numpy().view(U64) for c in SKETCH_COLS}
        right = table.column("right").to_numpy(zero_copy_only=False)
        rows["wide"] = table.column("wide").combine_chunks() if isinstance(table.column("wide"), pa.ChunkedArray) else table.column("wide")
        rows["has_wide"] = rows["wide"].is_valid().to_numpy(zero_copy_only=False)
        n = len(right)
        new = np.ones(n, bool)
        new[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        end = np.repeat(start + size, size)
        # rights follow lefts; a left row's partners begin at the first right row, or behind itself
        lefts = np.repeat(np.add.reduceat((~right).astype(np.int64), start), size)
        inner = rows["i"] == rows["j"]
        begin = np.where(inner, np.arange(n) + 1, np.repeat(start, size) + lefts)
        partners = np.where(right, 0, end - begin)
        total = np.cumsum(partners)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP_PAIRS, "right")))
            m = partners[a:b]
            if m.any():
                yield compare(rows, np.repeat(np.arange(a, b), m), ragged(begin[a:b], m))
            a = b

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = table.slice(table.num_rows - 1).select(["sig", "i", "j"]).to_pylist()[0]
            same = np.logical_and.reduce([table.column(c).to_numpy() == last[c] for c in last])
            whole = int(np.argmax(same))  # the last group may go on in the next batch
            if whole:
                for a, b in groups(table.slice(0, whole).combine_chunks()):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            for a, b in groups(pa.Table.from_batches(held).combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _row(col, i: int) -> np.ndarray:
    return col[i].values.to_numpy(zero_copy_only=False)


def _crossing(shared: DataFrame, found: DataFrame, sided: DataFrame, shape: Shape, closest: bool) -> DataFrame:
    """Pairs (a, b) that share a signature, are of different components by now and may link.

    A signature's rows are dealt to blocks of about BLOCK rows by a hash, and each two
    blocks meet in a task's stream of their own; no more rows than two blocks are held.
    """
    now = shared.join(found, shared.id == found.node, "left").select("sig", "id", F.coalesce("component", "id").alias("comp"))
    split = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("_m")).where("lo < hi")
    split = split.select("sig", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_n"))
    now = now.join(split, "sig").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    now = now.withColumn("_other", F.explode(F.expr("sequence(0, _n - 1)")))
    now = now.select("sig", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), (F.col("_block") > F.col("_other")).alias("right"), "id", "comp")
    now = now.join(sided, "id").select("sig", "i", "j", "right", "id", "comp", "n_shingles", "wide", *SKETCH_COLS)
    dealt = now.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "right", "id")
    return dealt.mapInArrow(_meet(shape, closest), "a bigint, b bigint").distinct()


def _possible(pairs: DataFrame, info: DataFrame, shape: Shape) -> DataFrame:
    """The ``pairs`` (a, b) that their sizes and sketches leave possible."""
    x = info.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("x"))
    y = info.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_near(shape), "a bigint, b bigint")


def _verified(pairs: DataFrame, held: DataFrame, shape: Shape) -> DataFrame:
    """The ``pairs`` (a, b) that link, by their texts' sets; ``held`` has id, elements."""
    x = held.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    y = held.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_overlap(shape), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach).

    Sets are distinct ``width``-word shingles of the ASCII-lowercased text; a shorter
    text's whole sequence is one; null, empty and blank texts have an empty set and
    link with nothing. A link is 100 * |A & B| >= percent * |A | B|, in integers.
    Rows that share a doc_id are one document's parts: what links to one links to
    all. Rows without a doc_id take part under an id of their text, link others, and
    come back with a null component. Columns other than doc_id and text aren't read.
    """
    stand_in = F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)))
    out = row_components(docs.withColumn("id", F.coalesce("doc_id", stand_in)), width, percent)
    if not docs.where("doc_id IS NULL").isEmpty():
        # a component that is named by a row without a doc_id takes its least real one
        named = out.where("doc_id IS NULL").select(F.col("component").alias("_c")).distinct()
        least = out.where("doc_id IS NOT NULL").join(named, F.col("component") == F.col("_c"), "left_semi").groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("_least"))
        out = out.join(least, F.col("component") == F.col("_c"), "left").withColumn("component", F.coalesce("_least", "component"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def row_components(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``rows`` (id, doc_id, text): id, doc_id, n_shingles, component (least id that links reach).

    Sets and links are those of ``jaccard_components``; rows of one id are parts of
    one. ``doc_id`` only passes through.
    """
    shape, work = Shape(percent), Scratch()
    keyed = rows.select(F.col("id").cast("bigint"), "text", F.col("doc_id").cast("bigint"))
    n_sk = ", ".join(f"{c} bigint" for c in SKETCH_COLS)
    sketched = work.durable(keyed.mapInArrow(_info(width), f"id bigint, doc_id bigint, n_shingles bigint, h0 bigint, h1 bigint, {n_sk}, sketch array<bigint>, wide array<bigint>"))
    keyed = keyed.drop("doc_id")
    full = sketched.where("n_shingles > 0")
    # Equal sets are one: the least id's. Written first, so that a set with very many rows is split in joins.
    whole = ["n_shingles", *SKETCH_COLS, "sketch", "wide"]
    reps = work.durable(full.groupBy("h0", "h1").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in whole)))
    info = work.durable(sketched.select("id", "doc_id", "n_shingles", "h0", "h1"))
    work.drop(sketched)
    sketched, reps, full = reps.select(F.col("rep").alias("id"), *whole), reps.select("h0", "h1", "rep"), info.where("n_shingles > 0")
    member = work.durable(full.select("id", "h0", "h1").join(reps, ["h0", "h1"]).select("id", "rep"))

    # Signatures that several rows have. A common one is summed in chunks before it travels; most are single,
    # so that a table of all of them on either side of the exchange would only take memory.
    counts = keyed.mapInArrow(_counts(width, shape), "sig bigint, n int").repartition("sig")
    several = work.durable(counts.groupBy("sig").agg(F.sum("n").alias("_n")).where("_n > 1").select("sig"))
    sigs = keyed.mapInArrow(_emit(width, shape), "sig bigint, id bigint")
    shared = work.durable(sigs.join(several, "sig"))
    work.drop(several)
    # Equal sets become their representative; what then has one member is done.
    once = work.durable(shared.join(member, "id").select("sig", F.col("rep").alias("id")).distinct())
    work.drop(shared)
    hubs = work.durable(once.groupBy("sig").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far").select("sig", "hub"))
    starry = once.join(hubs, "sig")
    shared = work.durable(starry.select("sig", "id", "hub"))
    work.drop(once, hubs)
    sided = sketched.drop("sketch")
    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = work.durable(_possible(stars, sketched, shape))
    shared = shared.drop("hub")

    def sets(pairs: DataFrame) -> DataFrame:
        """Sets of whatever may take part in a check of ``pairs``."""
        ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
        return work.durable(keyed.join(ids, "id", "left_semi").mapInArrow(_sets(width), "id bigint, h bigint, elements array<bigint>").dropDuplicates(["id", "h"]))

    held = sets(near)
    # First one pair for each document, then only those that still join two components.
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = work.durable(_verified(first, held, shape))
    found = components(links)
    links = work.durable(links.union(_verified(_apart(near, found), held, shape)))
    found = components(links)
    work.drop(held)

    # Signatures whose members are still of several components: the closest pairs first, then all that are left.
    tried = near
    for closest in (True, False):
        cross = work.durable(_possible(_crossing(shared, found, sided, shape, closest).join(tried, ["a", "b"], "left_anti"), sketched, shape))
        if cross.isEmpty():
            if closest:
                continue
            break
        links = work.durable(links.union(_verified(cross, sets(cross), shape)))
        tried = tried.union(cross)
        found = components(links)
    # An id with several sets holds them together.
    many = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    bound = member.join(many.select("id", "lo"), "id").where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    if not bound.isEmpty():
        found = components(links.union(bound))
    named = work.durable(reps.join(found, reps.rep == found.node, "left").select("h0", "h1", F.coalesce("component", "rep").alias("component")))
    out = work.durable(full.select("id", "doc_id", "n_shingles", "h0", "h1").join(named, ["h0", "h1"]).select("id", "doc_id", "n_shingles", "component"))
    # Rows without a set follow another row of their id, if there is one.
    none = info.where("n_shingles = 0").select("id", "doc_id", "n_shingles")
    of_id = out.groupBy("id").agg(F.min("component").alias("component"))
    none = none.join(of_id, "id", "left").select("id", "doc_id", "n_shingles", F.coalesce("component", "id").alias("component"))
    return work.result(out.union(none))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are of different components so far."""
    f = found.select("node", "component")
    p = pairs.join(f.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(f.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
