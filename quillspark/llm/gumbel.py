"""SentencePiece segmentations sampled without replacement by perturbed A* search.

A text's lattice is the product of its words' lattices: no piece spans a word start.
A segmentation's probability is proportional to the product of its pieces'
weights, 1 / (1 + rank) by the vocabulary's own ranks, to the power ``alpha``.
Perturbed with independent Gumbel noise, the k most probable segmentations are a
sample without replacement. The search holds subsets of segmentations with the
maximum of their perturbed values: it starts from all of them, and when it takes
the best subset it draws the segmentation that attains the maximum, and splits what
is left by the first word that differs. A part's maximum is a Gumbel variable cut at
the maximum of its whole. The value of the first subset not taken gives every
sample's inclusion probability. All draws come from a hash of the row's key, so a
row gives the same result wherever it runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _Powers, mix64, ragged

#: Where the public vocabulary lies by default, samples for each row, sharpness, characters that one step takes.
MODEL_FILE, SAMPLES, ALPHA = "/opt/tokenizers/piece_bpe_32k.model", 2, 1.0
STEP_CHARS = 1 << 19
#: Characters of words whose lattices a worker remembers before it starts afresh.
CACHE_CHARS = 3 << 19

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_UNSCORED = -1e8
_POINT_POW = _Powers(U64(0xBF58476D1CE4E5B9))


class Vocabulary:
    """Pieces of a SentencePiece model file with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [-1] * 256
        rank = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
                rank[i] = n
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
                rank[i] = n
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                score = sp.get_score(i)
                rank[i] = -score if score > _UNSCORED else n
        self.log_weight = -np.log1p(np.maximum(rank, 0.0))
        self.longest = max(map(len, self.ids), default=1)


def _loaded(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def words_of(text: str) -> list[str]:
    """The words of a text as SentencePiece marks them: a space before the text, spaces as their sign."""
    return _WORD.findall((" " + text).replace(" ", SPACE)) if text else []


def joined(ids, vocab: Vocabulary) -> bytes:
    """The UTF-8 text of ids: pieces without the space put before the text."""
    if len(ids) < 2:  # itemgetter gives a tuple from two on
        return b"".join(vocab.bytes_of[i] for i in ids).removeprefix(b" ")
    return b"".join(itemgetter(*ids)(vocab.bytes_of)).removeprefix(b" ")


def decode(ids, vocab: Vocabulary) -> str:
    return joined(ids, vocab).decode("utf-8", "replace")


def decoded(df: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """``df`` with ``decoded``: the text of a column of piece ids; null stays null."""

    def run(it):
        vocab = _loaded(model_file if "/" in model_file else SparkFiles.get(model_file))
        for col in it:
            yield pa.array([None if x is None else decode(x, vocab) for x in col.to_pylist()], pa.string())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("decoded", F.arrow_udf(run, "string")(F.col(ids)))


class _Pieces:
    """Piece ids by the hash of their code points: open addressing, probed for many substrings at once.

    Prefixes of pieces that aren't pieces are there too, as PREFIX, so that a
    position is left as soon as no longer piece can start there.
    """

    NONE, PREFIX = -1, -2

    def __init__(self, vocab: Vocabulary) -> None:
        entries = {p[:i]: self.PREFIX for p in vocab.ids for i in range(1, len(p))} | vocab.ids
        self.bits = max(4, 2 + len(entries).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.zeros(size, U64), np.full(size, self.NONE, np.int32), 1
        n = np.array([len(x) for x in entries])
        ends = np.cumsum(n)
        h = _span_hash(_point_sums(np.frombuffer("".join(entries).encode("utf-32-le"), np.uint32)), ends - n, ends)
        at, value = (h >> U64(64 - self.bits)).astype(np.int64), np.array(list(entries.values()), np.int32)
        left = np.arange(len(h))
        while len(left):  # the first comer takes a place, the others go one further
            free = left[self.values[at[left]] == self.NONE]
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.keys[at[take]], self.values[at[take]] = h[take], value[take]
            left = np.setdiff1d(left, take, assume_unique=True)
            if len(left):
                at[left] = (at[left] + 1) % size
                self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids, PREFIX or NONE."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        same = self.keys[at] == h
        got = np.where(same, self.values[at], self.NONE)
        open_ = np.flatnonzero(~same & (self.values[at] != self.NONE))
        for step in range(1, self.probes):
            if not len(open_):
                break
            x = (at[open_] + step) % len(self.keys)
            hit = self.keys[x] == h[open_]
            got[open_[hit]] = self.values[x[hit]]
            open_ = open_[~hit & (self.values[x] != self.NONE)]
        return got


def _point_sums(points: np.ndarray) -> np.ndarray:
    p, _ = _POINT_POW.upto(len(points) + 1)
    s = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * p[: len(points)], out=s[1:])
    return s


def _span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, q = _POINT_POW.upto(len(sums))
    return mix64((sums[b] - sums[a]) * q[a] + (b - a).astype(U64) * U64(0xA24BAED4963EE407))


class Lattices:
    """Lattices of distinct words, end to end: a node for each character, with edges for the pieces that start there.

    ``cum`` has, edge by edge, the cumulative probability of the node's edges given
    that the node is reached; ``to`` the node it leads to (-1: the word's
    end), ``lp`` its log probability and ``piece`` its id (below -1: the bytes of
    the code point -2 - piece).
    """

    def __init__(self, vocab: Vocabulary, alpha: float) -> None:
        self.vocab, self.alpha, self.pieces = vocab, alpha, _Pieces(vocab)
        self.byte_id = np.array(vocab.byte_id)
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}
        self.cum, self.to, self.lp, self.piece = np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        self.edge_at = np.zeros(1, np.int64)
        self.used = self.nodes = 0

    def add(self, words: list[str]) -> None:
        """Compile the words that aren't known yet, all at once; nodes are numbered by their distance from their word's end."""
        new = list(set(words).difference(self.first))
        if not new:
            return
        n = np.array([len(w) for w in new])
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        base, total = self.nodes, len(points)
        stop = np.cumsum(n)
        left = np.repeat(stop, n) - np.arange(total)
        nodes = np.argsort(left.astype(np.uint16) if n.max() < 1 << 16 else left, kind="stable")
        rank = np.empty(total, np.int64)
        rank[nodes] = np.arange(total)
        self.first.update(zip(new, (base + rank[stop - n]).tolist()))
        sums = _point_sums(points)
        steps, at = [], np.arange(total)
        count = np.zeros(total, np.int64)
        for w in range(1, self.vocab.longest + 1):
            at = at[left[at] >= w]
            if not len(at):
                break
            got = self.pieces.find(_span_hash(sums, at, at + w))
            hit, more = got >= 0, got != self.pieces.NONE
            if w == 1:  # characters without a piece: their bytes
                odd = np.flatnonzero(~hit)
                code = points[odd].astype(np.int64)
                got[odd] = np.where(code < 128, self.byte_id[np.minimum(code, 127)], -2 - code)
                hit[:] = True
            from_ = at[hit]
            count[rank[from_]] += 1
            steps.append((w, from_, got[hit]))
            at = at[more]
        edge_at = np.concatenate([[0], np.cumsum(count)])
        edges = int(edge_at[-1])
        piece, to, free = np.zeros(edges, np.int32), np.zeros(edges, np.int64), edge_at[:-1].copy()
        for w, from_, got in reversed(steps):  # of a node's edges the longest piece comes first
            r = rank[from_]
            e = free[r]
            free[r] = e + 1
            piece[e] = got
            to[e] = np.where(left[from_] == w, -1, rank[np.minimum(from_ + w, total - 1)])
        weight = self.vocab.log_weight
        score = self.alpha * weight[np.maximum(piece, 0)]
        for i in np.flatnonzero(piece < -1).tolist():
            raw = chr(-2 - int(piece[i])).encode("utf-8", "replace")
            score[i] = self.alpha * sum(float(weight[self.vocab.byte_id[x]]) for x in raw)
        # Backward sums, all words at once: a distance's nodes and edges lie together.
        beta = np.zeros(total + 1)  # the last stands for the words' ends
        bounds = np.searchsorted(left[nodes], np.arange(1, int(n.max()) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e0, e1 = int(edge_at[a]), int(edge_at[b])
            value = score[e0:e1]
            value += beta[to[e0:e1]]
            starts = edge_at[a:b] - e0
            top = np.maximum.reduceat(value, starts)
            value -= np.repeat(top, count[a:b])
            sums_ = np.log(np.add.reduceat(np.exp(value), starts))
            beta[a:b] = top + sums_
            value -= np.repeat(sums_, count[a:b])
        lp = np.minimum(score, 0.0, out=score)
        run = np.cumsum(np.exp(lp))
        run -= np.repeat(np.concatenate([[0.0], run])[edge_at[:-1]], count)
        run[edge_at[1:] - 1] = 1.0
        new = {"cum": np.minimum(run, 1.0), "to": np.where(to < 0, -1, base + to), "lp": lp, "piece": piece}
        self._append(self.used, **new)
        self._append(base + 1, edge_at=self.used + edge_at[1:])
        self.used += edges
        self.nodes += total

    def _append(self, at: int, **columns: np.ndarray) -> None:
        """Put values into arrays from place ``at``; an array that is full is doubled."""
        for name, new in columns.items():
            old = getattr(self, name)
            if at + len(new) > len(old):
                old = np.concatenate([old[:at], np.zeros(max(at, len(new), 1 << 16), old.dtype)])
                setattr(self, name, old)
            old[at : at + len(new)] = new

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids along edges."""
        p = self.piece[edges]
        odd = np.flatnonzero(p < -1)
        if not len(odd):
            return p
        out, at = [], 0
        for i in odd.tolist():
            out += [p[at:i], [self.vocab.byte_id[x] for x in chr(-2 - int(p[i])).encode("utf-8", "replace")]]
            at = i + 1
        return np.concatenate([*out, p[at:]]).astype(np.int32)


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    h = seed
    for p in parts:
        h = mix64(h ^ (np.asarray(p).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D)))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _walk(lat: Lattices, node: np.ndarray, seed: np.ndarray, word: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draw a path from each node to its word's end: edges, how many each, log probabilities."""
    active = np.arange(len(node))
    cur, lp = node.copy(), np.zeros(len(node))
    steps, who = [], []
    step = 0
    base = mix64(seed ^ mix64(word.astype(U64) + np.full(1, turn, U64) * U64(0xD6E8FEB86659FD93)))
    while len(active):
        at = cur[active]
        u = _uniform(base[active], np.full(1, step))
        e = lat.edge_at[at]
        on = np.flatnonzero(lat.cum[e] <= u)
        while len(on):  # a node's last edge ends at 1
            e[on] += 1
            on = on[lat.cum[e[on]] <= u[on]]
        steps.append(e)
        who.append(active)
        lp[active] += lat.lp[e]
        cur[active] = lat.to[e]
        active = active[lat.to[e] >= 0]
        step += 1
    if not steps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lp
    w, e = np.concatenate(who), np.concatenate(steps)
    order = np.argsort(w, kind="stable")
    return e[order], np.bincount(w, minlength=len(node)), lp


Path = tuple[tuple[int, ...], float]  # edges, log probability


def _other_path(lat: Lattices, start: int, taken: list[Path], rng: np.random.Generator) -> Path:
    """A path of a word other than those ``taken``, by its conditional law."""
    node, path, lp = start, (), 0.0
    while node >= 0:
        a, b = int(lat.edge_at[node]), int(lat.edge_at[node + 1])
        inside = [t for t in taken if t[0][: len(path)] == path]
        mass = np.exp(lat.lp[a:b])
        whole = np.zeros(b - a, bool)  # edges that end the word along a taken path
        for t, tlp in inside:
            i = t[len(path)] - a
            mass[i] -= np.exp(tlp - lp)  # what the path holds of the edge
            whole[i] |= len(t) == len(path) + 1
        mass = np.where(whole, 0.0, np.maximum(mass, 0.0))
        if mass.sum() <= 0:  # rounding: any edge that isn't a taken path's end
            mass = np.where(whole, 0.0, 1.0)
        i = min(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), "right")), b - a - 1)
        path, lp, node = path + (a + i,), lp + float(lat.lp[a + i]), int(lat.to[a + i])
    return path, lp


def _cut(phi: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with these locations, given that they are below ``bound``."""
    with np.errstate(over="ignore", divide="ignore"):
        return phi - np.log(np.exp(phi - bound) - np.log(u))


class Sample:
    __slots__ = ("edges", "log_inclusion", "log_prob", "lp", "sizes", "value")

    def __init__(self, edges, sizes, lp, value) -> None:
        self.edges, self.sizes, self.lp, self.value = edges, sizes, lp, value
        self.log_prob, self.log_inclusion = float(lp.sum()), 0.0


def sample(texts: list[str], seeds: np.ndarray, lat: Lattices, k: int) -> list[list[Sample]]:
    """For each text up to ``k`` distinct segmentations in the order of their perturbed values."""
    words = [words_of(t) for t in texts]
    if lat.nodes > CACHE_CHARS:
        lat.clear()
    every = list(chain.from_iterable(words))
    lat.add(every)
    n = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(texts)), n)
    w_off = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(len(doc)) - w_off[doc]
    node = np.array(list(map(lat.first.__getitem__, every)), np.int64)
    found: list[list[Sample]] = [[] for _ in texts]
    agenda: list[list[tuple]] = [[] for _ in texts]  # (value, parent, word, taken paths)
    top = -np.log(-np.log(_uniform(seeds, np.full(len(texts), 1 << 40))))
    edges, sizes, lp = _walk(lat, node, seeds[doc], index, 0)
    e_off = np.concatenate([[0], np.cumsum(sizes)])[w_off]
    for d in range(len(texts)):
        a, b = w_off[d], w_off[d + 1]
        found[d].append(Sample(edges[e_off[d] : e_off[d + 1]], sizes[a:b], lp[a:b], float(top[d])))
    _split(agenda, found, [(d, 0, []) for d in range(len(texts))], seeds, 0, k)
    for turn in range(1, k + 1):
        todo = []
        for d in range(len(texts)):
            if len(found[d]) == turn and agenda[d]:
                best = max(range(len(agenda[d])), key=lambda i: agenda[d][i][0])
                if turn == k:  # not drawn: it bounds the sample
                    for s in found[d]:
                        x = s.log_prob - agenda[d][best][0]
                        s.log_inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))
                else:
                    todo.append((d, *agenda[d].pop(best)))
        if not todo:
            continue
        after = np.array([x[3] + 1 for x in todo])
        of = np.array([x[0] for x in todo])
        count = n[of] - after
        who = np.repeat(of, count)
        at = ragged(after, count)
        edges, sizes, lp = _walk(lat, node[w_off[who] + at], seeds[who], at, turn)
        off = np.concatenate([[0], np.cumsum(count)])
        e_cum = np.concatenate([[0], np.cumsum(sizes)])
        for i, (d, value, parent, w, taken) in enumerate(todo):
            old = found[d][parent]
            path, plp = _other_path(lat, int(node[w_off[d] + w]), taken, np.random.default_rng([int(seeds[d]), turn]))
            keep = int(old.sizes[:w].sum())
            new = Sample(
                np.concatenate([old.edges[:keep], path, edges[e_cum[off[i]] : e_cum[off[i + 1]]]]).astype(np.int64),
                np.concatenate([old.sizes[:w], [len(path)], sizes[off[i] : off[i + 1]]]),
                np.concatenate([old.lp[:w], [plp], lp[off[i] : off[i + 1]]]),
                value,
            )
            found[d].append(new)
        _split(agenda, found, [(d, w, taken) for d, _, _, w, taken in todo], seeds, turn, k)
    return found


#: A part of less than this share of its subset's probability is rounding, and counts as empty.
LEAST_PART = 1e-12


def _split(agenda: list[list[tuple]], found: list[list[Sample]], new: list[tuple], seeds: np.ndarray, turn: int, k: int) -> None:
    """Put the parts around the newest samples' paths, word by word, into their texts' agendas; only the best k can matter.

    ``new`` has (text, first word that may differ, paths taken there). At that word,
    where the sample left its parent, the paths already taken are left out too.
    """
    new = [x for x in new if len(found[x[0]][-1].sizes)]
    if not new:
        return
    cuts, owns = [], []
    for d, since, taken in new:
        s = found[d][-1]
        cuts.append(np.concatenate([[0], np.cumsum(s.sizes)]))
        owns.append([*taken, _path(s, cuts[-1], since)])
    lps = [found[d][-1].lp for d, _, _ in new]
    count = np.array([len(lp) - since for lp, (_, since, _) in zip(lps, new)])
    off = np.concatenate([[0], np.cumsum(count)])
    lp = np.concatenate([x[since:] for x, (_, since, _) in zip(lps, new)])
    before = np.concatenate([float(x[:since].sum()) + np.cumsum(x[since:]) - x[since:] for x, (_, since, _) in zip(lps, new)])
    rest = -np.expm1(lp)
    rest[off[:-1]] = [1.0 - sum(np.exp(x) for _, x in own) for own in owns]
    with np.errstate(divide="ignore"):
        phi = before + np.log(np.where(rest > LEAST_PART, rest, 0.0))
    since = np.array([x[1] for x in new])
    ok = np.flatnonzero(np.isfinite(phi))
    of = np.repeat(np.arange(len(new)), count)
    word = np.arange(len(of)) - off[:-1][of] + since[of]
    text = np.array([x[0] for x in new])
    u = _uniform(seeds[text[of[ok]]], word[ok], np.full(1, (1 << 41) + turn))
    value = np.full(len(phi), -np.inf)
    value[ok] = _cut(phi[ok], np.array([found[d][-1].value for d in text])[of[ok]], u)
    for _ in range(k):
        best = np.maximum.reduceat(value, off[:-1])
        for i in np.flatnonzero(best > -np.inf).tolist():
            at = int(off[i]) + int(np.argmax(value[off[i] : off[i + 1]]))
            d, w = new[i][0], int(word[at])
            taken = owns[i] if w == new[i][1] else [_path(found[d][-1], cuts[i], w)]
            agenda[d].append((float(value[at]), len(found[d]) - 1, w, taken))
            value[at] = -np.inf


def _path(s: Sample, cut: np.ndarray, w: int) -> Path:
    return tuple(s.edges[cut[w] : cut[w + 1]].tolist()), float(s.lp[w])


SCHEMA = "sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>, round_trip boolean"


def sampled(docs: DataFrame, model_file: str = MODEL_FILE, k: int = SAMPLES, alpha: float = ALPHA, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Per row of ``docs`` up to ``k`` rows: ``key`` and SCHEMA; whole texts.

    Sample 0 is the first drawn. ``log_inclusion`` is the log of
    the probability that a segmentation is among k drawn, given the search's bound;
    0 where a text has no more than k (what is less than LEAST_PART counts as none). Null and empty texts have one segmentation, the empty one.
    ``round_trip`` says that the ids decode to the text. Rows with equal keys draw
    alike, so repeated rows repeat; other columns aren't read. The model file must
    lie at the same path on all executors, or be added with ``addFile`` and named
    without a folder.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        vocab = _loaded(model_file if "/" in model_file else SparkFiles.get(model_file))
        lat = Lattices(vocab, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            seeds = batch.column(1).to_numpy().view(U64)
            sizes = np.cumsum([len(t) + 1 for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + STEP_CHARS, "right")))
                rows, ids = [], []
                for d, found in enumerate(sample(texts[a:b], seeds[a:b], lat, k), a):
                    for i, s in enumerate(found):
                        x = lat.ids(s.edges)
                        ids.append(x)
                        rows.append((d, i, len(x), s.log_prob, s.value, s.log_inclusion, joined(x.tolist(), vocab) == texts[d].encode("utf-8", "replace")))
                cols = list(zip(*rows))
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[3:6]), lists, pa.array(cols[6], pa.bool_())], names=names)
                a = b

    names = [key, *(x.split()[0] for x in SCHEMA.split(", "))]
    return docs.select(key, F.xxhash64(F.lit(seed), key).alias("_seed"), "text").mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
