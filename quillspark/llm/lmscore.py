"""Scores of whole texts under a gated recurrent language model learned from the training fold.

Counts of all tokens of the training fold are a table (`token_counts`): they give the
unigram base score, the model's symbols (its WORDS most frequent tokens), its classes
and first biases, and the probability of every other token, which the network
predicts as one symbol: P(other) * (c + 1) / (N' + V' + 1), with N' the occurrences and
V' the number of other tokens. The probabilities of all tokens, one unseen included,
so sum to one. The network's weights are learned from all symbols of the fold: texts
become symbols once, cut into pieces; the pieces are dealt by hash to slices, a slice's
task moves a copy of the weights by its pieces, and the copies of a round are averaged
by their numbers of symbols (`learned`). The first round starts from weights fitted on a
bounded number of pieces (MAX_PIECES, drawn by hash), since copies that start untrained
average badly. Each symbol of the fold is learned from once after that start, however
many there are.

Tokens that every task knows are the most frequent ones, FREQUENT at most; a text's
other tokens travel as hashes and counts to the table of counts, none of which can
be frequent there. A token is its 64-bit hash.

Corners: null and empty texts are one end; repeated rows score alike but for the
last bits, as rows are; rows without an id hash as an empty id; a very long text is
read to its end with the state carried along; ties in frequency go by hash; without
training rows all scores are those of one unseen symbol each; an empty table gives
no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gated
from .common import Scratch, Tokens, chunks, ragged

#: Most pieces of texts that the weights are fitted on, and bytes in a piece.
MAX_PIECES, PIECE = 768, 4096
#: Most tokens whose counts every task holds.
FREQUENT = 1 << 18
#: Most symbols in a piece that weights learn from; symbols in a slice, about; slices in a round at least, if there is more than one round; rounds at most; rates of the first and the last round.
CUT, SLICE, SIDE, ROUNDS, RATES = 1024, 1 << 20, 16, 8, (5e-3, 2e-3)
#: Weights that are averaged as one row.
BLOCK = 1 << 14
#: Distinct tokens a task counts before it hands them on; bytes of text, or of symbols, taken side by side.
FLUSH, BESIDE = 1 << 20, 8 << 20


def training(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, n``: how often each token (as a hash) occurs in all texts; counted in tasks before it travels."""

    def run(batches):
        held, n = [], 0

        def merged():
            tokens, inverse = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in held]), len(tokens)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

        for b in batches:
            for _, _, words in chunks(b.column(0), lower_ascii=True):
                held.append(np.unique(words.word_hashes(), return_counts=True))
                n += len(held[-1][0])
                if n > FLUSH:
                    yield merged()
                    held, n = [], 0
        if held:
            yield merged()

    return docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Statistics:
    """What all tasks know of the counts: totals and the frequent tokens, sorted by hash."""

    def __init__(self, counts: DataFrame, ends: int, frequent: int = FREQUENT) -> None:
        rank = F.floor(F.log2("n") * 64).cast("int")
        by_rank = counts.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()  # 64 rows for each doubling
        self.ends = ends
        self.total = sum(r["n"] for r in by_rank) + ends
        self.kinds = sum(r["kinds"] for r in by_rank) + (ends > 0)
        held, least = 0, None
        for r in sorted(by_rank, key=lambda r: -r["rank"]):
            held += r["kinds"]
            if held > frequent:
                break
            least = r["rank"]
        got = counts.where(rank >= least).toArrow() if least is not None else None
        token = got["token"].to_numpy().astype(np.int64).view(np.uint64) if got is not None else np.zeros(0, np.uint64)
        n = got["n"].to_numpy().astype(np.int64) if got is not None else np.zeros(0, np.int64)
        order = np.argsort(token)
        self.token, self.n = token[order], n[order]

    def symbols(self, words: int = gated.WORDS) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Symbol of each frequent token, counts of symbols, the symbol of other tokens and the end's."""
        top = np.lexsort((self.token, -self.n))[:words]
        counts = np.concatenate([self.n[top], [self.total - self.ends - self.n[top].sum(), self.ends]])
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        symbol = np.full(len(self.token), number[-2], np.int32)
        symbol[top] = number[:-2]
        return symbol, counts[order].astype(np.float64), int(number[-2]), int(number[-1])


def pieces(docs: DataFrame, most: int, size: int = PIECE) -> list[tuple[bytes, bool, bool]]:
    """At most ``most`` pieces of ``size`` bytes of all texts, drawn by hash: bytes, whether it is the first and the last of its text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / size).cast("int")
    total = docs.select(F.sum(last + 1).alias("n")).first()["n"] or 0
    draw = F.xxhash64("doc_id", "hash", "piece")
    share = min(1.0, 2 * most / max(1, total))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), last.alias("last"))
    rows = rows.select("doc_id", "text", "hash", "last", F.explode(F.sequence(F.lit(0), "last")).alias("piece"))
    rows = rows.where(draw <= F.lit(int((share - 0.5) * 2 * (2**63 - 1)))) if share < 1 else rows
    got = rows.select(draw.alias("draw"), F.substring(text, F.col("piece") * size + 1, F.lit(size)).alias("bytes"), (F.col("piece") == 0).alias("first"), (F.col("piece") == F.col("last")).alias("last"))
    return [(bytes(r["bytes"]), r["first"], r["last"]) for r in got.orderBy("draw", "bytes").limit(most).collect()]


class Model:
    """Statistics and network together: what scoring needs. The network is the first one, until ``learned`` moves it."""

    def __init__(self, known: Statistics, drawn: list[tuple[bytes, bool, bool]], words: int = gated.WORDS) -> None:
        self.token, self.n = known.token, known.n
        self.symbol, counts, self.other, self.end = known.symbols(words)
        self.total, self.kinds, self.ends = known.total, known.kinds, known.ends
        self.kind = np.dtype("<u2" if len(counts) <= 1 << 16 else "<u4")
        rest = int(counts[self.other])
        # an other token has probability (c + 1) / 10**rest_log among the others
        self.base_log = float(np.log10(self.total + self.kinds + 1))
        self.rest_log = float(np.log10(rest + (self.kinds - (len(counts) - 2) - (self.ends > 0)) + 1))
        texts = [self._piece(*p) for p in drawn]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.net = gated.fit(counts, np.concatenate([*texts, np.zeros(0, np.int32)]), off, self.end)

    def _piece(self, piece: bytes, first: bool, last: bool) -> np.ndarray:
        """Symbols of a piece; words cut at its edges are left out."""
        data = np.frombuffer(piece, np.uint8)
        words = Tokens(data, np.array([0, len(data)]), lower_ascii=True)
        own = self.looked_up(words.word_hashes())[0]
        if not last and len(own) and words.end[-1] == len(data):
            own = own[:-1]
        if not first and len(own) and words.start[0] == 0:
            own = own[1:]
        return np.append(own, np.int32(self.end)) if last else own

    def looked_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, count and whether it is frequent, of each token."""
        if not len(self.token):
            return np.full(len(hashes), self.other, np.int32), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.token, hashes), len(self.token) - 1)
        hit = self.token[at] == hashes
        return np.where(hit, self.symbol[at], self.other).astype(np.int32), np.where(hit, self.n[at], 0), hit

    def partial(self, text: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array, pa.Array]:
        """Of each text: tokens, known ones, base and score without the network, as far as the frequent tokens go; its other tokens with their counts; its symbols in pieces."""
        n = len(text)
        out = {"n_tokens": np.ones(n, np.int64), "n_known": np.full(n, int(self.ends > 0)), "base": np.zeros(n), "score": np.zeros(n)}
        symbols, sizes, rest_n, rest_token, rest_of = [], np.ones(n, np.int64), [], [], np.zeros(n, np.int64)
        for a, b, words in chunks(text, lower_ascii=True):
            token, inverse = np.unique(words.word_hashes(), return_inverse=True)
            symbol, count, hit = self.looked_up(token)
            logs = np.log10(count + 1.0)
            doc, docs = words.doc, b - a
            sizes[a:b] += words.count
            out["n_tokens"][a:b] += words.count
            out["n_known"][a:b] += np.bincount(doc, hit[inverse], docs).astype(np.int64)
            out["base"][a:b] += np.bincount(doc, np.where(hit, logs, 0.0)[inverse], docs)
            other = symbol == self.other
            out["score"][a:b] += np.bincount(doc, np.where(other, np.where(hit, logs, 0.0) - self.rest_log, 0.0)[inverse], docs)
            # symbols of each text, its end after them
            own = np.full(len(inverse) + docs, self.end, np.int32)
            own[np.arange(len(inverse)) + doc] = symbol[inverse]
            symbols.append(own)
            lost = np.flatnonzero(~hit[inverse])
            pair, times = np.unique(doc[lost] * np.int64(len(token)) + inverse[lost], return_counts=True)
            rest_of[a:b] += np.bincount(pair // max(1, len(token)), minlength=docs)
            rest_token.append(token[pair % max(1, len(token))])
            rest_n.append(times)
        out["base"] += np.log10(self.ends + 1.0) - out["n_tokens"] * self.base_log
        values = pa.StructArray.from_arrays([pa.array(np.concatenate([*rest_token, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.concatenate([*rest_n, np.zeros(0, np.int64)]).astype(np.int64))], names=["token", "n"])
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest_of)]).astype(np.int32)), values)
        return out, rest, cut(np.concatenate([*symbols, np.zeros(0, np.int32)]), sizes, self.end, self.kind)


def cut(ids: np.ndarray, sizes: np.ndarray, end: int, kind: np.dtype) -> pa.Array:
    """Texts of symbols as lists of pieces, at most CUT symbols each; a piece is its symbols' bytes, after those of the symbol before it (the end's before a text)."""
    number = -(-sizes // CUT)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), number)
    start = first[of] + CUT * (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number))
    length = np.minimum(CUT, first[of] + sizes[of] - start) + 1
    flat = ids[ragged(start - 1, length)].astype(kind)
    head = np.cumsum(length) - length
    flat[head[start == first[of]]] = end
    bounds = np.append(head, len(flat)) * kind.itemsize
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pieces.cast(pa.binary()))


def joined(pieces: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of pieces: the symbols before each symbol, the symbols, and the pieces' bounds among them."""
    pieces = pieces.cast(pa.large_binary())
    at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    flat = np.frombuffer(pieces.buffers()[2], kind, (at[-1] - at[0]) // kind.itemsize, at[0]).astype(np.int32) if len(pieces) else np.zeros(0, np.int32)
    at = (at - at[0]) // kind.itemsize
    before, own = np.ones(len(flat), bool), np.ones(len(flat), bool)
    own[at[:-1]], before[at[1:] - 1] = False, False
    return flat[before], flat[own], at - np.arange(len(at))


def fitted(docs: DataFrame, counts: DataFrame, max_pieces: int = MAX_PIECES, words: int = gated.WORDS, frequent: int = FREQUENT) -> Model:
    """The model of the rows of the training fold, whose ``counts`` these are."""
    scratch = Scratch()
    model = _fitted(docs, counts, max_pieces, words, frequent, scratch)[0]
    scratch.drop()
    return model


def _fitted(docs: DataFrame, counts: DataFrame, max_pieces: int, words: int, frequent: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model, and the partial scores with the symbols that it has learned from."""
    train = docs.select("doc_id", "text").where(training())
    model = Model(Statistics(counts, train.count(), frequent), pieces(train, max_pieces), words)
    part = scratch.durable(partial_scores(docs, model))
    learned(part, model, scratch)
    return model, part


def learned(part: DataFrame, model: Model, scratch: Scratch) -> None:
    """Move the model's weights by all symbols of the training fold, each once, in rounds whose slices are learned apart and averaged."""
    slices = -(-model.total // SLICE)
    rounds = max(1, min(ROUNDS, slices // SIDE))
    side = -(-slices // rounds)
    pieces = part.where(~F.col("held_out")).select("key", F.posexplode("symbols").alias("place", "piece"))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("key", "place"), F.lit(max(1, slices and rounds * side))).cast("int"))
    for r in range(rounds if slices else 0):
        rate = RATES[1] * (RATES[0] / RATES[1]) ** ((rounds - 1 - r) / rounds)
        own = pieces.where(F.floor(F.col("slice") / side) == r).withColumn("slice", F.col("slice") % side)
        copies = own.repartitionById(side, F.col("slice")).mapInArrow(_moved(model, rate), "block int, slice int, n bigint, weights binary")
        mean = scratch.durable(copies.repartitionById(8, F.col("block") % 8).mapInArrow(_averaged, "block int, weights binary"))
        got = sorted(mean.collect(), key=lambda b: b["block"])
        model.net.put(np.frombuffer(b"".join(bytes(b["weights"]) for b in got), "<f4"))
        scratch.drop(mean)


def _moved(model: Model, rate: float):
    """A task's slice of pieces moves a copy of the weights, which it hands on in blocks."""
    net, kind = model.net, model.kind

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        # rows come from a shuffle in any order
        t = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("place", "ascending")]).combine_chunks()
        prev, ids, off = joined(t["piece"].combine_chunks() if t["piece"].num_chunks != 1 else t["piece"].chunk(0), kind)
        gated.passed(net, prev, ids, off, rate)
        flat = net.flat().astype("<f4")
        blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
        n, slices = len(blocks), t["slice"][0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([slices] * n, pa.int32()), pa.array([len(ids)] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "slice", "n", "weights"])

    return run


def _averaged(batches):
    """Means of blocks of weights over slices, by their numbers of symbols; sums go in the slices' order."""
    held = {}
    for b in batches:
        for block, *own in zip(*(b.column(c).to_pylist() for c in ("block", "slice", "n", "weights"))):
            held.setdefault(block, []).append(own)
    for block, copies in held.items():
        total = sum(n for _, n, _ in copies)
        mean = sum(np.frombuffer(weights, "<f4").astype(np.float64) * (n / total) for _, n, weights in sorted(copies))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=["block", "weights"])


def _slices(batches, column: int = 2):
    """Batches put together up to BESIDE bytes of a column, so that many texts are read side by side."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= BESIDE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def partial_scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``, numbered by task and place: partial sums, the tokens that still need their counts, and the symbols."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "symbols"]

    def run(batches):
        key = TaskContext.get().partitionId() << 40
        for t in _slices(batches):
            if not t.num_rows:
                continue
            out, rest, symbols = model.partial(t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0))
            own = [pa.array(key + np.arange(t.num_rows)), t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), *(pa.array(out[c]) for c in ("n_tokens", "n_known", "base", "score")), rest, symbols]
            key += t.num_rows
            yield from pa.Table.from_arrays(own, names=names).to_batches()

    rows = docs.select("doc_id", (~training()).alias("held_out"), "text")
    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rest array<struct<token: bigint, n: bigint>>, symbols array<binary>")


def with_network(part: DataFrame, model: Model) -> DataFrame:
    """``part`` without its symbols, whose log10 probability by the network is added to the score."""
    net, end, kind = model.net, model.end, model.kind

    def run(batches):
        for t in _slices((b for b in batches if b.num_rows), -1):
            lists = t["symbols"].combine_chunks() if t["symbols"].num_chunks != 1 else t["symbols"].chunk(0)
            _, ids, off = joined(lists.flatten(), kind)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            score = t["score"].to_numpy() + gated.text_log_probs(net, ids, off[ends], end) / np.log(10)
            yield from t.drop_columns(["symbols"]).set_column(t.column_names.index("score"), "score", pa.array(score)).to_batches()

    rows = part.select(*(c for c in part.columns if c not in ("rest", "symbols")), "symbols")
    return rows.mapInArrow(run, rows.drop("symbols").schema)


def scored(docs: DataFrame, max_pieces: int = MAX_PIECES, words: int = gated.WORDS, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    scratch = Scratch()
    counts = scratch.durable(token_counts(docs.where(training())))
    model, part = _fitted(docs, counts, max_pieces, words, frequent, scratch)
    pairs = part.select("key", F.explode("rest").alias("r")).select("key", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    known = pairs.join(counts, "token", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("c"))
    more = known.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more_score, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    full = with_network(part, model).join(more, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more_known).alias("n_known"), F.lit(int(model.total)).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more_score).alias("base_score"), (F.col("score") + more_score).alias("score"),
    )
    return scratch.result(full)
