"""Quality rules as learned decision lists.

Sequential covering: a rule, a conjunction of thresholds on statistics, is grown
condition by condition for the largest information gain on two thirds of the
labelled rows and pruned on the last third; rows it covers leave, and the next rule
is grown. A rule is taken if it shortens the description of the labels: the bits that
say the rule, which of the rows it covers are good, and which of the others are bad.
Where none is taken other splits into rows to grow and to prune are tried. The rules
come out in order as one Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, window_hashes, window_sums

#: Most labelled rows that a list is learned from: those with the least hash.
MAX_LABELLED = 20_000
#: Words of a repeated window; characters that count as symbols.
WINDOW, SYMBOLS = 8, b"#*$%&|<>"
#: Least precision of a rule (clean rows matter most), most conditions and rules, thresholds tried per statistic, splits tried for a rule.
MIN_PRECISION, MAX_CONDITIONS, MAX_RULES, CUTS, TRIES = 0.9, 4, 12, 64, 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_marks", "n_digits", "n_distinct", "n_lines", "most_common"]

#: The statistics that rules test: name and expression over the counts.
FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "marks_per_word": "n_marks / n_words",
    "digits_per_word": "n_digits / n_words",
    "distinct_share": "n_distinct / n_words",
    "most_common_share": "most_common / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "words": "CAST(n_words AS DOUBLE)",
}


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def _group_sizes(docs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number in that order) of equal (doc, hash)."""
    order = np.lexsort((h, docs))
    d, x = docs[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return order, np.cumsum(new) - 1


def text_counts(tokens) -> dict[str, np.ndarray]:
    """BASE and MORE for each document of a chunk."""
    data, off, n = tokens.data, tokens.off, len(tokens.off) - 1
    lead = tokens.ink & ((data & np.uint8(0xC0)) != np.uint8(0x80))
    upper, lower = (data - np.uint8(65)) < 26, (data - np.uint8(97)) < 26
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    marks = np.zeros(256, bool)
    marks[list(b"!?")] = True
    out = {
        "n_words": tokens.count,
        "word_chars": _per_doc(lead, off),
        "n_symbols": _per_doc(table[data], off),
        "n_upper": _per_doc(upper, off),
        "n_letters": _per_doc(upper | lower, off),
        "n_marks": _per_doc(marks[data], off),
        "n_digits": _per_doc((data - np.uint8(48)) < 10, off),
    }
    wh = tokens.word_hashes()
    order, group = _group_sizes(tokens.doc, wh)
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    of = tokens.doc[order][np.unique(group, return_index=True)[1]] if len(group) else np.zeros(0, np.int64)
    out["n_distinct"] = np.bincount(of, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, sizes)
    out["most_common"] = most
    # words in windows that the text has twice
    at = tokens.window_starts(WINDOW)
    order, group = _group_sizes(tokens.doc[at], window_hashes(window_sums(wh), at, WINDOW))
    twice = at[order][np.bincount(group)[group] > 1] if len(at) else at
    mark = np.zeros(len(wh) + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + WINDOW, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(mark[:-1]) > 0, tokens.first)
    # lines: ends at \n and at the end of a document
    ends = np.union1d(np.flatnonzero(data == 10), off[1:][np.diff(off) > 0] - 1)
    last_nl = data[ends] == 10 if len(ends) else np.zeros(0, bool)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    stops = np.where(last_nl, ends, ends + 1)
    inked = np.concatenate([[0], np.cumsum(tokens.ink)])
    worded = inked[stops] > inked[starts]
    starts, stops = starts[worded], stops[worded]
    doc = np.searchsorted(off, starts, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    order, group = _group_sizes(doc, tokens.span_hashes(starts, stops))
    distinct = np.unique(group, return_index=True)[1] if len(group) else np.zeros(0, np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[order][distinct], minlength=n)
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """Add BASE and MORE to ``docs``; columns of these names are replaced. Null texts have no words."""
    names = BASE + MORE
    rest = docs.select([c for c in docs.columns if c not in names])
    at = rest.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b, tokens in chunks(batch.column(at)):
                got = text_counts(tokens)
                cols = [batch.column(i)[a:b] for i in range(batch.num_columns)] + [pa.array(got[c].astype(np.int64)) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *names])

    schema = StructType([*rest.schema.fields, *(StructField(c, LongType()) for c in names)])
    return rest.mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        f = F.expr(FEATURES[self.feature])
        return f > F.lit(self.cut) if self.above else f <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.test(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of largest gain until no good row is covered or none gains."""
    rule: Rule = ()
    rows = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
        best, best_gain = None, 1e-9
        for name, values in x.items():
            v, b = values[rows], bad[rows]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            edges = np.flatnonzero(v[1:] > v[:-1])
            if len(edges) > CUTS:  # ends of the value range always, the rest evenly
                edges = edges[np.unique(np.linspace(0, len(edges) - 1, CUTS).astype(int))]
            low_p, low_n = np.cumsum(b), np.cumsum(~b)
            for e in edges:
                cut = float((v[e] + v[e + 1]) / 2)
                for above, p, n in ((False, low_p[e], low_n[e]), (True, p0 - low_p[e], n0 - low_n[e])):
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best_gain:
                        best, best_gain = Condition(name, above, cut), gain
        if best is None:
            break
        rule += (best,)
        rows &= best.test(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix with the best (covered bad - covered good) / covered; the shortest of ties."""
    def worth(r: Rule) -> float:
        hit = _covered(r, x, len(bad))
        return float((hit & bad).sum() - (hit & ~bad).sum()) / max(1, int(hit.sum()))

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def _subset_bits(n: int, k: int) -> float:
    """Bits that say which ``k`` of ``n`` rows: their number, then one of the choices."""
    return np.log2(n + 1) + (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / np.log(2)


def _exception_bits(hit: np.ndarray, bad: np.ndarray) -> float:
    """Bits that say the good rows among those hit and the bad ones among the others."""
    return float(_subset_bits(int(hit.sum()), int((hit & ~bad).sum())) + _subset_bits(int((~hit).sum()), int((~hit & bad).sum())))


def _rule_bits(rule: Rule, features: int) -> float:
    """Bits that say a rule: for each condition its statistic, its side and its cut; halved, as the order of conditions is free."""
    return len(rule) * (np.log2(features) + 1 + np.log2(CUTS)) / 2


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """An ordered list of rules that mark bad rows; empty where none shortens the description."""
    rules: list[Rule] = []
    left, rng = np.ones(len(bad), bool), np.random.default_rng(seed)
    part = lambda i: {k: v[i] for k, v in x.items()}
    while len(rules) < MAX_RULES and (left & bad).any():
        before, best, gain = _exception_bits(~left, bad), None, 0.0
        for _ in range(TRIES):
            at = rng.permutation(np.flatnonzero(left))
            grow, prune = at[: len(at) * 2 // 3], at[len(at) * 2 // 3 :]
            grown = _grow(part(grow), bad[grow])
            for rule in dict.fromkeys((_prune(grown, part(prune), bad[prune]), grown)):
                hit = _covered(rule, x, len(bad)) & left
                if not rule or (hit & bad).sum() < MIN_PRECISION * hit.sum():
                    continue
                saved = before - _exception_bits(~left | hit, bad) - _rule_bits(rule, len(x))
                if saved > gain:
                    best, gain = rule, saved
        if best is None:
            break
        rules.append(best)
        left &= ~_covered(best, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that fits, 0 if none: an ordered conditional."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_from(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from at most MAX_LABELLED ids of ``labels`` (doc_id, quality), and as many of their rows that the base leaves.

    Labels that are null are no labels. Without labels the list is empty. An id of
    very many rows stays within the bound: rows of the least hash of the id come first.
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # at most MAX_LABELLED rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_counts(rows).where(~base_failed()).select("doc_id", "quality", *(F.expr(e).alias(k) for k, e in FEATURES.items()))
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(MAX_LABELLED)
    got = got.toPandas().sort_values("doc_id", kind="stable")
    return learn({k: got[k].to_numpy(float) for k in FEATURES}, got["quality"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``rule`` (0: none fits) and ``kept``."""
    d = with_counts(docs.drop("base_failed", "rule", "kept")).withColumn("base_failed", base_failed())
    d = d.withColumn("rule", F.when(F.col("n_words") > 0, verdict(rules)).otherwise(F.lit(0)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge every row of ``docs`` by the base limits and a list learned from ``labels``.

    Null and empty texts have no words and fail the base. Repeated rows are judged
    each; ties of statistics fall on one side of a cut alike.
    """
    return apply_rules(docs, learn_from(docs, labels))
