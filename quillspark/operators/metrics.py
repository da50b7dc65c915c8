"""Edit distances, error rates and error analysis."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges
from ..functions.text import collapse, remove_spaces, tokens


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


#: Distinct words of a pair: the private-use characters of planes 15 and 16.
MAX_WORDS = 131_000


def _signs(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in it:
        out = []
        for x, y in zip(a, b):
            number: dict[str, int] = {}
            x, y = ("".join(chr(0xF0000 + number.setdefault(w, len(number))) if len(number) <= MAX_WORDS else "" for w in t.as_py() or []) for t in (x, y))
            if len(number) > MAX_WORDS:
                raise ValueError(f"a pair has more than {MAX_WORDS} distinct words")
            out.append((x, y))
        yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["a", "b"])


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein over words: a private-use character stands for each distinct word of the pair.

    Words are numbered in one pass over a pair; an expression would look each one up among all. A pair of more than
    MAX_WORDS distinct words is an error.
    """
    signs = F.arrow_udf(_signs, "struct<a:string,b:string>")(tokens(a), tokens(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.levenshtein(signs["a"], signs["b"]))


def with_distances(df: DataFrame, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Add distances, lengths, exact and spacing-only matches of a pair."""
    r, p = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(pred), F.lit(""))
    d = df.withColumn("char_distance", char_distance(r, p)).withColumn("ref_chars", F.length(r)).withColumn("word_distance", word_distance(r, p)).withColumn("ref_words", F.size(tokens(r)))
    exact = r == p
    return d.withColumn("exact", exact).withColumn("space_normalized", collapse(r) == collapse(p)).withColumn("spacing_only", ~exact & (remove_spaces(r) == remove_spaces(p)))


def row_rate(distance: Column, size: Column) -> Column:
    """Per row; 1 if an empty reference has edits, 0 if none."""
    return F.when(size > 0, distance / size).when(distance > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def corpus_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Micro averages, each reference counting as one at least."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        (F.sum("char_distance") / F.sum(F.greatest("ref_chars", F.lit(1)))).alias("cer"),
        (F.sum("word_distance") / F.sum(F.greatest("ref_words", F.lit(1)))).alias("wer"),
        F.avg(F.col("exact").cast("double")).alias("exact_match"),
    )


def nonblank_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Corpus rates over rows whose reference isn't blank; 0 if there are none."""
    filled = F.col("ref_words") > 0
    rate = lambda d, n: F.coalesce(F.sum(F.when(filled, F.col(d))) / F.nullif(F.sum(F.when(filled, F.col(n))), F.lit(0)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count_if(filled).alias("samples"), rate("char_distance", "ref_chars").alias("cer"), rate("word_distance", "ref_words").alias("wer"))


def plain_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of edits over sums of lengths; 0 without any length."""
    rate = lambda d, n: F.coalesce(F.sum(d) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("samples"), rate("char_distance", "ref_chars").alias("cer"), rate("word_distance", "ref_words").alias("wer"), F.count_if("exact").alias("exact"), F.count_if("spacing_only").alias("spacing_only"))


def by_dimensions(df: DataFrame, dimensions: list[str], aggregates: dict[str, str], medians: dict[str, str] | None = None) -> DataFrame:
    """``dimension, value``, aggregates and exact medians (SQL expressions) for each dimension by itself and overall.

    Aggregates take one pass; each median takes its own, by refinement (``ranges.quantiles``)
    over the counts of its values and all dimensions together, which are written once: rows are
    neither dealt to every dimension nor read again by each refinement.
    """
    of = lambda cases, rest: reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(rest) if cases else rest
    used = lambda d: F.grouping(d) == 0
    sets = df.groupingSets([[d] for d in dimensions] + [[]], *dimensions)
    out = sets.agg(
        of([(used(d), F.lit(d)) for d in dimensions], F.lit("overall")).alias("dimension"),
        of([(used(d), F.col(d).cast("string")) for d in dimensions], F.lit(None).cast("string")).alias("value"),
        *(F.expr(e).alias(n) for n, e in aggregates.items()),
    )
    out = out.select("dimension", "value", *aggregates)
    views = [F.struct(F.lit("overall").alias("d"), F.lit(None).cast("string").alias("v")), *(F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dimensions)]
    for name, e in (medians or {}).items():
        counts = ranges.kept(df.select(F.expr(e).alias("_x"), *dimensions).where("_x IS NOT NULL").groupBy("_x", *dimensions).agg(F.count(F.lit(1)).alias("_n")))
        long = counts.select("_x", "_n", F.explode(F.array(*views)).alias("view")).select("_x", "_n", F.col("view.d").alias("d"), F.col("view.v").alias("v"))
        got = ranges.quantiles(long, "_x", (0.5,), ("d", "v"), weight="_n").select(F.col("d").alias("_d"), F.col("v").alias("_v"), F.col("q")[0].alias(name))
        out = out.join(got, F.col("dimension").eqNullSafe(F.col("_d")) & F.col("value").eqNullSafe(F.col("_v")), "left").drop("_d", "_v")
    return out


def compression_metrics(df: DataFrame, dimensions: list[str], width: str, steps: str, length: str) -> DataFrame:
    """Widths against the frames that a model makes of them, by each dimension and overall.

    ``width`` of an image, ``steps`` that it is reduced to, ``length`` of its label:
    mean and median widths, steps per character, and how many rows have fewer steps
    than characters, or a width that is missing. Ratios over nothing are null.
    """
    ratio = f"{steps} / nullif({length}, 0)"
    return by_dimensions(df, dimensions, {
        "samples": "count(*)",
        "mean_width": f"avg({width})",
        "mean_steps_per_char": f"avg({ratio})",
        "too_short": f"count_if({steps} < {length})",
        "no_width": f"count_if({width} IS NULL)",
    }, {"median_width": width, "median_steps_per_char": ratio})


def _next_costs(up: np.ndarray, token: int, pred: np.ndarray) -> np.ndarray:
    """The row of edit costs below ``up``: its insertions are a running minimum along the row."""
    best = np.concatenate([[up[0] + 1], np.minimum(up[:-1] + (pred != token), up[1:] + 1)])
    at = np.arange(len(best))
    return np.minimum.accumulate(best - at) + at


def align(ref: list[str], pred: list[str]) -> list[tuple[str, str, str]]:
    """An optimal alignment as (op, ref, pred); at ties the diagonal comes first, then deletion, then insertion.

    Every b-th row of costs is kept, b the root of their number, and those between
    are made again on the way back: memory grows by the root of the rows.
    """
    number: dict[str, int] = {}
    r, p = (np.array([number.setdefault(t, len(number)) for t in x], np.int64) for x in (ref, pred))
    i, j = len(ref), len(pred)
    out = []
    while i and j and r[i - 1] == p[j - 1]:  # equal ends are on the diagonal
        i, j = i - 1, j - 1
        out.append(("equal", ref[i], pred[j]))
    p = p[:j]
    step = max(1, int(i**0.5))
    kept, row = [np.arange(j + 1)], np.arange(j + 1)
    for k in range(i):
        row = _next_costs(row, r[k], p)
        if (k + 1) % step == 0:
            kept.append(row)
    first, cost = i + 1, []  # cost[x] is row first + x
    while i or j:
        if i and i - 1 < first:
            first = (i - 1) // step * step
            cost = [kept[first // step]]
            for k in range(first, i):
                cost.append(_next_costs(cost[-1], r[k], p))
        here = cost[i - first][j] if cost else j
        if i and j and here == cost[i - first - 1][j - 1] + (r[i - 1] != p[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if r[i] == p[j] else "substitute", ref[i], pred[j]))
        elif i and here == cost[i - first - 1][j] + 1:
            i -= 1
            out.append(("delete", ref[i], ""))
        else:
            j -= 1
            out.append(("insert", "", pred[j]))
    return out[::-1]


_EDIT = pa.struct([("op", pa.string()), ("ref", pa.string()), ("pred", pa.string())])
#: Edits that a task holds before it hands them on.
FLUSH = 1 << 16


def _split(level: str):
    return list if level == "char" else str.split


def _aligned(split):
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in it:
            done, held, ends = [], [], [0]

            def hand_on():
                values = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*held)] if held else [pa.array([], pa.string())] * 3, fields=list(_EDIT))
                done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                held.clear()
                ends[:] = [0]

            for r, p in zip(a, b):
                held += align(split(r.as_py() or ""), split(p.as_py() or ""))
                ends.append(len(held))
                if len(held) >= FLUSH:
                    hand_on()
            hand_on()
            yield pa.concat_arrays(done)

    run.__annotations__ = {"it": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<op:string,ref:string,pred:string>>")


def alignments(df: DataFrame, level: str, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Add ``ops``: the alignment of characters or words. Traceback is beyond SQL, so it is an Arrow UDF."""
    return df.withColumn("ops", _aligned(_split(level))(F.col(ref), F.col(pred)))


def confusions(df: DataFrame, level: str, keys: list[str] | None = None, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Counts of (op, ref, pred) among the edits. A task holds FLUSH edits and one alignment at a time, whatever the size of its batches."""
    keys, split = keys or [], _split(level)
    columns = df.select(*keys, F.col(ref).alias("_ref"), F.col(pred).alias("_pred"))
    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "op string, ref string, pred string"

    def run(batches):
        for batch in batches:
            rows, held = [], []

            def handed():
                of = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(keys))), *(pa.array(c, pa.string()) for c in zip(*held))], names=[*keys, "op", "ref", "pred"])
                rows.clear()
                held.clear()
                return out

            for i, (r, p) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1))):
                edits = [e for e in align(split(r.as_py() or ""), split(p.as_py() or "")) if e[0] != "equal"]
                held += edits
                rows += [i] * len(edits)
                if len(held) >= FLUSH:
                    yield handed()
            if held:
                yield handed()

    return columns.mapInArrow(run, schema).groupBy(*keys, "op", "ref", "pred").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))


def _edit_counts(split):
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ops = ("substitute", "delete", "insert")
        for a, b in it:
            n = np.zeros((len(a), 3), np.int64)
            for i, (r, p) in enumerate(zip(a, b)):
                done = [op for op, _, _ in align(split(r.as_py() or ""), split(p.as_py() or ""))]
                n[i] = [done.count(op) for op in ops]
            yield pa.StructArray.from_arrays([pa.array(n[:, i]) for i in range(3)], names=list(ops))

    run.__annotations__ = {"it": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<substitute:bigint,delete:bigint,insert:bigint>")


def edit_breakdown(df: DataFrame, level: str, *keys: str, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Sums of substitutions, deletions and insertions; three numbers leave a pair, not its alignment."""
    d = df.withColumn("_n", _edit_counts(_split(level))(F.col(ref), F.col(pred)))
    return d.groupBy(*keys).agg(F.sum("_n.substitute").alias("substitutions"), F.sum("_n.delete").alias("deletions"), F.sum("_n.insert").alias("insertions"))


def impact(before_words: Column, after_words: Column, before_chars: Column, after_chars: Column) -> Column:
    """improved, hurt or unchanged: word edits decide, character edits break ties."""
    return (
        F.when(after_words < before_words, "improved").when(after_words > before_words, "hurt").when(after_chars < before_chars, "improved").when(after_chars > before_chars, "hurt").otherwise("unchanged")
    )


def best_setting(candidates: DataFrame, settings: DataFrame, row_id: str) -> DataFrame:
    """Per row and setting the candidate of the largest acoustic + w * lm + b * words.

    ``settings`` (setting, lm_weight, word_bonus) is a small grid, so it is sent to all.
    """
    c = candidates.join(F.broadcast(settings))
    value = F.col("acoustic") + F.col("lm_weight") * F.col("lm") + F.col("word_bonus") * F.col("n_words")
    return c.withColumn("score", value).groupBy(row_id, "setting").agg(F.max_by("candidate", F.struct("score", F.col("candidate"))).alias("candidate"), F.max("score").alias("score"))
