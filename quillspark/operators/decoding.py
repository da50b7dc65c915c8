"""CTC prefix beam search over tables of frame scores."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame


#: Places of log probabilities that count in the order of prefixes.
PLACES = 9


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def prefix_beam_search(frames: list[list[float]], beam: int = 10, prune: int = 20, blank: int = 0) -> list[tuple[tuple[int, ...], float]]:
    """Prefixes with their log probabilities, best first.

    Log probabilities that are equal to PLACES places are ties, which go to the lesser prefix: sums of
    equal paths differ in their last bits by the order they are taken in.

    ``frames`` are log probabilities by symbol. Each frame's ``prune`` best symbols
    (the blank always) extend the ``beam`` best prefixes. A prefix keeps the
    probability of ending in a blank and of ending in its last symbol apart, so a
    repeated symbol extends it only after a blank.
    """
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -math.inf)}
    for scores in frames:
        symbols = sorted(range(len(scores)), key=lambda s: (-scores[s], s))[:prune]
        if blank not in symbols:
            symbols.append(blank)
        after: dict[tuple[int, ...], tuple[float, float]] = {}

        def put(prefix, in_blank: float, in_symbol: float) -> None:
            if in_blank == in_symbol == -math.inf:
                return  # can't be reached: a repeat without a blank before it
            b, s = after.get(prefix, (-math.inf, -math.inf))
            after[prefix] = (_add(b, in_blank), _add(s, in_symbol))

        for prefix, (b, s) in beams.items():
            for c in symbols:
                p = scores[c]
                if c == blank:
                    put(prefix, _add(b, s) + p, -math.inf)
                elif prefix and prefix[-1] == c:
                    put(prefix, -math.inf, s + p)
                    put((*prefix, c), -math.inf, b + p)
                else:
                    put((*prefix, c), -math.inf, _add(b, s) + p)
        beams = dict(sorted(after.items(), key=lambda x: (-round(_add(*x[1]), PLACES), x[0]))[:beam])
    return sorted(((k, _add(*v)) for k, v in beams.items()), key=lambda x: (-round(x[1], PLACES), x[0]))


def beam_search(df: DataFrame, key: str, frames: str, beam: int = 10, prune: int = 20, blank: int = 0) -> DataFrame:
    """``key, rank, indices, log_prob`` of each row's frames (array<array<double>>); a null gives no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            which, ranks, indices, lps = [], [], [], []
            for i, f in enumerate(batch.column(1).to_pylist()):
                for r, (prefix, lp) in enumerate(prefix_beam_search(f, beam, prune, blank) if f is not None else []):
                    which.append(i)
                    ranks.append(r)
                    indices.append(list(prefix))
                    lps.append(lp)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(ranks, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(lps, pa.float64())], names=[key, "rank", "indices", "log_prob"])

    return df.select(key, frames).mapInArrow(run, f"`{key}` {kind}, rank int, indices array<int>, log_prob double")
