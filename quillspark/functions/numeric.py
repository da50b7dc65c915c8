"""Numbers: rounding, bins, keys and quotas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-closed edges of the analyses' bins (fixed values): the largest value of each bin but the last.
LENGTH_EDGES, WORD_EDGES = [5, 10, 20, 40, 80], [1, 2, 5, 10]


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def buckets(c: Column, edges: list[float]) -> Column:
    """Right-closed bins by name: <=5, 6-10, ..., >80."""
    out = F.when(c <= edges[0], f"<={edges[0]:g}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(c <= hi, f"({lo:g},{hi:g}]")
    return out.otherwise(F.when(c.isNotNull(), f">{edges[-1]:g}"))


def hex_int(hexdigits: Column) -> Column:
    return F.conv(hexdigits, 16, 10).cast("bigint")


def sha1_bucket(key: Column, n: int = 100) -> Column:
    """The first eight hex digits of the key's SHA-1, modulo n."""
    return hex_int(F.substring(F.sha1(key), 1, 8)) % n


def ratio_split(bucket: Column, train: int = 80, val: int = 90) -> Column:
    return F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test")


def split_priority(split: Column) -> Column:
    return F.when(split == "test", 2).when(split == "val", 1).otherwise(0)


def resized_width(width: Column, height: Column, target: int, most: int) -> Column:
    """Width after scaling to the target height; half to even; 1 to ``most``."""
    scaled = F.when(height > 0, F.bround(width * target / height)).otherwise(F.lit(1.0))
    return F.least(F.greatest(scaled.cast("int"), F.lit(1)), F.lit(most))


def timesteps(width: Column, stride: int = 4) -> Column:
    return F.greatest(F.floor(width / stride).cast("int"), F.lit(1))


def log_add(values: Column) -> Column:
    """ln(sum(exp(x))) of an array, without overflow."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def quota(total: Column, parts: Column, index: Column) -> Column:
    """Share of part ``index`` (from 0) when total is dealt evenly, the rest to the first ones."""
    return F.floor(total / parts) + F.when(index < total % parts, 1).otherwise(0)
