"""Visual order of right-to-left text: a subset of the Unicode bidirectional algorithm.

One paragraph level (from the first strong character), runs of strong, number and
neutral characters, mirrored brackets; explicit embeddings and isolates are ignored.
Text without right-to-left characters is returned as it is.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def visual_order(text: str) -> str:
    """Characters in the order they are seen from left to right."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in text]
    if not any(k in ("R", "AL", "AN") for k in kinds):
        return text
    base = next((int(k in ("R", "AL")) for k in kinds if k in ("L", "R", "AL")), 0)
    # numbers take the separators within them; marks go with what they follow
    for i, k in enumerate(kinds):
        if k == "NSM":
            kinds[i] = kinds[i - 1] if i else "ON"
        elif k in ("CS", "ES") and 0 < i < len(kinds) - 1 and kinds[i - 1] == kinds[i + 1] in ("EN", "AN"):
            kinds[i] = kinds[i - 1]
    strong = ["R" if k in ("R", "AL") else k if k in ("L", "EN", "AN") else "N" for k in kinds]
    edge = "R" if base else "L"
    levels, i = [0] * len(text), 0
    side = lambda k: "R" if k in ("R", "EN", "AN") else "L"
    last = edge  # the last strong letter: European numbers after Latin letters are Latin
    for j, k in enumerate(strong):
        if k in ("L", "R"):
            last = k
        elif k == "EN" and last == "L":
            strong[j] = "L"
    while i < len(text):
        j = i
        while j < len(text) and strong[j] == "N":
            j += 1
        if j > i:
            before, after = (side(strong[i - 1]) if i else edge), (side(strong[j]) if j < len(text) else edge)
            strong[i:j] = [before if before == after else edge] * (j - i)
        i = max(j, i + 1)
    for i, k in enumerate(strong):
        levels[i] = (1 if k == "R" else 2 if k in ("EN", "AN") else 2 * base) if base else (0 if k == "L" else 1 if k == "R" else 2)
    order = list(range(len(text)))
    for level in range(max(levels), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    mirror = dict(zip("()[]{}<>«»", ")(][}{><»«"))
    return "".join(mirror.get(text[i], text[i]) if levels[i] % 2 else text[i] for i in order)


def _visual(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else visual_order(t) for t in x.to_pylist()], pa.string())


def visual(c: Column) -> Column:
    """``visual_order`` of a column."""
    return F.arrow_udf(_visual, "string")(c)
