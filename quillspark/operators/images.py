"""Images as rows: decoded, prepared for a recogniser, cut into lines.

Images travel as PNG bytes in a column, so Spark places and moves them like other
values; each function works on one image at a time within Arrow batches. An image
that can't be read, or a step that doesn't apply, gives an ``error`` in its row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png
from ..sources.documents import HELD, _rows

#: Weights of red, green and blue in grey, of 65,536 (fixed values of ITU-R 601).
GREY = (19595, 38470, 7471)


def slices(found: Iterable, size: Callable[[Any], int]) -> Iterator[list]:
    """Values in their order, in lists that end once their sizes come to HELD."""
    part, held = [], 0
    for v in found:
        part.append(v)
        held += size(v)
        if held >= HELD:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(images: DataFrame, width: str = "width", height: str = "height", channels: str = "channels", pixels: str = "pixels") -> Column:
    """PNG bytes of 8-bit samples row by row; null where samples are missing or don't fill the size."""

    def image(w, h, c, px):
        w, h, c = w.as_py(), h.as_py(), c.as_py()
        if px.is_valid and None not in (w, h, c) and w > 0 and h > 0 and c in (1, 3) and len(px.as_buffer()) == w * h * c:
            return np.frombuffer(px.as_buffer(), np.uint8).reshape(int(h), int(w), int(c))
        return None

    def packed(it: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in it:
            done = []
            for part in slices((image(*row) for row in zip(*batch)), lambda px: 0 if px is None else px.size):
                found = iter(png.encode_many([px for px in part if px is not None]))
                done.append(pa.array([None if px is None else next(found) for px in part], pa.binary()))
            yield pa.concat_arrays(done or [pa.array([], pa.binary())])

    return F.arrow_udf(packed, "binary")(images[width], images[height], images[channels], images[pixels])


def levels(pixels: Column) -> Column:
    """The sum of an image's samples."""

    def total(px: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(p.as_buffer(), np.uint8).sum(dtype=np.int64)) if p.is_valid else None for p in px], pa.int64())

    return F.arrow_udf(total, "bigint")(pixels)


def decoded(files: DataFrame) -> DataFrame:
    """``path, width, height, channels, pixels`` of PNG files; ``error`` says why bytes aren't an image."""

    def parse(data):
        px = png.decode(data)
        yield px.shape[1], px.shape[0], px.shape[2], px.tobytes()

    return _rows(files, parse, "width int, height int, channels int, pixels binary")


# -- steps on one image, (h, w, c) to (h, w, c) -------------------------------


def _colours(px: np.ndarray) -> np.ndarray:
    """Three channels; what alpha leaves open is dropped, as a plain conversion does."""
    return px[:, :, :3] if px.shape[2] >= 3 else np.repeat(px[:, :, :1], 3, 2)


def grey(px: np.ndarray) -> np.ndarray:
    if px.shape[2] < 3:
        return px[:, :, :1]
    return ((px[:, :, :3].astype(np.int64) @ np.array(GREY) + (1 << 15)) >> 16).astype(np.uint8)[:, :, None]


def square(px: np.ndarray, margin: float = 0.08) -> np.ndarray:
    """In the middle of a white square with a margin of at least two pixels on each side."""
    px = _colours(px)
    h, w = px.shape[:2]
    edge = max(2, round(max(h, w) * margin))
    side = max(h, w) + 2 * edge
    out = np.full((side, side, 3), 255, np.uint8)
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = px
    return out


def _triangle(n: int, m: int) -> np.ndarray:
    """m x n weights of a linear filter, widened where it shrinks, so that every sample counts."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    weight = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None] - centre[:, None]) / scale)
    return weight / weight.sum(1, keepdims=True)


def resize(px: np.ndarray, height: int, max_width: int) -> np.ndarray:
    """To a height, the width by the same factor within 1 and ``max_width``."""
    h, w = px.shape[:2]
    width = min(max_width, max(1, round(w * (height / h))))
    out = np.einsum("ya,xb,abc->yxc", _triangle(h, height), _triangle(w, width), px.astype(np.float64), optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _even_steps() -> np.ndarray:
    """Row r deals r ones to 256 levels at even steps."""
    rest, level = np.arange(256)[:, None], np.arange(256)
    step = np.maximum(1, 256 // np.maximum(rest, 1))
    return (level % step == 0) & (level // step < rest)


_EVEN_STEPS = _even_steps()


def local_contrast(px: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation of grey by tiles with a clip limit, blended between tile centres.

    The image is mirrored at its right and lower edge until tiles are of one size. What
    a tile's histogram has above ``clip`` times its mean is dealt to all levels evenly,
    the rest one each at even steps.
    """
    g = grey(px)[:, :, 0]
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    mirrored = lambda n, m: (lambda i: np.where(i < n, i, 2 * (n - 1) - i))(np.arange(m) % max(1, 2 * (n - 1)))
    full = g[mirrored(h, th * tiles)][:, mirrored(w, tw * tiles)]
    tile = full.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, th * tw)
    hist = np.bincount((np.arange(tiles * tiles)[:, None] * 256 + tile).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    limit = max(1, int(clip * th * tw / 256))
    excess = np.maximum(hist - limit, 0).sum(1)
    hist = np.minimum(hist, limit) + (excess // 256)[:, None]
    hist += _EVEN_STEPS[excess % 256]
    table = np.rint(np.cumsum(hist, 1) * (255.0 / (th * tw))).clip(0, 255).reshape(tiles, tiles, 256)

    def sides(n, size):
        at = (np.arange(n) / size) - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = sides(h, th)
    x0, x1, fx = sides(w, tw)
    flat, number = table.ravel(), g.astype(np.intp)
    at = lambda y, x: flat.take((y[:, None] * tiles + x) * 256 + number)
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.rint(top * (1 - fy[:, None]) + low * fy[:, None]).clip(0, 255).astype(np.uint8)[:, :, None]


def thresholds(g: np.ndarray) -> np.ndarray:
    """For each page (k, h, w) the level that parts dark from light with the largest variance between both; -1 where there is one level only."""
    n = np.array([np.bincount(page, minlength=256) for page in g.reshape(len(g), -1)]).astype(np.float64)
    below, mass = np.cumsum(n, 1), np.cumsum(n * np.arange(256), 1)
    above = below[:, -1:] - below
    ok = (below > 0) & (above > 0)
    gap = mass / np.maximum(below, 1) - (mass[:, -1:] - mass) / np.maximum(above, 1)
    return np.where(ok.any(1), np.where(ok, below * above * gap**2, -1.0).argmax(1), -1)


def ink(px: np.ndarray) -> np.ndarray:
    """True where a pixel is dark."""
    g = grey(px)[:, :, 0]
    return g <= thresholds(g[None])[0]


def crop_ink(px: np.ndarray, padding: int = 12) -> np.ndarray:
    """The smallest box around ink and a padding; an image without ink stays."""
    y, x = np.nonzero(ink(px))
    if not len(y):
        return px
    return px[max(0, y.min() - padding) : y.max() + 1 + padding, max(0, x.min() - padding) : x.max() + 1 + padding]


def blue_ink(px: np.ndarray, least: float = 5.0, gain: float = 6.0) -> np.ndarray:
    """Grey where blue stands out from red and green: white below ``least``, darker by ``gain`` for each level above."""
    c = _colours(px).astype(np.float32)
    strength = c[:, :, 2] - (c[:, :, 0] + c[:, :, 1]) / 2
    return (255 - np.clip((strength - least) * gain, 0, 255)).astype(np.uint8)[:, :, None]


STEPS = {"grey": grey, "blue_ink": blue_ink, "square": square, "resize": resize, "local_contrast": local_contrast, "crop_ink": crop_ink}


def prepared(files: DataFrame, *steps: tuple) -> DataFrame:
    """``path, width, height, content``: PNG files taken through steps of STEPS in turn, each a name and its arguments."""
    for name, *_ in steps:
        if name not in STEPS:
            raise ValueError(f"no step {name!r} among {', '.join(STEPS)}")

    def parse(data):
        px = png.decode(data)
        for name, *args in steps:
            px = STEPS[name](px, *args)
        px = px if px.shape[2] == 1 else _colours(px) if px.shape[2] > 2 else px[:, :, :1]
        yield px.shape[1], px.shape[0], png.encode(px)

    return _rows(files, parse, "width int, height int, content binary")


# -- lines of a page ----------------------------------------------------------


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end column of the runs of true pixels, row by row."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    wide[:, 1:-1] = mask
    # every run has two edges, and edges of a row come in order
    row, at = np.divmod(np.flatnonzero(wide[:, 1:] != wide[:, :-1]), mask.shape[1] + 1)
    return row[::2], at[::2], at[1::2]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers below n that each is joined to by pairs of a and b."""
    least = np.arange(n)
    while len(a):
        p, q = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = p < q
        a, b = a[apart], b[apart]
        np.minimum.at(least, q[apart], p[apart])
        while not np.array_equal(up := least[least], least):
            least = up
    return least


def components(mask: np.ndarray) -> np.ndarray:
    """Rows x, y, width, height, area, and the sum of y, of parts joined by sides or corners; in order of their first pixel."""
    return _parts(*runs(mask), mask.shape[1])


def _parts(row: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """``components`` of runs in their order.

    Runs that touch runs of the row above are joined all at once, the least number of a
    part handed on until nothing changes; pixels are never visited one by one.
    """
    if not len(row):
        return np.zeros((0, 6), np.int64)
    # runs of the row above that end at or after a run's first column less one, and start at or before its end
    stride = width + 2
    lo = np.searchsorted(row * stride + end, (row - 1) * stride + first)
    hi = np.searchsorted(row * stride + first, (row - 1) * stride + end, side="right")
    times = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(row)), times)
    above = np.arange(len(below)) - np.repeat(np.cumsum(times) - times, times) + lo[below]
    root = _joined(len(row), below, above)
    order = np.argsort(root, kind="stable")
    row, first, end, root = row[order], first[order], end[order], root[order]
    at = np.flatnonzero(np.diff(root, prepend=-1))
    x, y = np.minimum.reduceat(first, at), np.minimum.reduceat(row, at)
    sizes = (np.maximum.reduceat(end, at) - x, np.maximum.reduceat(row, at) + 1 - y)
    return np.stack([x, y, *sizes, np.add.reduceat(end - first, at), np.add.reduceat((end - first) * row, at)], 1).astype(np.int64)


#: Most numbers whose intervals' costs are held at once, and most such costs.
_SMALL, _COSTS = 256, 1 << 18


def groups_on_lines(x: np.ndarray, k: int) -> np.ndarray:
    """Group of each number of each row, 0 to k - 1 from below, with the least sum of squared distances to the groups' means; of equal ones the one whose last groups are the largest.

    On a line a group is an interval of sorted values, so the best grouping is found exactly.
    Equal numbers may fall into different groups only where there are fewer values than groups.
    """
    p, n = x.shape
    order = np.argsort(x, axis=1, kind="stable")
    v = np.take_along_axis(np.asarray(x, np.float64), order, 1)
    v = v - v.mean(1, keepdims=True)
    s, q = np.zeros((2, p, n + 1))
    s[:, 1:], q[:, 1:] = np.cumsum(v, 1), np.cumsum(v * v, 1)
    best, cut, first = np.full((p, n + 1), np.inf), np.zeros((k, p, n + 1), np.int32), np.zeros((k, p), int)
    best[:, 0] = 0
    if n <= _SMALL:  # the cost of every interval, before j (rows) from i, in one table
        size = np.arange(n + 1)[:, None] - np.arange(n + 1)[None]
        whole = np.where(size > 0, np.maximum(0, q[:, :, None] - q[:, None] - (s[:, :, None] - s[:, None]) ** 2 / np.maximum(size, 1)), np.inf)
    for g in range(k):
        if n <= _SMALL:
            total = best[:, None] + whole
            cut[g] = total.argmin(2)
            best = np.take_along_axis(total, cut[g][:, :, None].astype(np.intp), 2)[:, :, 0]
            continue
        now = np.full((p, n + 1), np.inf)
        for j in range(g + 1, n + 1):
            i = np.arange(g, j)
            cost = best[:, i] + np.maximum(0, q[:, j, None] - q[:, i] - (s[:, j, None] - s[:, i]) ** 2 / (j - i))
            at = cost.argmin(1)
            now[:, j], cut[g, :, j] = cost[np.arange(p), at], g + at
        best = now
    j = np.full(p, n)
    for g in range(k - 1, -1, -1):
        first[g] = j = cut[g, np.arange(p), j]
    of, out = np.zeros((p, n), int), np.empty((p, n), int)
    for f in first[1:]:
        of += np.arange(n) >= f[:, None]
    np.put_along_axis(out, order, of, 1)
    return out


def groups_on_a_line(x: np.ndarray, k: int) -> np.ndarray:
    """``groups_on_lines`` of one row."""
    return groups_on_lines(np.asarray(x)[None], k)[0]


def _boxes(c: np.ndarray, k: int, h: int, w: int) -> list[tuple[list[tuple[int, int, int, int]], str]]:
    """Boxes of k lines and ``ok``, or why there are none, of each page (p, n, 6) of n parts."""
    p, n, _ = c.shape
    centre = c[:, :, 5] / c[:, :, 4]
    # a page's parts by line, one page after the other
    line = (np.arange(p)[:, None] * k + groups_on_lines(centre, k)).ravel()
    order = np.argsort(line, kind="stable")
    own, size = c.reshape(-1, 6)[order], np.bincount(line, minlength=p * k)
    begin = np.cumsum(size) - size
    means = (np.add.reduceat(centre.ravel()[order], begin) / size).reshape(p, k)
    pad = (max(8, int(w * 0.01)), max(5, int(h * 0.008)))
    least = np.maximum(np.minimum.reduceat(own[:, :2], begin) - pad, 0)
    most = np.minimum(np.maximum.reduceat(own[:, :2] + own[:, 2:4], begin) + pad, (w, h))
    wide, tall = (most - least).reshape(p, k, 2).transpose(2, 0, 1)
    small, high = (tall < 8) | (wide < 20), tall > h * 0.45
    wrong = (small | high).argmax(1)
    at = np.arange(p)
    why = np.where(small[at, wrong], 2, np.where(high[at, wrong], 3, 0))
    why[(np.diff(means, axis=1) <= 0).any(1)] = 1
    boxes = np.concatenate([least, most], 1).reshape(p, k, 4).tolist()
    return [([], ("invalid_reading_order", "crop_too_small", "crop_too_tall")[y - 1]) if y else (list(map(tuple, b)), "ok") for b, y in zip(boxes, why.tolist())]


def pages_lines(px: np.ndarray, expected: list[int]) -> list[tuple[list[tuple[int, int, int, int]], str]]:
    """Of each page (k, h, w, c): boxes x1, y1, x2, y2 of its lines from above, and ``ok`` or why there are none.

    Dark parts, without rules (long runs) and specks, are grouped by the height of their
    centres into as many lines as the page has by its text. The pages lie below one another
    with a row between, and those of as many parts and lines are grouped at once.
    """
    k, h, w, c = px.shape
    g = px[..., 0] if c < 3 else grey(px.reshape(k, h * w, c)).reshape(k, h, w)
    row, first, end = runs((g <= thresholds(g)[:, None, None]).reshape(k * h, w))
    short = end - first < max(30, w // 12)
    row, first, end = row[short], first[short], end[short]
    c = _parts(row + row // h, first, end, w)
    page = c[:, 1] // (h + 1)
    c[:, 1] -= page * (h + 1)
    c[:, 5] -= page * (h + 1) * c[:, 4]
    speck = (c[:, 4] < max(8, int(h * w * 0.000002))) | (c[:, 2] < 2) | (c[:, 3] < 3)
    held = ~speck & ~((c[:, 2] > w * 0.75) & (c[:, 3] < max(5, h * 0.015)))
    c, page = c[held], page[held]
    count = np.bincount(page, minlength=k)
    begin = np.cumsum(count) - count
    out, alike = [None] * k, defaultdict(list)
    for i, (n, e) in enumerate(zip(count.tolist(), expected)):
        if e <= 0:
            out[i] = [], "no_text_lines"
        elif n < e:
            out[i] = [], f"too_few_components:{n}<{e}"
        else:
            alike[n, e].append(i)
    for (n, e), pages in alike.items():
        step = max(1, _COSTS // (n + 1) ** 2)
        for some in (pages[i : i + step] for i in range(0, len(pages), step)):
            for i, got in zip(some, _boxes(c[begin[some][:, None] + np.arange(n)], e, h, w)):
                out[i] = got
    return out


def page_lines(px: np.ndarray, expected: int) -> tuple[list[tuple[int, int, int, int]], str]:
    """``pages_lines`` of one page."""
    return pages_lines(px[None], [expected])[0]


def _lines_or_error(pages: list[np.ndarray], expected: list[int]) -> list[tuple | Exception]:
    try:
        return pages_lines(np.stack(pages) if len(pages) > 1 else pages[0][None], expected)
    except Exception as e:  # reported with the page that it comes from
        return [e] if len(pages) == 1 else [r for px, n in zip(pages, expected) for r in _lines_or_error([px], [n])]


def cut(files: Iterable[bytes]) -> Iterator[list[tuple] | Exception]:
    """The lines of each page with its PNG, one row without a line where it isn't cut, or why it can't be read; a file is the number of its lines and a PNG."""
    for part in slices(files, lambda data: png.samples(data[4:]) + len(data)):
        out, shapes = png.decode_many([data[4:] for data in part]), defaultdict(list)
        for i, px in enumerate(out):
            if not isinstance(px, Exception):
                shapes[px.shape].append(i)
        crops = []
        for alike in shapes.values():
            got = _lines_or_error([out[i] for i in alike], [int.from_bytes(part[i][:4], "big", signed=True) for i in alike])
            for i, r in zip(alike, got):
                flat = out[i][:, :, : 1 if out[i].shape[2] < 3 else 3]
                out[i] = r
                if not isinstance(r, Exception):
                    crops += [flat[y1:y2, x1:x2] for x1, y1, x2, y2 in r[0]]
                    out[i] = [(n, *box, r[1]) for n, box in enumerate(r[0], 1)] or [(None, None, None, None, None, r[1])]
        # in the order in which their pages were cut
        made = iter(png.encode_many(crops))
        for i in (i for alike in shapes.values() for i in alike):
            if not isinstance(out[i], Exception):
                out[i] = [(*r, None if r[0] is None else next(made)) for r in out[i]]
        yield from out


def line_crops(pages: DataFrame, expected: str = "expected") -> DataFrame:
    """``path, line, x1, y1, x2, y2, status, content, error``: a PNG of each line of a page; one row without a line where a page isn't cut.

    ``pages`` has path, content and the number of lines that the page's text has.
    """
    # the number of lines goes ahead of the image's bytes
    count = F.unhex(F.lpad(F.right(F.hex(F.coalesce(F.col(expected), F.lit(0)).cast("int")), F.lit(8)), 8, "0"))
    files = pages.select("path", F.concat(count, F.coalesce("content", F.lit(b""))).alias("content"))
    return _rows(files, cut, "line int, x1 int, y1 int, x2 int, y2 int, status string, content binary", together=True)
