"""PNG images of 8-bit samples, both ways, as arrays of rows, columns and channels."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np

_MARK = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type (fixed values of the format).
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Most samples of an image that is read; a larger header is an error, not an allocation.
MAX_SAMPLES = 1 << 28


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


_END = _chunk(b"IEND", b"")


def _filtered(px: np.ndarray) -> np.ndarray:
    """Rows with their filter ahead of k images of one shape (k, h, w, c); each row takes the filter of the least sum of differences among none, left and above."""
    k, h, w, c = px.shape
    forms = np.empty((3, k, h, w, c), np.uint8)
    forms[:] = px
    forms[1, :, :, 1:] -= px[:, :, :-1]
    forms[2, :, 1:] -= px[:, :-1]
    forms = forms.reshape(3, k * h, w * c)
    # a difference counts by its distance from 0 on the circle of 256
    best = np.minimum(forms, np.uint8(0) - forms).sum(2, dtype=np.int64).argmin(0)
    rows = np.empty((k * h, w * c + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(k * h)]
    return rows.reshape(k, h, w * c + 1)


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Grey (h, w) or (h, w, 1) or colour (h, w, 3) images; those of one shape are filtered at once, equal ones packed once."""
    shapes = defaultdict(lambda: defaultdict(list))
    for i, px in enumerate(images):
        h, w, c = px.shape if px.ndim == 3 else (*px.shape, 1)
        if not h or not w or c not in (1, 3):
            raise ValueError(f"no image of {w} x {h} x {c}")
        shapes[h, w, c][np.ascontiguousarray(px).tobytes()].append(i)
    out = [b""] * len(images)
    for (h, w, c), found in shapes.items():
        head = _MARK + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0))
        rows = _filtered(np.frombuffer(b"".join(found), np.uint8).reshape(-1, h, w, c))
        for at, own in zip(found.values(), rows):
            packed = head + _chunk(b"IDAT", zlib.compress(own.tobytes(), 6)) + _END
            for i in at:
                out[i] = packed
    return out


def encode(pixels: np.ndarray) -> bytes:
    """One image as ``encode_many`` has it."""
    return encode_many([pixels.reshape(*pixels.shape[:2], -1)])[0]


def _chunks(data: bytes):
    at = len(_MARK)
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"torn chunk {kind!r}")
        yield kind, body
        at += 12 + n


def _average(row: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    out = row.astype(np.int32)
    for x in range(0, len(out), c):
        before = out[x - c : x] if x else 0
        out[x : x + c] = (out[x : x + c] + (before + up[x : x + c].astype(np.int32)) // 2) & 255
    return out.astype(np.uint8)


def _paeth(row: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    out, above = row.astype(int).tolist(), up.astype(int).tolist()
    for x in range(len(out)):
        a, b, d = (out[x - c], above[x], above[x - c]) if x >= c else (0, above[x], 0)
        p = a + b - d
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))
        out[x] = (out[x] + near[2]) & 255
    return np.array(out, np.uint8)


def _simple(rows: np.ndarray, c: int) -> np.ndarray:
    """Samples of rows without a filter, or with those of left and above, all rows at once.

    Sums go down whole columns (modulo 256), less what was summed up where a row doesn't lean on the one above.
    """
    how, out = rows[:, 0], rows[:, 1:].copy()
    h = len(out)
    left = np.flatnonzero(how == 1)
    if len(left):
        by_channel = out[left].reshape(len(left), -1, c).transpose(0, 2, 1)
        out[left] = np.cumsum(by_channel, 2, dtype=np.uint8).transpose(0, 2, 1).reshape(len(left), -1)
    if (how == 2).any():
        total = np.cumsum(out, 0, dtype=np.uint8)
        first = np.maximum.accumulate(np.where(how != 2, np.arange(h), 0))
        out = np.where((first > 0)[:, None], total - total[first - 1], total)
    return out


def _unfiltered(rows: np.ndarray, c: int) -> np.ndarray:
    """Samples of rows of any filter, row by row."""
    out, up = np.empty((len(rows), rows.shape[1] - 1), np.uint8), np.zeros(rows.shape[1] - 1, np.uint8)
    for y in range(len(rows)):
        how, row = rows[y, 0], rows[y, 1:]
        if how == 0:
            up = row
        elif how == 1:
            up = np.cumsum(row.reshape(-1, c), 0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            up = row + up
        elif how in (3, 4):
            up = (_average if how == 3 else _paeth)(row, up, c)
        else:
            raise ValueError(f"filter {how}")
        out[y] = up
    return out


def _samples(rows: np.ndarray, c: int) -> np.ndarray:
    return _simple(rows, c) if rows[:, 0].max() < 3 else _unfiltered(rows, c)


def samples(data: bytes) -> int:
    """Samples that an image has by its header, not checked further; 0 where there is none."""
    if not data.startswith(_MARK) or len(data) < 26:
        return 0
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    return min(w * h * _CHANNELS.get(kind, 0), MAX_SAMPLES)


def _read(data: bytes) -> tuple[tuple[int, int, int], np.ndarray | None, bytes]:
    """Height, width and channels, the palette, and the rows with their filters."""
    if not data.startswith(_MARK):
        raise ValueError("not a PNG")
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit PNG without interlace")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    if not w or not h or w * h * c > MAX_SAMPLES:
        raise ValueError(f"image of {w} x {h}")
    size = h * (w * c + 1)
    raw = zlib.decompressobj().decompress(b"".join(packed), size)
    if len(raw) != size:
        raise ValueError("too few samples")
    if head[3] != 3:
        palette = None
    elif palette is None:
        palette = np.zeros((0, 3), np.uint8)
    return (h, w, c), palette, raw


def _coloured(out: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    if palette is None:
        return out
    if int(out.max()) >= len(palette):
        raise ValueError("colour outside the palette")
    return palette[out[:, :, 0]]


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels); palettes become colours. Interlaced images and other depths than 8 bits raise."""
    (h, w, c), palette, raw = _read(data)
    rows = np.frombuffer(raw, np.uint8).reshape(h, w * c + 1)
    return _coloured(_samples(rows, c).reshape(h, w, c), palette)


#: Fewest images of one shape whose rows are summed up side by side.
_FEW = 8


def _simple_many(rows: np.ndarray, c: int) -> np.ndarray:
    """Samples of k images (k, h, w * c + 1) whose rows have no filter, or those of left and above: a row of all of them at a time."""
    how, out = rows[:, :, 0], rows[:, :, 1:].copy()
    left = np.nonzero(how == 1)
    if len(left[0]):
        by_channel = out[left].reshape(len(left[0]), -1, c).transpose(0, 2, 1)
        out[left] = np.cumsum(by_channel, 2, dtype=np.uint8).transpose(0, 2, 1).reshape(len(left[0]), -1)
    up = (how == 2).astype(np.uint8)
    for y in range(1, out.shape[1]):
        out[:, y] += out[:, y - 1] * up[:, y, None]
    return out


def decode_many(files: list[bytes]) -> list[np.ndarray | Exception]:
    """Each file's image as ``decode`` has it, or why there is none; images of one shape are unfiltered at once."""
    out, shapes = [None] * len(files), defaultdict(list)
    for i, data in enumerate(files):
        try:
            shape, palette, raw = _read(data)
            shapes[shape].append((i, palette, raw))
        except Exception as e:  # any malformed file: reported, not raised
            out[i] = e
    for (h, w, c), found in shapes.items():
        rows = np.frombuffer(b"".join([raw for *_, raw in found]), np.uint8).reshape(-1, h, w * c + 1)
        at_once = len(rows) >= _FEW and rows[:, :, 0].max() < 3
        done = _simple_many(rows, c) if at_once else rows
        for (i, palette, _), px in zip(found, done):
            try:
                out[i] = _coloured((px if at_once else _samples(px, c)).reshape(h, w, c), palette)
            except Exception as e:
                out[i] = e
    return out
