"""Matroska: store samples as an audio track and parse files into packet tables.

``mux`` writes 8-bit PCM mono samples as EBML: header, segment, info, tracks,
clusters of laced SimpleBlocks (Xiph, EBML and fixed-size lacing in turn) and cues.
``parse`` reads any Matroska bytes with these elements, known or unknown sizes,
BlockGroups too, into one row for each packet with timestamp, track and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the Matroska and EBML formats.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples in a packet, packets in a block, blocks in a cluster, milliseconds of a packet.
FRAME, LACE, BLOCKS, FRAME_MS = 576, 8, 32, 12
PAD = b"\xff"

PACKET_SCHEMA = "track int, timestamp_ms bigint, cluster int, block int, lace int, lacing int, keyframe boolean, offset bigint, length bigint"


class MalformedMatroska(ValueError):
    """The bytes aren't well-formed EBML, or an element breaks its bounds."""


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all-ones values stay reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes, width: int = 0) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body), width) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_id(buf, at: int) -> tuple[int, int]:
    first = buf[at] if at < len(buf) else 0
    width = 9 - first.bit_length()
    if not 1 <= width <= 4 or at + width > len(buf):
        raise MalformedMatroska(f"bad element id at byte {at}")
    return int.from_bytes(buf[at : at + width], "big"), at + width


def read_vint(buf, at: int) -> tuple[int, int, int]:
    """(value, place after it, width); -1 is the unknown size."""
    first = buf[at] if at < len(buf) else 0
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(buf):
        raise MalformedMatroska(f"bad size at byte {at}")
    n = int.from_bytes(buf[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width, width


#: Elements that end an unknown-sized one: those of its own level or above.
_ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, CLUSTER, CUES, INFO, TRACKS}}


def elements(buf, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of the children in [at, end)."""
    while at < end:
        start = at
        ident, at = read_id(buf, at)
        size, at, _ = read_vint(buf, at)
        if size < 0:
            if ident not in _ENDS:
                raise MalformedMatroska(f"unknown size of element {ident:#x}")
            stop = at
            while stop < end:
                nxt, body = read_id(buf, stop)
                if nxt in _ENDS[ident]:
                    break
                n, body, _ = read_vint(buf, body)
                if n < 0:  # a nested element of unknown size ends where its children do
                    n = max((x[3] for x in elements(buf, stop, end)), default=body) - body if nxt in _ENDS else 0
                stop = body + n
            size = stop - at
        if at + size > end:
            raise MalformedMatroska(f"element {ident:#x} at byte {start} runs past its parent")
        yield ident, start, at, at + size
        at += size


def lace_header(sizes: list[int], lacing: int) -> bytes:
    """Frame count and sizes as they precede the frames of a laced block."""
    out = bytes([len(sizes) - 1])
    if lacing == XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif lacing == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out += vint(d + (1 << 7 * width - 1) - 1, width)
    return out


def lace_sizes(buf, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first one begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MalformedMatroska("laced block without a frame count")
    n, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise MalformedMatroska("fixed lacing doesn't divide the block")
        return [(end - at) // n] * n, at
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise MalformedMatroska("Xiph lace sizes run past the block")
                size, at = size + buf[at], at + 1
                if buf[at - 1] != 255:
                    break
        else:
            v, at, width = read_vint(buf, at)
            size = v if i == 0 else sizes[-1] + v - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MalformedMatroska("lace sizes exceed the block")
    return [*sizes, last], at


def pad(payload: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of a packet."""
    return payload + PAD * (FRAME - len(payload) % FRAME if len(payload) % FRAME or not payload else 0)


def mux(samples: bytes) -> bytes:
    """A Matroska file whose only track holds these samples as 8-bit PCM."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    n = -(-len(samples) // FRAME)
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(n * FRAME_MS))) + element(MUXING_APP, b"quillspark") + element(WRITING_APP, b"quillspark"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 48000.0)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per = LACE * BLOCKS
    for c in range(0, n, per):
        body = [uint(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(n, c + per), LACE):
            frames = samples[b * FRAME : (b + LACE) * FRAME]
            sizes = [min(FRAME, len(frames) - i) for i in range(0, len(frames), FRAME)]
            lacing = (XIPH, EBML_LACING, FIXED)[(b // LACE) % 3] if len(sizes) > 1 else NO_LACING
            if lacing == FIXED and len(frames) % FRAME:
                lacing = XIPH
            top = b"\x81" + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | lacing << 1)
            body.append(element(SIMPLE_BLOCK, top + (lace_header(sizes, lacing) if lacing else b"") + frames))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


class Parsed:
    """Packets (rows of PACKET_SCHEMA), tracks {number: codec} and cues [(ms, track, position)]."""

    def __init__(self) -> None:
        self.packets: list[tuple] = []
        self.tracks: dict[int, str] = {}
        self.cues: list[tuple[int, int, int]] = []
        self.clusters: list[int] = []
        self.durations: dict[int, int] = {}
        self.scale, self.segment = 1_000_000, 0


def _number(buf, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def _block(out: Parsed, buf, a: int, b: int, base: int, cluster: int, block: int, simple: bool) -> None:
    track, at, _ = read_vint(buf, a)
    if at + 3 > b:
        raise MalformedMatroska("block without a header")
    shift, flags = struct.unpack(">hB", buf[at : at + 3])
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(buf, at + 3, b, lacing)
    scale, step = out.scale, out.durations.get(track, 0)
    ticks = (base + shift) * scale
    for i, n in enumerate(sizes):
        out.packets.append((track, (ticks + i * step) // 1_000_000, cluster, block, i, lacing, bool(flags & 0x80) if simple else None, at, n))
        at += n


def parse(data) -> Parsed:
    """Read a file's packets, tracks and cues; raises MalformedMatroska."""
    buf, out = memoryview(data).cast("B"), Parsed()
    seen = False
    for ident, _, a, b in elements(buf, 0, len(buf)):
        if ident != SEGMENT:
            continue
        out.segment, seen = a, True
        for kind, start, c, d in elements(buf, a, b):
            if kind == INFO:
                out.scale = next((_number(buf, x, y) for k, _, x, y in elements(buf, c, d) if k == TIMESTAMP_SCALE), out.scale)
            elif kind == TRACKS:
                for k, _, x, y in elements(buf, c, d):
                    if k == TRACK_ENTRY:
                        f = {i: (p, q) for i, _, p, q in elements(buf, x, y)}
                        number = _number(buf, *f[TRACK_NUMBER]) if TRACK_NUMBER in f else 0
                        out.tracks[number] = bytes(buf[slice(*f[CODEC_ID])]).decode("ascii", "replace") if CODEC_ID in f else ""
                        out.durations[number] = _number(buf, *f[DEFAULT_DURATION]) if DEFAULT_DURATION in f else 0
            elif kind == CLUSTER:
                n, base, block = len(out.clusters), 0, 0
                out.clusters.append(start - a)
                for k, _, x, y in elements(buf, c, d):
                    if k == TIMESTAMP:
                        base = _number(buf, x, y)
                    elif k == SIMPLE_BLOCK:
                        _block(out, buf, x, y, base, n, block, True)
                        block += 1
                    elif k == BLOCK_GROUP:
                        for i, _, p, q in elements(buf, x, y):
                            if i == BLOCK:
                                _block(out, buf, p, q, base, n, block, False)
                                block += 1
            elif kind == CUES:
                for k, _, x, y in elements(buf, c, d):
                    if k == CUE_POINT:
                        time, where = 0, []
                        for i, _, p, q in elements(buf, x, y):
                            if i == CUE_TIME:
                                time = _number(buf, p, q)
                            elif i == CUE_TRACK_POSITIONS:
                                where.append({j: _number(buf, r, s) for j, _, r, s in elements(buf, p, q)})
                        out.cues += [(time * out.scale // 1_000_000, w.get(CUE_TRACK, 0), w.get(CUE_CLUSTER_POSITION, -1)) for w in where]
    if not seen:
        raise MalformedMatroska("no segment")
    return out


def payload(data, found: Parsed, track: int = 1) -> bytes:
    """The bytes of one track's packets, in file order."""
    buf = memoryview(data).cast("B")
    return b"".join(buf[p[7] : p[7] + p[8]] for p in found.packets if p[0] == track)


def packets(df: DataFrame, key: str, content: str) -> DataFrame:
    """The packet table of a column of Matroska bytes: ``key`` and PACKET_SCHEMA.

    A null gives no rows. Malformed bytes give one row with all packet columns null.
    """
    kind = df.schema[key].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not data.is_valid:
                    continue
                try:
                    found = parse(data.as_buffer()).packets
                except MalformedMatroska:
                    found = [(None,) * 9]
                for i in range(0, len(found), 65536):
                    cols = list(zip(*found[i : i + 65536]))
                    if cols:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(cols[0]), key_type), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, *names])

    names = [x.split()[0] for x in PACKET_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[key].dataType)
    return df.select(key, content).mapInArrow(rows, f"`{key}` {kind}, {PACKET_SCHEMA}")


def _digest(text: bytes, stored: bytes) -> tuple:
    found = parse(stored)
    back = payload(stored, found)
    at = set(found.clusters)
    laces = [0] * 4
    for p in found.packets:
        laces[p[5]] += 1
    cued = sum(c[2] in at for c in found.cues)
    last = found.packets[-1][1] if found.packets else -1
    feature = f"tracks={len(found.tracks)} codec={found.tracks.get(1, '')} clusters={len(found.clusters)} packets={len(found.packets)} plain={laces[0]} xiph={laces[1]} fixed={laces[2]} ebml={laces[3]} cues={cued}/{len(found.cues)} last_ms={last} first_byte={found.packets[0][7] if found.packets else -1} mean_sample={sum(back) // max(1, len(back))}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


DIGEST_SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as Matroska, parse the stored bytes, and digest both.

    A null text is empty, an empty one a single packet of padding. Equal texts give
    equal values; rows that repeat give repeated rows; other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                raw = b"" if not t.is_valid else t.as_buffer().to_pybytes()
                rows.append(_digest(raw, mux(pad(raw))))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [key, *(x.split()[0] for x in DIGEST_SCHEMA.split(", "))]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {DIGEST_SCHEMA}")
