import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 4609, 200_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    padded = m.pad(raw)
    assert len(padded) % 576 == 0 and len(padded) > 0 and padded.startswith(raw) and set(padded[n:]) <= {255}
    stored = m.mux(padded)
    found = m.parse(stored)
    assert m.payload(stored, found) == padded
    assert [p[1] for p in found.packets] == [12 * i for i in range(len(padded) // 576)]
    starts = set(found.clusters)
    assert len(found.cues) == len(starts) and all(c[2] in starts for c in found.cues)


def test_variable_length_integers():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**28, 2**49):
        v, at, width = m.read_vint(m.vint(n), 0)
        assert (v, at) == (n, width)
    assert m.read_vint(b"\xff", 0)[0] == -1 and m.read_vint(b"\x01" + b"\xff" * 7, 0)[0] == -1


@pytest.mark.parametrize("lacing", [m.XIPH, m.EBML_LACING])
def test_lacing_of_any_sizes(lacing):
    rng = random.Random(lacing)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 254, 255, 256, 510, 5000, 70000]) for _ in range(rng.randint(2, 9))]
        head = m.lace_header(sizes, lacing)
        got, at = m.lace_sizes(head + bytes(sum(sizes)), 0, len(head) + sum(sizes), lacing)
        assert got == sizes and at == len(head)


def test_unknown_sizes_and_block_groups():
    block = b"\x81" + struct.pack(">hB", 5, 0) + b"data"
    cluster = b"\x1f\x43\xb6\x75\xff" + m.uint(m.TIMESTAMP, 100) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block))
    data = m.element(m.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster + cluster
    found = m.parse(data)
    assert [(p[0], p[1], p[2], bytes(data[p[7] : p[7] + p[8]])) for p in found.packets] == [(1, 105, 0, b"data"), (1, 105, 1, b"data")]


@pytest.mark.parametrize("data", [b"", b"\x00", b"junk that is no EBML", m.mux(m.pad(b"x"))[:-40], m.element(m.EBML, b"")])
def test_malformed(data):
    with pytest.raises(m.MalformedMatroska):
        m.parse(data)


def test_packet_table(spark):
    good = m.mux(m.pad(b"q" * 2000))
    rows = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"bad")), ("c", None)], "k string, content binary")
    got = m.packets(rows, "k", "content").collect()
    assert [r.k for r in got] == ["a"] * 4 + ["b"]
    assert b"".join(good[r.offset : r.offset + r.length] for r in got[:4]) == m.pad(b"q" * 2000) and got[4].offset is None


def test_stored_texts(spark, corner_docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in m.stored_texts(corner_docs.withColumn("packets", F.lit(1))).collect()}
    for r in corner_docs.collect():
        raw = (r.text or "").encode()
        g = got[r.doc_id, len(raw)]
        assert g.payload_bytes == len(m.pad(raw)) and g.payload_sha256 == hashlib.sha256(m.pad(raw)).hexdigest()
        assert g.tail_crc32 == zlib.crc32(m.pad(raw)[-32:]) and g.media_bytes > g.payload_bytes
    assert m.stored_texts(corner_docs).count() == corner_docs.count() and m.stored_texts(no_docs).count() == 0
