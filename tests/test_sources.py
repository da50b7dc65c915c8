"""Readers, extractors and writers on small files."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.sources import documents as D
from quillspark.sources import manifests as M
from quillspark.streaming import incremental


def test_manifest_is_all_strings(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes('﻿image,text,extra\na.png,NA,\nb.png,13113,"say ""hi""\nthere"\n'.encode())
    got = [tuple(r) for r in M.read_manifest(spark, str(tmp_path / "m.csv")).collect()]
    assert got == [("a.png", "NA", ""), ("b.png", "13113", 'say "hi"\nthere')]
    assert M.typed(M.read_manifest(spark, str(tmp_path / "m.csv")), {"text": "int"}).collect()[0].text is None


def test_annotation_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a.png ok some label\nb.png ok\n\n")
    lines = M.read_lines(spark, str(tmp_path / "a.txt"))
    assert [(r.image, r.status, r.label, r.error) for r in M.path_status_label(lines).collect()] == [("a.png", "ok", "some label", None), (None, None, None, "malformed_line")]
    assert [(r.image, r.label) for r in M.path_label(lines).collect()] == [("a.png", "ok some label"), ("b.png", "ok")]
    (tmp_path / "c.txt").write_text("x.png,a,b\nnone\n\"d\\e.png\"\ttab label\n")
    lines = M.read_lines(spark, str(tmp_path / "c.txt"))
    assert [(r.image, r.label) for r in M.image_comma_label(lines).collect()][0] == ("x.png", "a,b")
    assert ("d/e.png", "tab label") in [(r.image, r.label) for r in M.tab_or_space_label(lines).collect()]


def test_text_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿سلام".encode())
    (tmp_path / "w.txt").write_bytes("سلام".encode("cp1256"))
    assert {r.text for r in M.read_texts(spark, str(tmp_path)).collect()} == {"سلام"}


def test_resolve_paths(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/e/b.png",), ("f/b.png",), ("g/C.png",)], "path string")
    rows = spark.createDataFrame([("d/a.png",), ("e/b.png",), ("b.png",), ("x/c.PNG",), ("none.png",), ("./d\\a.png",)], "image string")
    got = {r.image: r.resolved for r in M.resolve_paths(rows, files).collect()}
    assert got == {"d/a.png": "d/a.png", "e/b.png": "d/e/b.png", "b.png": "d/e/b.png", "x/c.PNG": "g/C.png", "none.png": None, "./d\\a.png": "d/a.png"}


def as_files(spark, **contents):
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in contents.items()], "path string, length bigint, content binary")


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9) + b"\x08\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 6) + b"\x01\x01\x11\0"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -4)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12)
    files = as_files(spark, png=png, jpeg=jpeg, bmp=bmp, tiff=tiff, bad=b"xx")
    got = {r.path: (r.format, r.width, r.height) for r in D.image_sizes(files).collect()}
    assert got == {"png": ("png", 7, 9), "jpeg": ("jpeg", 6, 5), "bmp": ("bmp", 3, 4), "tiff": ("tiff", 11, 12), "bad": (None, None, None)}
    w, h = D.png_size(F.col("content"))
    assert {r.path: (r.w, r.h) for r in files.select("path", w.alias("w"), h.alias("h")).collect()}["png"] == (7, 9)


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>h2</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/media/i.png", b"123")
    return out.getvalue()


def test_docx(spark):
    files = as_files(spark, a=docx(), b=b"junk")
    assert [(r.path, r.text, r.error is None) for r in D.docx_paragraphs(files).orderBy("path").collect()] == [("a", "One two", True), ("b", None, False)]
    assert D.docx_tables(files).where("error is null").head().rows == [["h1", "h2"], ["a", ""]]
    assert bytes(D.docx_media(files).where("error is null").head().bytes) == b"123"
    docs = D.docx_tables(files).where("error is null").select("path", F.array(F.struct(F.lit(1).alias("page"), "table_index", "rows")).alias("tables"))
    assert [(r.header, r.value) for r in D.flatten_tables(docs, "path").orderBy("col_no").collect()] == [("h1", "a"), ("h2", "")]


def pdf():
    content = zlib.compress(b"BT /F1 10 Tf 50 700 Td (Hello \\(world\\)) Tj 0 -12 Td [(Sec) -20 (ond)] TJ ET BT /F1 10 Tf 1 0 0 1 50 500 Tm (a) Tj ET BT 1 0 0 1 150 500 Tm (b) Tj ET BT 1 0 0 1 50 488 Tm (c) Tj ET BT 1 0 0 1 150 488 Tm (d) Tj ET")
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Subtype /Image /Filter /DCTDecode >>\nstream\n\xff\xd8x\nendstream"]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, o) for i, o in enumerate(objs, 1))


def test_pdf(spark):
    files = as_files(spark, a=pdf(), b=b"no pdf")
    blocks = D.pdf_blocks(files).where("error is null").orderBy("block_no").collect()
    assert [(r.page, r.text) for r in blocks] == [(1, "Hello (world)\nSec ond".replace("Sec ond", "Second")), (1, "a b\nc d")]
    assert D.pdf_tables(files).where("error is null").head().rows == [["a", "b"], ["c", "d"]]
    assert bytes(D.pdf_images(files).where("error is null").head().bytes) == b"\xff\xd8x"
    assert D.pdf_blocks(files).where("error is not null").count() == 1
    kinds = D.pdf_blocks(files).groupBy("path").agg(D.text_kind(F.col("text")).alias("k")).collect()
    assert {r.path: r.k for r in kinds} == {"a": "digital", "b": "scanned"}


def test_zip(spark):
    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return out.getvalue()

    files = as_files(spark, good=archive("a/x.txt", "b.csv"), evil=archive("ok.txt", "../up.txt"))
    got = D.zip_members(files, r".*\.txt").collect()
    assert [(r.path, r.member) for r in got if r.error is None] == [("good", "a/x.txt")]
    assert "unsafe member" in next(r.error for r in got if r.path == "evil")
    with pytest.raises(ValueError, match="several"):
        D.exactly_one(files, "archive")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", "train"), ("b", "y", "val")], "image string, text string, split string")
    sinks.write_csv(d, str(tmp_path / "c"), ["text", "image", "missing"])
    back = M.read_manifest(spark, str(tmp_path / "c"))
    assert back.columns == ["text", "image", "missing"] and back.count() == 2
    sinks.write_by(d, str(tmp_path / "p"), "split")
    assert {p.name for p in (tmp_path / "p").glob("split=*")} == {"split=train", "split=val"}
    u = sinks.union_of_keys([d.select("image"), d.select("text", "image")])
    assert u.columns == ["image", "text"] and u.count() == 4
    sinks.write_report(d.groupBy("split").count(), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1
    assert sinks.packed(d.union(d), "text").count() == 2
    listed = D.listing(spark, str(tmp_path / "p"), "*.parquet")
    assert {r.ext for r in listed.collect()} == {".parquet"}


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:00:01", 2), ("m", "2024-01-01 00:00:02", 3)], "key string, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = incremental.snapshots(incremental.keep_first_stream(stream, ["key"], "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k", "m"]


def _pdf_of(objects):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items())


def test_pdf_images_have_the_pages_that_name_them(spark):
    """Resources in place, referred to, and of the node above; one image on two pages; one on none; pages inside an object stream."""
    image = lambda x, f: b"<< /Type /XObject /Subtype /Image %s >>\nstream\n%s\nendstream" % (f, x)
    packed = {
        3: b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /B 11 0 R /A 10 0 R /F 13 0 R >> >> >>",
        4: b"<< /Type /Page /Parent 2 0 R >>",
        5: b"<< /Type /Page /Parent 2 0 R /Resources 7 0 R >>",
        7: b"<< /XObject 8 0 R >>",
        8: b"<< /Z 12 0 R >>",
    }
    heads, body = [], b""
    for n, b in packed.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += b + b" "
    first = b" ".join(heads) + b" "
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /Resources << /XObject << /A 10 0 R >> >> >>",
        6: b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), len(first), zlib.compress(first + body)),
        10: image(b"\xff\xd8x", b"/Filter /DCTDecode"),
        11: image(zlib.compress(b"raw"), b"/Filter /FlateDecode"),
        12: image(b"jp", b"/Filter /JPXDecode"),
        13: b"<< /Subtype /Form >>\nstream\nq Q\nendstream",
        14: image(b"unnamed", b""),
    }
    d = spark.createDataFrame([("p", _pdf_of(objects))], "path string, content binary")
    got = [(r.page, r.img_index, r.ext, bytes(r.bytes)) for r in D.pdf_images(d).collect()]
    assert got == [(1, 0, "raw", b"raw"), (1, 1, "jpg", b"\xff\xd8x"), (2, 0, "jpg", b"\xff\xd8x"), (3, 0, "jp2", b"jp"), (None, 0, "raw", b"unnamed")]
