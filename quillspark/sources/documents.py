"""Documents of several formats as rows: HTML, DOCX, PDF, archives, image headers.

Bytes come from Spark's ``binaryFile`` reader, so any file system that Spark reads
will do; parsing runs in Arrow batches, one file at a time, and gives rows.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

#: Least characters of text that make a document digital (fixed value).
DIGITAL_CHARS = 20
#: Bytes of results that a task holds before it hands them on.
HELD = 4 << 20


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of all files below a folder; unread columns aren't loaded."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with name and extension; contents aren't read."""
    return binary_files(spark, path, pattern).select("path", "length", extension(F.col("path")).alias("ext"))


def route(path: Column) -> Column:
    """Which extractor a file goes to."""
    e = extension(path)
    return F.when(e == ".pdf", "pdf").when(e == ".docx", "docx").otherwise("unsupported")


def text_kind(text: Column) -> Column:
    """Aggregate: digital if a document's parts have more than DIGITAL_CHARS characters, else scanned."""
    return F.when(F.sum(F.length(F.trim(F.coalesce(text, F.lit(""))))) > DIGITAL_CHARS, "digital").otherwise("scanned")


def _rows(files: DataFrame, parse: Callable, schema: str, together: bool = False) -> DataFrame:
    """``path`` and the rows that ``parse`` gives for each file's content; unreadable files give none but an ``error``.

    ``together``: parse takes all contents of a batch in turn and gives each one's rows, or its exception.
    """
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", schema)]

    def alone(contents):
        for content in contents:
            try:
                yield list(parse(content))
            except Exception as e:  # any malformed file: reported, not raised
                yield e

    def run(batches):
        for batch in batches:
            rows, size = [], 0

            def handed():
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows.clear()
                return out

            contents = (content.as_py() or b"" for content in batch.column(1))
            for path, got in zip(batch.column(0), (parse if together else alone)(contents)):
                error = None
                if isinstance(got, Exception):
                    got, error = [(None,) * len(names)], f"{type(got).__name__}: {got}"
                name = path.as_py()
                for r in got:
                    rows.append((name, *r, error))
                    size += sum([len(v) if isinstance(v, (bytes, str)) else 8 for v in r])
                    if size >= HELD:
                        yield handed()
                        size = 0
            if rows:
                yield handed()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"path string, {schema}, error string"
    arrow = to_arrow_schema(_parse_datatype_string(full))
    return files.select("path", "content").mapInArrow(run, full)


# -- HTML -------------------------------------------------------------------


class _Blocks(HTMLParser):
    """Text between block-level tags; scripts and styles left out."""

    BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 article section nav footer header aside table tr td th title body br".split())
    SKIP = frozenset(("script", "style"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.part: list[str] = []
        self.skip = 0

    def flush(self) -> None:
        t = " ".join("".join(self.part).split())
        if t:
            self.out.append(t)
        self.part = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.BLOCKS:
            self.flush()
        self.skip += tag in self.SKIP

    def handle_endtag(self, tag) -> None:
        if tag in self.BLOCKS:
            self.flush()
        self.skip -= tag in self.SKIP and self.skip > 0

    def handle_data(self, data) -> None:
        if not self.skip:
            self.part.append(data)


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, block_no, text``: text blocks of each page, flattened."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, nos, texts = [], [], []
            for i in range(batch.num_rows):
                p = _Blocks()
                p.feed(batch.column(1)[i].as_py() or "")
                p.flush()
                keys += [i] * len(p.out)
                nos += range(len(p.out))
                texts += p.out
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=[key, "block_no", "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, block_no int, text string")


def flatten_blocks(docs: DataFrame, key: str) -> DataFrame:
    """Text blocks of extraction documents (text[].blocks[]) as rows with page and place."""
    d = docs.select(key, F.explode("text").alias("p")).select(key, F.col("p.page").alias("page"), F.posexplode("p.blocks").alias("block_no", "b"))
    return d.select(key, "page", "block_no", "b.text", "b.bbox")


def flatten_tables(docs: DataFrame, key: str) -> DataFrame:
    """Cells of extraction documents' tables as rows; the first row of a table names its columns."""
    d = docs.select(key, F.explode("tables").alias("t")).select(key, "t.page", "t.table_index", "t.rows")
    d = d.withColumn("_head", F.get("rows", F.lit(0))).select(key, "page", "table_index", "_head", F.posexplode("rows").alias("row_no", "_cells")).where("row_no > 0")
    d = d.select(key, "page", "table_index", "_head", (F.col("row_no") - 1).alias("row_no"), F.posexplode("_cells").alias("col_no", "value"))
    return d.withColumn("header", F.coalesce(F.get("_head", F.col("col_no")), F.lit(""))).drop("_head")


# -- DOCX -------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter(f"{_W}t"))


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """``path, paragraph_no, text``: body paragraphs that aren't blank."""

    def parse(data):
        n = 0
        for p in _docx(data).findall(f"{_W}p"):
            if (t := _text(p)).strip():
                yield n, t
                n += 1

    return _rows(files, parse, "paragraph_no int, text string")


def docx_tables(files: DataFrame) -> DataFrame:
    """``path, table_index, rows``."""

    def parse(data):
        for i, t in enumerate(_docx(data).findall(f"{_W}tbl")):
            yield i, [["\n".join(_text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]

    return _rows(files, parse, "table_index int, rows array<array<string>>")


def docx_media(files: DataFrame) -> DataFrame:
    """``path, file, bytes`` of embedded media."""

    def parse(data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.startswith("word/media/") and not name.endswith("/"):
                    yield name.rpartition("/")[2], z.read(name)

    return _rows(files, parse, "file string, bytes binary")


# -- Archives ---------------------------------------------------------------


def zip_members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """``path, member, bytes`` of ZIP files; a member that would leave its folder fails the archive."""
    want = re.compile(pattern)

    def parse(data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                parts = m.filename.replace("\\", "/").split("/")
                if ".." in parts or parts[0] == "" or ":" in parts[0]:
                    raise ValueError(f"unsafe member {m.filename!r}")
            for m in z.infolist():
                if not m.is_dir() and want.fullmatch(m.filename):
                    yield m.filename, z.read(m)

    return _rows(files, parse, "member string, bytes binary")


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """The table, if it has one row; else raises."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"expected exactly one {what}, found {'none' if not n else 'several'}")
    return df


# -- Images -----------------------------------------------------------------


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header, natively; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(ok, number(17)), F.when(ok, number(21))


def _image_size(b: bytes) -> tuple[str, int, int]:
    be = lambda x: int.from_bytes(x, "big")
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", be(b[16:20]), be(b[20:24])
    if b[:2] == b"BM":
        return "bmp", int.from_bytes(b[18:22], "little"), abs(int.from_bytes(b[22:26], "little", signed=True))
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                raise ValueError("bad JPEG marker")
            if b[at + 1] in (0xFF, 0x01) or 0xD0 <= b[at + 1] <= 0xD8:
                at += 1 + (b[at + 1] != 0xFF)
            elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                return "jpeg", be(b[at + 7 : at + 9]), be(b[at + 5 : at + 7])
            else:
                at += 2 + be(b[at + 2 : at + 4])
        raise ValueError("JPEG without a frame")
    if b[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if b[:2] == b"II" else "big"
        n = lambda x: int.from_bytes(x, order)
        at, size = n(b[4:8]), {}
        for i in range(n(b[at : at + 2])):
            e = b[at + 2 + 12 * i : at + 14 + 12 * i]
            if n(e[:2]) in (256, 257):
                size[n(e[:2])] = n(e[8:10]) if n(e[2:4]) == 3 else n(e[8:12])
        return "tiff", size[256], size[257]
    raise ValueError("unknown image format")


def image_sizes(files: DataFrame) -> DataFrame:
    """``path, format, width, height``; ``error`` says why bytes aren't an image."""
    return _rows(files, lambda b: iter([_image_size(b)]), "format string, width int, height int")


# -- PDF --------------------------------------------------------------------

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_CONTENT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


class _Pdf:
    """The objects of simple PDF files: plain or Flate streams, simple fonts, no encryption."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.objects = {int(m[1]): m[3] for m in _OBJ.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                raw = self.stream(body)
                n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
                heads = list(map(int, raw[:first].split()[: 2 * n]))
                for i in range(n):
                    end = first + heads[2 * i + 3] if i + 1 < n else len(raw)
                    self.objects.setdefault(heads[2 * i], raw[first + heads[2 * i + 1] : end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)
        out: list[bytes] = []

        def visit(body: bytes, depth: int = 0) -> None:
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids and depth < 50:
                for n in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                    visit(self.objects.get(int(n), b""), depth + 1)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)

        if root:
            visit(root)
        return out

    def dictionary(self, body: bytes, key: bytes) -> bytes:
        """The dictionary under a key, written in place or referred to; empty where there is none."""
        m = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R|(?=<<))" % key, body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth = 0
        for t in re.finditer(rb"<<|>>", body[m.end() :]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return body[m.end() : m.end() + t.end()]
        return body[m.end() :]

    def image(self, number: int) -> tuple[str, bytes] | None:
        """Extension and bytes of an object that is an image."""
        body = self.objects.get(number, b"")
        m = _STREAM.search(body)
        head = body[: m.start()] if m else b""
        if not re.search(rb"/Subtype\s*/Image\b", head):
            return None
        ext = "jpg" if b"/DCTDecode" in head else "jp2" if b"/JPXDecode" in head else "raw"
        return ext, m[1] if ext != "raw" else zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in head else m[1]

    def named(self, page: bytes) -> list[int]:
        """Numbers of the objects among the page's resources, in their order; a page without resources has those of the nodes above."""
        for _ in range(50):
            found = self.dictionary(page, b"Resources")
            parent = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", page)
            if found or not parent:
                break
            page = self.objects.get(int(parent[1]), b"")
        return [int(n) for n in re.findall(rb"/[^\s/<>\[\]()]+\s+(\d+)\s+\d+\s+R", self.dictionary(found, b"XObject"))]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", page, re.S)
        if not m:
            return b""
        ids = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m[1] is not None else [m[2]]
        return b"\n".join(self.stream(self.objects.get(int(i), b"")) for i in ids)


def _literal(t: bytes) -> str:
    if t[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", t[1:-1]).decode()).decode("latin-1")
    s = t[1:-1].decode("latin-1")
    return re.sub(r"\\([0-7]{1,3}|.|\n)", lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else _ESCAPES.get(m[1], "" if m[1] == "\n" else m[1]), s, flags=re.S)


def _pdf_items(content: bytes) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of shown strings."""
    stack: list = []
    x = y = lx = ly = 0.0
    size, lead = 10.0, 0.0
    for m in _CONTENT.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(t)
            continue
        nums = [float(s) for s in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", s)]
        if t == b"BT":
            x = y = lx = ly = 0.0
        elif t == b"Tf" and nums:
            size = nums[-1]
        elif t == b"TL" and nums:
            lead = nums[-1]
        elif t in (b"Td", b"TD") and len(nums) >= 2:
            lx, ly = lx + nums[-2], ly + nums[-1]
            x, y = lx, ly
            lead = -nums[-1] if t == b"TD" else lead
        elif t == b"Tm" and len(nums) >= 6:
            lx, ly = nums[-2], nums[-1]
            x, y = lx, ly
        elif t in (b"T*", b"'", b'"'):
            ly -= lead
            x, y = lx, ly
        if t in (b"Tj", b"TJ", b"'", b'"'):
            text = "".join(_literal(s) for s in stack if s[:1] in b"(<")
            if text:
                yield x, y, size, text
                x += 0.5 * size * len(text)
        stack = []


def _pdf_lines(data: bytes) -> Iterator[tuple[int, float, list[tuple[float, float, str]]]]:
    """(page, y, items of the line from left to right), pages from 1, lines from the top."""
    pdf = _Pdf(data)
    for no, page in enumerate(pdf.pages(), 1):
        lines: dict[int, list] = {}
        for x, y, size, text in _pdf_items(pdf.content(page)):
            lines.setdefault(round(y), []).append((x, size, text))
        for y in sorted(lines, reverse=True):
            yield no, float(y), sorted(lines[y])


def pdf_blocks(files: DataFrame) -> DataFrame:
    """``path, page, block_no, text, bbox``: a block for each run of lines without a gap of two line heights."""

    def parse(data):
        page_of, no, last, block = 0, 0, None, []

        def close():
            xs = [i[0] for _, items in block for i in items]
            ends = [i[0] + 0.5 * i[1] * len(i[2]) for _, items in block for i in items]
            text = "\n".join(" ".join(i[2] for i in items) for _, items in block)
            return page_of, no, text, [min(xs), block[-1][0], max(ends), block[0][0] + block[0][1][0][1]]

        for page, y, items in _pdf_lines(data):
            if block and (page != page_of or last - y > 2 * items[0][1]):
                yield close()
                block, no = [], no + 1 if page == page_of else 0
            page_of, last = page, y
            block.append((y, items))
        if block:
            yield close()

    return _rows(files, parse, "page int, block_no int, text string, bbox array<double>")


def pdf_tables(files: DataFrame) -> DataFrame:
    """``path, page, table_index, rows``: runs of two lines or more whose items start at the same places."""

    def parse(data):
        run: list = []
        index: dict[int, int] = {}

        def close():
            if len(run) > 1:
                page = run[0][0]
                index[page] = index.get(page, -1) + 1
                return page, index[page], [[i[2] for i in items] for _, _, items in run]
            return None

        key = lambda line: (line[0], tuple(round(i[0]) for i in line[2]))
        for line in _pdf_lines(data):
            if run and (len(line[2]) < 2 or key(line) != key(run[0])):
                if (t := close()) is not None:
                    yield t
                run = []
            if len(line[2]) > 1:
                run.append(line)
        if (t := close()) is not None:
            yield t

    return _rows(files, parse, "page int, table_index int, rows array<array<string>>")


def pdf_images(files: DataFrame) -> DataFrame:
    """``path, page, img_index, ext, bytes``: JPEG and JPEG 2000 files as they are, raw samples of others.

    Pages count from 1, the images that a page names from 0; an image that several pages
    name comes once for each, and those that none names come last, without a page.
    """

    def parse(data):
        pdf = _Pdf(data)
        used: set[int] = set()
        for page, body in enumerate(pdf.pages(), 1):
            found = [(i, image) for i in pdf.named(body) if (image := pdf.image(i))]
            used.update(i for i, _ in found)
            yield from ((page, n, *image) for n, (_, image) in enumerate(found))
        rest = [pdf.image(i) for i in pdf.objects if i not in used]
        yield from ((None, n, *image) for n, image in enumerate(filter(None, rest)))

    return _rows(files, parse, "page int, img_index int, ext string, bytes binary")
