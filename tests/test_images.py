"""Images: PNG both ways, steps against plain versions, lines of drawn pages."""

import itertools
import struct
import zlib

import numpy as np
import pytest

from quillspark.functions import png
from quillspark.operators import images
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)


def picture(h, w, c=1):
    return RNG.integers(0, 256, (h, w, c), dtype=np.uint8)


@pytest.mark.parametrize("h, w, c", [(1, 1, 1), (1, 7, 3), (9, 1, 1), (33, 20, 3), (64, 64, 1)])
def test_png_round_trip(h, w, c):
    px = picture(h, w, c)
    assert (png.decode(png.encode(px)) == px).all()
    smooth = np.cumsum(np.ones_like(px), 0, dtype=np.uint8)
    assert (png.decode(png.encode(smooth)) == smooth).all()


def plain_png(px, filters, colour, palette=None):
    """A PNG whose rows use the given filters in turn, byte by byte as the format says."""
    h, w, c = px.shape
    rows, flat = b"", px.reshape(h, w * c).astype(int)
    for y in range(h):
        f = filters[y % len(filters)]
        line = []
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            p = a + b - d
            pa, pb, pd = abs(p - a), abs(p - b), abs(p - d)
            paeth = a if pa <= pb and pa <= pd else b if pb <= pd else d
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth, 0, 0, 0)[f]) % 256)
        rows += bytes([f, *line])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = zlib.compress(rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, c", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_are_read(colour, c):
    px = picture(11, 6, c)
    assert (png.decode(plain_png(px, [4, 3, 2, 1, 0], colour)) == px).all()


def test_palette_and_torn_files():
    px = RNG.integers(0, 4, (5, 5, 1), dtype=np.uint8)
    colours = bytes(range(12))
    assert (png.decode(plain_png(px, [0], 3, colours)) == np.frombuffer(colours, np.uint8).reshape(4, 3)[px[:, :, 0]]).all()
    whole = png.encode(px)
    for bad in (b"", b"GIF89a", whole[:40], whole[:45] + b"x" + whole[46:], plain_png(px + 9, [0], 3, colours), plain_png(px, [7], 0)):
        with pytest.raises(ValueError):
            png.decode(bad)


def plain_contrast(g, clip, tiles):
    """Pixel by pixel, with loops."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    back = lambda i, n: 0 if n == 1 else (i % (2 * n - 2) if i % (2 * n - 2) < n else 2 * n - 2 - i % (2 * n - 2))
    tables = {}
    for a, b in itertools.product(range(tiles), range(tiles)):
        hist = [0] * 256
        for y, x in itertools.product(range(a * th, a * th + th), range(b * tw, b * tw + tw)):
            hist[g[back(y, h), back(x, w)]] += 1
        limit = max(1, int(clip * th * tw / 256))
        over = sum(max(0, n - limit) for n in hist)
        hist = [min(n, limit) + over // 256 for n in hist]
        rest = over % 256
        if rest:
            for level in range(0, 256, max(1, 256 // rest)):
                if rest:
                    hist[level] += 1
                    rest -= 1
        total, table = 0, []
        for n in hist:
            total += n
            table.append(min(255, round(total * (255.0 / (th * tw)))))
        tables[a, b] = table
    out = np.zeros((h, w), np.uint8)
    edge = lambda i: min(max(i, 0), tiles - 1)
    for y, x in itertools.product(range(h), range(w)):
        fy, fx = y / th - 0.5, x / tw - 0.5
        a, b = int(np.floor(fy)), int(np.floor(fx))
        fy, fx = fy - a, fx - b
        v = lambda i, j: tables[edge(i), edge(j)][g[y, x]]
        top, low = v(a, b) * (1 - fx) + v(a, b + 1) * fx, v(a + 1, b) * (1 - fx) + v(a + 1, b + 1) * fx
        out[y, x] = round(top * (1 - fy) + low * fy)
    return out


@pytest.mark.parametrize("h, w", [(1, 1), (1, 64), (19, 64), (40, 33)])
def test_local_contrast_against_plain_version(h, w):
    g = (picture(h, w)[:, :, 0] // 3 + 40).astype(np.uint8)
    assert (images.local_contrast(g[:, :, None], 2.0, 8)[:, :, 0] == plain_contrast(g, 2.0, 8)).all()


def test_resize_keeps_flat_images_and_limits_the_width():
    flat = np.full((10, 400, 1), 77, np.uint8)
    got = images.resize(flat, 64, 1024)
    assert got.shape == (64, 1024, 1) and (got == 77).all()
    assert images.resize(flat[:, :1], 5, 9).shape == (5, 1, 1)
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 8, 0)
    assert (np.diff(images.resize(ramp, 4, 500)[0, :, 0].astype(int)) > 0).all()


def test_blue_ink_and_grey():
    px = np.array([[[10, 10, 200], [90, 90, 90], [0, 0, 12]]], np.uint8)
    assert images.blue_ink(px)[0, :, 0].tolist() == [0, 255, 213]
    assert images.grey(px)[0, :, 0].tolist() == [32, 90, 1]


def flooded(mask):
    """Boxes and areas by visiting pixels."""
    todo, out = set(zip(*map(np.ndarray.tolist, np.nonzero(mask)))), []
    while todo:
        edge, part = [todo.pop()], []
        while edge:
            y, x = edge.pop()
            part.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= near
            edge += near
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part), sum(ys)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.4, 0.6, 1.0, 0.0])
def test_components_against_flooding(share):
    for _ in range(6):
        mask = RNG.random((17, 23)) < share
        assert sorted(map(tuple, images.components(mask).tolist())) == flooded(mask)


def test_groups_on_a_line_against_all_cuts():
    for n in (1, 3, 6, 9):
        x = RNG.integers(0, 30, n).astype(float)
        for k in range(1, n + 1):
            of = images.groups_on_a_line(x, k)
            cost = sum(((x[of == g] - x[of == g].mean()) ** 2).sum() for g in range(k))
            s = np.sort(x)
            best = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(s, cuts)) for cuts in itertools.combinations(range(1, n), k - 1))
            assert sorted(set(of.tolist())) == list(range(k)) and cost == pytest.approx(best, abs=1e-6)


def test_pages_without_lines():
    blank = np.full((40, 80, 1), 255, np.uint8)
    assert images.page_lines(blank, 2) == ([], "too_few_components:0<2")
    assert images.page_lines(blank, 0) == ([], "no_text_lines")
    level = blank.copy()
    level[10:16, 5:15] = level[10:16, 30:40] = 0
    assert images.page_lines(level, 2) == ([], "invalid_reading_order")


def test_bad_rows_have_errors_and_steps_are_checked(spark):
    d = spark.createDataFrame([("a", b"no"), ("b", None), ("c", png.encode(picture(20, 30)))], "path string, content binary")
    got = {r.path: r for r in images.prepared(d, ("square",), ("grey",)).collect()}
    assert got["a"].error and got["b"].error and got["c"].error is None and got["c"].width == got["c"].height == 34
    assert {r.path: r.error is None for r in images.decoded(d).collect()} == {"a": False, "b": False, "c": True}
    from pyspark.sql import functions as F

    lines = images.line_crops(d.withColumn("expected", F.lit(None).cast("int"))).collect()
    assert {r.path: r.status for r in lines} == {"a": None, "b": None, "c": "no_text_lines"}
    with pytest.raises(ValueError):
        images.prepared(d, ("sharpen",))
    short = spark.createDataFrame([(2, 2, 1, b"abc"), (0, 0, 1, b""), (3, 1, 1, None)], "width int, height int, channels int, pixels binary")
    assert short.select(images.encode(short).alias("p")).where("p IS NOT NULL").count() == 0


def test_local_contrast_query(spark):
    import hashlib

    texts = {r.doc_id: (r.text or "").encode() for r in registry.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.pixels_sha256 for r in registry.QUERIES["img01_local_contrast"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key in sorted(texts, key=lambda k: len(texts[k]))[:12]:
        b = texts[key].ljust(max(1, -(-len(texts[key]) // 64)) * 64)
        g = np.frombuffer(b, np.uint8).reshape(-1, 64)
        assert got[key] == hashlib.sha256(plain_contrast(g, 2.0, 8).tobytes()).hexdigest()


def test_rows_without_average_or_paeth_are_taken_at_once():
    """Rows of no filter, left and above in any order, against the step from row to row."""
    rng = np.random.default_rng(1)
    for c in (1, 2, 3, 4):
        for h in (1, 2, 9, 40):
            rows = np.concatenate([rng.integers(0, 3, (h, 1), dtype=np.uint8), rng.integers(0, 256, (h, 7 * c), dtype=np.uint8)], 1)
            assert np.array_equal(png._simple(rows, c), png._unfiltered(rows, c))


def test_files_share_batches(spark):
    """Results leave a task by size, not one batch a file; a torn file among them is an error of its own."""
    from quillspark.sources import documents

    files = spark.createDataFrame([(str(i), b"PK" if i == 7 else png.encode(np.full((2, 3), i, np.uint8))) for i in range(50)], "path string, content binary").coalesce(1)
    got = images.decoded(files)
    sizes = got.mapInArrow(lambda batches: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert [r.n for r in sizes] == [50]
    rows = {int(r.path): r for r in got.collect()}
    assert rows[7].error and rows[7].width is None and all(rows[i].error is None and bytes(rows[i].pixels) == bytes([i]) * 6 for i in range(50) if i != 7)
    assert [r.n for r in got.where("error IS NULL").select(images.levels(got.pixels).alias("n")).collect()] == [6 * i for i in range(50) if i != 7]


def test_images_of_a_small_table_are_dealt_to_tasks(spark):
    """One split holds all parts and customers; the work on them must not stay in its task."""
    from quillspark.plans import formats

    for files in (formats._pdfs(spark, SF), __import__("quillspark.plans.images", fromlist=["_boxes"])._boxes(spark, SF)):
        assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def drawn(n, c=1):
    """A page of n lines of two words with a rule below each."""
    px = np.full((16 * n, 96, c), 230, np.uint8)
    for y in range(0, 16 * n, 16):
        px[y + 5 : y + 11, 10 : int(RNG.integers(20, 40))] = px[y + 5 : y + 11, 48 : int(RNG.integers(55, 90))] = 40
        px[y + 14] = 40
    return px


def test_pages_of_one_size_are_cut_at_once(monkeypatch):
    """The steps run once a size, not once a page, and give each page what it has alone; a torn file is its own error."""
    pages = [drawn(3 + i % 2, (1, 3)[i % 4 == 3]) for i in range(60)] + [picture(48, 96) for _ in range(3)]
    expected = [int(RNG.integers(0, 9)) for _ in pages]
    alone = [images.page_lines(px, n) for px, n in zip(pages, expected)]
    files = [n.to_bytes(4, "big") + png.encode(px) for px, n in zip(pages, expected)]
    files[5] = files[5][:60]
    calls, runs = [], images.runs
    monkeypatch.setattr(images, "runs", lambda mask: calls.append(1) or runs(mask))
    got = list(images.cut(iter(files)))
    assert len(calls) == len({px.shape for px in pages}) == 3
    assert isinstance(got.pop(5), ValueError) and {status[:3] for _, status in alone} >= {"ok", "too", "no_"}
    for px, (boxes, status), rows in zip(pages[:5] + pages[6:], alone[:5] + alone[6:], got, strict=True):
        assert [(r[0], r[1:5], r[5]) for r in rows] == ([(i, b, status) for i, b in enumerate(boxes, 1)] or [(None, (None,) * 4, status)])
        assert all((png.decode(r[6]) == px[r[2] : r[4], r[1] : r[3]]).all() for r in rows if r[0])


def test_many_images_have_the_bytes_of_one():
    """Of any shapes and filters, equal ones among them; what can't be read has its error."""
    px = [picture(*RNG.choice([(9, 7, 1), (9, 7, 3), (30, 4, 1), (1, 1, 1)]).tolist()) // int(RNG.integers(1, 90)) for _ in range(80)]
    px += px[:9]
    files = png.encode_many(px)
    assert files == [png.encode(p) for p in px] and all((a == b).all() for a, b in zip(png.decode_many(files), px, strict=True))
    odd = [plain_png(picture(11, 6, c), f, colour) for f in ([1], [2], [0, 2, 1], [4, 3], [7]) for colour, c in ((0, 1), (2, 3), (4, 2), (6, 4)) for _ in range(9)]
    odd += [b"", files[0][:40], plain_png(px[0] % 4, [0], 3, bytes(12)), plain_png(px[0] % 4 + 9, [0], 3, bytes(12))]
    for data, got in zip(odd, png.decode_many(odd), strict=True):
        try:
            assert (png.decode(data) == got).all()
        except ValueError as e:
            assert repr(got) == repr(e)
    with pytest.raises(ValueError):
        png.encode_many([px[0], np.zeros((2, 2, 2), np.uint8)])


def test_orders_are_dealt_to_tasks(spark):
    """Few splits hold the items and their shuffle is small; the pages drawn from them must not stay in few tasks."""
    assert registry.QUERIES["img02_line_boxes"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
