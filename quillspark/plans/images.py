"""Images drawn from the driver's tables: stored, prepared, cut into lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import images
from .registry import query, spread, table

#: Levels of paper and ink as characters, so that rows of pixels can be built by text functions.
PAPER, INK = "~", " "
_WIDTH = 64
_ROWS = f"greatest(1, CAST(ceil(octet_length(encode(coalesce(text, ''))) / {_WIDTH}) AS INTEGER))"


def _many(c, n):
    return F.expr(f"repeat('{c}', CAST({n} AS INT))")


def _files(df, key):
    return df.select(F.col(key).cast("string").alias("path"), images.encode(df).alias("content"))


def _documents(spark, sf_dir):
    """Every text's UTF-8 bytes as a grey image 64 pixels wide, filled up with blanks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    d = d.withColumn("height", F.greatest(F.lit(1), F.ceil(F.length("b") / _WIDTH)).cast("int"))
    fill = F.encode(_many(" ", f"height * {_WIDTH} - length(b)"), "UTF-8")
    return _files(d.select("doc_id", "height", F.lit(_WIDTH).alias("width"), F.lit(1).alias("channels"), F.concat("b", fill).alias("pixels")), "doc_id")


@query(f"SELECT doc_id, {_WIDTH} AS width, {_ROWS} AS height, 1 AS channels, sha256(coalesce(text, '') || repeat(' ', {_ROWS} * {_WIDTH} - octet_length(encode(coalesce(text, ''))))) AS pixels_sha256, false AS failed FROM documents")
def snk06_png_round_trip(spark, sf_dir):
    """Texts as PNG in a Parquet table, read back and decoded."""
    path = sinks.work_folder(spark) + "/png"
    _documents(spark, sf_dir).write.parquet(path)
    d = images.decoded(spark.read.parquet(path))
    return d.select(F.col("path").cast("bigint").alias("doc_id"), "width", "height", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), F.col("error").isNotNull().alias("failed"))


def _boxes(spark, sf_dir):
    """A page for each part with one dark box: its place and size come from the part's numbers."""
    d = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("p_partkey", "60 + p_partkey % 41 AS width", "40 + p_partkey % 29 AS height", "p_partkey % 30 AS x", "p_partkey % 20 AS y", "1 + p_size % 30 AS w", "1 + p_size % 17 AS h")
    blank = _many(PAPER, "width")
    row = F.concat(_many(PAPER, "x"), _many(INK, "w"), _many(PAPER, "width - x - w"))
    page = F.concat(F.repeat(blank, F.col("y").cast("int")), F.repeat(row, F.col("h").cast("int")), F.repeat(blank, (F.col("height") - F.col("y") - F.col("h")).cast("int")))
    return _files(d.withColumn("pixels", page.cast("binary")).withColumn("channels", F.lit(1)), "p_partkey")


_BOX = "SELECT p_partkey AS partkey, 60 + p_partkey % 41 AS pw, 40 + p_partkey % 29 AS ph, p_partkey % 30 AS x, p_partkey % 20 AS y, 1 + p_size % 30 AS w, 1 + p_size % 17 AS h FROM part"


@query(f"""
WITH b AS ({_BOX}), c AS (SELECT *, least(pw, x + w + 12) - greatest(0, x - 12) AS cw, least(ph, y + h + 12) - greatest(0, y - 12) AS ch FROM b)
SELECT partkey, CAST(cw AS INTEGER) AS width, CAST(ch AS INTEGER) AS height, CAST(cw * ch * 126 - w * h * 94 AS BIGINT) AS levels FROM c""")
def img01_ink_crop(spark, sf_dir):
    """Pages cropped to their ink and a padding of 12; ``levels`` is the sum of what is left."""
    return _measured(images.prepared(_boxes(spark, sf_dir), ("crop_ink", 12)))


@query(f"""
WITH b AS ({_BOX})
SELECT partkey, CAST(least(60, greatest(1, round_even(pw * (32 / ph), 0))) AS INTEGER) AS width, 32 AS height FROM b""")
def img01_resized(spark, sf_dir):
    """Pages at a height of 32 and a width of 60 at most."""
    return _measured(images.prepared(_boxes(spark, sf_dir), ("grey",), ("resize", 32, 60))).drop("levels")


def _measured(done):
    """The prepared images decoded again: size and sum of levels."""
    px = images.decoded(done.select("path", "content"))
    return px.select(F.col("path").cast("bigint").alias("partkey"), "width", "height", images.levels(F.col("pixels")).alias("levels"))


_GREY = "list_sum(list_transform(range(n), lambda i: (19595 * ascii(name[3 * i + 1]) + 38470 * ascii(name[3 * i + 2]) + 7471 * ascii(name[3 * i + 3]) + 32768) >> 16))"


@query(f"""
WITH p AS (SELECT p_partkey, p_name || repeat(' ', (3 - length(p_name) % 3) % 3) AS name, CAST(ceil(length(p_name) / 3) AS BIGINT) AS n FROM part),
s AS (SELECT *, n + 2 * greatest(2, CAST(round(n * 0.08) AS BIGINT)) AS side FROM p)
SELECT p_partkey AS partkey, CAST(side AS INTEGER) AS width, CAST(side AS INTEGER) AS height, CAST((side * side - n) * 255 + {_GREY} AS BIGINT) AS levels FROM s""")
def img01_grey_square(spark, sf_dir):
    """Names as rows of coloured pixels, in the middle of a white square, in grey."""
    d = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.rpad("p_name", (F.ceil(F.length("p_name") / 3) * 3).cast("int"), F.lit(" ")).cast("binary").alias("pixels"))
    d = d.withColumn("width", (F.length("pixels") / 3).cast("int")).withColumn("height", F.lit(1)).withColumn("channels", F.lit(3))
    return _measured(images.prepared(_files(d, "p_partkey"), ("square", 0.08), ("grey",)))


@query()
def img01_local_contrast(spark, sf_dir):
    """Every text's image with its contrast evened out by tiles; a test compares it with a plain version."""
    d = images.decoded(images.prepared(_documents(spark, sf_dir), ("local_contrast", 2.0, 8)).select("path", "content"))
    return d.select(F.col("path").cast("bigint").alias("doc_id"), "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"))


_LINES = "SELECT l_orderkey AS orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, 10 + l_linenumber AS x1, 48 + 5 + CAST(l_quantity AS BIGINT) % 20 AS x2 FROM lineitem"


@query(f"""
WITH l AS ({_LINES}), p AS (SELECT *, CASE WHEN orderkey % 7 = 0 THEN 2 * n + 1 ELSE n END AS expected FROM l)
SELECT orderkey, CAST(CASE WHEN expected = n AND n > 2 THEN i + 1 END AS INTEGER) AS line, CAST(CASE WHEN expected = n AND n > 2 THEN x1 - 8 END AS INTEGER) AS x1,
  CAST(CASE WHEN expected = n AND n > 2 THEN 16 * i END AS INTEGER) AS y1, CAST(CASE WHEN expected = n AND n > 2 THEN x2 + 8 END AS INTEGER) AS x2, CAST(CASE WHEN expected = n AND n > 2 THEN 16 * i + 16 END AS INTEGER) AS y2,
  CASE WHEN expected > n THEN 'too_few_components:' || 2 * n || '<' || expected WHEN n <= 2 THEN 'crop_too_tall' ELSE 'ok' END AS status
FROM p WHERE i = 0 OR (expected = n AND n > 2)""")
def img02_line_boxes(spark, sf_dir):
    """A page for each order: a line of two words and a rule for each item; the lines are cut out again.

    Pages of one or two lines are too flat to cut, and every seventh order claims more lines than its page has parts.
    """
    rule, blank = _many(INK, 96), _many(PAPER, 96)

    def band(item):
        second = (item["l_quantity"].cast("bigint") % 20 + 5).cast("int")
        first = item["l_linenumber"].cast("int")
        word = lambda n: F.repeat(F.lit(INK), n)
        gap = lambda n: F.repeat(F.lit(PAPER), n)
        row = F.concat(gap(first + 10), word(first + 8), gap(48 - 18 - first * 2), word(second), gap(48 - second))
        return F.concat(F.repeat(blank, F.lit(5)), F.repeat(row, F.lit(6)), F.repeat(blank, F.lit(3)), rule, blank)

    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("items"))
    pages = items.select("l_orderkey", F.size("items").alias("n"), (F.size("items") * 16).alias("height"), F.lit(96).alias("width"), F.lit(1).alias("channels"), F.array_join(F.transform("items", band), "").cast("binary").alias("pixels"))
    expected = F.when(F.col("l_orderkey") % 7 == 0, 2 * F.col("n") + 1).otherwise(F.col("n"))
    got = images.line_crops(pages.select(F.col("l_orderkey").cast("string").alias("path"), images.encode(pages).alias("content"), expected.alias("expected")))
    return got.select(F.col("path").cast("bigint").alias("orderkey"), "line", "x1", "y1", "x2", "y2", "status")
