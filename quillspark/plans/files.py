"""Sources and sinks: the driver's tables written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import published, sinks
from ..functions import text as T
from ..operators import metrics
from ..sources import documents, manifests
from .registry import query, table


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(replace(text, chr(13), chr(10)), '') AS text, coalesce(lang, '') AS lang, '' AS note FROM documents")
def src01_manifest(spark, sf_dir):
    """A CSV manifest with quotes and line breaks in values, written with a column that is missing and read as strings."""
    path = sinks.work_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("\n")).alias("text"), "lang", "source")
    sinks.write_csv(docs, path, ["doc_id", "text", "lang", "note"])
    return manifests.read_manifest(spark, path, ["doc_id", "text", "lang", "note"])


@query("SELECT l_returnflag AS split, count(*) AS n, sum(l_linenumber) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag")
def src02_parquet_splits(spark, sf_dir):
    """Parquet written in a folder for each return flag, read as splits, only two columns of it."""
    path = sinks.work_folder(spark)
    rows = table(spark, sf_dir, "lineitem")
    sinks.write_by(rows, path, "l_returnflag")
    flags = sorted(r[0] for r in rows.select("l_returnflag").distinct().collect())  # a handful of values
    files = {x: [f"{path}/l_returnflag={x}"] for x in flags}
    d = manifests.read_parquet_splits(spark, files, ["l_linenumber", "l_extendedprice"])
    return d.groupBy("split").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS INTEGER) AS clerk FROM orders")
def src03_typed_manifest(spark, sf_dir):
    """Columns of a manifest cast where their text allows."""
    path = sinks.work_folder(spark)
    sinks.write_csv(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS price", "'Clerk ' || o_orderkey AS clerk"), path, ["key", "price", "clerk"])
    return manifests.typed(manifests.read_manifest(spark, path), {"key": "bigint", "price": "double", "clerk": "int"})


@query("SELECT name, type, true AS nullable, filled, example FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count({c}) AS filled, min(CAST({c} AS VARCHAR)) AS example FROM documents" for c, t in {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}.items()) + ")")
def src05_describe(spark, sf_dir):
    """SRC-06: columns, their types, how many rows fill them and an example."""
    return manifests.describe(table(spark, sf_dir, "documents"))


@query("SELECT DISTINCT n_regionkey AS regionkey, n_name || ' \u0645' AS text FROM nation")
def src06_text_files(spark, sf_dir):
    """Text files, a folder of them for each region, read whole."""
    path = sinks.work_folder(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.concat("n_name", F.lit(" \u0645")).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey", "n_regionkey").text(path)
    d = manifests.read_texts(spark, path)
    return d.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("bigint").alias("regionkey"), F.rtrim(F.translate("text", "\n", "")).alias("text")).distinct()


@query("SELECT r_regionkey AS regionkey, r_name AS name, n AS nations FROM region JOIN (SELECT n_regionkey, list(n_name ORDER BY n_name)[1] AS n FROM nation GROUP BY n_regionkey) ON n_regionkey = r_regionkey")
def src08_json_documents(spark, sf_dir):
    """Nested JSON documents written and read back by a schema."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    d = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("region"), "names")
    sinks.write_json(d, path)
    got = spark.read.schema("region struct<id: bigint, name: string>, names array<string>").json(path)
    return got.select(F.col("region.id").alias("regionkey"), F.col("region.name").alias("name"), F.element_at("names", 1).alias("nations"))


def _lines(spark, sf_dir, line):
    """Lines of customers written as text and read with their file."""
    path = sinks.work_folder(spark)
    sinks.write_texts(table(spark, sf_dir, "customer").select(F.expr(line).alias("line")), path, "line")
    return manifests.read_lines(spark, path)


_KEY = "printf('%d', c_custkey)"


@query(f"SELECT {_KEY} || '.png' AS image, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'ok' END AS status, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || ' ' || c_mktsegment END AS label, CASE WHEN c_custkey % 7 = 0 THEN 'malformed_line' END AS error FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT NULL, NULL, NULL, 'malformed_line' FROM customer WHERE c_custkey % 7 = 0")
def src09a_path_status_label(spark, sf_dir):
    d = _lines(spark, sf_dir, "IF(c_custkey % 7 = 0, 'broken', concat(c_custkey, '.png ok ', c_name, ' ', c_mktsegment))")
    return manifests.path_status_label(d).select("image", "status", "label", "error")


@query(f"SELECT {_KEY} || '.png' AS image, c_name || ',' || c_mktsegment AS label, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT NULL, NULL, 'malformed_line' FROM customer WHERE c_custkey % 7 = 0")
def src09b_image_comma_label(spark, sf_dir):
    d = _lines(spark, sf_dir, "IF(c_custkey % 7 = 0, 'broken', concat(c_custkey, '.png , ', c_name, ',', c_mktsegment))")
    return manifests.image_comma_label(d).select("image", "label", "error")


@query(f"SELECT {_KEY} || '.png' AS image, c_name || ' ' || c_mktsegment AS label, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT NULL, NULL, 'malformed_line' FROM customer WHERE c_custkey % 7 = 0")
def src09c_path_label(spark, sf_dir):
    d = _lines(spark, sf_dir, "IF(c_custkey % 7 = 0, 'broken', concat(c_custkey, '.png   ', c_name, ' ', c_mktsegment))")
    return manifests.path_label(d).select("image", "label", "error")


@query(f"SELECT 'a/' || {_KEY} || '.png' AS image, c_name || ' ' || c_mktsegment AS label FROM customer")
def src09d_tab_or_space_label(spark, sf_dir):
    d = _lines(spark, sf_dir, "concat('\"a\\\\', c_custkey, '.png\"', IF(c_custkey % 2 = 0, '\\t', '  '), c_name, ' ', c_mktsegment)")
    return manifests.tab_or_space_label(d).select("image", "label")


@query("SELECT s_suppkey AS suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) + 1 AS INTEGER) AS row FROM supplier")
def prj04_row_number(spark, sf_dir):
    """Rows of an ordered manifest by their place: the header is row 1."""
    path = sinks.work_folder(spark)
    sinks.write_csv(table(spark, sf_dir, "supplier").orderBy("s_suppkey"), path, ["s_suppkey", "s_name"])
    d = manifests.placed_parts(spark, path, ["s_suppkey", "s_name"])
    return d.select(F.col("s_suppkey").cast("bigint").alias("suppkey"), (F.col("place") + 1).cast("int").alias("row"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(replace(text, chr(13), chr(10)), '') AS text, coalesce(lang, '') AS lang, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def prj04_places_across_lines(spark, sf_dir):
    """Whole texts with quotes and line breaks in an ordered manifest, read in ranges of its files and numbered."""
    path = sinks.work_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("\n")).alias("text"), "lang")
    sinks.write_csv(docs.orderBy("doc_id"), path, ["doc_id", "text", "lang"])
    return manifests.placed_parts(spark, path, ["doc_id", "text", "lang"])


@query("SELECT c_custkey AS custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS page_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS word_index, CASE WHEN c_custkey % 3 = 0 THEN 'not a page and word: ' || c_nationkey || '-' || c_custkey END AS error FROM customer")
def str10_page_and_word(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), T.page_and_word(F.expr("concat(c_nationkey, IF(c_custkey % 3 = 0, '-', '_'), c_custkey)")).alias("_p"))
    return d.select("custkey", F.col("_p.page_id").cast("bigint").alias("page_id"), F.col("_p.word_index").alias("word_index"), F.col("_p.error").alias("error"))


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) THEN 'c/' || o_custkey WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) THEN 's/' || o_custkey END AS found FROM orders")
def jon07_first_existing(spark, sf_dir):
    """Each order's path among the even customers, else among the suppliers."""
    files = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("concat('c/', c_custkey) AS path").union(table(spark, sf_dir, "supplier").selectExpr("concat('s/', s_suppkey)"))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS orderkey", "concat('c/', o_custkey) AS a", "concat('s/', o_custkey) AS b")
    return manifests.first_existing(rows, ["a", "b"], files).select("orderkey", "found")


_COMPRESSED = "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey % 5 AS VARCHAR) AS mode, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS discount, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS tax, CAST(l_quantity AS INTEGER) * 8 AS width, CAST(l_quantity AS INTEGER) AS steps, CAST(l_linenumber AS INTEGER) * 4 AS length FROM lineitem"
_DIMENSIONS = ["flag", "status", "mode", "line", "discount", "tax"]


@query(f"""
SELECT CASE {" ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _DIMENSIONS)} ELSE 'overall' END AS dimension, coalesce({", ".join(_DIMENSIONS)}) AS value, count(*) AS samples, round(avg(width), 6) AS mean_width, median(width) AS median_width, round(avg(steps / nullif(length, 0)), 6) AS mean_steps_per_char, round(median(steps / nullif(length, 0)), 6) AS median_steps_per_char, count(*) FILTER (steps < length) AS too_short, count(*) FILTER (width IS NULL) AS no_width
FROM ({_COMPRESSED}) GROUP BY GROUPING SETS ({", ".join(f"({d})" for d in _DIMENSIONS)}, ())""")
def agg13_compression(spark, sf_dir):
    """Widths, steps and label lengths made from line items, by six dimensions and overall."""
    d = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "l_linestatus AS status", "CAST(l_suppkey % 5 AS STRING) AS mode", "CAST(l_linenumber AS STRING) AS line", "IF(l_discount > 0.05, 'high', 'low') AS discount", "IF(l_tax > 0.04, 'high', 'low') AS tax", "CAST(l_quantity AS INT) * 8 AS width", "CAST(l_quantity AS INT) AS steps", "CAST(l_linenumber AS INT) * 4 AS length")
    out = metrics.compression_metrics(d, _DIMENSIONS, "width", "steps", "length")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_width", "mean_steps_per_char", "median_steps_per_char")})


@query("SELECT r_regionkey AS regionkey, count(*) AS n FROM region, (VALUES (1), (2), (3)) v(i) GROUP BY r_regionkey")
def snk03_appended(spark, sf_dir):
    path = sinks.work_folder(spark)
    for _ in range(3):
        sinks.append_rows(table(spark, sf_dir, "region"), path)
    return spark.read.parquet(path).groupBy(F.col("r_regionkey").alias("regionkey")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS nationkey, n_name AS name FROM nation WHERE n_nationkey % 2 = 1")
def snk12_replaced(spark, sf_dir):
    """A table replaced as a whole: readers get the new rows."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    sinks.replace(nations, path)
    sinks.replace(nations.where("nationkey % 2 = 1"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey AS nationkey, n_name AS name, 25 AS before FROM nation WHERE n_nationkey % 2 = 1")
def snk12_published(spark, sf_dir):
    """A table swapped without a gap: who opened the version before reads it to its end, the next one reads the new rows."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    published.publish(nations, path)
    opened = published.published(spark, path)
    published.publish(nations.where("nationkey % 2 = 1"), path)
    return published.published(spark, path).crossJoin(F.broadcast(opened.agg(F.count("*").cast("int").alias("before"))))  # one row


@query("SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN 'existing' ELSE 'copied' END AS second, 'existing' AS third, c_name AS content FROM customer")
def snk07_repeated_installs(spark, sf_dir):
    """Half of the customers' files installed, then all of them, then all again."""
    path = sinks.work_folder(spark)
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("images/c"), "c_custkey", F.lit(".txt")).alias("target"), F.col("c_name").cast("binary").alias("content"))
    published.install(files.where("c_custkey % 2 = 0").select("target", "content"), path)
    second = published.install(files.select("target", "content"), path).withColumnRenamed("status", "second")
    third = published.install(files.select("target", "content"), path).withColumnRenamed("status", "third")
    there = published.published(spark, path).select("target", F.col("content").cast("string").alias("content"))
    return second.join(third, "target").join(there, "target").select(F.regexp_extract("target", "c(\\d+)", 1).cast("bigint").alias("custkey"), "second", "third", "content")


@query("SELECT c_custkey // 100 AS package, 'c' || c_custkey || '.txt' AS name, c_name AS content FROM customer")
def snk09_packages(spark, sf_dir):
    """A ZIP of every hundred customers under names that no two of its paths share, read back."""
    files = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("package"), F.concat(F.lit("d/"), F.pmod("c_custkey", F.lit(7)), F.lit("/c"), "c_custkey", F.lit(".txt")).alias("path"), F.col("c_name").cast("binary").alias("content"))
    named = published.package_names(files, "path", "package")
    zips = named.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("members")).select(F.col("package").cast("string").alias("path"), sinks.zipped(F.col("members")).alias("content"))
    got = documents.zip_members(zips.withColumn("length", F.length("content").cast("bigint")))
    return got.select(F.col("path").cast("bigint").alias("package"), F.col("member").alias("name"), F.col("bytes").cast("string").alias("content"))
