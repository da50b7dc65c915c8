"""Archives, office documents and images made of the driver's tables, and more sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema, sinks
from ..functions import numeric
from ..functions import text as T
from ..operators import ngrams, quality, segments, splits, vocabulary
from ..sources import documents as D
from ..sources import manifests
from ..streaming import incremental
from .registry import query, spread, table
from .vocabularies import COUNTS


def _files(df, key, content):
    """Contents as files that ``sources.documents`` reads, with the key as their path."""
    return df.select(F.col(key).cast("string").alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))


def _key(df, name):
    return df.withColumn(name, F.col("path").cast("bigint"))


def _grid(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")


@query("SELECT l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def src04_pruned_scan(spark, sf_dir):
    """Two of the columns are read."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", "l_quantity")
    return d.groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT DISTINCT n_regionkey AS regionkey, '.parquet' AS ext FROM nation")
def src07_listing(spark, sf_dir):
    """Files of one extension below a folder that has others too."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation")
    sinks.write_by(nations, f"{path}/parquet", "n_regionkey")
    sinks.write_texts(nations, f"{path}/text", "n_name")
    return D.listing(spark, path, "*.parquet").select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("bigint").alias("regionkey"), "ext").distinct()


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 'png' END AS format, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey + 10 AS INTEGER) END AS width, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey + 1 AS INTEGER) END AS height, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey + 10 AS INTEGER) END AS native_width, s_suppkey % 5 = 0 AS failed FROM supplier")
def src11_image_sizes(spark, sf_dir):
    """Sizes from image headers, by the parser of all formats and by expressions."""
    number = lambda c: F.lpad(F.hex(F.col(c).cast("bigint")), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("_w"), number("_h"), F.lit("0802000000")))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") + 10).alias("_w"), (F.col("s_nationkey") + 1).alias("_h"))
    files = _files(d, "s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, png).otherwise(F.lit("no image").cast("binary")))
    native = files.select("path", D.png_size(F.col("content"))[0].alias("native_width"))
    return _key(D.image_sizes(files).join(native, "path"), "suppkey").select("suppkey", "format", "width", "height", "native_width", F.col("error").isNotNull().alias("failed"))


def _archives(spark, sf_dir):
    """A ZIP file for each region with a text for each nation; the last one has a member that would leave its folder."""
    member = lambda name, text: F.struct(name.alias("name"), text.cast("binary").alias("content"))
    n = table(spark, sf_dir, "nation").withColumn("m", member(F.concat(F.lit("names/"), "n_name", F.lit(".txt")), F.col("n_name")))
    per = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("m")).alias("m"))
    extra = F.when(F.col("n_regionkey") == 4, F.lit("../up.txt")).otherwise(F.lit("notes/read.me"))
    return _files(per, "n_regionkey", sinks.zipped(F.concat("m", F.array(member(extra, F.lit("more"))))))


@query("SELECT n_regionkey AS regionkey, 'names/' || n_name || '.txt' AS member, n_name AS text, false AS failed FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT 4, NULL, NULL, true")
def src12_zip_members(spark, sf_dir):
    """Members of archives by a pattern; an archive with an unsafe member fails as a whole."""
    d = _key(D.zip_members(_archives(spark, sf_dir), r".*\.txt"), "regionkey")
    return d.select("regionkey", "member", F.col("bytes").cast("string").alias("text"), F.col("error").isNotNull().alias("failed"))


@query("SELECT r_regionkey AS regionkey FROM region WHERE r_regionkey = 2")
def src14_one_archive(spark, sf_dir):
    """The only archive of a name; none or several raise."""
    return _key(D.exactly_one(_archives(spark, sf_dir).where("path = '2'"), "archive"), "regionkey").select("regionkey")


def _pdfs(spark, sf_dir):
    """A PDF for each customer: name and segment, a table of two lines, an image."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    shown = F.format_string("BT /F1 10 Tf 50 700 Td (%s) Tj 0 -12 Td (%s) Tj ET BT /F1 10 Tf 1 0 0 1 50 500 Tm (key) Tj ET BT 1 0 0 1 150 500 Tm (nation) Tj ET BT 1 0 0 1 50 488 Tm (%d) Tj ET BT 1 0 0 1 150 488 Tm (%d) Tj ET", "c_name", "c_mktsegment", "c_custkey", "c_nationkey")
    stream = lambda head, body: F.concat(F.lit(f"<< {head} >>\nstream\n"), body, F.lit("\nendstream"))
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << >> /XObject << /Im0 5 0 R >> >> >>"), stream("/Length 0", shown), stream("/Subtype /Image /Filter /DCTDecode", F.concat(F.lit("image of "), "c_name"))]
    parts = [F.concat(F.lit(f"{i} 0 obj\n"), o, F.lit("\nendobj\n")) for i, o in enumerate(objects, 1)]
    return _files(c, "c_custkey", F.concat(F.lit("%PDF-1.4\n"), *parts).cast("binary"))


@query("SELECT c_custkey AS custkey, 1 AS page, i AS block_no, CASE i WHEN 0 THEN c_name || chr(10) || c_mktsegment ELSE 'key nation' || chr(10) || c_custkey || ' ' || c_nationkey END AS text FROM customer, (VALUES (0), (1)) v(i)")
def src16_pdf_blocks(spark, sf_dir):
    return _key(D.pdf_blocks(_pdfs(spark, sf_dir)), "custkey").select("custkey", "page", "block_no", "text")


@query("SELECT c_custkey AS custkey, 1 AS page, 0 AS table_index, 'key|nation;' || c_custkey || '|' || c_nationkey AS cells FROM customer")
def src17_pdf_tables(spark, sf_dir):
    return _key(D.pdf_tables(_pdfs(spark, sf_dir)), "custkey").select("custkey", "page", "table_index", _grid(F.col("rows")).alias("cells"))


@query("SELECT c_custkey AS custkey, 1 AS page, 0 AS img_index, 'jpg' AS ext, 'image of ' || c_name AS image FROM customer")
def src18_pdf_images(spark, sf_dir):
    return _key(D.pdf_images(_pdfs(spark, sf_dir)), "custkey").select("custkey", "page", "img_index", "ext", F.col("bytes").cast("string").alias("image"))


def _docx(spark, sf_dir):
    """A DOCX for each supplier: two paragraphs and a blank one, a table, two media files."""
    s = table(spark, sf_dir, "supplier")
    p = lambda *runs: F.concat(F.lit("<w:p>"), *(x for r in runs for x in (F.lit("<w:r><w:t>"), r, F.lit("</w:t></w:r>"))), F.lit("</w:p>"))
    cell = lambda x: F.concat(F.lit("<w:tc>"), p(x), F.lit("</w:tc>"))
    row = lambda *xs: F.concat(F.lit("<w:tr>"), *map(cell, xs), F.lit("</w:tr>"))
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    body = F.concat(p(F.col("s_name"), F.lit(" of "), nation), F.lit("<w:p/>"), p(F.lit("second")), F.lit("<w:tbl>"), row(F.lit("key"), F.lit("nation")), row(key, nation), F.lit("</w:tbl>"))
    xml = F.concat(F.lit('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'), body, F.lit("</w:body></w:document>"))
    member = lambda name, text: F.struct(F.lit(name).alias("name"), text.cast("binary").alias("content"))
    return _files(s, "s_suppkey", sinks.zipped(F.array(member("word/document.xml", xml), member("word/media/b.png", nation), member("word/media/a.png", key))))


@query("SELECT s_suppkey AS suppkey, i AS paragraph_no, CASE i WHEN 0 THEN s_name || ' of ' || s_nationkey ELSE 'second' END AS text FROM supplier, (VALUES (0), (1)) v(i)")
def src19_docx_paragraphs(spark, sf_dir):
    return _key(D.docx_paragraphs(_docx(spark, sf_dir)), "suppkey").select("suppkey", "paragraph_no", "text")


@query("SELECT s_suppkey AS suppkey, 0 AS table_index, 'key|nation;' || s_suppkey || '|' || s_nationkey AS cells FROM supplier")
def src19_docx_tables(spark, sf_dir):
    return _key(D.docx_tables(_docx(spark, sf_dir)), "suppkey").select("suppkey", "table_index", _grid(F.col("rows")).alias("cells"))


@query("SELECT s_suppkey AS suppkey, f AS file, CASE f WHEN 'a.png' THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(s_nationkey AS VARCHAR) END AS content FROM supplier, (VALUES ('a.png'), ('b.png')) v(f)")
def src20_docx_media(spark, sf_dir):
    return _key(D.docx_media(_docx(spark, sf_dir)), "suppkey").select("suppkey", "file", F.col("bytes").cast("string").alias("content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang FROM documents")
def snk02_csv_with_mark(spark, sf_dir):
    """CSV that begins with a byte order mark, read back without one."""
    path = sinks.work_folder(spark)
    sinks.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "lang"], mark=True)
    return manifests.read_manifest(spark, path).select("doc_id", "lang")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS part_of FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def snk03_union_of_keys(spark, sf_dir):
    """Tables of different columns written as one."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS part_of")
    sinks.union_of_keys([table(spark, sf_dir, "region").selectExpr("r_name AS name", "r_regionkey AS id"), nations]).write.parquet(path)
    return spark.read.parquet(path).select("id", "name", "part_of")


@query("SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def snk04_report(spark, sf_dir):
    """A report of aggregates as one JSON file."""
    path = sinks.work_folder(spark)
    sinks.write_report(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("lang string, n bigint, chars bigint").json(path)


@query("SELECT e AS epoch, round(avg(l_quantity) / e, 4) AS loss FROM lineitem, (VALUES (1), (2), (3)) v(e) GROUP BY e")
def snk11_metrics_rows(spark, sf_dir):
    """A row of metrics appended after each epoch."""
    path = sinks.work_folder(spark)
    for epoch in (1, 2, 3):
        sinks.append_rows(table(spark, sf_dir, "lineitem").agg(F.lit(epoch).alias("epoch"), F.round(F.avg("l_quantity") / epoch, 4).alias("loss")), path)
    return spark.read.parquet(path)


@query(COUNTS)
def snk13_ngram_model(spark, sf_dir):
    """A language model kept as a table of counts by group, and read again."""
    path = sinks.work_folder(spark)
    sinks.write_by(ngrams.fit(table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 2), "g", 3), path, "g")
    return spark.read.parquet(path).select(F.col("g").cast("bigint").alias("g"), "ctx", "tok", "n")


@query("SELECT n_nationkey AS nationkey, n_name AS name FROM nation")
def snk16_snapshots(spark, sf_dir):
    """A stream's batches saved as they come."""
    path = sinks.work_folder(spark)
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS nationkey", "n_name AS name")
    nations.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(nations.schema).parquet(f"{path}/in")
    incremental.snapshots(stream, f"{path}/out", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("nationkey", "name")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), 'real') AS source_type FROM documents")
def prj02_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_filled(F.expr("IF(doc_id % 3 = 0, '', source)"), F.expr("IF(doc_id % 2 = 0, lang, NULL)"), F.lit("real")).alias("source_type"))


@query("SELECT n_nationkey AS nationkey, 'nations' AS dataset, 'geo' AS domain, 'research' AS usage_scope, 'nation.parquet' AS source_manifest FROM nation")
def prj03_provenance(spark, sf_dir):
    """Constants and the manifest that a row comes from."""
    d = schema.with_provenance(table(spark, sf_dir, "nation"), dataset="nations", domain="geo", usage_scope="research")
    return d.select(F.col("n_nationkey").alias("nationkey"), "dataset", "domain", "usage_scope", F.regexp_extract("source_manifest", "([^/]+\\.parquet)", 1).alias("source_manifest"))


@query("SELECT 'documents' AS name, NULL AS error, count(*) AS n, sum(length(text)) AS chars FROM documents UNION ALL SELECT 'region', 'missing columns: text, lang', NULL, NULL")
def prj05_required_columns(spark, sf_dir):
    """Rows of a table that has the required columns; the message of one that hasn't."""

    def checked(name):
        try:
            d = schema.assert_columns(table(spark, sf_dir, name), ["text", "lang"])
        except schema.MissingColumns as e:
            return spark.createDataFrame([(name, str(e).partition(";")[0], None, None)], "name string, error string, n bigint, chars bigint")
        return d.agg(F.lit(name).alias("name"), F.lit(None).cast("string").alias("error"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))

    return checked("documents").union(checked("region"))


@query("SELECT c_custkey AS key, c_name AS label FROM customer")
def prj06_found_columns(spark, sf_dir):
    """Columns by the first candidate that there is, letter case aside."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col(schema.find_column(c, ["id", "C_CUSTKEY", "c_name"])).alias("key"), F.col(schema.find_column(c, ["label", "C_Name"])).alias("label"))


@query("SELECT page_id, 'images/' || page_id || '/a.png' AS path, 'a.png' AS name, 'a' AS stem FROM pages")
def prj12_portable_path(spark, sf_dir):
    path = T.portable_path(F.concat(F.lit(".\\images\\"), F.col("page_id").cast("string"), F.lit("\\a.png")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", T.filename(F.col("path")).alias("name"), T.stem(F.col("path")).alias("stem"))


@query("SELECT n_nationkey, n_name FROM nation WHERE length(n_name) > 6")
def prj13_original_columns(spark, sf_dir):
    """Helper columns dropped again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return schema.restore_order(n.withColumn("_length", F.length("n_name")).where("_length > 6"), n.columns)


@query("SELECT * FROM (VALUES ('repeated nations', false), ('repeated orders of lines', true)) v(name, raised)")
def flt14_assertions(spark, sf_dir):
    """Assertions over tables: one that holds and one that doesn't."""

    def raised(name, key):
        try:
            quality.assert_none(table(spark, sf_dir, name).groupBy(key).count().where("count > 1"), key)
        except AssertionError:
            return True
        return False

    return spark.createDataFrame([("repeated nations", raised("nation", "n_nationkey")), ("repeated orders of lines", raised("lineitem", "l_orderkey"))], "name string, raised boolean")


@query("SELECT c_custkey AS custkey, CASE WHEN c_custkey % 4 < 2 OR c_custkey % 8 = 6 THEN 'd' || c_nationkey || '/c' || c_custkey || '.png' END AS resolved FROM customer")
def jon05_resolved_paths(spark, sf_dir):
    """Files by exact path, by the end of a path, by a name that only one file has, or none."""
    c = table(spark, sf_dir, "customer")
    files = c.selectExpr("concat('d', c_nationkey, '/c', c_custkey, '.png') AS path").union(c.where("c_custkey % 8 < 3").selectExpr("concat('e/c', c_custkey, '.png')"))
    wanted = "CASE c_custkey % 4 WHEN 0 THEN concat('./d', c_nationkey, '\\\\c', c_custkey, '.png') WHEN 1 THEN concat('c', c_custkey, '.png') WHEN 2 THEN concat('x/c', c_custkey, '.PNG') ELSE concat('none', c_custkey, '.png') END AS image"
    return manifests.resolve_paths(c.selectExpr("c_custkey AS custkey", wanted), files).select("custkey", "resolved")


def _placed(spark, ordered, columns, key):
    """The rows' places over all files that an ordered table is written to."""
    path = sinks.work_folder(spark)
    sinks.write_csv(ordered, path, columns)
    d = manifests.placed_parts(spark, path, columns)
    return d.select(F.col(key).cast("bigint").alias(key), F.col("place").cast("int").alias("place"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_name DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def srt01_sorted_output(spark, sf_dir):
    return _placed(spark, table(spark, sf_dir, "supplier").orderBy("s_nationkey", F.desc("s_name"), "s_suppkey"), ["s_suppkey"], "s_suppkey")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY sha256('42:' || c_custkey), c_custkey) AS INTEGER) AS place FROM customer")
def srt09_shuffled_output(spark, sf_dir):
    return _placed(spark, splits.shuffled(table(spark, sf_dir, "customer"), "c_custkey"), ["c_custkey"], "c_custkey")


@query("SELECT doc_id, regexp_replace(nfc_normalize(coalesce(text, '')), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def str02_weak_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_weak(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' WHEN 2 THEN lower(trim(coalesce(lang, ''))) ELSE 'en' END AS code FROM documents")
def str04_language_code(spark, sf_dir):
    alias = F.expr("CASE doc_id % 4 WHEN 0 THEN ' English ' WHEN 1 THEN 'ar-EG' WHEN 2 THEN upper(lang) ELSE 'EN_gb' END")
    return table(spark, sf_dir, "documents").select("doc_id", T.language_code(alias).alias("code"))


@query("""
SELECT n_nationkey AS nationkey, CASE k % 5 WHEN 0 THEN 'record_ids_removed' WHEN 1 THEN 'short_leading_id_removed' WHEN 2 THEN 'no_ids_found' WHEN 3 THEN 'leading_short_id_removed+record_ids_removed' ELSE 'unnumbered_prefix_preserved+record_ids_removed' END AS status,
CASE k % 5 WHEN 0 THEN (10000 + k) || ':' || n_name || '.|' || (2000 + k) || ':Next 77 1234 years' WHEN 1 THEN k || ':' || n_name WHEN 2 THEN ':' || n_name || ' in 1979 . 30000 of' WHEN 3 THEN k || ':' || n_name || '.|' || (10000 + k) || ':"Quoted"' ELSE ':' || n_name || ';|' || (10000 + k) || ':(Next) ' || (50000 + k) || ' 12345678 Last' END AS segments,
false AS starts_with_number, false AS needs_review FROM (SELECT *, n_nationkey AS k FROM nation)""")
def str08_repaired_records(spark, sf_dir):
    """Records by ids that their neighbours confirm, short ones at the start, and words before the first id."""
    raw = "CASE k % 5 WHEN 0 THEN concat(10000 + k, ' ', n_name, '.  ', 2000 + k, '\\tNext 77 1234 years') WHEN 1 THEN concat(k, ' ', n_name) WHEN 2 THEN concat(n_name, ' in 1979 . 30000 of') WHEN 3 THEN concat(k, ' ', n_name, '. ', 10000 + k, ' \"Quoted\"') ELSE concat(n_name, '; ', 10000 + k, ' (Next) ', 50000 + k, ' 12345678 Last') END AS raw"
    d = segments.repair_records(table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey")).selectExpr("n_nationkey AS nationkey", raw), "raw")
    return d.select("nationkey", "status", F.array_join(F.transform("segments", lambda s: F.concat(s["record_id"], F.lit(":"), s["text"])), "|").alias("segments"), "starts_with_number", "needs_review")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '.jpeg' ELSE '.png' END AS suffix FROM pages")
def str22_safe_suffix(spark, sf_dir):
    name = F.expr("concat('a', page_id, CASE page_id % 3 WHEN 0 THEN '.JPEG' WHEN 1 THEN '.exe' ELSE '' END)")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_suffix(T.extension(name)).alias("suffix"))


@query("SELECT c_custkey AS custkey, i AS part, c_custkey // 7 + CASE WHEN i < c_custkey % 7 THEN 1 ELSE 0 END AS quota FROM customer, range(7) v(i)")
def mth06_quotas(spark, sf_dir):
    """Each key dealt evenly to seven parts."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<bigint>")).alias("part"))
    return d.select("custkey", "part", numeric.quota(F.col("custkey"), F.lit(7), F.col("part")).alias("quota"))


@query("""
WITH v AS (SELECT ch, row_number() OVER (ORDER BY unicode(ch)) AS i FROM (SELECT DISTINCT unnest(string_split(n_name, '')) AS ch FROM nation)),
e AS (SELECT n_nationkey, length(n_name) AS n, string_agg(CAST(v.i AS VARCHAR), ',' ORDER BY p) AS x FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS p FROM nation) JOIN v ON v.ch = substr(n_name, p, 1) GROUP BY ALL),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY n, n_nationkey) - 1) / 8) AS BIGINT) AS batch_id FROM e)
SELECT n_nationkey AS nationkey, batch_id, CAST(n AS INTEGER) AS length, x || repeat(',0', CAST(max(n) OVER (PARTITION BY batch_id) - n AS INTEGER)) AS padded FROM b""")
def udf06_padded_batches(spark, sf_dir):
    """Encoded names in batches of like length, padded with the blank."""
    n = table(spark, sf_dir, "nation")
    m = vocabulary.vocabulary_map(vocabulary.vocabulary(n, "n_name"))
    # the map is one row
    e = n.crossJoin(F.broadcast(m)).select(F.col("n_nationkey").alias("nationkey"), F.length("n_name").alias("n"), T.encode(F.col("n_name"), F.col("char_to_index")).cast("array<int>").alias("ids"))
    d = splits.padded(splits.bucket_batches(e, "n", 8, "nationkey"), "batch_id", "ids")
    return d.select("nationkey", "batch_id", "length", F.array_join(F.col("ids").cast("array<string>"), ",").alias("padded"))
