"""Flattening documents, URLs, nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments
from ..sources import documents as D
from .registry import query, table


@query("SELECT page_id, ext, tokens, shape FROM (SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) AS ext, array_to_string(list_filter(string_split_regex(regexp_extract(url, '([^/]*)$', 1), '[_\\-\\s.]+'), lambda x: x <> ''), ' ') AS tokens, replace(regexp_replace(regexp_replace(url, '[0-9]+', chr(1), 'g'), '[A-Za-z]+', '<A>', 'g'), chr(1), '<N>') AS shape FROM pages)")
def str09_url_structure(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.extension(F.col("url")).alias("ext"), F.array_join(T.name_tokens(T.filename(F.col("url"))), " ").alias("tokens"), T.shape(F.col("url")).alias("shape"))


@query("SELECT page_id, coalesce(string_split(url, '/')[3], '') AS host, coalesce(string_split(url, '/')[4], '') AS part, coalesce(string_split(url, '/')[9], '') AS deep FROM pages")
def prj10_path_components(spark, sf_dir):
    parts = F.split("url", "/")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", at(2).alias("host"), at(3).alias("part"), at(8).alias("deep"))


@query("SELECT lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, ext LIMIT 30")
def agg24_extension_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(30)


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def src10_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT a.conv_id, CAST(b.r - 2 AS INTEGER) AS row_no, CAST(c.i - 1 AS INTEGER) AS col_no, a.text AS header, b.text AS value FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.r = 1 AND b.r > 1, (VALUES (1)) c(i)")
def prj08_flatten_tables(spark, sf_dir):
    """Conversations as tables of one column: the first turn is the header, the others are cells."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    grid = F.transform("t", lambda x: F.array(x["text"]))
    docs = rows.select("conv_id", F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("table_index"), grid.alias("rows"))).alias("tables"))
    return D.flatten_tables(docs, "conv_id").select("conv_id", "row_no", "col_no", "header", "value")


@query("SELECT conv_id, CAST(r - 1 AS INTEGER) AS block_no, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)")
def prj07_flatten_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    docs = rows.select("conv_id", F.array(F.struct(F.lit(1).alias("page"), F.transform("t", lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("array<double>").alias("bbox"))).alias("blocks"))).alias("text"))
    return D.flatten_blocks(docs, "conv_id").select("conv_id", "block_no", "text")


@query("SELECT conv_id, CASE WHEN sum(length(trim(text))) > 20 THEN 'digital' ELSE 'scanned' END AS kind FROM conversations GROUP BY conv_id")
def src15_digital_or_scanned(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(D.text_kind(F.col("text")).alias("kind"))


@query("SELECT page_id, CASE lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' ELSE 'unsupported' END AS route FROM pages")
def src21_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.route(F.col("url")).alias("route"))


@query("SELECT doc_id, CAST(json_object('doc_id', doc_id, 'source', source) AS VARCHAR) AS j FROM documents")
def snk15_json_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "source")).alias("j"))


@query("""
SELECT conv_id, 'parsed' AS status, CAST(count(*) AS INTEGER) AS n_segments, CAST(to_json(list({'record_id': CAST(10000 + turn AS VARCHAR), 'text': t} ORDER BY turn, text)) AS VARCHAR) AS segments_json
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id""")
def str07_segment_records(spark, sf_dir):
    """Numbered transcriptions of conversations, parsed back into records."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    raw = F.array_join(F.transform("t", lambda x: F.concat((F.lit(10000) + x["turn"]).cast("string"), F.lit(" "), x["text"])), " ")
    return segments.parse_records(c.select("conv_id", raw.alias("raw")), "raw").select("conv_id", "status", F.size("segments").alias("n_segments"), F.to_json("segments").alias("segments_json"))


@query()
def prj07_html_blocks(spark, sf_dir):
    """The text blocks of pages, flattened."""
    return D.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
