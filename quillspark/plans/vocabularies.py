"""Vocabularies, out-of-vocabulary analysis and n-gram models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ngrams, vocabulary
from .registry import query, table

_CHARS = "SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM documents"


@query(f"SELECT ch, count(*) AS n, 'U+' || lpad(printf('%X', unicode(ch)), 4, '0') AS codepoint FROM ({_CHARS}) WHERE ch <> '' GROUP BY ch")
def agg01_char_inventory(spark, sf_dir):
    return vocabulary.char_inventory(table(spark, sf_dir, "documents")).withColumn("codepoint", T.codepoint_label(F.col("ch")))


@query(f"SELECT ch, CAST(row_number() OVER (ORDER BY unicode(ch)) AS INTEGER) AS idx FROM (SELECT DISTINCT ch FROM ({_CHARS}) WHERE ch <> '')")
def map01_vocabulary_index(spark, sf_dir):
    return vocabulary.vocabulary(table(spark, sf_dir, "documents"))


@query(f"SELECT CAST(0 AS INTEGER) AS blank_index, count(DISTINCT ch) + 1 AS num_classes FROM ({_CHARS}) WHERE ch <> ''")
def map01_vocabulary_size(spark, sf_dir):
    return vocabulary.vocabulary_map(vocabulary.vocabulary(table(spark, sf_dir, "documents"))).drop("char_to_index")


_EN = f"SELECT DISTINCT ch FROM ({_CHARS}) WHERE lang = 'en'"


@query(f"SELECT lang, count(DISTINCT ch) AS unique_oov, count(*) AS occurrences, count(DISTINCT doc_id) AS affected_rows FROM ({_CHARS}) WHERE ch <> '' AND ch NOT IN ({_EN}) GROUP BY lang")
def agg22_oov_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vocabulary.oov_summary(d, vocabulary.vocabulary(d.where("lang = 'en'")), "lang", "doc_id")


@query(f"SELECT lang, ch, count(*) AS occurrences, count(DISTINCT doc_id) AS rows_containing, 'U+' || lpad(printf('%X', unicode(ch)), 4, '0') AS codepoint FROM ({_CHARS}) WHERE ch <> '' AND ch NOT IN ({_EN}) GROUP BY lang, ch")
def jon08_oov_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vocabulary.oov_report(d, vocabulary.vocabulary(d.where("lang = 'en'")), "lang", "doc_id")


@query(f"SELECT d.doc_id, coalesce(o.oov, '') AS oov_characters, o.oov IS NULL AS accepted FROM documents d LEFT JOIN (SELECT doc_id, string_agg(ch, '' ORDER BY unicode(ch)) AS oov FROM (SELECT DISTINCT doc_id, ch FROM ({_CHARS}) WHERE ch <> '' AND ch NOT IN ({_EN})) GROUP BY doc_id) o ON o.doc_id = d.doc_id")
def flt12_oov_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vocabulary.oov_split(d, vocabulary.vocabulary(d.where("lang = 'en'")), "doc_id")


@query(f"""
WITH o AS (SELECT ch, CAST(row_number() OVER (ORDER BY unicode(ch)) AS INTEGER) AS old_idx FROM (SELECT DISTINCT ch FROM ({_CHARS}) WHERE lang = 'fr' AND ch <> '')), n AS (SELECT ch, CAST(row_number() OVER (ORDER BY unicode(ch)) AS INTEGER) AS new_idx FROM (SELECT DISTINCT ch FROM ({_CHARS}) WHERE lang = 'de' AND ch <> ''))
SELECT coalesce(o.ch, n.ch) AS ch, old_idx, new_idx, CASE WHEN old_idx IS NULL THEN 'added' WHEN new_idx IS NULL THEN 'removed' WHEN old_idx <> new_idx THEN 'index_changed' ELSE 'shared' END AS change FROM o FULL JOIN n ON o.ch = n.ch""")
def jon09_vocabulary_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vocabulary.vocabulary_diff(vocabulary.vocabulary(d.where("lang = 'fr'")), vocabulary.vocabulary(d.where("lang = 'de'")))


_P = f"repeat('{ngrams.BOS}', 2) || text || '{ngrams.EOS}'"
_POS = f"SELECT item_id, s, unnest(range(3, length(s) + 1)) AS p FROM (SELECT item_id, {_P} AS s FROM benchmark)"
COUNTS = f"SELECT g, ctx, tok, count(*) AS n FROM (SELECT item_id % 2 AS g, right(substr(s, p - 2, 2), CAST(l AS INTEGER)) AS ctx, substr(s, p, 1) AS tok FROM ({_POS}), (VALUES (0), (1), (2)) v(l)) GROUP BY ALL"


@query(COUNTS)
def agg18_ngram_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 2)
    return ngrams.fit(b, "g", 3)


@query(f"""
WITH c AS ({COUNTS}), t AS (SELECT g, ctx, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT g, count(*) AS v FROM c WHERE ctx = '' GROUP BY g),
x AS (SELECT 1 - item_id % 2 AS g, item_id, p, substr(s, p - 2, 2) AS full_ctx, substr(s, p, 1) AS tok FROM ({_POS})),
b AS (SELECT x.*, t.ctx, t.total, row_number() OVER (PARTITION BY item_id, p ORDER BY length(t.ctx) DESC) AS r FROM x JOIN t ON t.g = x.g AND (t.ctx = x.full_ctx OR t.ctx = right(x.full_ctx, 1) OR t.ctx = ''))
SELECT b.g, item_id, round(sum(ln((coalesce(c.n, 0) + 0.1) / (total + 0.1 * v.v))), 5) AS log_prob FROM b JOIN v ON v.g = b.g LEFT JOIN c ON c.g = b.g AND c.ctx = b.ctx AND c.tok = b.tok WHERE r = 1 GROUP BY b.g, item_id""")
def mth03_ngram_log_prob(spark, sf_dir):
    """Each half of the benchmark under the other half's model."""
    b = table(spark, sf_dir, "benchmark")
    model = ngrams.fit(b.withColumn("g", F.col("item_id") % 2), "g", 3)
    return ngrams.score(b.withColumn("g", 1 - F.col("item_id") % 2), model, "g", "item_id", 3).withColumn("log_prob", F.round("log_prob", 5))


@query("SELECT doc_id, CAST(len(list_filter(list_zip(c[:-2], c[2:]), lambda p: p[1] = p[2])) AS INTEGER) AS repeats FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)")
def win09_adjacent_repeats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.adjacent_repeats(F.col("text")).alias("repeats"))


@query("""
WITH i AS (SELECT conv_id, list(CAST(length(text) % 4 AS INTEGER) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> 0 AND (i = 1 OR a[i] <> a[i - 1]) THEN a[i] END), lambda x: x IS NOT NULL), ',') AS decoded FROM i""")
def str17_ctc_collapse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 4).alias("i")))).alias("a"))
    return c.select("conv_id", F.array_join(F.transform(T.collapse_runs(F.transform("a", lambda x: x["i"])), lambda x: x.cast("string")), ",").alias("decoded"))


@query("WITH v AS (SELECT ch, row_number() OVER (ORDER BY unicode(ch)) AS i FROM (SELECT DISTINCT unnest(string_split(n_name, '')) AS ch FROM nation)) SELECT n_nationkey, string_agg(CAST(v.i AS VARCHAR), ',' ORDER BY p) AS encoded FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS p FROM nation) x JOIN v ON v.ch = substr(n_name, p, 1) GROUP BY n_nationkey")
def str18_encode(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m = vocabulary.vocabulary_map(vocabulary.vocabulary(n, "n_name"))
    # the map is one row
    return n.crossJoin(F.broadcast(m)).select("n_nationkey", F.array_join(F.transform(T.encode(F.col("n_name"), F.col("char_to_index")), lambda x: x.cast("string")), ",").alias("encoded"))
