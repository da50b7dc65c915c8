"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annular, exponion, gumbel, htmltext, language, lmscore, matroska, mixing, partenum, rules, shards, substrings, toxicity, vector_sql
from .common import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Matroska audio, parsed back and digested."""
    return matroska.stored_texts(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict of a list learned from `labels`."""
    judged = rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left when all windows of 35 words that start elsewhere too are gone."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), width=35)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole text, without replacement."""
    return gumbel.sampled(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity by a model fitted on `labels` of the training fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shards.hypergeometric_shuffle(rows, 16, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language by a model fitted on the training fold."""
    return language.language_id(table(spark, sf_dir, "documents"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of Lloyd's rounds over all vectors, with every cluster's inertia."""
    return exponion.clustered(table(spark, sf_dir, "embeddings"))


def op12_gated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log-probability under a recurrent model of the training fold, beside a unigram base."""
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors under codebooks learned in four rounds."""
    return annular.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_matroska, op2_html_text, op3_quality_rules, op4_jaccard_join, op5_substring_dedup, op6_sentencepiece, op7_toxicity, op8_shards, op9_mixing, op10_language_id, op11_exponion, op12_gated_scores, op13_annular_codes)}

#: Words with their place, and the sequence of ``n`` words that starts at each.
_WORDS = "SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"
_STARTS = "SELECT doc_id, p, n, string_agg(w, ' ') OVER f AS k, count(*) OVER f AS c FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op4_jaccard_join": f"""
WITH RECURSIVE words AS ({_WORDS.format(text=_LOWER)}),
sh AS (SELECT DISTINCT doc_id, k FROM ({_STARTS.format(more=3)}) WHERE c = 4 OR (n < 4 AND p = 1)), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
ln AS (SELECT x, y FROM pr JOIN sz s ON s.doc_id = x JOIN sz t ON t.doc_id = y WHERE 100 * i >= 85 * (s.n + t.n - i)), e AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
r AS (SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN sz ON sz.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op5_substring_dedup": f"""
WITH words AS ({_WORDS.format(text="coalesce(text, '')")}),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS m FROM ({_STARTS.format(more=34)}) WHERE c = 35) WHERE m > 1),
gone AS (SELECT words.doc_id, words.p, w, max(CASE WHEN twice.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS g FROM words LEFT JOIN twice ON twice.doc_id = words.doc_id AND twice.p = words.p),
kept AS (SELECT doc_id, count(*) AS n, sum(g) AS r, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (g = 0), '') AS t FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op11_exponion": vector_sql.centroid_sql(),
    "op13_annular_codes": vector_sql.code_sql(),
}
