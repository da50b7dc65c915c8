"""Curation: normalising, reviewing, deduplicating, splitting, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import dedup, profiles, quality, ranges, ranking, splits
from .registry import query, table

_BUCKET = "CAST('0x' || substr(sha1(source), 1, 8) AS BIGINT) % 100"
_SPLIT = f"CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'val' ELSE 'test' END"
_MANIFEST = f"SELECT CAST(doc_id AS VARCHAR) AS image, text, lang AS language, source AS dataset, {_SPLIT} AS split, sha256(text) AS sha256, CAST(doc_id AS VARCHAR) AS source_row, n_chars FROM documents"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a manifest; its pseudo-split is a hash bucket of the source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("image"), "text", F.col("lang").alias("language"), F.col("source").alias("dataset"), N.ratio_split(N.sha1_bucket(F.col("source"))).alias("split"),
        F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("source_row"), F.lit("real").alias("source_type"), F.lit("print").alias("domain"), "n_chars",
    )


_SCORE = "CASE WHEN (language = 'en' AND regexp_matches(text, '[A-Za-z]')) OR (language = 'ar' AND regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]')) THEN 110 ELSE 10 END"


@query(f"""
WITH m AS ({_MANIFEST}), p AS (SELECT *, CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END AS prio, {_SCORE} AS score FROM m),
g AS (SELECT *, max(prio) OVER (PARTITION BY sha256) AS top, row_number() OVER (PARTITION BY sha256 ORDER BY prio DESC, score DESC, dataset, image, source_row) AS rn FROM p)
SELECT image, dataset, split, CASE WHEN rn = 1 THEN 'accepted' ELSE 'removed' END AS status,
  CASE WHEN rn = 1 THEN '' WHEN prio < top THEN 'lower_priority_split_removed' ELSE 'same_split_exact_duplicate_removed' END AS reason FROM g""")
def win02_leakage_resolution(spark, sf_dir):
    return dedup.leakage_resolution(manifest(spark, sf_dir)).select("image", "dataset", "split", "status", "reason")


@query(f"""
WITH m AS (SELECT *, sha256(language || ':' || length(text)) AS k FROM ({_MANIFEST})), p AS (SELECT *, CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END AS prio, {_SCORE} AS score FROM m),
g AS (SELECT *, max(prio) OVER (PARTITION BY k) AS top, min(prio) OVER (PARTITION BY k) AS low, min(text) OVER (PARTITION BY k) <> max(text) OVER (PARTITION BY k) AS texts,
 row_number() OVER (PARTITION BY k ORDER BY prio DESC, score DESC, dataset, image, source_row) AS rn FROM p),
r AS (SELECT split, CASE WHEN texts AND low < top THEN 'cross_split_conflicting_labels' WHEN texts THEN 'same_split_conflicting_labels' WHEN rn = 1 THEN '' WHEN prio < top THEN 'lower_priority_split_removed' ELSE 'same_split_exact_duplicate_removed' END AS reason FROM g)
SELECT split, reason, count(*) AS n FROM r GROUP BY ALL""")
def win03_conflicting_groups(spark, sf_dir):
    """Groups by language and length, so that whole texts within a group conflict."""
    m = manifest(spark, sf_dir).withColumn("sha256", F.sha2(F.concat_ws(":", "language", F.length("text")), 256))
    return dedup.leakage_resolution(m).groupBy("split", "reason").agg(F.count("*").alias("n"))


@query(f"""
SELECT sha256, count(*) AS n, CASE WHEN count(DISTINCT split) > 1 THEN 'cross_split_duplicate' WHEN count(DISTINCT text) > 1 THEN 'conflicting_label_duplicate' ELSE 'exact_duplicate' END AS reason,
 array_to_string(list_sort(list(DISTINCT split)), '|') AS splits, array_to_string(list_sort(list(DISTINCT dataset)), '|') AS datasets, min(image) AS first_image
FROM ({_MANIFEST}) GROUP BY sha256 HAVING count(*) > 1""")
def agg05_duplicate_report(spark, sf_dir):
    return dedup.duplicate_report(manifest(spark, sf_dir)).drop("n_texts")


@query("SELECT d.doc_id, d.source FROM documents d WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)")
def jon01_conflict_semi_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(dedup.conflicting_keys(d, "h", "source"), "h", "left_semi").select("doc_id", "source")


@query("SELECT d.doc_id, d.source FROM documents d WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)")
def jon02_conflict_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(dedup.conflicting_keys(d, "h", "source"), "h", "left_anti").select("doc_id", "source")


@query("""
SELECT doc_id, n_norm, n_strip, n_spaceless, n_words FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\\s\\x{00A0}]+', ' ', 'g')) AS t, text FROM documents) x,
LATERAL (SELECT length(t) AS n_norm, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_strip, length(regexp_replace(text, '[\\s\\x{00A0}]+', '', 'g')) AS n_spaceless, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words) y""")
def str01_normalized_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(T.normalize(F.col("text"))).alias("n_norm"), F.length(T.strip(F.col("text"))).alias("n_strip"), F.length(T.remove_spaces(F.col("text"))).alias("n_spaceless"), T.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT language, score, count(*) AS n FROM (SELECT language, {_SCORE} AS score FROM ({_MANIFEST})) GROUP BY ALL")
def str05_script_score(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.select("language", T.script_score(F.col("text"), F.col("language"), F.col("source_type"), F.col("domain")).alias("score")).groupBy("language", "score").agg(F.count("*").alias("n"))


_SYM = "[^\\p{L}\\p{N}\\s.,!?''\"()-]"


@query(f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN contains(text, '_') THEN 'underscore' END,
 CASE WHEN regexp_matches(text, '{_SYM}') THEN 'unusual_symbols:' || array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_SYM}'))), '') END], lambda x: x IS NOT NULL), ';') AS review_reason FROM documents""")
def flt05_review_reasons_symbols(spark, sf_dir):
    return quality.route(table(spark, sf_dir, "documents"), quality.reasons_symbols(F.col("text"))).select("doc_id", "review_reason")


@query("""
SELECT status, review_reason, count(*) AS n FROM (SELECT r AS review_reason, CASE WHEN r = '' THEN 'clean' ELSE 'review' END AS status FROM (SELECT array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty_text' END,
 CASE WHEN contains(text, '_') THEN 'underscore' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin_character' END, CASE WHEN regexp_matches(text, '[0-9\\x{0660}-\\x{0669}]') THEN 'digit' END,
 CASE WHEN length(text) > 60 THEN 'long_label' END], lambda x: x IS NOT NULL), ';') AS r FROM documents)) GROUP BY ALL""")
def flt06_clean_review_counts(spark, sf_dir):
    return quality.route(table(spark, sf_dir, "documents"), quality.reasons_script(F.col("text"))).groupBy("status", "review_reason").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN lang <> 'en' THEN 'annotation_status:' || lang END,
 CASE WHEN len(list_filter(string_split_regex(text, '[\\s\\x{00A0}]+'), lambda w: w <> '')) > 1 THEN 'multiword' END, CASE WHEN length(text) > 80 THEN 'long_label' END,
 CASE WHEN regexp_matches(text, '\\pC') THEN 'control_character:U+' || lpad(printf('%X', unicode(regexp_extract(text, '\\pC'))), 4, '0') END], lambda x: x IS NOT NULL), ';') AS review_reason FROM documents""")
def flt07_review_reasons_words(spark, sf_dir):
    status = F.when(F.col("lang") == "en", "ok").otherwise(F.col("lang"))
    return quality.route(table(spark, sf_dir, "documents"), quality.reasons_words(F.col("text"), status)).select("doc_id", "review_reason")


@query("SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN regexp_matches(text, '\\pC') THEN 'control_character' END, CASE WHEN length(text) > 100 THEN 'long_label' END], lambda x: x IS NOT NULL)) AS issue FROM documents) GROUP BY 1")
def flt08_scene_issue_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(quality.reasons_scene(F.col("text"))).alias("issue"))
    return d.groupBy("issue").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN n_chars <= 0 THEN 'empty_image' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'invalid_language' WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'invalid' WHEN n_chars > 10000 THEN 'dimensions' END AS error
FROM documents LEFT JOIN labels USING (doc_id)""")
def flt09_validation_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    failure = quality.first_failure((F.trim("text") == "", "empty_text"), (F.col("n_chars") <= 0, "empty_image"), (~F.col("lang").isin("en", "fr", "de"), "invalid_language"), (F.col("quality").isNull(), "missing"), (F.col("quality") == 0, "invalid"), (F.col("n_chars") > 10000, "dimensions"))
    return d.select("doc_id", failure.alias("error"))


@query("""
SELECT doc_id, unnest(list_filter([CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars <> length(text) THEN 'length_mismatch' END, CASE WHEN n_chars > 5000 THEN 'long' END], lambda x: x IS NOT NULL)) AS issue
FROM documents LEFT JOIN labels USING (doc_id)""")
def flt10_validation_issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.all_failures(d, ["doc_id"], (F.col("quality").isNull(), "no_label"), (F.col("quality") == 0, "low_quality"), (F.col("toxic") == 1, "toxic"), (F.col("n_chars") != F.length("text"), "length_mismatch"), (F.col("n_chars") > 5000, "long"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '^\\s*[0-9]') THEN 'starts_with_number' END, CASE WHEN regexp_matches(text, '[0-9]{5,}') THEN 'residual_boundary_id' END, CASE WHEN trim(text) = '' THEN 'empty_text' END], lambda x: x IS NOT NULL), ';') AS quarantine_reason FROM conversations""")
def flt11_quarantine_reasons(spark, sf_dir):
    d = quality.quarantine(table(spark, sf_dir, "conversations"), (F.col("text").rlike("^\\s*[0-9]"), "starts_with_number"), (F.col("text").rlike("[0-9]{5,}"), "residual_boundary_id"), (F.trim("text") == "", "empty_text"))
    return d.select("conv_id", "turn", F.coalesce("quarantine_reason", F.lit("")).alias("quarantine_reason"))


@query("SELECT lang, count(*) AS n FROM documents WHERE trim(text) <> '' AND lang NOT IN ('es') AND source IS NOT NULL GROUP BY lang")
def flt01_filters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.trim("text") != "") & ~F.col("lang").isin("es")).na.drop(subset=["source"])
    return d.groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(nullif(CAST(l.quality AS VARCHAR), ''), nullif(d.lang, ''), '') AS label, coalesce(nullif(d.source, ''), 'real') AS source_type FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def prj01_alias_coalesce(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    j = l.join(d, "doc_id", "full_outer")
    return j.select("doc_id", T.first_filled(F.col("quality").cast("string"), F.col("lang")).alias("label"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("real")).alias("source_type"))


@query("SELECT c_custkey, n_name, r_name, CASE WHEN n_name IS NULL THEN 'no_match' ELSE 'ok' END AS status FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jon03_dimension_lookup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("c_custkey", "n_name", "r_name", F.when(F.col("n_name").isNull(), "no_match").otherwise("ok").alias("status"))


@query(f"SELECT r.usage_scope, m.split, count(*) AS n FROM ({_MANIFEST}) m JOIN (VALUES ('en', 'primary'), ('fr', 'extra'), ('de', 'extra')) r(language, usage_scope) ON m.language = r.language GROUP BY ALL")
def jon04_registry_join(spark, sf_dir):
    registry = spark.createDataFrame([("en", "primary"), ("fr", "extra"), ("de", "extra")], "language string, usage_scope string")
    return manifest(spark, sf_dir).join(F.broadcast(registry), "language").groupBy("usage_scope", "split").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01')
SELECT 'unseen' AS kind, l_partkey FROM (SELECT * FROM o EXCEPT SELECT * FROM t) UNION ALL SELECT 'shared', l_partkey FROM (SELECT * FROM o INTERSECT SELECT * FROM t)""")
def set03_unseen_labels(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    cut = F.to_timestamp(F.lit("1995-01-01"))
    t, o = l.where(F.col("l_shipdate") < cut).select("l_partkey").distinct(), l.where(F.col("l_shipdate") >= cut).select("l_partkey").distinct()
    return o.subtract(t).select(F.lit("unseen").alias("kind"), "l_partkey").unionByName(o.intersect(t).select(F.lit("shared").alias("kind"), "l_partkey"))


@query(f"SELECT a, b, count(*) AS n FROM (SELECT least(x.split, y.split) AS a, greatest(x.split, y.split) AS b, x.sha256 FROM (SELECT DISTINCT split, sha256 FROM ({_MANIFEST})) x JOIN (SELECT DISTINCT split, sha256 FROM ({_MANIFEST})) y ON x.sha256 = y.sha256 AND x.split < y.split) GROUP BY ALL")
def set02_split_leakage(spark, sf_dir):
    h = manifest(spark, sf_dir).select("split", "sha256").distinct()
    y = h.select(F.col("split").alias("b"), F.col("sha256").alias("h2"))
    j = h.withColumnRenamed("split", "a").join(y, (F.col("sha256") == F.col("h2")) & (F.col("a") < F.col("b")))
    return j.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT src, count(*) AS n, count(DISTINCT key) AS n_keys FROM (SELECT 'customer' AS src, c_nationkey AS key FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY src")
def set01_union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_nationkey").alias("key"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.col("s_nationkey").alias("key"))
    return c.unionByName(s).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query("SELECT DISTINCT lang AS key FROM documents UNION SELECT DISTINCT role FROM conversations")
def set04_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("key")).union(table(spark, sf_dir, "conversations").select("role")).distinct()


@query("SELECT conv_id, turn, role, CASE WHEN rn = 1 THEN 'first' WHEN role = first_role THEN 'same_label_duplicate' ELSE 'conflicting_duplicate' END AS kind FROM (SELECT *, row_number() OVER w AS rn, first_value(role) OVER w AS first_role FROM conversations WINDOW w AS (PARTITION BY text ORDER BY conv_id, turn))")
def win01_keep_first(spark, sf_dir):
    d = dedup.keep_first(table(spark, sf_dir, "conversations"), ["text"], [F.col("conv_id"), F.col("turn")], "role")
    return d.select("conv_id", "turn", "role", "kind")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def win07_duplicated(spark, sf_dir):
    return dedup.duplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id")


@query("""
WITH h AS (SELECT page_id, sha256('42:' || page_id) AS split_hash FROM pages), r AS (SELECT *, row_number() OVER (ORDER BY split_hash, page_id) AS rn, count(*) OVER () AS n FROM h)
SELECT page_id, split_hash, CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' WHEN rn <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def win04_page_rank_split(spark, sf_dir):
    return splits.rank_split(table(spark, sf_dir, "pages").select("page_id"), "page_id")


@query("WITH s AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r <= 4 THEN 'test' WHEN r <= 8 THEN 'val' ELSE 'train' END AS split FROM documents JOIN s USING (source)")
def win05_writer_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.attach_split(d, splits.last_units_split(d, "source"), "source").select("doc_id", "split")


@query(f"SELECT source, {_BUCKET} AS bucket, {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL")
def str19_bucket_split(spark, sf_dir):
    b = N.sha1_bucket(F.col("source"))
    return table(spark, sf_dir, "documents").groupBy("source", b.alias("bucket"), N.ratio_split(b).alias("split")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang FROM r ORDER BY r > 25, doc_id LIMIT 100")
def win06_balanced_first(spark, sf_dir):
    return splits.balanced_first(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 100, 4)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE list_contains(list_transform(range(0, 20), lambda p: CAST(round_even(p * (n - 1) / 19.0, 0) AS BIGINT)), i)")
def win11_evenly_spaced(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return splits.evenly_spaced(d, [F.col("doc_id")], F.floor(F.col("doc_id") / 4096), 20)


@query("SELECT doc_id, batch_id FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 32) AS BIGINT) AS batch_id FROM documents)")
def win12_bucket_batches(spark, sf_dir):
    return splits.bucket_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 32, "doc_id").select("doc_id", "batch_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50")
def srt07_random_sample(spark, sf_dir):
    return splits.random_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7)


@query("""
WITH q(lang, quota) AS (VALUES ('en', 70), ('fr', 40), ('de', 30), ('es', 300)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY sha256('42:' || doc_id), doc_id) AS r, n, quota FROM documents d JOIN n ON n.lang = d.lang JOIN q ON q.lang = d.lang),
t AS (SELECT *, quota // n + CASE WHEN r <= quota % n THEN 1 ELSE 0 END AS t FROM r) SELECT doc_id, lang, CAST(unnest(range(1, t + 1)) AS INTEGER) AS copy FROM t WHERE t > 0""")
def srt08_stratified_sample(spark, sf_dir):
    quotas = spark.createDataFrame([("en", 70), ("fr", 40), ("de", 30), ("es", 300)], "lang string, quota bigint")
    return splits.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", quotas)


@query("SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def agg21_first_k_examples(spark, sf_dir):
    return ranking.first_k_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], 5, F.desc("n_chars"), F.col("doc_id"))


@query(f"SELECT coalesce(split, 'ALL') AS split, coalesce(dataset, 'ALL') AS dataset, count(*) AS n FROM ({_MANIFEST}) GROUP BY ROLLUP (split, dataset)")
def agg23_split_rollup(spark, sf_dir):
    return profiles.rollup_counts(manifest(spark, sf_dir), "split", "dataset")


@query(f"SELECT 'all' AS view, 'all' AS value, count(*) AS n FROM documents UNION ALL SELECT 'split', split, count(*) FROM ({_MANIFEST}) GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM ({_MANIFEST}) GROUP BY 2 UNION ALL SELECT 'dataset', dataset, count(*) FROM ({_MANIFEST}) GROUP BY 2")
def snk10_fanout_counts(spark, sf_dir):
    return profiles.fan_out(manifest(spark, sf_dir), ["split", "language", "dataset"])


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, min(n_chars) AS least, max(n_chars) AS most, sum(n_chars) AS total FROM documents GROUP BY ALL ORDER BY n DESC")
def agg03_grouped_counts(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", "lang")
    return g.agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (trim(text) = '') AS empty_text, count(*) FILTER (trim(source) = '') AS missing_path, count(DISTINCT text) AS distinct_texts FROM documents")
def agg25_manifest_profile(spark, sf_dir):
    return profiles.manifest_profile(table(spark, sf_dir, "documents"), "text", "source")


@query("""
WITH l AS (SELECT 'l_partkey' AS candidate, CAST(l_partkey AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem UNION ALL SELECT 'l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem),
s AS (SELECT candidate, value, count(*) AS n FROM l GROUP BY ALL)
SELECT candidate, 100.0 * sum(n) FILTER (value IS NOT NULL) / sum(n) AS coverage, count(*) AS n_groups, count(*) FILTER (n = 1) AS singletons, min(n) AS min_size, median(n) AS median_size, avg(n) AS mean_size, max(n) AS max_size FROM s GROUP BY candidate""")
def agg07_group_profile(spark, sf_dir):
    return profiles.group_profile(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"])


@query("SELECT min(w) AS least, median(w) AS middle, max(w) AS most, count(*) AS n FROM (SELECT conv_id, sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(list_filter(string_split_regex(text, '[\\s\\x{00A0}]+'), lambda x: x <> '')) END) AS w FROM conversations GROUP BY 1)")
def agg20_words_per_page(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.word_count(F.coalesce("text", F.lit("")))).alias("w"))
    return ranges.quantiles(pages, "w", (0.5,)).select(F.col("least").cast("bigint").alias("least"), F.col("q")[0].alias("middle"), F.col("most").cast("bigint").alias("most"), F.col("n_values").alias("n"))


@query("SELECT quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99, min(n_chars) AS min, avg(n_chars) AS mean, max(n_chars) AS max FROM documents")
def agg16_percentiles(spark, sf_dir):
    return profiles.percentiles(table(spark, sf_dir, "documents"), "n_chars")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS loss FROM events GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d),
i AS (SELECT *, best_before IS NULL OR loss < best_before AS improved FROM b), s AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY day) AS streak FROM i)
SELECT CAST(day AS VARCHAR) AS day, round(loss, 6) AS loss, round(best_before, 6) AS best_before, improved, row_number() OVER (PARTITION BY streak ORDER BY day) - 1 AS bad_rows FROM s""")
def win10_running_best(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    d = profiles.running_best(days, "day", "loss")
    return d.select(F.col("day").cast("string").alias("day"), F.round("loss", 6).alias("loss"), F.round("best_before", 6).alias("best_before"), "improved", "bad_rows")


@query("""
WITH b AS (SELECT event_id, value, min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, ts FROM events),
i AS (SELECT *, best_before IS NULL OR coalesce(value < best_before, false) AS improved FROM b), s AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY ts, event_id) AS streak FROM i)
SELECT event_id, best_before, improved, row_number() OVER (PARTITION BY streak ORDER BY ts, event_id) - 1 AS bad_rows FROM s""")
def win10_running_best_rows(spark, sf_dir):
    """The running best over every event in the order of time, scanned in ranges."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ranges.running_best(events, [F.col("ts"), F.col("event_id")], "value").select("event_id", "best_before", "improved", "bad_rows")


@query("SELECT doc_id, CAST(lower(trim(CAST(q AS VARCHAR))) IN ('true', '1', 'yes', 'y') AS BOOLEAN) AS flag FROM (SELECT doc_id, quality AS q FROM labels)")
def flt16_boolean_text(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", T.as_boolean(F.col("quality").cast("string")).alias("flag"))


@query("SELECT sha256, 'images/' || substr(sha256, 1, 2) || '/' || sha256 || '.png' AS packed FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents)")
def snk08_content_addresses(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")).dropDuplicates(["sha256"])
    return h.select("sha256", F.concat(F.lit("images/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256", T.safe_suffix(F.lit(".png"))).alias("packed"))


@query("SELECT base, count(DISTINCT url) AS n_paths FROM (SELECT url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages) GROUP BY 1 HAVING count(DISTINCT url) > 1")
def snk09_basename_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", T.filename(F.col("url")).alias("base"))
    return p.groupBy("base").agg(F.countDistinct("url").alias("n_paths")).where("n_paths > 1")


@query("SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS inventory FROM documents GROUP BY source")
def snk05_inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("inventory"))


@query("""
WITH t AS (SELECT c_custkey AS k, c_nationkey AS n, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS m FROM customer) SELECT k, n, CASE WHEN c = 1 THEN 'unique' ELSE 'shared' END AS kind FROM (SELECT k, n, count(*) OVER (PARTITION BY n) AS c FROM t)""")
def jon06_stem_if_unique(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    per = c.groupBy("n").agg(F.count("*").alias("c"))
    return c.join(per, "n").select("k", "n", F.when(F.col("c") == 1, "unique").otherwise("shared").alias("kind"))
