"""Evaluation: error rates, grouped metrics, ranks, feasibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bidi
from ..functions import numeric as N
from ..functions import text as T
from ..operators import decoding, feasibility, metrics, profiles, ranking
from .registry import query, table


def pairs(spark, sf_dir):
    """Neighbouring conversation turns, as reference and prediction."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("prediction", F.lead("text").over(w)).withColumnRenamed("text", "reference").where("prediction IS NOT NULL")


#: DuckDB's levenshtein counts bytes, so a pair's characters become the bytes 1 to 127 (a pair has fewer), and so do the
#: words that both texts have; the other words of a text match nothing and share one byte, each text its own.
_PAIRS = "SELECT * FROM (SELECT conv_id, turn, role, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations) WHERE prediction IS NOT NULL"
_BYTES = "(SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) FROM range(1, 128) t(i))"
_SIGNS = f"SELECT *, array_to_string(list_distinct(string_split(reference || prediction, '')), '') AS signs FROM ({_PAIRS})"
_DIST = f"SELECT *, levenshtein(translate(reference, signs, {_BYTES}), translate(prediction, signs, {_BYTES})) AS cd, length(reference) AS rc, reference = prediction AS exact FROM ({_SIGNS})"
_WORDS = f"SELECT *, list_filter(string_split_regex(reference, '\\s+'), lambda w: w <> '') AS rw, list_filter(string_split_regex(prediction, '\\s+'), lambda w: w <> '') AS pw FROM ({_DIST})"
_COMMON = f"SELECT *, list_distinct(list_intersect(rw, pw)) AS common FROM ({_WORDS})"
_WORD_BYTES = "array_to_string(list_transform({words}, lambda w: chr(CAST(coalesce(list_position(common, w) + 2, {own}) AS INTEGER))), '')"
_WORD_DIST = f"SELECT *, levenshtein({_WORD_BYTES.format(words='rw', own=1)}, {_WORD_BYTES.format(words='pw', own=2)}) AS wd FROM ({_COMMON})"


@query(f"SELECT role, count(*) AS samples, round(sum(cd) / sum(greatest(rc, 1)), 9) AS cer, avg(CAST(exact AS DOUBLE)) AS exact_match FROM ({_DIST}) GROUP BY role")
def agg09_cer_corpus(spark, sf_dir):
    d = metrics.with_distances(pairs(spark, sf_dir))
    return metrics.corpus_metrics(d, "role").select("role", "samples", F.round("cer", 9).alias("cer"), "exact_match")


@query(f"SELECT role, count(*) FILTER (trim(reference) <> '') AS samples, round(coalesce(sum(cd) FILTER (trim(reference) <> '') / nullif(sum(rc) FILTER (trim(reference) <> ''), 0), 0), 9) AS cer FROM ({_DIST}) GROUP BY role")
def agg10_cer_nonblank(spark, sf_dir):
    d = metrics.with_distances(pairs(spark, sf_dir))
    return metrics.nonblank_metrics(d, "role").select("role", "samples", F.round("cer", 9).alias("cer"))


@query(f"SELECT conv_id, turn, cd AS char_distance, round(CASE WHEN rc > 0 THEN cd / rc WHEN cd > 0 THEN 1.0 ELSE 0.0 END, 9) AS cer, NOT exact AND regexp_replace(reference, '\\s+', '', 'g') = regexp_replace(prediction, '\\s+', '', 'g') AS spacing_only FROM ({_DIST})")
def str15_pair_evaluation(spark, sf_dir):
    d = metrics.with_distances(pairs(spark, sf_dir))
    return d.select("conv_id", "turn", "char_distance", F.round(metrics.row_rate(F.col("char_distance"), F.col("ref_chars")), 9).alias("cer"), "spacing_only")


@query(f"SELECT role, count(*) AS samples, round(sum(cd) / sum(greatest(rc, 1)), 9) AS cer, round(sum(wd) / sum(greatest(len(rw), 1)), 9) AS wer, avg(CAST(exact AS DOUBLE)) AS exact_match FROM ({_WORD_DIST}) GROUP BY role")
def agg10_wer_corpus(spark, sf_dir):
    """Character and word error rates by role."""
    d = metrics.corpus_metrics(metrics.with_distances(pairs(spark, sf_dir)), "role")
    return d.select("role", "samples", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "exact_match")


@query()
def agg17_confusions(spark, sf_dir):
    """Counts of word-level edits by alignment."""
    return metrics.confusions(pairs(spark, sf_dir), "word")


@query()
def agg11_edit_breakdown(spark, sf_dir):
    return metrics.edit_breakdown(pairs(spark, sf_dir), "word", "role")


@query()
def srt02_top_confusions(spark, sf_dir):
    return ranking.top_k(metrics.confusions(pairs(spark, sf_dir), "word"), 20, F.desc("n"), F.col("op"), F.col("ref"), F.col("pred"))


@query(f"SELECT conv_id, turn, cd AS char_distance FROM ({_DIST}) ORDER BY cd DESC, conv_id, turn LIMIT 25")
def srt03_worst_examples(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("char_distance", metrics.char_distance(F.col("reference"), F.col("prediction")))
    return ranking.top_k(d, 25, F.desc("char_distance"), F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "char_distance")


_METRICS = "count(*) AS n, sum(n_chars) AS chars, median(n_chars) AS median_chars, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (quality = 1) AS good"
_BUCKET = "CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 1000 THEN '(500,1000]' WHEN n_chars <= 5000 THEN '(1000,5000]' ELSE '>5000' END"


@query(f"""
WITH d AS (SELECT *, {_BUCKET} AS length_bucket FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'overall' AS dimension, NULL AS value, {_METRICS} FROM d UNION ALL SELECT 'lang', lang, {_METRICS} FROM d GROUP BY lang UNION ALL SELECT 'source', source, {_METRICS} FROM d GROUP BY source UNION ALL SELECT 'length_bucket', length_bucket, {_METRICS} FROM d GROUP BY length_bucket""")
def agg12_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("length_bucket", N.buckets(F.col("n_chars"), [500, 1000, 5000]))
    return metrics.by_dimensions(d, ["lang", "source", "length_bucket"], {"n": "count(*)", "chars": "sum(n_chars)", "mean_chars": "round(avg(n_chars), 6)", "good": "count_if(quality = 1)"}, {"median_chars": "n_chars"})


@query("SELECT length_bucket, words_bucket, count(*) AS n FROM (SELECT CASE WHEN l <= 5 THEN '<=5' WHEN l <= 10 THEN '(5,10]' WHEN l <= 20 THEN '(10,20]' WHEN l <= 40 THEN '(20,40]' WHEN l <= 80 THEN '(40,80]' ELSE '>80' END AS length_bucket, CASE WHEN w <= 1 THEN '<=1' WHEN w <= 2 THEN '(1,2]' WHEN w <= 5 THEN '(2,5]' WHEN w <= 10 THEN '(5,10]' ELSE '>10' END AS words_bucket FROM (SELECT length(text) AS l, len(list_filter(string_split_regex(text, '[\\s\\x{00A0}]+'), lambda x: x <> '')) AS w FROM conversations)) GROUP BY ALL")
def mth05_buckets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(N.buckets(F.length("text"), N.LENGTH_EDGES).alias("length_bucket"), N.buckets(T.word_count(F.col("text")), N.WORD_EDGES).alias("words_bucket")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 10) AS rho, count(*) AS n FROM r""")
def agg15_spearman(spark, sf_dir):
    return ranking.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 10).alias("rho"), "n")


@query("""
WITH s AS (SELECT doc_id, n_chars % 97 AS acoustic, n_chars % 13 AS lm, n_chars % 7 AS n_words FROM documents), g(setting, lm_weight, word_bonus) AS (VALUES ('lm_0p1', 0.1, 0.0), ('lm_0p5', 0.5, 0.5), ('lm_1p0', 1.0, 1.0)),
c AS (SELECT s.doc_id, setting, 'a' AS candidate, acoustic + lm_weight * lm + word_bonus * n_words AS score FROM s, g UNION ALL SELECT s.doc_id, setting, 'b', 50 + lm_weight * (12 - lm) + word_bonus * (6 - n_words) FROM s, g)
SELECT doc_id, setting, arg_max(candidate, {'s': score, 'c': candidate}) AS candidate, round(max(score), 6) AS score FROM c GROUP BY doc_id, setting""")
def jon10_best_setting(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("x"), (F.col("n_chars") % 13).alias("l"), (F.col("n_chars") % 7).alias("w"))
    c = d.select("doc_id", F.lit("a").alias("candidate"), F.col("x").cast("double").alias("acoustic"), F.col("l").alias("lm"), F.col("w").alias("n_words")).unionByName(d.select("doc_id", F.lit("b").alias("candidate"), F.lit(50.0).alias("acoustic"), (12 - F.col("l")).alias("lm"), (6 - F.col("w")).alias("n_words")))
    grid = spark.createDataFrame([("lm_0p1", 0.1, 0.0), ("lm_0p5", 0.5, 0.5), ("lm_1p0", 1.0, 1.0)], "setting string, lm_weight double, word_bonus double")
    return metrics.best_setting(c, grid, "doc_id").withColumn("score", F.round("score", 6))


@query("SELECT arg_min(source, {'w': wer, 'c': cer, 's': source}) AS best FROM (SELECT source, round(avg(n_chars), 6) AS wer, min(n_chars) AS cer FROM documents GROUP BY source)")
def srt05_best_by_metrics(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("wer"), F.min("n_chars").alias("cer"))
    return g.agg(F.min_by("source", F.struct("wer", "cer", "source")).alias("best"))


@query("SELECT source, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source ORDER BY mean_chars DESC, source LIMIT 1")
def srt06_worst_group(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return ranking.top_k(g, 1, F.desc("mean_chars"), F.col("source"))


@query("""
WITH b AS (SELECT doc_id, length(text) AS target_length, CAST(len(list_filter(list_zip(string_split(text, '')[:-2], string_split(text, '')[2:]), lambda p: p[1] = p[2])) AS INTEGER) AS adjacent_repeats, CAST(least(greatest(round_even(n_chars * 64 / 32.0, 0), 1), 16384) AS INTEGER) AS resized_width, lang FROM documents),
f AS (SELECT *, target_length + adjacent_repeats AS required_timesteps, greatest(resized_width // 4, 1) AS available_timesteps FROM b)
SELECT doc_id, target_length, adjacent_repeats, resized_width, required_timesteps, available_timesteps, CASE WHEN lang = 'es' THEN 'out_of_vocabulary' WHEN available_timesteps < required_timesteps THEN 'insufficient_timesteps' ELSE '' END AS reason FROM f""")
def flt13_ctc_feasibility(spark, sf_dir):
    d = feasibility.ctc_feasibility(table(spark, sf_dir, "documents"), F.col("text"), F.col("n_chars"), F.lit(32), F.col("lang") == "es", 64, 16384)
    return d.select("doc_id", "target_length", "adjacent_repeats", "resized_width", "required_timesteps", "available_timesteps", "reason")


@query("SELECT CASE WHEN regexp_matches(text, '^[\\p{Nd}\\s.,:;/\\\\+\\-()%]+$') AND regexp_matches(text, '\\p{Nd}') THEN 'numeric_like' WHEN len(list_filter(string_split_regex(text, '[\\s\\x{00A0}]+'), lambda x: x <> '')) <= 1 THEN 'single_word' ELSE 'multi_word' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def flt17_text_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.text_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < l_discount THEN 'improved' WHEN l_tax > l_discount THEN 'hurt' WHEN l_partkey % 7 < l_suppkey % 7 THEN 'improved' WHEN l_partkey % 7 > l_suppkey % 7 THEN 'hurt' ELSE 'unchanged' END AS impact FROM lineitem")
def flt18_impact(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", metrics.impact(F.col("l_discount"), F.col("l_tax"), F.col("l_suppkey") % 7, F.col("l_partkey") % 7).alias("impact"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_tax = 0) AS untaxed FROM lineitem GROUP BY ALL")
def agg14_condition_counts(spark, sf_dir):
    return profiles.condition_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"discounted": F.col("l_discount") > 0.05, "untaxed": F.col("l_tax") == 0})


@query("SELECT decoder, count(*) AS n, sum(v) AS total FROM (SELECT 'l_quantity' AS decoder, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY decoder")
def prj11_wide_to_long(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").unpivot([], ["l_quantity", "l_tax"], "decoder", "v")
    return long.groupBy("decoder").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE 0.0 END AS unit_price, CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0.0 END AS tax_ratio FROM lineitem")
def prj09_safe_ratios(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", N.safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"), N.safe_div(F.col("l_tax"), F.col("l_discount")).alias("tax_ratio"))


@query("SELECT c_custkey, round(m + ln(list_sum(list_transform(a, lambda x: exp(x - m)))), 6) AS total FROM (SELECT c_custkey, [c_acctbal / 1000, -c_acctbal / 1000, c_nationkey] AS a, greatest(c_acctbal / 1000, -c_acctbal / 1000, c_nationkey) AS m FROM customer)")
def mth02_log_add(spark, sf_dir):
    a = F.array(F.col("c_acctbal") / 1000, -F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(N.log_add(a), 6).alias("total"))


_FRAME = " UNION ALL ".join(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, {k} AS c, (1 + CAST('0x' || substr(sha256(text || '{k}'), 1, 8) AS BIGINT) % 97) / 600.0 AS p FROM conversations" for k in range(6))


@query(f"""
WITH RECURSIVE f AS MATERIALIZED ({_FRAME}), n AS (SELECT conv_id, max(t) AS n FROM f GROUP BY 1),
beams AS (SELECT conv_id, 0 AS t, [0][2:] AS x, 1.0::DOUBLE AS b, 0.0::DOUBLE AS s FROM n UNION ALL
 SELECT conv_id, t, x, b, s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(ln(b + s), 9) DESC, x) AS k FROM (
  SELECT conv_id, t, x, sum(b) AS b, sum(s) AS s FROM (
   SELECT o.conv_id, f.t, unnest(CASE WHEN f.c = 0 THEN [{{'x': o.x, 'b': (o.b + o.s) * f.p, 's': 0.0}}] WHEN len(o.x) > 0 AND o.x[-1] = f.c THEN [{{'x': o.x, 'b': 0.0, 's': o.s * f.p}}, {{'x': list_append(o.x, f.c), 'b': 0.0, 's': o.b * f.p}}] ELSE [{{'x': list_append(o.x, f.c), 'b': 0.0, 's': (o.b + o.s) * f.p}}] END, recursive := true)
   FROM beams o JOIN f ON f.conv_id = o.conv_id AND f.t = o.t + 1) GROUP BY ALL) WHERE b + s > 0) WHERE k <= 5)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY round(ln(b + s), 9) DESC, x) - 1 AS INTEGER) AS rank, array_to_string(x, ',') AS indices, round(ln(b + s), 6) AS log_prob FROM beams JOIN n USING (conv_id) WHERE t = n""")
def udf04_beam_search(spark, sf_dir):
    """Beams over frame scores made from each conversation's turns (six symbols, a frame for each turn)."""
    c = table(spark, sf_dir, "conversations")
    digits = lambda k: F.conv(F.substring(F.sha2(F.concat("text", F.lit(str(k))), 256), 1, 8), 16, 10).cast("bigint")
    score = F.array(*(F.ln((1 + digits(k) % 97) / 600.0) for k in range(6)))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", score.alias("s")))).alias("t")).select("conv_id", F.transform("t", lambda x: x["s"]).alias("frames"))
    d = decoding.beam_search(rows, "conv_id", "frames", beam=5)
    return d.select("conv_id", "rank", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.round("log_prob", 6).alias("log_prob"))


#: Logical texts and what is seen: Hebrew and Arabic runs turn, numbers in them don't, brackets mirror.
_VISUAL = [("plain words (1)", "plain words (1)"), ("\u05d0\u05d1\u05d2", "\u05d2\u05d1\u05d0"), ("abc \u05d0\u05d1 def", "abc \u05d1\u05d0 def"), ("\u05d0\u05d1 12 \u05d2", "\u05d2 12 \u05d1\u05d0"), ("(\u05d0\u05d1)", "(\u05d1\u05d0)"), ("\u0633\u0644\u0627\u0645", "\u0645\u0627\u0644\u0633"), ("x = \u05d0 + \u05d1;", "x = \u05d1 + \u05d0;")]


@query("SELECT doc_id, CASE doc_id % {n} {cases} END AS visual FROM documents".format(n=len(_VISUAL), cases=" ".join(f"WHEN {i} THEN '{seen}'" for i, (_, seen) in enumerate(_VISUAL))))
def str06_visual_order(spark, sf_dir):
    """Each document's number picks a logical text; right-to-left runs turn."""
    logical = F.element_at(F.array(*(F.lit(t) for t, _ in _VISUAL)), (F.col("doc_id") % len(_VISUAL) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", bidi.visual(logical).alias("visual"))
