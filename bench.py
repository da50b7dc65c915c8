"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillspark.plans import registry

HEADLINE = [
    "win02_leakage_resolution", "agg05_duplicate_report", "str01_normalized_text", "flt05_review_reasons_symbols", "flt10_validation_issues", "win04_page_rank_split", "srt08_stratified_sample",
    "agg01_char_inventory", "agg22_oov_summary", "mth03_ngram_log_prob", "agg09_cer_corpus", "agg12_grouping_sets", "agg15_spearman", "agg16_percentiles", "flt13_ctc_feasibility", "agg07_group_profile", "src10_json_props", "prj07_html_blocks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["agg16_percentiles"](spark, sf_dir).collect()  # warm up the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
