"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

HEADLINE = (
    "doc_panel_metrics", "doc_text_stats", "doc_token_metrics", "doc_entropy", "doc_sentence_rhythm", "doc_ngram_repeat", "doc_paragraph_lines", "doc_academic_context", "doc_repeated_phrases", "doc_verdict", "doc_receipt_signals", "doc_panels",
    "benchmark_contamination", "page_html_text", "emb_hamming_topk", "emb_robust_z", "train_stats", "confusion_matrix", "event_session", "plan_lookup", "best_by_group", "weighted_fusion",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from glyphmill.plans import catalogue

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    queries["doc_entropy"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the executors' code
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
