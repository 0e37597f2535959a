"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query writes its whole result to Spark's noop sink; the first, small run
of the session isn't counted.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from papersluice.plans import catalogue

NAMES = ["full_triage", "typed_documents", "decision_summary", "classify_documents", "explode_words", "ocr_confidence", "token_distribution", "extracted_fields", "field_confidence", "region_overlaps", "nms", "box_neighbours", "words_in_region", "business_rules_orders", "quality_gate"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["business_rules_orders"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    cards = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "triaged_docs_per_s": round(cards / took["full_triage"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
