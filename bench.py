"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and local[N]. Each query is run once to warm up and then three times; its
time is the median of writing its full result to Spark's no-op sink.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lectern.plans import catalog

HEADLINE = (
    "token_stats",
    "document_frequency",
    "bm25_topk",
    "dense_topk",
    "dense_mmr",
    "rrf_fusion",
    "chunk_fixed",
    "chunk_soft_boundary",
    "chunk_recursive",
    "chunk_atomic",
    "special_chunks",
    "chunk_segment_overlap",
    "pack_segments",
    "neighbor_context",
    "normalize_text",
    "strip_html",
    "chat_messages",
    "metric_summary",
    "ingest_pending",
    "prompt_assembly",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
