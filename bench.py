"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Seconds per query: median of BENCH_RUNS runs after one warm-up run. Every run builds
its query anew and writes the whole result to a sink that keeps nothing.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pagesift.catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "page_links", "link_class_counts", "page_blocks", "content_density", "content_largest", "redirect_chain", "charset_detect", "robots_filter",
    "sentences", "tokens", "stem_dictionary", "ngrams", "vocab_top", "count_vectors", "tfidf_vectors",
    "oneclass_centroid", "oneclass_linear", "oneclass_kernel", "sentence_votes", "relevant_docs",
    "frontier_unique", "priority_step", "focused_traversal", "fetch_schedule", "crawl_report", "download_rate", "stream_score",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    rates = {f"{q}_pages_per_s": round(n_pages / seconds[q], 1) for q in ("content_density", "relevant_docs") if q in seconds}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "shuffle_partitions": int(cpus), "runs": runs, **rates,
    }))


if __name__ == "__main__":
    main()
