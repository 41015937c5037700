"""Benchmark the headline jobs on one scale factor; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Timed (each over the whole table, result fully collected; one warm run, then the median of three):
  quality_scan      – full quality scan of ``documents`` (the flagship; one file, one row group)
  quality_scan_shards – the same over ``documents`` cut into Parquet shards (many tasks)
  analytics_report  – one-pass analytics report of ``documents`` + stored token lists (written untimed)
  search_all        – all-column search for a common word, all matches
  search_page       – page 2 of that search's results
  first_page        – browse page 0 (100 rows)
  last_page         – browse the last page (index clamped)
  last_page_shards  – last page of ``documents`` cut into Parquet shards (shards written untimed)
  role_counts       – role markers over rendered conversations
  quality_scan_jsonl / last_page_jsonl – the same jobs over ``documents`` exported as JSON Lines
                      (export untimed; the JSON is parsed in every run)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shardlens import open_dataset  # noqa: E402
from shardlens.operators import paging, profile, search  # noqa: E402
from shardlens.plans import fixtures as X  # noqa: E402
from shardlens.session import get_spark  # noqa: E402


RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="shardlens-bench", shuffle_partitions=int(cpus) * 2)

    docs = X.documents(spark, sf_dir)
    tokens = open_dataset(spark, X.write_token_documents(spark, sf_dir))
    conv = X.conversations(spark, sf_dir, ordered=False)
    sharded = X.shards(spark, sf_dir)
    jsonl = open_dataset(spark, X.export_documents(spark, sf_dir, "jsonl"), kind="jsonl")
    # Warm-up: JVM start, range tables (written once per dataset), code generation.
    docs.ranges()
    sharded.ranges()
    jsonl.ranges()
    profile.quality_scan(docs).collect()

    jobs = {
        "quality_scan": lambda: profile.quality_scan(docs).collect(),
        "quality_scan_shards": lambda: profile.quality_scan(sharded).collect(),
        "analytics_report": lambda: profile.analytics_report(tokens, seq_len=1024).collect(),
        "search_all": lambda: search.search(docs, "the", match_names=True, match_nulls=True).select("__row_no").collect(),
        "search_page": lambda: search.search_page(docs, "the", 1, 100).collect(),
        "first_page": lambda: paging.browse(docs, 0, 100).collect(),
        "last_page": lambda: paging.browse(docs, 1 << 30, 100).collect(),
        "last_page_shards": lambda: paging.browse(sharded, 1 << 30, 100).collect(),
        "role_counts": lambda: profile.role_counts(conv).collect(),
        "quality_scan_jsonl": lambda: profile.quality_scan(jsonl).collect(),
        "last_page_jsonl": lambda: paging.browse(jsonl, 1 << 30, 100).collect(),
    }
    times = {}
    for name, job in jobs.items():
        job()  # warm run (code generation, JIT), not timed
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            job()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
