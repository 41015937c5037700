"""Write the physical plans of the headline jobs to PLANS.md.

    python scripts/explain_plans.py [sf_dir]

For each job: the operator tree of ``explain("formatted")`` and the Parquet
``ReadSchema`` lines (what column pruning left), so plan shape can be reviewed
without running anything.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shardlens.operators import paging, profile, search  # noqa: E402
from shardlens.plans import fixtures as X  # noqa: E402
from shardlens.session import get_spark  # noqa: E402


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    docs = X.documents(spark, sf)
    shards = X.shards(spark, sf)
    jobs = {
        "quality_scan (A7)": profile.quality_scan(docs),
        "analytics_report (A8)": profile.analytics_report(docs, with_files=False),
        "role_counts (A6)": profile.role_counts(X.conversations(spark, sf)),
        "search, all columns (F1)": search.search(docs, "the"),
        "search_stats, one column (F2, F10)": search.search_stats(docs, "the", column="lang"),
        "search_page (L6)": search.search_page(docs, "the", 1, 25),
        "browse, last page of shards (L2, P6)": paging.browse(shards, 1 << 30, 100),
        "row_to_shard (W2, W3)": paging.row_to_shard(shards),
    }
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `scripts/explain_plans.py` on `{sf}` (local[8], AQE on; final plans may coalesce "
           "shuffle partitions). Trees are `explain(\"formatted\")`; `ReadSchema` shows what the Parquet scan reads.",
           ""]
    for name, df in jobs.items():
        txt = formatted(df)
        tree = txt.split("\n\n\n")[0]
        reads = sorted(set(re.findall(r"ReadSchema: (.*)", txt)))
        out += [f"## {name}", "", "```", tree.strip(), *[f"ReadSchema: {r}" for r in reads], "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
