"""Command line: the viewer's actions as Spark jobs.

    python -m shardlens summary   PATH
    python -m shardlens schema    PATH
    python -m shardlens drift     PATH
    python -m shardlens page      PATH [--page N] [--size 100]
    python -m shardlens search    PATH QUERY [--column C] [--max N] [--page N] [--size 100] [--export OUT]
    python -m shardlens inspect   PATH ROW
    python -m shardlens analytics PATH [--sample N] [--seq-len 1024]
    python -m shardlens quality   PATH [--sample N] [--seq-len 1024]
    python -m shardlens export    PATH OUT [--format jsonl|json]

Results print as JSON lines (one per row). ``--master`` picks the Spark master;
without it the session's own (or ``local[*]``) is used.
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators import paging, profile, schema, search
from .session import get_spark
from .sources.dataset import open_dataset
from .sources.sinks import export


def _print(df, limit: int | None = None) -> None:
    rows = df.limit(limit).collect() if limit else df.collect()
    for r in rows:
        print(json.dumps({k: v for k, v in r.asDict(recursive=True).items() if not k.startswith("__")},
                         ensure_ascii=False, default=str))


def _positions(df):
    """Hit rows with their positions as ``match_no`` and ``row_no``, data columns after."""
    data = [c for c in df.columns if not c.startswith("__")]
    return df.select(df["__match_no"].alias("match_no"), df["__row_no"].alias("row_no"), *data)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shardlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("--master", default=None)
    ap.add_argument("--strict", action=argparse.BooleanOptionalAction, default=True,
                    help="one JSON/CSV file per folder (default)")
    ap.add_argument("--kind", choices=["parquet", "jsonl", "json", "csv"], default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("summary", "schema", "drift"):
        sub.add_parser(name).add_argument("path")
    p = sub.add_parser("page")
    p.add_argument("path")
    p.add_argument("--page", type=int, default=0)
    p.add_argument("--size", type=int, default=100, choices=paging.PAGE_SIZES)
    s = sub.add_parser("search")
    s.add_argument("path")
    s.add_argument("query")
    s.add_argument("--column", default=search.ALL_COLUMNS)
    s.add_argument("--max", type=int, default=None)
    s.add_argument("--page", type=int, default=0)
    s.add_argument("--size", type=int, default=100, choices=paging.PAGE_SIZES)
    s.add_argument("--match-names", action="store_true")
    s.add_argument("--match-nulls", action="store_true")
    s.add_argument("--export", default=None, help="write all hits as JSON Lines to this folder")
    i = sub.add_parser("inspect")
    i.add_argument("path")
    i.add_argument("row", type=int)
    for name in ("analytics", "quality"):
        a = sub.add_parser(name)
        a.add_argument("path")
        a.add_argument("--sample", type=int, default=None, help="first N rows only (default: all)")
        a.add_argument("--seq-len", type=int, default=profile.DEFAULT_SEQ_LEN)
    e = sub.add_parser("export")
    e.add_argument("path")
    e.add_argument("out")
    e.add_argument("--format", choices=["jsonl", "json"], default="jsonl")
    args = ap.parse_args(argv)

    spark = get_spark(args.master) if args.master else get_spark()
    if args.cmd == "drift":
        _print(schema.schema_drift(spark, args.path))
        return 0
    ds = open_dataset(spark, args.path, strict=args.strict, kind=args.kind)
    if args.cmd == "summary":
        _print(profile.dashboard(ds))
    elif args.cmd == "schema":
        _print(ds.schema_report())
    elif args.cmd == "page":
        _print(paging.browse(ds, args.page, args.size).orderBy("row_no"))
    elif args.cmd == "search":
        res = search.SearchResults(ds, args.query, args.column, args.max, args.match_names, args.match_nulls)
        print(json.dumps({"matches": res.count()}))
        _print(_positions(res.page(args.page, args.size).orderBy("__match_no")))
        if args.export:
            export(res.hits, args.export, "jsonl", ds=ds, order_col="__match_no")
    elif args.cmd == "inspect":
        _print(paging.inspect_fields(ds, args.row).orderBy("ordinal"))
        _print(paging.inspect_record(ds, args.row))
    elif args.cmd == "analytics":
        _print(profile.analytics_report(ds, args.seq_len, sample_rows=args.sample))
        _print(profile.role_counts(ds, sample_rows=args.sample))
    elif args.cmd == "quality":
        _print(profile.quality_report(ds, args.seq_len, sample_rows=args.sample))
    elif args.cmd == "export":
        export(ds.positioned(), args.out, args.format, ds=ds, order_col="__row_no")
    return 0


if __name__ == "__main__":
    sys.exit(main())
