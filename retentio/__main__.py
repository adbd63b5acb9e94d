"""Command line: run the registered reports or write the workbook tables.

    python -m retentio list
    python -m retentio run    <sf_dir> <out_dir> [--only a,b] [--load <dir>] [--show N]
    python -m retentio report <sf_dir> <out_dir> [--ltv-edges 0,500,...] [--load <dir>]

``run`` writes one CSV folder per query (nothing for an empty result) and
prints one status line per query (``--show N``: and its first N rows); a
failing query does not stop the batch.
``--load`` derives the two analytical tables once into <dir> (use a folder
every executor can read) and runs every report / sheet against them, instead of
re-deriving them from the raw tables for each one. ``report`` writes the
workbook's sheets as parquet tables.
"""

from __future__ import annotations

import argparse
import sys

from retentio.functions.expr import LTV_EDGES_REFERENCE
from retentio.plans.catalog import Catalog
from retentio.plans.registry import REGISTRY
from retentio.plans.runner import run_all
from retentio.session import get_session
from retentio.sources.sinks import write_report_tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m retentio")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("sf_dir")
    run.add_argument("out_dir")
    run.add_argument("--only", default=None)
    run.add_argument("--load", default=None)
    run.add_argument("--show", type=int, default=0)
    rep = sub.add_parser("report")
    rep.add_argument("sf_dir")
    rep.add_argument("out_dir")
    rep.add_argument("--ltv-edges", default=",".join(str(e) for e in LTV_EDGES_REFERENCE))
    rep.add_argument("--load", default=None)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(REGISTRY))
        return 0
    spark = get_session()
    if args.cmd == "run":
        cat = Catalog(spark, args.sf_dir)
        if args.load:
            cat = cat.load(args.load)
        names = args.only.split(",") if args.only else None
        results = run_all(spark, args.sf_dir, args.out_dir, names, catalog=cat, preview=args.show)
        for r in results:
            print(f"{r.status:8s} {r.seconds:7.2f}s  {r.name}" + (f"  {r.error}" if r.error else ""))
            if r.preview:
                print("    " + "  ".join(r.columns))
                for row in r.preview:
                    print("    " + "  ".join(str(v) for v in row))
        return 1 if any(r.status == "error" for r in results) else 0
    edges = tuple(float(x) if "." in x else int(x) for x in args.ltv_edges.split(","))
    cat = Catalog(spark, args.sf_dir)
    if args.load:
        cat = cat.load(args.load)
    for name in write_report_tables(cat.subscriptions(), args.out_dir, edges):
        print(f"written  {args.out_dir.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
