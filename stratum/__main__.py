"""Command line: python -m stratum <command> ...

  rebuild  RAW CLEAN [--fmt parquet|csv] [--dialect quoted|semicolon] [--levels month,all]
  append   FOLDER CLEAN YEAR MONTH PERIOD [--replace-absent] [--fmt ...] [--dialect ...]
  compact  CLEAN [--fmt ...] [--dialect ...]     (merges file sets of the whole-history level, then vacuums)
  stream   LANDING CLEAN [--fmt ...] [--dialect ...]          (processes what has landed, then stops)
  profile  raw RAW ENV | clean CLEAN ENV
  import   FLAT_FOLDER CLEAN [--dialect ...]

Stage timings / profiles are printed as one JSON line. The master and cluster
settings come from spark-submit / the environment.
"""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m stratum")
    sub = p.add_subparsers(dest="cmd", required=True)

    def io_opts(sp):
        sp.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
        sp.add_argument("--dialect", default="quoted", choices=["quoted", "semicolon"])

    r = sub.add_parser("rebuild")
    r.add_argument("raw")
    r.add_argument("clean")
    r.add_argument("--levels", default="", help="comma list of month,all")
    io_opts(r)
    a = sub.add_parser("append")
    for n in ("folder", "clean"):
        a.add_argument(n)
    for n in ("year", "month", "period"):
        a.add_argument(n, type=int)
    a.add_argument("--replace-absent", action="store_true", help="clear categories that the folder lacks")
    io_opts(a)
    c = sub.add_parser("compact")
    c.add_argument("clean")
    io_opts(c)
    s = sub.add_parser("stream")
    s.add_argument("landing")
    s.add_argument("clean")
    io_opts(s)
    pr = sub.add_parser("profile")
    pr.add_argument("kind", choices=["raw", "clean"])
    pr.add_argument("root")
    pr.add_argument("environment")
    im = sub.add_parser("import")
    im.add_argument("folder")
    im.add_argument("clean")
    im.add_argument("--dialect", default="quoted", choices=["quoted", "semicolon"])
    return p


def main(argv=None, spark=None) -> dict:
    args = _parser().parse_args(argv)
    if spark is None:
        from stratum.session import get_spark

        spark = get_spark()
    if args.cmd == "rebuild":
        from stratum.plans.rebuild import rebuild

        levels = tuple(x for x in args.levels.split(",") if x)
        out = rebuild(spark, args.raw, args.clean, fmt=args.fmt, dialect=args.dialect, levels=levels)
    elif args.cmd == "append":
        from stratum.plans.append import append_extraction

        out = append_extraction(spark, args.folder, args.clean, args.year, args.month, args.period,
                                fmt=args.fmt, dialect=args.dialect, replace_absent=args.replace_absent)
    elif args.cmd == "compact":
        from stratum.plans.history import merge_tiers, vacuum

        out = {"merged": merge_tiers(spark, args.clean, args.fmt, args.dialect), "deleted": vacuum(spark, args.clean)}
    elif args.cmd == "stream":
        from stratum.streaming.append_stream import start_append_stream

        q = start_append_stream(spark, args.landing, args.clean, fmt=args.fmt, dialect=args.dialect)
        q.awaitTermination()
        out = {"batches": len(q.recentProgress)}
    elif args.cmd == "profile":
        from stratum.plans.profiles import profile_clean_layer, profile_raw_tree

        fn = profile_raw_tree if args.kind == "raw" else profile_clean_layer
        out = fn(spark, args.root, args.environment).first().asDict()
    else:
        from stratum.plans.migrate import import_flat_layer

        out = import_flat_layer(spark, args.folder, args.clean, dialect=args.dialect)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
