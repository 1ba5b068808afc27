"""``python -m fiberloom scan ROOT...``: findings of source trees as Markdown or JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fiberloom.plans import detectors
from fiberloom.sources import sinks


def main() -> None:
    parser = argparse.ArgumentParser(prog="fiberloom")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="find repeated and mirrored structure in Python sources")
    scan.add_argument("roots", nargs="+")
    scan.add_argument("--only", nargs="*", choices=sorted(detectors.DETECTORS), help="detectors to run; all by default")
    scan.add_argument("--scope", nargs="*", default=[], help="report only findings with evidence under these paths")
    scan.add_argument("--json", metavar="FOLDER", help="write JSON lines instead of printing Markdown")
    scan.add_argument("--summary", action="store_true", help="with --json: counts by detector only")
    scan.add_argument("--limit", type=int, default=25)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("fiberloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = detectors.analyze(spark, args.roots, args.only)
    found = detectors.in_scope(found, args.scope) if args.scope else found
    if args.json:
        sinks.json_report(found, args.json, "summary" if args.summary else "full")
    else:
        print(sinks.markdown_report(found, args.limit))


if __name__ == "__main__":
    main()
