"""Command line: compare two feeds and write the change document as JSON."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import datetime

from feedelta import __version__
from feedelta.plans import registry


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="feedelta", description="Report what changed between two feeds.")
    p.add_argument("base_feed")
    p.add_argument("new_feed")
    p.add_argument("--files", help="comma-separated file names; others are left out")
    p.add_argument("-o", "--output", help="write here instead of standard output")
    p.add_argument("-c", "--cap", type=int, help="most row changes reported for each file; 0 for none")
    p.add_argument("--pretty", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--base-downloaded-at", help="ISO 8601 with zone")
    p.add_argument("--new-downloaded-at", help="ISO 8601 with zone")
    p.add_argument("--id-churn-threshold", type=float, default=registry.CHURN_THRESHOLD)
    p.add_argument("--id-churn-threshold-for", nargs=2, action="append", default=[], metavar=("FILE", "RATIO"))
    p.add_argument("--column-stats", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--reader", choices=("strict", "native", "native_split"), default="strict")
    p.add_argument("--rows-to", help="folder for all changed rows as JSON lines, written by Spark; the document has counts only")
    p.add_argument("--trace", action="store_true", help="log each step with its seconds and memory to standard error")
    p.add_argument("--version", action="version", version=__version__)
    return p


def _fail(message) -> int:
    print(f"Error: {message}", file=sys.stderr)
    return 1


def main(argv: list[str] | None = None, spark=None) -> int:
    from feedelta.sources.feeds import is_url

    args = _parser().parse_args(argv)
    for path in (args.base_feed, args.new_feed):
        if not is_url(path) and not os.path.exists(path):
            return _fail(f"{path} does not exist")
    if not 0 <= args.id_churn_threshold <= 1:
        return _fail("--id-churn-threshold must lie between 0 and 1")
    try:
        when = {f"{s}_downloaded_at": datetime.fromisoformat(v) for s in ("base", "new") if (v := getattr(args, f"{s}_downloaded_at"))}
        overrides = {f: float(r) for f, r in args.id_churn_threshold_for}
    except ValueError as e:
        return _fail(e)
    files = None if args.files is None else [f.strip() for f in args.files.split(",") if f.strip()]
    if args.trace:
        logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(message)s")
        logging.getLogger("feedelta").setLevel(logging.INFO)
    try:
        from feedelta.api import diff_feeds
        from feedelta.plans.document import to_json
        from feedelta.session import session

        doc = diff_feeds(
            spark or session(), args.base_feed, args.new_feed, args.cap, id_churn_threshold=args.id_churn_threshold,
            id_churn_thresholds=overrides, files=files, column_stats=args.column_stats, reader=args.reader, rows_to=args.rows_to, **when,
        )
        text = to_json(doc, pretty=args.pretty)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
    except Exception as e:  # every failure ends as one line and status 1
        return _fail(e)
    return 0
