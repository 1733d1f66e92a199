"""``python -m faultline LOG...``: the ranked groups of log files, or their records.

Exit codes: 0, 2 for a wrong argument or configuration, 1 for what fails while it runs.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .config import RUNTIME_EXIT, ConfigError, Tuning, load, resolve


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("faultline", description=__doc__.splitlines()[0])
    parser.add_argument("log", nargs="+", help="log files or folders")
    parser.add_argument("--config", type=Path, help="a TOML file")
    parser.add_argument("--level", action="append", default=[], help="a level to select; more than once for several")
    parser.add_argument("--timezone", help="the zone of the stamps: utc, local or a name")
    parser.add_argument("--view", default="volume", choices=("volume", "new", "increasing"))
    parser.add_argument("--sort", help="a column of the view to sort by")
    parser.add_argument("--search", default="", help="text, or re: and a pattern, that groups must hold")
    parser.add_argument("--ndjson", help="a folder for the groups' records; the table is not printed then")
    return parser


def report(tuning: Tuning, options: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from .operators import records, views
    from .plans.batch import analyze
    from .sources.lines import scan_log

    spark = SparkSession.builder.appName("faultline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    groups = analyze(scan_log(spark, options.log), tuning).groups
    if options.ndjson:
        records.write(records.updated(groups, records.session_id()), options.ndjson)
        return
    shown = views.ranked(views.search(views.snapshot(groups, tuning), options.search), options.view, options.sort)
    rows = views.cells(shown)
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():  # live groups are capped
        print("\t".join(map(str, row)))


def main(argv: list[str] | None = None) -> int:
    options = arguments().parse_args(argv)  # exits with 2 by itself
    try:
        tuning = resolve(load(options.config) if options.config else None, options.level, options.timezone)
    except ConfigError as error:
        print(f"faultline: {error}", file=sys.stderr)
        return error.exit_code
    try:
        report(tuning, options)
    except Exception as error:  # whatever fails is said and ends the command
        print(f"faultline: {error}", file=sys.stderr)
        return RUNTIME_EXIT
    return 0


if __name__ == "__main__":
    sys.exit(main())
