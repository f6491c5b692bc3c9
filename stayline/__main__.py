"""Command line: ``python -m stayline JOB --input FOLDER --output FOLDER`` (or spark-submit)."""

from __future__ import annotations

import argparse
from datetime import date

from stayline import jobs
from stayline.session import build_session
from stayline.sources.star_schema import business_tables
from stayline.sources.tables import load_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stayline")
    parser.add_argument("job", choices=("explore", "score", "report", "all"))
    parser.add_argument("--input", help="folder, or database for --format catalog")
    parser.add_argument("--format", default="csv", choices=("csv", "parquet", "catalog", "star"))
    parser.add_argument("--prefix", default="", help="what precedes the table names")
    parser.add_argument("--output", required=True)
    parser.add_argument("--work", help="shared folder for intermediates, removed at the end (default: below --output)")
    parser.add_argument("--as-of", type=date.fromisoformat, help="day tenure is counted to (default: today)")
    parser.add_argument("--folds", type=int, default=0, help="score also has every account scored by a model that has not learnt from it")
    args = parser.parse_args(argv)
    if args.job != "score" and not args.input:
        parser.error("--input is needed to read the business tables")

    spark = build_session()
    tables = {}
    if args.job != "score":
        if args.format == "star":
            tables = business_tables(spark, args.input)
        else:
            tables = load_tables(spark, args.input, args.format, args.prefix)
    if args.job in ("explore", "all"):
        jobs.explore(spark, tables, args.output, args.as_of, args.work)
    if args.job in ("report", "all"):
        jobs.report(tables, args.output)
    if args.job in ("score", "all"):
        jobs.score(spark, args.output, work=args.work, folds=args.folds)


if __name__ == "__main__":
    main()
