"""Command line: CSV event files -> raw table -> clean table -> serving views.

    python -m clickweave --csv 's3://bucket/events/*.csv' --out s3://bucket/analytics
    python -m clickweave --raw s3://bucket/analytics/raw --out s3://bucket/analytics --months 2019-12-01

Writes ``<out>/raw`` (with ``--csv``; rejected rows in ``<out>/raw_rejected``),
``<out>/clean`` (month-partitioned; with ``--months`` only those months are rebuilt) and one
parquet folder per view under ``<out>/views``. The Spark session comes from the
environment (spark-submit); sizing follows ``--input-bytes`` and ``--cores`` when given.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from clickweave.config import SESSION_DEFAULTS, ensure_checkpoint_dir, scale_conf
from clickweave.operators.checks import check_category_product, check_funnel_rates, check_month_completeness
from clickweave.operators.clean import rebuild_months, write_clean
from clickweave.plans.catalog import EventCatalog
from clickweave.plans.views import VIEWS, export_views
from clickweave.schema import DEFAULT_PARAMS, Params
from clickweave.sources.ingest import ingest_events
from clickweave.sources.tables import raw_table_schema, read_event_table


def params_of(args: argparse.Namespace) -> Params:
    day, changes = dt.date.fromisoformat, {}
    if args.period:
        changes["period"] = (day(args.period[0]), day(args.period[1]))
    if args.reference_date:
        changes["reference_date"] = day(args.reference_date)
    if args.weeks is not None:
        changes["weeks"] = args.weeks
    if args.check_category:
        changes["check_category"] = args.check_category
    if args.check_month:
        changes["check_month"] = day(args.check_month)
    return replace(DEFAULT_PARAMS, **changes)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="clickweave")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", nargs="+", help="CSV event files or globs")
    src.add_argument("--raw", help="existing month-partitioned raw table")
    ap.add_argument("--out", required=True, help="output root (raw/, clean/, views/ below it)")
    ap.add_argument("--months", nargs="*", default=None, help="rebuild only these months (YYYY-MM-01)")
    ap.add_argument("--period", nargs=2, metavar=("START", "END"), default=None,
                    help="analysed months [START, END), first days (YYYY-MM-01); default: all")
    ap.add_argument("--reference-date", default=None, help="RFM recency counts days up to this date")
    ap.add_argument("--weeks", type=int, default=None, help="cohort weeks after the first")
    ap.add_argument("--check-category", default=None, help="category of the category checks; default: the top one")
    ap.add_argument("--check-month", default=None, help="month of the completeness check (YYYY-MM-01)")
    ap.add_argument("--load", choices=("append", "overwrite"), default="append", help="add to loaded months or replace them")
    ap.add_argument("--views", nargs="*", default=list(VIEWS), help="views to export (default: all)")
    ap.add_argument("--input-bytes", type=int, default=None, help="input size, for shuffle sizing")
    ap.add_argument("--cores", type=int, default=None, help="total executor cores, for shuffle sizing")
    args = ap.parse_args(argv)

    params = params_of(args)

    builder = SparkSession.builder.appName("clickweave")
    conf = dict(SESSION_DEFAULTS)
    if args.input_bytes and args.cores:
        conf.update(scale_conf(args.input_bytes, args.cores))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)

    out = args.out.rstrip("/")
    report: dict = {}
    if args.csv:
        raw_path = f"{out}/raw"
        _, rejected = ingest_events(spark, args.csv, out=raw_path, mode=args.load)
        report["rejected"] = rejected.count()
    else:
        raw_path = args.raw
    raw = read_event_table(spark, raw_path, raw_table_schema())
    clean_path = f"{out}/clean"
    if args.months:
        rebuild_months(raw, clean_path, [dt.date.fromisoformat(m) for m in args.months], params)
    else:
        write_clean(raw, clean_path, params=params)
    catalog = EventCatalog.over_table(spark, raw_path, params, clean_path=clean_path)
    month, category = params.check_month, params.check_category
    report["checks"] = {
        "month": [str(v) for v in check_month_completeness(raw, month).first()],
        "category": [[str(v) for v in r] for r in check_category_product(catalog.product(), category).collect()],
        "rates_outside": {r.row_type: r.n_outside for r in check_funnel_rates(VIEWS["vw_funnel"](catalog)).collect()}}
    report["views"] = export_views(catalog, f"{out}/views", args.views)
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
