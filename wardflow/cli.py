"""Command line: run the load job or a report.

    python -m wardflow list
    python -m wardflow load --source /shared/in --format csv --target /shared/star
    python -m wardflow derive --sf-dir /root/testdata/sf0.01 --target /shared/star
    python -m wardflow report hospital_outliers --star /shared/star --region R02 --out /shared/out/r6
    python -m wardflow report radar_profiles --sf-dir /root/testdata/sf0.01 --show 10

On a cluster the session comes from ``spark-submit``; locally a session is
created.  Reports are written with the DataFrame writer (``--out``) or
shown (``--show``, for interactive use).
"""

from __future__ import annotations

import argparse
import inspect
import sys

from pyspark.sql import SparkSession

from wardflow import catalog
from wardflow.operators.scope import Scope
from wardflow.session import configure, local_session
from wardflow.sources import etl
from wardflow.sources.star import DriverStar, PublishedStar


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return configure(active) if active is not None else local_session()


def _report_kwargs(fn, args) -> dict:
    params = inspect.signature(fn).parameters
    kwargs = {}
    if "scope" in params:
        kwargs["scope"] = Scope(args.region, args.trust_type, None if "hospital_id" in params else args.hospital)
    if "hospital_id" in params and args.hospital:
        kwargs["hospital_id"] = args.hospital
    if "period" in params and args.period:
        kwargs["period"] = args.period
    return kwargs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wardflow")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered reports")

    ld = sub.add_parser("load", help="conform, audit and publish source tables")
    ld.add_argument("--source", required=True)
    ld.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ld.add_argument("--target", required=True)
    ld.add_argument("--strict-flags", action="store_true",
                    help="parse yes/no/true/false text (always on for CSV, which has no booleans)")
    ld.add_argument("--truthy-flags", action="store_true",
                    help="for CSV too, keep the source ETL's Python truthiness of flag text")
    ld.add_argument("--allow", nargs="*", default=[], help="findings (audit:table:column) that do not block")

    dv = sub.add_parser("derive", help="publish the star derived from driver tables")
    dv.add_argument("--sf-dir", required=True)
    dv.add_argument("--target", required=True)
    dv.add_argument("--allow", nargs="*", default=["keys:fact_patient_visits:visit_id"])

    rp = sub.add_parser("report", help="run one report")
    rp.add_argument("name")
    src = rp.add_mutually_exclusive_group(required=True)
    src.add_argument("--star", help="published star folder")
    src.add_argument("--sf-dir", help="driver tables folder")
    rp.add_argument("--region")
    rp.add_argument("--trust-type")
    rp.add_argument("--hospital")
    rp.add_argument("--period", choices=["H1", "H2"])
    rp.add_argument("--out", help="write the result here")
    rp.add_argument("--out-format", default="parquet", choices=["parquet", "json", "csv"],
                    help="json gives the row objects the dashboard API returned")
    rp.add_argument("--show", type=int, default=0, help="print the first N rows")
    args = p.parse_args(argv)

    registry = catalog.star_queries()
    if args.cmd == "list":
        for name, fn in registry.items():
            doc = (fn.__doc__ or "").strip().splitlines()
            print(f"{name:28s} {doc[0] if doc else ''}")
        return 0

    spark = _session()
    if args.cmd == "load":
        strict = args.strict_flags or (args.format == "csv" and not args.truthy_flags)
        coerced = {}
        tables = etl.conform(etl.read_sources(spark, args.source, fmt=args.format), strict, coerced)
        result = etl.load(spark, tables, args.target, allow_violations=set(args.allow), coerced=coerced)
        for row in result.findings["coerced"]:
            if row["rows"]:
                print(f"{row['table_name']}.{row['column_name']}: {row['rows']} values did not parse and are null")
        print(f"published {result.published_to} (staged at {result.staged_at})")
        return 0
    if args.cmd == "derive":
        result = etl.load(spark, etl.star_tables(DriverStar(spark, args.sf_dir)), args.target,
                          allow_violations=set(args.allow))
        print(f"published {result.published_to} (staged at {result.staged_at})")
        return 0

    if args.name not in registry:
        print(f"unknown report {args.name!r}; see `python -m wardflow list`", file=sys.stderr)
        return 2
    report = registry[args.name].report
    star = PublishedStar(spark, args.star) if args.star else DriverStar(spark, args.sf_dir)
    df = report(star, **_report_kwargs(report, args))
    if args.out:
        writer = df.write.mode("overwrite")
        if args.out_format == "csv":
            writer = writer.option("header", True)
        writer.format(args.out_format).save(args.out)
        print(f"wrote {args.out} ({args.out_format})")
    if args.show:
        df.show(args.show, truncate=False)
    return 0
