"""Command line: run one of the service's endpoints and write its JSON records.

    python -m visitlake conversions --format parquet \
        --table users=/data/users --table orders=/data/orders --table logs=/data/logs \
        --table sources=/data/sources --table campaigns=/data/campaigns \
        --date-from "2024-01-05 00:00:00" --date-to "2024-01-20 00:00:00" --out /data/out/conversions

Runs on the session spark-submit provides (``--master`` only for local use);
records are written from the executors as JSON lines, never collected.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from visitlake import api
from visitlake.sources import load_tables, write_json

ENDPOINTS = ("orders", "pages_visit", "visitors", "logs", "conversions")


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m visitlake", description=__doc__.splitlines()[0])
    p.add_argument("endpoint", choices=ENDPOINTS)
    p.add_argument("--format", default="parquet", help="Spark data source of the tables")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="path of one table")
    p.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="reader option of all tables")
    p.add_argument("--table-option", action="append", default=[], metavar="NAME.KEY=VALUE", help="reader option of one table")
    p.add_argument("--key-type", choices=("bigint", "string"), default="bigint", help="type of the join keys")
    p.add_argument("--date-from")
    p.add_argument("--date-to")
    p.add_argument("--condition", action="append", default=[], metavar="FROM/TO", help="time range of the logs endpoint (repeatable; an end may be empty)")
    p.add_argument("--operator", choices=("OR", "AND"), default="OR", help="how the conditions combine")
    p.add_argument("--corrupt", choices=("fail", "drop"), default="fail", help="what becomes of malformed JSON records")
    p.add_argument("--as-of", help="end of the visitor report's trailing year (default: today)")
    p.add_argument("--zone", default=None, help="time zone of the conversion report")
    p.add_argument("--out", required=True, help="output folder (JSON lines)")
    p.add_argument("--mode", default="errorifexists")
    p.add_argument("--master", help="for local runs only, e.g. local[*]")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = dict(item.split("=", 1) for item in args.table)
    options: dict[str, dict[str, str]] = {}
    for item in args.table_option:
        name, pair = item.split(".", 1)
        key, value = pair.split("=", 1)
        options.setdefault(name, {})[key] = value
    common = dict(item.split("=", 1) for item in args.option)
    t = load_tables(spark, args.format, paths, options=options, common_options=common, key_type=args.key_type, corrupt=args.corrupt)
    if args.endpoint == "visitors":
        df = api.visitors(t, args.date_from, args.date_to, as_of=args.as_of)
    elif args.endpoint == "conversions":
        kw = {"zone": args.zone} if args.zone else {}
        df = api.conversions(t, args.date_from, args.date_to, **kw)
    elif args.endpoint == "logs" and args.condition:
        df = api.logs(t, [[x or None for x in c.split("/", 1)] for c in args.condition], args.operator)
    else:
        df = getattr(api, args.endpoint)(t)
    write_json(df, args.out, mode=args.mode)


def main(argv=None) -> None:
    args = parse(argv)
    builder = SparkSession.builder.appName(f"visitlake-{args.endpoint}")
    if args.master:
        builder = builder.master(args.master)
    run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
