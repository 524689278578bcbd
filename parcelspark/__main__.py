"""Command line: ``python -m parcelspark import|to-geojson ...``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions import text
from .plans import importer


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="parcelspark")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("import", help="archives into versioned tables")
    i.add_argument("-p", "--path", required=True)
    i.add_argument("-d", "--date", required=True, help="vintage, yyyy-MM")
    i.add_argument("-o", "--root", required=True, help="folder of the tables")
    i.add_argument("--config", default="full", help="full, light, bati or a JSON file")
    i.add_argument("--srid", type=int, default=4326)
    i.add_argument("--precision", type=int)
    i.add_argument("--dep", help="department code, or fromFile")
    i.add_argument("--drop-table", action="store_true")
    i.add_argument("--drop-schema", action="store_true")
    i.add_argument("--trust-stat", action="store_true", help="skip files of unchanged size and time unread")
    i.add_argument("--jobs", type=int, help="tasks that run at a time in a local session")
    i.add_argument("--report", help="write the report to this JSON file")
    g = sub.add_parser("to-geojson", help="archives into GeoJSON files")
    g.add_argument("-p", "--path", required=True)
    g.add_argument("-o", "--output", required=True)
    g.add_argument("--srid", type=int)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    if a.command == "import":
        text.vintage(a.date)
    b = SparkSession.builder.appName("parcelspark")
    if getattr(a, "jobs", None):
        b = b.master(f"local[{a.jobs}]")
    spark = b.getOrCreate()
    if a.command == "to-geojson":
        print(importer.export_geojson(spark, a.path, a.output, a.srid))
        return 0
    r = importer.import_archives(spark, a.path, a.date, a.root, a.config, a.srid, a.precision, a.dep, a.drop_table, a.drop_schema, a.trust_stat)
    print(r.display())
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(r.to_json())
    return 0 if r.status != "Failed" else 1


if __name__ == "__main__":
    sys.exit(main())
