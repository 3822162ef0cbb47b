"""python -m leadweave: score, analyse, resolve, export, stats and leads over a store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from leadweave.engine import Engine
from leadweave.settings import Settings


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leadweave", description=__doc__)
    p.add_argument("command", choices=("discover", "analyse", "score", "resolve", "export", "stats", "leads", "crawler"))
    p.add_argument("store", help="folder of the tables")
    p.add_argument("--query")
    p.add_argument("--wilaya")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--out", default="exports")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("leadweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.store, Settings.from_environment())
    if a.command == "discover":
        print(e.discover(a.query or "", a.wilaya, a.limit))
    elif a.command == "analyse":
        print({"analysed": e.analyse()})
    elif a.command == "score":
        print({"scored": e.score()})
    elif a.command == "resolve":
        print(e.resolve())
    elif a.command == "export":
        print([e.export_leads_csv(a.out, a.limit), e.export_leads_json(a.out, a.limit), e.export_entities_json(a.out, a.limit)])
    elif a.command == "stats":
        print(e.stats().first().asDict())
    elif a.command == "crawler":
        print(e.crawler_status())
    else:
        e.list_leads(wilaya=a.wilaya, limit=min(a.limit, 500)).show(a.limit, truncate=40)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
