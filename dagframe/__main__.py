"""Runs a plan from a JSON file: ``python -m dagframe plan.json --tables FOLDER [--out PATH --format csv]``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .plans import PlanError


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dagframe", description="Runs a workflow plan.")
    parser.add_argument("plan", help="JSON file with operators and links")
    parser.add_argument("--tables", help="folder of parquet tables")
    parser.add_argument("--out", help="where to write the only sink's rows; else they are printed")
    parser.add_argument("--format", choices=["csv", "json", "parquet"], default="csv")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark configuration")
    parser.add_argument("--explain", action="store_true", help="print the physical plans and run nothing")
    a = parser.parse_args(args)
    builder = SparkSession.builder.appName("dagframe")
    for pair in a.conf:
        key, _, value = pair.partition("=")
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    engine = Engine.over(spark, a.tables) if a.tables else Engine(spark)
    plan = json.loads(Path(a.plan).read_text())
    try:
        if a.explain:
            low = engine.lower(plan)
            for id in low.flow.sinks():
                print(id)
                low.frames[id].explain("formatted")
        elif a.out:
            engine.download(plan, a.out, a.format)
        else:
            result = engine.result(plan)
            print(json.dumps(result, ensure_ascii=False))
            return result["code"]
    except PlanError as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
