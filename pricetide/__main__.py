"""Batch stages as commands.

``python -m pricetide run /lake`` does all stages; the others do one of them. On a
cluster: ``spark-submit --py-files pricetide.zip pricetide/__main__.py run /lake``. A
failed stage, quality check or table load ends with a non-zero exit code.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from pricetide.operators.quality import content_sample, layer_profile
from pricetide.plans import incremental, medallion
from pricetide.session import build_session
from pricetide.sinks import (
    TABLES,
    export_csv,
    jdbc_writer,
    load_new_rows,
    load_tables,
    require_loaded,
)
from pricetide.sources import read_table_or_none
from pricetide.sources.folders import OPEN_FOLDERS

STAGES = (
    "run", "bronze", "bronze-by-folder", "silver", "quality", "gold", "gold-by-date",
    "profile", "sample", "export", "serve",
)


def parse(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pricetide")
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("root", help="folder of the lakehouse")
    parser.add_argument("--late", choices=("drop", "admit"), default="drop")
    parser.add_argument("--open-folders", type=int, default=OPEN_FOLDERS,
                        help="landing folders before the newest that may still get files")
    parser.add_argument("--out", help="folder of the CSV export")
    parser.add_argument("--url", help="JDBC address to serve to")
    parser.add_argument("--prefix", default="crypto_", help="prefix of served table names")
    parser.add_argument("--mode", choices=("overwrite", "append"), default="overwrite",
                        help="append: growing tables get only rows not served yet")
    parser.add_argument(
        "--property", action="append", default=[], metavar="KEY=VALUE", help="JDBC property"
    )
    return parser.parse_args(argv)


def _profile(spark: SparkSession, layout: medallion.Layout) -> list[dict]:
    paths = {
        "bronze": layout.bronze,
        "silver": layout.silver,
        "top_assets": layout.gold("top_assets"),
    }
    found = {name: read_table_or_none(spark, path) for name, path in paths.items()}
    layers = {name: df for name, df in found.items() if df is not None}
    return [row.asDict() for row in layer_profile(layers).collect()] if layers else []


def execute(spark: SparkSession, args: argparse.Namespace) -> object:
    """Run one stage; returns something to print."""
    layout = medallion.Layout(args.root)
    if args.stage == "run":
        return medallion.run(spark, args.root, args.late)
    if args.stage == "bronze":
        return medallion.refresh_bronze(spark, layout)
    if args.stage == "bronze-by-folder":
        return medallion.refresh_bronze_by_folder(spark, layout, args.open_folders)
    if args.stage == "silver":
        return medallion.refresh_silver(spark, layout, args.late)
    if args.stage == "quality":
        return medallion.check_silver(spark, layout)
    if args.stage == "gold":
        return medallion.refresh_gold(spark, layout)
    if args.stage == "gold-by-date":
        return incremental.refresh_gold_by_date(spark, layout)
    if args.stage == "profile":
        return _profile(spark, layout)

    gold = medallion.gold_tables(spark, layout, TABLES)
    if args.stage == "sample":
        return [row.asDict() for row in content_sample(gold["top_assets"]).collect()]
    if args.stage == "export":
        # One row per asset: small enough for one file.
        export_csv(gold["top_assets"], args.out, single_file=True)
        return {"exported": args.out}
    properties = dict(item.split("=", 1) for item in args.property)
    writer = jdbc_writer(args.url, properties)
    if args.mode == "append":
        append = jdbc_writer(args.url, properties, "append")
        marks = layout.folder("_served")
        results = load_new_rows(spark, gold, writer, append, marks, args.prefix)
    else:
        results = load_tables(spark, gold, writer, args.prefix)
    results.show(len(TABLES), truncate=False)
    require_loaded(results)
    return {"served": len(TABLES)}


def main(argv: Sequence[str] | None = None) -> int:
    args = parse(argv)
    spark = build_session(f"pricetide-{args.stage}")
    try:
        print(json.dumps(execute(spark, args), default=str))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
