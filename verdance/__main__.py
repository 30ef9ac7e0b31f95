"""Command line: ``python -m verdance --config study.json [--step 01 --step 05]``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from verdance.config import load_config
from verdance.plans import steps


def main() -> None:
    parser = argparse.ArgumentParser(prog="verdance", description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--project-root", help="folder that the configuration's paths are relative to")
    parser.add_argument("--step", action="append", help=f"number or name; may repeat; all without it: {', '.join(steps.NAMES)}")
    parser.add_argument("--missing-table", help="missing targets from elsewhere")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("verdance").getOrCreate()
    steps.run(spark, load_config(args.config, args.project_root), args.step, args.missing_table)


if __name__ == "__main__":
    main()
