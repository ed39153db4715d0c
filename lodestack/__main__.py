"""python -m lodestack CONFIG TABLE [--dry-run] [--reset] [--prune] [-v]: bring a chunk table up to date."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .sources.files import Config


def main() -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("config")
    p.add_argument("table")
    for flag in ("--dry-run", "--reset", "--prune"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-v", "--verbose", action="store_true", help="show what Spark logs")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "WARN")
    row = Engine(spark, a.table).ingest(Config.load(Path(a.config).read_text()), a.dry_run, a.prune, a.reset).first()
    print(row.asDict())
    return 1 if not row["files_discovered"] or row["files_failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
