"""Offline backfill of boards from stored postings: ``python -m postloom.backfill POSTINGS BOARDS OUT [--dry-run]``.

Reads postings (source, url, apply_url, description) and known boards (ats, slug, pos) as Parquet, mines the postings'
texts for boards without any request, and writes the merged boards to OUT; a dry run writes nothing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.extract import company_host, is_interstitial
from .operators.discovery import backfill_report, discover
from .session import get_spark


def backfill(postings: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged boards, report) of stored postings."""
    merged = discover(postings, boards)
    new = merged.join(boards, ["ats", "slug"], "left_anti").select("ats", "slug", F.lit(False).alias("sniffed"))
    given = F.coalesce(F.col("apply_url") != "", F.lit(False))
    scanned = postings.select(company_host(F.col("url")).alias("host"), F.lit(False).alias("attempted"), F.lit(False).alias("resolved"), (is_interstitial(F.col("url")) & given).alias("given"))
    return merged, backfill_report(scanned, new)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("postings")
    parser.add_argument("boards")
    parser.add_argument("out")
    parser.add_argument("--dry-run", action="store_true", help="report only")
    told = parser.parse_args(arguments)
    spark = spark or get_spark("backfill")
    merged, report = backfill(spark.read.parquet(told.postings), spark.read.parquet(told.boards))
    if not told.dry_run:
        merged.write.mode("overwrite").parquet(told.out)
    row = report.first().asDict()
    print(row)
    return row


if __name__ == "__main__":
    main()
