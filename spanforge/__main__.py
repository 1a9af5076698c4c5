"""Command line: python -m spanforge pages.parquet out_folder [--json]; the exit code is 1 if a document does not pass."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.convert import convert_pages
from .sinks.markdown import summary


def main(arguments: list[str] | None = None) -> int:
    """Convert raw pages; the output folder gets markdown, ledger, issues and summary as Parquet."""
    parser = argparse.ArgumentParser(prog="spanforge", description="Raw pages (page_id, url, html) to Markdown with a quality gate.")
    parser.add_argument("pages", help="a Parquet table of pages")
    parser.add_argument("out", help="the folder of the output tables; they are written anew")
    parser.add_argument("--json", action="store_true", help="write the summary as JSON lines too")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("spanforge").getOrCreate()
    done = convert_pages(spark.read.parquet(given.pages))
    for name in ("markdown", "ledger", "issues", "summary"):
        getattr(done, name).write.mode("overwrite").parquet(f"{given.out}/{name}")
    kept = spark.read.parquet(f"{given.out}/summary")
    if given.json:
        summary(kept, "page_id").select("json").write.mode("overwrite").text(f"{given.out}/summary-json")
    total, failed = kept.count(), kept.filter("not quality_ok").count()
    print(f"{total} documents, {failed} of them with blocking issues")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
