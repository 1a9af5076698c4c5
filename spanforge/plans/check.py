"""A sampled audit: some pages of a table, converted and scanned; the exit code tells whether all of them pass.

python -m spanforge.plans.check pages.parquet [--sample-size 4] [--offset 0] [--json]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan, sequences
from ..store import cut
from .convert import convert_pages


def run_audit(pages: DataFrame, sample_size: int = 4, offset: int = 0, page_id: str = "page_id") -> dict:
    """ok, total, sample_size, offset and one result a sampled page: its issues by kind and whether its gate is open.

    The sample are the pages at (offset + i) modulo their number, by id; an empty sample does not pass.
    """
    sample = cut(sequences.wrap_sample(pages, page_id, sample_size, offset), "sample")
    done = convert_pages(sample.drop("pick"), page_id)
    found = cut(scan.scan(done.markdown, page_id), "findings")
    kinds = found.groupBy(page_id, "type").agg(F.count(F.lit(1)).alias("n")).groupBy(page_id).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("kinds"))
    rows = sample.select(page_id, "pick").join(done.summary.select(page_id, "quality_ok", "n_blocks", "n_warnings"), page_id, "left").join(kinds, page_id, "left").orderBy("pick").collect()
    results = [{"page": r[page_id], "ok": bool(r.quality_ok) and not r.kinds, "blocks": r.n_blocks or 0, "warnings": r.n_warnings or 0, "issues": dict(r.kinds or {})} for r in rows]
    return {"ok": bool(results) and all(r["ok"] for r in results), "total": pages.count(), "sample_size": len(results), "offset": offset, "results": results}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanforge.plans.check", description="Convert a sample of raw pages and audit the Markdown.")
    parser.add_argument("pages", help="a Parquet table of pages (page_id, url, html)")
    parser.add_argument("--sample-size", type=int, default=4)
    parser.add_argument("--offset", type=int, default=0, help="where the sample begins; it wraps around")
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("spanforge-check").getOrCreate()
    report = run_audit(spark.read.parquet(given.pages), given.sample_size, given.offset)
    if given.json:
        print(json.dumps(report, ensure_ascii=False, indent=2))
    else:
        print(f"{'ok' if report['ok'] else 'issues found'}: {report['sample_size']} of {report['total']} pages")
        for r in report["results"]:
            print(f"{'ok' if r['ok'] else '!!'} {r['page']}: {', '.join(f'{k} {n}' for k, n in sorted(r['issues'].items())) or 'nothing found'}")
    return 0 if report["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
