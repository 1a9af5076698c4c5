"""Raw pages to Markdown with a ledger, issues and a quality gate; pages are read and rendered once, into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import coverage, lines
from ..sinks import markdown
from ..sources.pages import html_blocks
from ..store import cut

#: Issues that keep a document from passing.
BLOCKING = ["garbled", "glued_formula", "section_missing"]


class Converted:
    """The tables of a conversion: blocks, markdown, ledger, issues, summary."""

    def __init__(self, blocks: DataFrame, md: DataFrame, ledger: DataFrame, issues: DataFrame, summary: DataFrame):
        self.blocks, self.markdown, self.ledger, self.issues, self.summary = blocks, md, ledger, issues, summary


def convert_pages(pages: DataFrame, page_id: str = "page_id") -> Converted:
    """Pages: page_id, html. Navigation and footers are read into the ledger, not into the output."""
    read = cut(html_blocks(pages, page_id), "read")
    blocks = read.filter(F.col("area") == "body")
    md = cut(markdown.render(blocks, page_id), "rendered")
    ledger = coverage.ledger({"read": read, "body": blocks})
    found = lines.readability(lines.split_lines(md, [page_id], "markdown")).select(page_id, F.col("line_no"), F.col("issue").alias("check"))
    garbled = blocks.filter(P.garbled_score(F.col("text")) > 0.3).select(page_id, F.col("seq").alias("line_no"), F.lit("garbled").alias("check"))
    torn = blocks.filter((F.col("kind") == "para") & P.looks_truncated(F.col("text"))).select(page_id, F.col("seq").alias("line_no"), F.lit("truncated").alias("check"))
    issues = found.unionByName(garbled).unionByName(torn)
    gate = coverage.quality_gate(pages, issues, page_id, BLOCKING)
    counts = blocks.groupBy(page_id).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum((F.col("kind") == "heading").cast("long")).alias("n_headings"))
    return Converted(blocks, md, ledger, issues, gate.join(counts, page_id, "left").fillna(0, ["n_blocks", "n_headings"]))
