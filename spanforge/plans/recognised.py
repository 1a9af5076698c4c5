"""Recognised pages end to end: lines and ruling lines in; blocks, Markdown, ledger, issues, gate and summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.packs import EMPTY, Pack
from ..operators import audit, coverage, pages, rules
from ..sinks import export
from ..store import cut
from .convert import Converted

#: Checks of the audit that keep a document from passing; all others are warnings.
BLOCKING = ["garbled", "review_marker", "contents_coverage", "heading_gap", "table_rendering", "image_coverage", "block_coverage", "region_coverage", "section_title", "section_terms", "section_fields", "section_formulas", "global_term", "readability_glued_formula"]


def convert_lines(lines: DataFrame, sizes: DataFrame, ruling: DataFrame, verticals: DataFrame, pack: Pack = EMPTY, header_words: list[str] | None = None, noise: list[str] | None = None, marker: str = "") -> Converted:
    """lines: doc_id, page, line_no, text, conf, x0, y0, x1, y1; sizes: doc_id, page, page_w, page_h; ruling: y, x0, x1 and
    verticals: x, y0, y1 of a page. Every line is in the ledger, whatever becomes of it."""
    key = pages.KEY
    found = cut(pages.assemble(lines, sizes, ruling, verticals, header_words or [], noise or []), "assembled")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")) - 1
    blocks = cut(found.withColumn("seq", order).withColumn("text", rules.normalise(F.col("text"))), "blocks")
    md = cut(export.finish(cut(export.export(blocks, "doc_id", pack, marker=marker), "exported"), "doc_id", pack), "markdown")
    box = ["x0", "y0", "x1", "y1"]
    read = lines.select(*key, F.col("line_no").alias("idx"), F.lit("para").alias("kind"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.array().cast("array<string>").alias("flags"), *box)
    made = found.select(*key, F.col("seq").alias("idx"), "kind", "text", "rows", "flags", *box)
    ledger = cut(coverage.ledger({"ocr_line": read, "assembled": made}), "ledger")
    audited = cut(audit.audit(blocks, blocks, ledger, md, "doc_id", pack), "issues")
    garbled = blocks.filter(P.garbled_score(F.coalesce("text", F.lit(""))) > 0.3).select("doc_id", F.lit("garbled").alias("check"), F.concat(F.lit("block "), F.col("seq").cast("string")).alias("detail"))
    issues = audited.unionByName(garbled)
    docs = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    gate = coverage.quality_gate(docs, issues, "doc_id", BLOCKING)
    counts = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum((F.col("kind") == "heading").cast("long")).alias("n_headings"), F.sum((F.col("kind") == "table").cast("long")).alias("n_tables"))
    done = docs.join(gate, "doc_id").join(counts, "doc_id", "left").fillna(0, ["n_blocks", "n_headings", "n_tables"])
    return Converted(blocks, md, ledger, issues, done)


