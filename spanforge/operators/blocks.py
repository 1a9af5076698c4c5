"""Block-level operators: spans to paragraphs and headings, low-confidence grouping, formula and caption passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.formulas import short_math_block
from ..functions.text import heading_level, numbering, trim
from .intervals import sessions

SCHEMA = "doc_id long, page int, seq int, kind string, text string, level int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double, confidence double, flags array<string>, origin string"


def body_size(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, body: the most frequent font size (half-even rounded); of equals the one seen first."""
    counted = spans.withColumn("_s", F.bround("size", 0)).groupBy(doc, "_s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    return counted.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "first"))).filter("_k = 1").select(doc, F.col("_s").alias("body"))


def spans_to_blocks(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines of spans as paragraphs and headings, in reading order.

    A line opens a block if it is a bold label, or if it follows a gap above 0.8 of its size or a change of size
    above 1 and does not go on an unfinished line. A block is a heading if its size is above 1.15 of the body's or
    it is one short bold line; its level follows its numbering, else its size.
    """
    w = Window.partitionBy(doc, "page").orderBy("y0", "x0", "line_no")
    before = lambda c: F.lag(c).over(w)
    gap = (F.col("y0") - before("y1") > F.col("size") * 0.8) | (F.abs(F.col("size") - before("size")) > 1)
    opens = P.is_bold_label(F.col("text"), F.col("bold")) | before("text").isNull() | (gap & ~F.coalesce(P.continues(before("text"), F.col("text")), F.lit(False)))
    numbered = spans.withColumn("_b", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(w))
    grouped = numbered.groupBy(doc, "page", "_b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text"))), lambda s: trim(s["text"])), " ").alias("text"),
        F.max("size").alias("size"),
        F.bool_and("bold").alias("bold"),
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    sized = grouped.join(body_size(spans, doc), doc)
    heading = (F.col("size") > F.col("body") * 1.15) | (F.col("bold") & (F.col("n") == 1) & (F.char_length("text") <= 60))
    by_size = F.when(F.col("size") > F.col("body") * 1.6, 1).when(F.col("size") > F.col("body") * 1.3, 2).otherwise(3)
    seq = F.row_number().over(Window.partitionBy(doc).orderBy("page", "y0", "x0")) - 1
    return sized.select(
        doc,
        "page",
        seq.alias("seq"),
        F.when(P.is_caption(F.col("text")), "caption").when(heading, "heading").otherwise("para").alias("kind"),
        "text",
        F.when(heading & ~P.is_caption(F.col("text")), heading_level(F.col("text"), by_size)).otherwise(0).alias("level"),
        "x0",
        "y0",
        "x1",
        "y1",
    )


def low_confidence_groups(blocks: DataFrame, doc: str = "doc_id", gap: float = 250.0, conf: float = 0.35) -> DataFrame:
    """doc, page, group, first_seq, n, y0, y1, text: runs of bad blocks that become one image each.

    Bad: text of confidence up to conf that is flagged. A good block closes a run; so does a gap above ``gap`` to
    the lowest edge so far.
    """
    bad = F.col("kind").isin("para", "heading") & (F.col("confidence") <= conf) & F.arrays_overlap("flags", F.array(F.lit("low_confidence"), F.lit("garbled")))
    w = Window.partitionBy(doc, "page").orderBy("seq")
    runs = blocks.withColumn("_bad", bad).withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w)).filter("_bad")
    joined = sessions(runs, [doc, "page", "_run"], F.col("seq"), F.col("y0"), F.col("y1"), gap)
    grouped = joined.groupBy(doc, "page", "_run", "session").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("text")
    )
    return grouped.withColumn("group", F.row_number().over(Window.partitionBy(doc, "page").orderBy("first_seq"))).drop("_run", "session")


def promote_math(blocks: DataFrame, doc: str = "doc_id", dy: float = 18.0, dx: float = 80.0) -> DataFrame:
    """Short mathematical paragraphs near a formula block of their page get the flag formula_text."""
    short = short_math_block(F.col("text")) & (F.col("kind") == "para") & ~F.array_contains("flags", "formula_text")
    formula = blocks.filter(F.array_contains("flags", "formula_text")).select(F.col(doc).alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1", "seq")])
    near = (
        (F.greatest(F.col("y0") - F.col("_y1"), F.col("_y0") - F.col("y1"), F.lit(0.0)) <= dy)
        & (F.greatest(F.col("x0") - F.col("_x1"), F.col("_x0") - F.col("x1"), F.lit(0.0)) <= dx)
        & (F.col("seq") != F.col("_seq"))
    )
    hit = blocks.filter(short).join(formula, (F.col(doc) == F.col("_d")) & (F.col("page") == F.col("_p")) & near, "left_semi").select(doc, "seq", F.lit(True).alias("_hit"))
    return blocks.join(hit, [doc, "seq"], "left").withColumn("flags", F.when(F.col("_hit"), F.array_union("flags", F.array(F.lit("formula_text")))).otherwise(F.col("flags"))).drop("_hit")


def split_trailing_headings(blocks: DataFrame) -> DataFrame:
    """A paragraph that ends in a numbered heading becomes a paragraph and a heading; ``part`` orders the two."""
    tail = F.regexp_extract("text", r"[.!?。]\s+(\d{1,2}(?:\.\d{1,2}){1,4}\.?\s+[A-Z][^\n.!?]{2,90})\z", 1)
    head = F.expr("substring(text, 1, char_length(text) - char_length(_tail))")
    parts = F.when(
        (F.col("kind") == "para") & (F.col("_tail") != ""),
        F.array(F.struct(F.lit("para").alias("kind"), trim(head).alias("text"), F.lit(0).alias("level")), F.struct(F.lit("heading").alias("kind"), F.col("_tail").alias("text"), heading_level(F.col("_tail")).alias("level"))),
    ).otherwise(F.array(F.struct("kind", "text", F.col("level").cast("int").alias("level"))))
    rest = [c for c in blocks.columns if c not in ("kind", "text", "level")]
    return blocks.withColumn("_tail", tail).select(*rest, F.posexplode(parts).alias("part", "_p")).select(*rest, "part", "_p.*")


def scan(blocks: DataFrame, header_words: list[str], doc: str = "doc_id") -> DataFrame:
    """doc, seq, check, severity: what a second reading of the finished blocks finds."""
    from ..functions.grids import suspect_score

    issue = lambda check, severity: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    found = F.array_compact(
        F.array(
            F.when(P.garbled_score(F.coalesce("text", F.lit(""))) > 0.3, issue("garbled", "blocking")),
            F.when(F.array_contains("flags", "low_confidence"), issue("low_confidence", "warning")),
            F.when((F.col("kind") == "table") & (suspect_score(F.col("rows"), header_words) >= 3), issue("suspect_table", "blocking")),
            F.when((F.col("kind") == "para") & P.looks_truncated(F.col("text")), issue("truncated", "warning")),
        )
    )
    return blocks.select(doc, "seq", F.explode(found).alias("i")).select(doc, "seq", "i.*")


__all__ = ["Column", "SCHEMA", "body_size", "low_confidence_groups", "numbering", "promote_math", "scan", "spans_to_blocks", "split_trailing_headings"]
