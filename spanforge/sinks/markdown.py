"""Blocks as Markdown, one text per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.text import md_escape, trim


def block_lines(kind: Column, level: Column, text: Column, rows: Column | None = None) -> Column:
    """array of Markdown lines of a block, a blank line at its end; empty for a block without content."""
    t = trim(F.coalesce(text, F.lit("")))
    mark = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "))
    blank = F.lit("")
    lines = (
        F.when((kind == "heading") & (t != ""), F.array(F.concat(mark, md_escape(F.regexp_replace(t, r"\s*\n\s*", " "))), blank))
        .when((kind == "item") & (t != ""), F.array(F.concat(F.lit("- "), md_escape(F.regexp_replace(t, r"\s*\n\s*", " ")))))
        .when((kind == "formula") & (t != ""), F.array(F.lit("$$"), t, F.lit("$$"), blank))
        .when(kind.isin("para", "caption") & (t != ""), F.concat(F.transform(F.filter(F.split(t, "\n"), lambda x: trim(x) != ""), lambda x: md_escape(trim(x))), F.array(blank)))
    )
    none = F.array().cast("array<string>")
    if rows is not None:
        table = F.when(grids.is_complex(rows), grids.grouped_text(rows)).otherwise(grids.pipe_table(rows))
        lines = F.when((kind == "table") & (F.size(rows) > 0), F.concat(table, F.array(blank))).otherwise(lines)
    return F.coalesce(lines, none)


def render(blocks: DataFrame, doc: str, order: str = "seq", has_rows: bool = False) -> DataFrame:
    """doc, markdown: blocks in order, runs of blank lines as one, no blank line at either end."""
    lines = blocks.select(doc, order, block_lines(F.col("kind"), F.col("level"), F.col("text"), F.col("rows") if has_rows else None).alias("lines"))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "lines"))), lambda s: s["lines"])), "\n")
    return lines.groupBy(doc).agg(joined.alias("markdown")).select(doc, F.regexp_replace(F.regexp_replace("markdown", r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "").alias("markdown"))


def drop_repeated_formulas(lines: DataFrame, doc: str) -> DataFrame:
    """Without display formulas ($$ ... $$ on a line) equal to the formula line before them, blank lines aside."""
    w = Window.partitionBy(doc).orderBy("line_no")
    text = F.when(trim(F.col("line")) != "", F.col("line"))
    before = F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    formula = F.col("line").rlike(r"\A\s*\$\$.*\$\$\s*\z")
    return lines.withColumn("_same", F.coalesce(formula & (before == F.col("line")), F.lit(False))).filter(~F.col("_same")).drop("_same")


def contents_entries(markdown: Column) -> Column:
    """array of (token, title, page) of flattened contents: dotted number, title, optional page number after leaders."""
    found = F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*(?:- )?(\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\S.*?)\s*$"), F.lit(1))
    part = lambda x, i: F.regexp_extract(x, r"\A(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+(.*?)(?:[\s.·…]{2,}(\d{1,3}))?\z", i)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("token"), part(x, 2).alias("title"), part(x, 3).alias("page")))


def summary(docs: DataFrame, doc: str) -> DataFrame:
    """doc, json: every column of a summary row as one JSON object."""
    return docs.select(doc, F.to_json(F.struct(*docs.columns)).alias("json"))
