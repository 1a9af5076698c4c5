"""Document-wide rewrites of Markdown lines: headings, contents, notes, formulas, long lines, repeated fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, compact_signs, numbering, trim, wrap

#: Marks before which a readable text breaks.
BREAK_BEFORE = [r"注[:：]", r"备注[:：]", r"PS[:：]", r"Note:", r"举例\d*[:：]", r"其中[:：，,]", r"示例[:：]?"]


def break_notes(text: Column, marks: list[str] = BREAK_BEFORE) -> Column:
    """A line end after a full stop or semicolon where a note, example or remark begins."""
    return F.regexp_replace(text, rf"([。；;.])[ \t]*(?={'|'.join(marks)})", "$1\n")


def readable_lines(text: Column, limit: int = 180) -> Column:
    """array of lines: <br> as line ends, broken before notes, wrapped; blank ones left out."""
    broken = break_notes(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"))
    lines = F.filter(F.transform(F.split(broken, "\n"), trim), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) > limit, wrap(x, limit)).otherwise(F.array(x))))


def wrap_long(lines: DataFrame, doc: str, limit: int = 220, order: str = "line_no") -> DataFrame:
    """doc, line_no, part, line: lines above the limit wrapped, but for code, formulas, headings, tables and lists."""
    w = Window.partitionBy(doc).orderBy(order)
    fence = F.pmod(F.sum(F.col("line").rlike(r"\A\s*```").cast("int")).over(w), F.lit(2))
    math = F.pmod(F.sum(F.col("line").rlike(r"\A\s*\$\$\s*\z").cast("int")).over(w), F.lit(2))
    fixed = (F.col("_f") == 1) | (F.col("_m") == 1) | F.col("line").rlike(r"\A\s*(?:```|\$\$|#|\||[-*] |\d+\. )")
    parts = F.when(fixed | (F.char_length("line") <= limit), F.array("line")).otherwise(wrap(F.col("line"), limit))
    return lines.withColumn("_f", fence).withColumn("_m", math).select(doc, order, F.posexplode(parts).alias("part", "line"))


def restore_headings(lines: DataFrame, doc: str, order: str = "line_no") -> DataFrame:
    """The rows with ``line``: a numbered line alone between blank lines becomes a heading, two marks deeper than its numbering."""
    w = Window.partitionBy(doc).orderBy(order)
    blank = lambda c: F.coalesce(trim(c) == "", F.lit(True))
    t = trim(F.col("line"))
    number = numbering(t)
    alone = blank(F.lag("line").over(w)) & blank(F.lead("line").over(w))
    fits = alone & (number != "") & F.contains(number, F.lit(".")) & (F.char_length(t) <= 60) & ~t.rlike(r"[。；;，,.:：]\z") & ~t.startswith("#")
    depth = F.least(F.size(F.split(number, r"\.")) + 2, F.lit(6))
    return lines.withColumn("line", F.when(fits, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), t)).otherwise(F.col("line")))


def contents_and_body(lines: DataFrame, doc: str, title: str = r"\A#*\s*(?:目\s*录|Contents|Table of Contents)\s*\z", order: str = "line_no") -> DataFrame:
    """The rows with ``part``: front, contents (from a contents title to its last entry) or body.

    Entries are numbered lines, with or without a list mark; blank lines between them belong to the contents.
    """
    w = Window.partitionBy(doc)
    t = trim(F.regexp_replace("line", r"\A\s*[-*]\s+", ""))
    entry = t.rlike(r"\A(?:\d{1,2}(?:[.．]\d{1,2})*[.．、]?\s*\S|[一二三四五六七八九十]{1,3}[、.．])")
    start = F.min(F.when(trim(F.col("line")).rlike(f"(?i){title}"), F.col(order))).over(w)
    first = F.min(F.when((F.col(order) > F.col("_s")) & entry, F.col(order))).over(w)
    stop = F.min(F.when((F.col(order) > F.col("_e")) & ~entry & (t != ""), F.col(order))).over(w)
    marked = lines.withColumn("_s", start).withColumn("_e", first).withColumn("_x", stop)
    part = F.when(F.col("_e").isNull() | (F.col(order) < F.col("_s")), F.when(F.col("_e").isNull(), "body").otherwise("front")).when(F.col("_x").isNull() | (F.col(order) < F.col("_x")), "contents").otherwise("body")
    return marked.withColumn("part", part).drop("_s", "_e", "_x")


def nested_contents(entries: Column) -> Column:
    """array of list lines of (token, title, page) entries, indented by the depth of the token."""
    return F.transform(
        entries,
        lambda e: F.concat(F.repeat(F.lit("  "), F.size(F.split(e["token"], r"\.")) - 1), F.lit("- "), e["token"], F.lit(" "), e["title"], F.when(e["page"] != "", F.concat(F.lit(" "), e["page"])).otherwise("")),
    )


def missing_body_headings(entries: DataFrame, lines: DataFrame, doc: str, order: str = "line_no", tail: int = 6) -> DataFrame:
    """doc, line_no, line: a heading for each contents entry (documents with four or more) that the body lacks.

    It belongs before the first body line that holds the last characters of the entry's title. entries: doc, seq, token,
    title; lines: body lines.
    """
    many = entries.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(doc))).filter("_n >= 4").drop("_n")
    body = lines.select(doc, order, "line", compact_signs(F.col("line")).alias("_c"))
    both = many.withColumn("_full", compact_signs(F.concat("token", "title"))).withColumn("_tail", F.right(compact_signs(F.col("title")), F.lit(tail))).join(body, doc)
    found = both.groupBy(doc, "seq", "token", "title").agg(
        F.max((F.contains("_c", F.col("_full")) & F.col("line").startswith("#")).cast("int")).alias("_there"), F.min(F.when(F.contains("_c", F.col("_tail")), F.col(order))).alias(order)
    )
    depth = F.least(F.size(F.split("token", r"\.")) + 1, F.lit(6))
    return found.filter((F.col("_there") == 0) & F.col(order).isNotNull()).select(doc, order, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), "token", F.lit(" "), "title").alias("line"))


def formula_latex(text: Column, templates: list[tuple[list[str], str]]) -> Column:
    """The LaTeX of the first template all of whose tokens the text holds; empty if none."""
    flat = compact(text)
    out = F.lit("")
    for tokens, latex in reversed(templates):
        holds = F.lit(True)
        for t in tokens:
            holds = holds & F.contains(flat, F.lit(t))
        out = F.when(holds, F.lit(latex)).otherwise(out)
    return out


def drop_covered_fragments(lines: DataFrame, doc: str, fragment: Column, order: str = "line_no") -> DataFrame:
    """Without fragment lines in sections (from heading to heading) that hold a display formula with a fraction."""
    w = Window.partitionBy(doc).orderBy(order)
    numbered = lines.withColumn("_sec", F.sum(F.col("line").rlike(r"\A\s*#").cast("int")).over(w))
    has = F.max((F.contains("line", F.lit("\\frac")) & F.contains("line", F.lit("$$"))).cast("int")).over(Window.partitionBy(doc, "_sec"))
    return numbered.withColumn("_has", has).filter(~(fragment & (F.col("_has") == 1))).drop("_sec", "_has")


def first_of_section(lines: DataFrame, doc: str, which: Column, order: str = "line_no") -> DataFrame:
    """Lines that ``which`` picks stay only once a section: the first of each text."""
    w = Window.partitionBy(doc).orderBy(order)
    numbered = lines.withColumn("_sec", F.sum(F.col("line").rlike(r"\A\s*#").cast("int")).over(w)).withColumn("_w", which)
    rank = F.row_number().over(Window.partitionBy(doc, "_sec", "_w", "line").orderBy(order))
    return numbered.withColumn("_k", rank).filter(~F.col("_w") | (F.col("_k") == 1)).drop("_sec", "_w", "_k")


def records(lines: DataFrame, doc: str, start: str, order: str = "line_no") -> DataFrame:
    """doc, record (from 1), first_line, fields: labelled records as maps of label to value.

    A record begins at a line that starts with ``start`` and goes on over indented lines; continuation lines without a label
    are added to the field before. Lines outside of records are left out.
    """
    w = Window.partitionBy(doc).orderBy(order)
    begins = F.col("line").startswith(start)
    inside = begins | F.col("line").rlike(r"\A\s+\S")
    marked = lines.withColumn("_r", F.sum(begins.cast("int")).over(w)).withColumn("_g", F.sum((~inside).cast("int")).over(w))
    held = marked.filter(inside & (F.col("_r") > 0))
    opened = held.withColumn("_own", F.max(F.when(begins, F.col("_g"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_own = _g")
    label = F.regexp_extract("line", r"\A\s*(?:[-*]\s*)?([^:：\s][^:：]{0,20})[:：]\s*(.*)\z", 1)
    value = F.when(label != "", F.regexp_extract("line", r"\A\s*(?:[-*]\s*)?([^:：\s][^:：]{0,20})[:：]\s*(.*)\z", 2)).otherwise(trim(F.col("line")))
    named = opened.withColumn("_v", value).withColumn("_l", F.last(F.when(label != "", label), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fields = named.groupBy(doc, "_r", "_l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_v"))), lambda s: s["_v"]), " ").alias("_v"), F.min(order).alias("_o"))
    return fields.groupBy(doc, F.col("_r").alias("record")).agg(F.min("_o").alias("first_line"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_v")))).alias("fields"))
