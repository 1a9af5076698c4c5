"""The full Markdown sink: blocks with flags, formulas and tables to text, then the document-wide rewrites in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as X
from ..functions import grids
from ..functions.packs import EMPTY, Pack
from ..functions.text import md_escape, strip_controls, trim
from ..operators import layout
from . import markdown as M

#: Prose after which a bare formula stands; labels that a line end has torn apart; where definitions part.
LEAD_INS = [r"\bcomputed as", "same accessible set:"]
TORN_NOTE = r"备\n注[:：]"
DEFINITIONS = r"(?:指标定义|数据来源|考核范围|核算公式|计算公式)[:：]"


def text_line(line: Column) -> Column:
    """A bullet as a list item, anything else escaped."""
    bullet = F.regexp_extract(trim(line), r"\A[•·▪]\s*(.+)\z", 1)
    return F.when(bullet != "", F.concat(F.lit("- "), md_escape(trim(bullet)))).otherwise(md_escape(line))


def reviewable(text: Column, pack: Pack = EMPTY, templates: list | None = None, marker: str = "") -> Column:
    """array of lines of a text: known visual formulas as LaTeX, those that need a second look under the marker."""
    none = F.array().cast("array<string>")

    def one(line: Column) -> Column:
        latex = layout.formula_latex(line, templates or [])
        shown = (latex != "") & X.visual_formula(line, pack)
        review = X.needs_review(line, pack, marker, latex != "") if marker else F.lit(False)
        return F.when(shown, F.array(F.concat(F.lit("$$"), latex, F.lit("$$")))).when(review, F.array(F.lit(f"**{marker}**"), F.lit(""), md_escape(line))).otherwise(F.array(text_line(line)))

    return F.coalesce(F.flatten(F.transform(layout.readable_lines(F.coalesce(text, F.lit(""))), one)), none)


def table_lines(rows: Column, flags: Column, pack: Pack = EMPTY) -> Column:
    """A pipe table, or grouped text for one that is complex and not better as it is."""
    grouped = ~grids.native_prefers_pipes(rows, flags, pack) & grids.complex_by_rules(rows, pack)
    return F.when(grouped, grids.readable_table(rows, layout.readable_lines, pack)).otherwise(grids.pipe_table(rows))


def block_lines(kind: Column, level: Column, text: Column, rows: Column, flags: Column, pack: Pack = EMPTY, templates: list | None = None, marker: str = "") -> Column:
    """array of lines of a block, a blank line at the end; formula_text paragraphs are not looked at here."""
    none = F.array().cast("array<string>")
    flags = F.coalesce(flags, none)
    flagged = lambda f: F.array_contains(flags, f)
    lines = reviewable(text, pack, templates, marker)
    has_rows = F.coalesce(F.size(rows), F.lit(0)) > 0
    latex = layout.formula_latex(F.coalesce(text, F.lit("")), templates or [])
    display = F.array(F.concat(F.lit("$$"), latex, F.lit("$$")))
    mode = X.formula_mode(text, flags, pack, latex != "")
    marked = F.concat(F.array(F.lit(f"**{marker}**"), F.lit("")) if marker else none, F.transform(layout.readable_lines(F.coalesce(text, F.lit(""))), md_escape))
    formula = F.when(mode == "text", lines).when((mode == "latex") & (latex != ""), display).otherwise(marked)
    stays = X.text_must_stay(text, pack)
    under = F.concat(lines, F.array(F.lit("")))
    table = table_lines(rows, flags, pack)
    caption = ~flagged("formula") & ~flagged("auto_image") & caption_is_reliable(text)
    picture = (
        F.when(flagged("formula"), formula)
        .when(has_rows, F.concat(F.when(X.text_is_reliable(text), under).otherwise(none), table))
        .when((latex != "") & X.visual_formula(text, pack), display)
        .when(caption | flagged("auto_image"), lines)
        .otherwise(none)
    )
    head = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), md_escape(F.coalesce(text, F.lit(""))))
    body = (
        F.when(kind == "heading", F.array(head))
        .when(kind.isin("para", "caption"), lines)
        .when((kind == "table") & has_rows, F.concat(F.when(stays, under).otherwise(none), table))
        .when(kind == "table", F.when(stays, lines).otherwise(none))
        .when(kind == "image", picture)
        .otherwise(none)
    )
    return F.concat(body, F.array(F.lit("")))


def caption_is_reliable(text: Column) -> Column:
    """Text of a picture that is neither blank, a page number, nor torn contents."""
    t = trim(F.coalesce(text, F.lit("")))
    return (t != "") & (X.text_is_reliable(t) | ((F.char_length(F.regexp_replace(t, r"\s", "")) < 4) & ~t.rlike(r"\A\s*\d{1,3}\s*\z")))


def export(blocks: DataFrame, doc: str = "doc_id", pack: Pack = EMPTY, templates: list | None = None, marker: str = "", order: str = "seq") -> DataFrame:
    """doc, markdown. blocks: doc, order, kind, text, level, rows, flags.

    Paragraphs flagged formula_text, and bare formulas at the end of prose, that follow each other stand in one fenced
    block. The result has no runs of blank lines and ends in one line end; a document without text is a line end.
    """
    para = F.col("kind") == "para"
    is_formula = F.coalesce(F.array_contains("flags", "formula_text"), F.lit(False))
    whole = F.array(F.struct(F.when(para & is_formula, "formula_text").otherwise("block").alias("kind"), F.coalesce("text", F.lit("")).alias("value")))
    tails = F.transform(X.formula_tail(F.col("text"), LEAD_INS), lambda s: F.struct(F.when(s["kind"] == "text", "block").otherwise(s["kind"]).alias("kind"), s["value"].alias("value")))
    parts = F.when(para & ~is_formula & (F.size(tails) > 1), tails).otherwise(whole)
    split = blocks.select("*", F.posexplode(parts).alias("_p", "_s"))
    w = Window.partitionBy(doc).orderBy(order, "_p")
    code = F.col("_s.kind") == "formula_text"
    runs = split.withColumn("_code", code).withColumn("_run", F.sum((~code).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(F.col("_p") > -1, F.col("_s.value"))
    lines = block_lines(F.col("kind"), F.col("level"), text, F.col("rows"), F.col("flags"), pack, templates, marker)
    plain = runs.filter(~F.col("_code")).select(doc, "_run", F.lit(0).alias("_k"), lines.alias("_l"))
    raw = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "_p", F.col("_s.value").alias("v")))), lambda s: F.split(strip_controls(s["v"]), "\n")))
    fenced = runs.filter("_code").groupBy(doc, "_run").agg(F.filter(F.transform(raw, trim), lambda x: x != "").alias("_c"))
    fenced = fenced.filter(F.size("_c") > 0).select(doc, "_run", F.lit(1).alias("_k"), F.concat(F.array(F.lit("```text")), "_c", F.array(F.lit("```"), F.lit(""))).alias("_l"))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_k", "_l"))), lambda s: s["_l"])), "\n")
    done = plain.unionByName(fenced).groupBy(doc).agg(joined.alias("markdown"))
    return done.select(doc, F.concat(F.regexp_replace(trim(F.col("markdown")), r"\n{3,}", "\n\n"), F.lit("\n")).alias("markdown"))


def finish(exported: DataFrame, doc: str = "doc_id", pack: Pack = EMPTY, limit: int = 220) -> DataFrame:
    """doc, markdown after the document-wide rewrites, in this order: repeated formulas, fragments that a formula covers,
    numbered headings, headings that the contents promise, breaks before notes and definitions, long lines."""
    lines = exported.select(doc, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    lines = M.drop_repeated_formulas(lines, doc)
    lines = layout.drop_covered_fragments(lines, doc, X.needs_review(F.col("line"), pack)) if pack.review_labels else lines
    lines = layout.restore_headings(lines, doc)
    parted = layout.contents_and_body(lines, doc)
    entries = parted.filter("part = 'contents'").select(doc, F.col("line_no").alias("seq"), F.get(M.contents_entries(F.col("line")), F.lit(0)).alias("e")).filter("e is not null").select(doc, "seq", "e.token", "e.title")
    promised = layout.missing_body_headings(entries, parted.filter("part = 'body'"), doc)
    lines = lines.select(doc, "line_no", F.lit(1).alias("_p"), "line").unionByName(promised.select(doc, "line_no", F.lit(0).alias("_p"), "line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_p", "line"))), lambda s: s["line"]), "\n")
    text = lines.groupBy(doc).agg(joined.alias("markdown"))
    broken = F.regexp_replace(layout.break_notes(F.col("markdown")), rf"([。；;])[ \t]*(?={DEFINITIONS})", "$1\n")
    text = text.select(doc, F.regexp_replace(F.regexp_replace(broken, rf"。\s*{TORN_NOTE}", "。\n备注："), rf"\n{TORN_NOTE}", "\n备注：").alias("markdown"))
    wrapped = layout.wrap_long(text.select(doc, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")), doc, limit)
    out = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", "line"))), lambda s: s["line"]), "\n")
    return wrapped.groupBy(doc).agg(out.alias("markdown"))
