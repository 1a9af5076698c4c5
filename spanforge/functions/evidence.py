"""What of a source must be found in an output: headings, formulas, anchors, pictures. Compact forms on both sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packs import EMPTY, Pack
from .predicates import count_of
from .text import CJK, compact_signs, covers, numeric_anchors, trim

#: A heading of a source (number, title); a line of a table of contents; a heading that starts another section.
SOURCE_HEADING = rf"\A\s*((?:\d+(?:[.．]\d+){{0,4}})|[一二三四五六七八九十]{{1,3}}[、.．])\s*([A-Za-z0-9{CJK}（）()【】《》·、/\-]{{2,80}})\s*\z"
CONTENTS_LINE = r"\A\s*((?:\d+(?:[.．]\d+)*)|[一二三四五六七八九十]{1,3}[、.．])\s*(.+?)\s*[.。·•．…⋯\s]*\d{1,3}\s*\z"
NEXT_SECTION = r"\A(?:\d+(?:[.．]\d+)+|[一二三四五六七八九十]{1,3}[、.．])\s*"


def _lit(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def has_any(x: Column, words: list[str]) -> Column:
    return F.exists(_lit(words), lambda w: F.contains(x, w))


def lines_of(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")


def rows_text(rows: Column, between: str = "\n") -> Column:
    """The filled cells of each row by spaces, rows by ``between``; empty for no rows."""
    line = lambda r: F.array_join(F.filter(r, lambda c: F.coalesce(c, F.lit("")) != ""), " ")
    return F.coalesce(F.array_join(F.transform(rows, line), between), F.lit(""))


def block_text(text: Column, rows: Column) -> Column:
    """Text, then rows, each on a line of its own."""
    parts = F.array(F.coalesce(text, F.lit("")), rows_text(rows))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def heading_token(line: Column) -> Column:
    return F.replace(F.regexp_extract(line, SOURCE_HEADING, 1), F.lit("．"), F.lit("."))


def heading_title(line: Column) -> Column:
    return trim(F.regexp_extract(line, SOURCE_HEADING, 2))


def probable_heading(token: Column, title: Column, pack: Pack = EMPTY) -> Column:
    """Two ideographs or more in the title, and neither a date nor a quantity."""
    flat = compact_signs(title)
    year = token.rlike(r"\A20\d{2}\z") & flat.rlike(r"\A年\d{1,2}月")
    date = F.concat(token, flat).rlike(r"\d{4}年\d{1,2}月\d{1,2}日")
    amount = token.rlike(r"\A\d+\z") & (flat.rlike(r"\A(?:分钟|秒|公里|km|KM)") | has_any(flat, pack.not_headings))
    return (count_of(flat, f"[{CJK}]") >= 2) & ~year & ~date & ~amount


def detailed_section(token: Column) -> Column:
    """A numbered child: sections of ideographic numbers are containers."""
    t = F.replace(token, F.lit("．"), F.lit("."))
    return ~t.rlike(r"\A[一二三四五六七八九十]{1,3}[、.]\z") & F.contains(t, F.lit("."))


def local_evidence(section: Column, limit: int = 2200) -> Column:
    """The front of a section: its heading and the lines up to one that starts another, ``limit`` characters at most."""
    lines = lines_of(section)
    other = lambda s: trim(s).rlike(SOURCE_HEADING) | trim(s).rlike(NEXT_SECTION)
    ends = F.filter(F.transform(lines, lambda s, i: F.when((i > 0) & other(s), i)), lambda i: i.isNotNull())
    kept = F.slice(lines, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(lines)))
    return F.left(F.when(F.size(lines) > 1, F.array_join(kept, "\n")).otherwise(F.coalesce(section, F.lit(""))), F.lit(limit))


def formula_anchor(x: Column) -> Column:
    """Letters, digits and ideographs of a left side, without the command for text."""
    return F.regexp_replace(F.replace(F.regexp_replace(compact_signs(x), r"\A[。．·•、:：|]+", ""), F.lit(r"\text"), F.lit("")), rf"[^0-9A-Za-z{CJK}]", "")


def formula_left_sides(source: Column, pack: Pack = EMPTY) -> Column:
    """Compact left sides of the source's formula lines that name something: four to 36 signs, one clause, no comparison or sum."""

    def left(line: Column) -> Column:
        side = F.regexp_extract(line, r"\A([^=＝≤≥]*)", 1)
        side = F.regexp_replace(F.regexp_replace(side, r"\A[|•·\-\s]+", ""), r"\A[ ：:]+|[ ：:]+\z", "")
        for pattern in (pack.formula_item, pack.formula_lead):
            side = F.regexp_replace(side, pattern, "") if pattern else side
        return F.when(~side.rlike("[。；;]"), compact_signs(side))

    lines = F.filter(F.transform(lines_of(source), trim), lambda s: (F.char_length(s) >= 8) & s.rlike(r"(?i)[=＝]|SUM|Σ") & s.rlike(f"[{CJK}]"))
    odd = r"(?i)[<>≤≥〈〉＜＞、]|\A(?:订单\d+|正向指标|负向指标)|[（(][^）)]*\d+\s*[,，]\s*\d+|SUM|Σ|K[n].*Q[n]|Q[n].*K[n]"
    return F.array_distinct(F.filter(F.transform(lines, left), lambda s: F.char_length(s).between(4, 36) & ~s.rlike(odd)))


def missing_formulas(source: Column, target: Column, pack: Pack = EMPTY, most: int = 20) -> Column:
    """Left sides that the target lacks, marks aside."""
    flat, anchor = compact_signs(target), formula_anchor(target)
    lacks = lambda s: ~F.contains(flat, s) & ~((formula_anchor(s) != "") & F.contains(anchor, formula_anchor(s)))
    return F.slice(F.filter(formula_left_sides(source, pack), lacks), 1, most)


def missing_seen(source: Column, target: Column, terms: Column) -> Column:
    """Of an array of terms, those in the compact source that the compact target has under no spelling."""
    return F.array_distinct(F.filter(terms, lambda t: (compact_signs(t) != "") & F.contains(source, compact_signs(t)) & ~covers(target, t)))


def region_anchors(text: Column, pack: Pack = EMPTY) -> Column:
    """The pack's anchors, and number and title of a heading."""
    t = trim(F.coalesce(text, F.lit("")))
    token, title = heading_token(t), heading_title(t)
    own = F.when((token != "") & probable_heading(token, title, pack), F.array(F.regexp_extract(t, SOURCE_HEADING, 1), F.regexp_extract(t, SOURCE_HEADING, 2))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_lit(pack.region_anchors), own))


def high_risk_region(kind: Column, stage: Column, flags: Column, text: Column, flat: Column, pack: Pack = EMPTY) -> Column:
    """A recorded region whose loss must be reported: headings in every stage; beyond recognised lines, what is flagged, tables and
    pictures with text, and what holds a term of the pack."""
    t = trim(F.coalesce(text, F.lit("")))
    token, title = heading_token(t), heading_title(t)
    flagged = F.coalesce(F.arrays_overlap(flags, _lit(["auto_image", "table_fallback", "formula", "table_low_confidence"])), F.lit(False))
    content = flagged | (kind.isin("table", "image") & (F.char_length(flat) >= 12)) | has_any(flat, pack.region_terms)
    return (F.char_length(flat) >= 4) & (((token != "") & probable_heading(token, title, pack)) | ((F.coalesce(stage, F.lit("")) != "ocr_line") & content))


def raw_anchors(text: Column, pack: Pack = EMPTY) -> Column:
    return F.concat(_lit(pack.raw_anchors), numeric_anchors(text))


def high_risk_block(kind: Column, rows: Column, flat: Column, pack: Pack = EMPTY) -> Column:
    """Twenty signs or more, no heading, with a term of the pack; tables also with one of its column terms."""
    return (F.char_length(flat) >= 20) & (kind != "heading") & (has_any(flat, pack.raw_terms) | ((F.coalesce(F.size(rows), F.lit(0)) > 0) & has_any(flat, pack.raw_row_terms)))


def image_is_important(text: Column, rows: Column, pack: Pack = EMPTY) -> Column:
    """Signs of a formula or a term of the pack in a picture's text or rows."""
    flat = compact_signs(F.concat_ws(" ", text, rows_text(rows, " ")))
    return (flat != "") & (flat.rlike(r"(?i)[=＝≤≥×÷*/]|SUM|Σ") | has_any(flat, pack.image_terms))


def image_rows_are_important(text: Column, rows: Column, pack: Pack = EMPTY) -> Column:
    cells = F.filter(F.transform(F.flatten(rows), compact_signs), lambda c: c != "")
    many = (F.size(rows) >= 2) & (F.size(cells) >= 4)
    flat = compact_signs(rows_text(rows, " "))
    return F.coalesce((F.size(rows) > 0) & (F.char_length(flat) >= 12) & (image_is_important(text, rows, pack) | many | F.exists(cells, lambda c: F.char_length(c) >= 8)), F.lit(False))


def anchors_exported(text: Column, markdown: Column, hits: int = 1) -> Column:
    """Do the starts of enough lines (28 signs of those of four or more) stand in the compact output?"""
    starts = F.filter(F.transform(lines_of(text), compact_signs), lambda s: F.char_length(s) >= 4)
    return F.size(F.filter(F.transform(starts, lambda s: F.left(s, F.lit(28))), lambda s: F.contains(markdown, s))) >= hits


def image_exported(text: Column, rows: Column, flags: Column, markdown: Column) -> Column:
    """Is a picture's text, or are its rows, in the compact output? Formulas by one line, others by two or by their start."""
    flat, table = compact_signs(text), compact_signs(rows_text(rows, " "))
    start = lambda c: (F.char_length(c) >= 8) & F.contains(markdown, F.left(c, F.lit(40)))
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.left(compact_signs(c), F.lit(24))), lambda c: (F.char_length(c) >= 4) & F.contains(markdown, c))
    formula = F.coalesce(F.array_contains(flags, "formula"), F.lit(False)) & anchors_exported(text, markdown)
    return formula | start(flat) | anchors_exported(text, markdown, 2) | start(table) | F.coalesce(F.size(cells) >= 2, F.lit(False))
