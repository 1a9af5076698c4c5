"""Predicates and scores on columns of text, geometry and style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, compact, once, trim

#: Captions; equation numbers.
CAPTION = r"(?i)\A(?:Figure|Fig\.?|Table|图|表)\s*\d+\s*(?:[|:：.]|\s)"
EQUATION_NUMBER = r"\A\(?\d{1,3}\)?\z"
#: Words at which no sentence ends; a parameter of looks_truncated.
DANGLING = ["and", "or", "the", "of", "to", "with", "for", "by", "in", "a", "an", "及", "和", "或", "的", "与"]


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def garbled_score(x: Column) -> Column:
    """0 to 1: one if replacement or private-use characters or (cid:n) stand in the text; else the share of control,
    format, private, unassigned and surrogate characters among those beyond ASCII that are not white space."""

    # what is beyond ASCII is taken out first: little is left to look at
    def score(rest: Column) -> Column:
        even = F.regexp_replace(rest, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Cs}]+", "")
        beyond = F.char_length(F.regexp_replace(rest, rf"[{WS}]+", ""))
        lost = rest.rlike(r"[\x{FFFD}\x{E000}-\x{F8FF}]") | (F.contains(x, F.lit("(cid:")) & x.rlike(r"\(cid:\d+\)"))
        return F.when(lost, 1.0).when(beyond == 0, 0.0).otherwise((F.char_length(rest) - F.char_length(even)) / F.greatest(beyond, F.lit(1)))

    return once(F.when(F.octet_length(x) == F.char_length(x), "").otherwise(F.regexp_replace(x, r"[\x00-\x7F]+", "")), score)


def is_light(color: Column) -> Column:
    """Luma above 190, of a packed RGB integer."""
    part = lambda n: F.shiftright(color, n).bitwiseAND(F.lit(255))
    return part(16) * 0.299 + part(8) * 0.587 + part(0) * 0.114 > 190


def is_rotated(dy: Column) -> Column:
    return F.abs(dy) > 0.08


def is_caption(x: Column) -> Column:
    return x.rlike(CAPTION)


def is_equation_number(x: Column) -> Column:
    """One to three digits, in parentheses or not."""
    return compact(x).rlike(EQUATION_NUMBER)


def is_number(x: Column) -> Column:
    return x.rlike(r"\A\d+(\.\d+)?\z")


def is_page_number(x: Column) -> Column:
    return compact(x).rlike(r"\A(?:[-–—]?\d{1,4}[-–—]?|第\d{1,4}页|(?i)page\d{1,4}(?:of\d{1,4})?)\z")


def is_leader(x: Column) -> Column:
    return x.rlike(rf"\A[{WS}.。·•．…⋯\-_—－]+\z")


def is_bold_label(x: Column, bold: Column) -> Column:
    """A bold line that starts with a capitalised or ideographic label and a colon."""
    return bold & F.regexp_replace(trim(x), rf"[{WS}]+", " ").rlike(r"\A(?:[A-Z][A-Za-z0-9 /&()'\-]{1,48}|[\x{4E00}-\x{9FFF}]{2,16})[:：]\s*\S")


def looks_truncated(x: Column, dangling: list[str] = DANGLING) -> Column:
    """Twelve characters or more, no mark at the end, and a last word after which a sentence goes on."""
    ascii_words = "|".join(w for w in dangling if w.isascii())
    others = "|".join(w for w in dangling if not w.isascii())
    t = trim(x)
    return (F.char_length(t) >= 12) & t.rlike(rf"(?:(?:\A|[{WS}])(?:{ascii_words})|(?:{others or 'x^'}))\z")


def continues(previous: Column, following: Column) -> Column:
    """The line before has no mark at its end and the next starts in lower case; a blank line neither ends nor goes on."""
    before, after = trim(previous), trim(following)
    return (before != "") & ~before.rlike(r"[.!?。！？;；:：]\z") & after.rlike(r"\A[a-z]")


def is_noise(x: Column, patterns: list[str]) -> Column:
    """Blank, leaders only, or any of the caller's patterns for header and footer residue."""
    blank = compact(x) == ""
    return blank | is_leader(x) | (x.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False))


def heading_kind(x: Column, height: Column, body_height: Column, n_rows: Column, width: Column, page_width: Column) -> Column:
    """struct(kind, level) of a recognised row: by numbering, else by height.

    No heading has more than one row or forty characters, an equal sign, the width of a body line, or a mark at its end
    after which a sentence goes on; with a colon at its end only a numbered one is.
    """
    t = trim(x)
    out = (n_rows > 1) | (F.char_length(t) > 40) | t.rlike("[=＝]") | (width > page_width * 0.72) | t.rlike(r"[，、；,;]\z")
    number = F.regexp_extract(t, r"\A(\d{1,2}(?:[.．]\d{1,2}){0,3})\s*[、.．\s]", 1)
    head = lambda level: F.struct(F.lit("heading").alias("kind"), level.cast("int").alias("level"))
    none = F.struct(F.lit("para").alias("kind"), F.lit(0).alias("level"))
    return (
        F.when(out, none)
        .when(t.rlike(r"\A第[一二三四五六七八九十百\d]{1,3}[章节条部分]"), head(F.lit(1)))
        .when(t.rlike(r"\A[（(]?[一二三四五六七八九十]{1,3}[、）)．.]"), head(F.lit(2)))
        .when((number != "") & (F.char_length(t) <= 30), head(F.least(count_of(number, "[.．]") + 3, F.lit(4))))
        .when(t.rlike(r"[：:]\z"), none)
        .when((height > body_height * 1.35) & (F.char_length(t) <= 24), head(F.lit(1)))
        .otherwise(none)
    )


def high_risk(kind: Column, stage: Column, flags: Column, text: Column, terms: list[str], flagged: list[str]) -> Column:
    """A recorded region whose loss must be reported: a heading, a flagged region, a table, or one with a listed term.

    Regions of the stage ocr_line count only as headings.
    """
    has_term = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)
    return (
        F.when(kind == "heading", True)
        .when(stage == "ocr_line", False)
        .when(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in flagged])), True)
        .when(kind == "table", True)
        .otherwise(has_term)
    )


def review_markers(markdown: Column, markers: list[str]) -> Column:
    """Which of the placeholders that must not stay are in an output."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(markdown, m))
