"""Which texts are formulas, and what to do with them: readable as text, for LaTeX, or for a second look.

Mathematical letters are those of the mathematical italic block and Greek. Words that only one kind of document has come
as a pack (``packs.Pack``); an empty one switches their rules off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packs import EMPTY, Pack
from .predicates import count_of, garbled_score, is_noise
from .text import CJK, compact, latex_escape, strip_controls, trim

#: Letters of formulas; signs that make a line mathematics; operators by name; formula marks of markup.
LETTERS = r"\x{1D44E}-\x{1D467}\x{1D434}-\x{1D44D}α-ωΑ-Ω"
_ANY_MATH = rf"[=+\-*/×÷√∑Σ≤≥→←↔↦(){{}}\[\]|{LETTERS}]"
_STRONG = r"(?i)[=≈≤≥∑Σ√∪∩{}→←↔↦]|\b(?:exp|max|min|SUM)\b"
_OPERATOR = r"(?:exp|sqrt|log|min|max|sum|SUM)"
_MARKUP = r"(?i)\\frac|_\{|[A-Za-z]\s*/\s*[A-Za-z]"
_SUMS = r"(?i)SUM|Σ|\\frac|_\{|[A-Za-z]\s*/\s*[A-Za-z]"
_EQUALS = "[=＝]"
MATH_SIGN = r"[=≤≥×÷√∑∏∝≈≠＋＝]|[+*/^]\s*\d|\d\s*[+*/]"


def _has(x: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)) if words else F.lit(False)


def _matches(x: Column, pattern: str) -> Column:
    return x.rlike(pattern) if pattern else F.lit(False)


def _flat(x: Column) -> Column:
    return compact(F.coalesce(x, F.lit("")))


def math_fragment(x: Column) -> Column:
    """Up to 80 signs, no ideograph: one mathematical letter, arrows, a named operator, or two signs and more that with
    ASCII letters make up 0.55 of it (three at least)."""
    c = _flat(x)
    n, signs, letters = F.char_length(c), count_of(c, _ANY_MATH), count_of(c, "[A-Za-z]")
    alone = c.rlike(rf"\A(?:[{LETTERS}]|[→←↔↦]+\d*\.?|{_OPERATOR})\z")
    dense = (signs >= 2) & (signs + letters >= F.greatest(F.lit(3), n * 0.55))
    return (c != "") & (n <= 80) & ~c.rlike(f"[{CJK}]") & (alone | dense)


def standalone_math_line(x: Column, x0: Column, x1: Column, page_width: Column) -> Column:
    """A fragment that stands alone: not prose with a sign in it, and short or inset on its page."""
    c = _flat(x)
    prose = (F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("([A-Za-z]{3,})"), F.lit(1))) >= 4) & (count_of(x, _STRONG) < 2)
    placed = (F.greatest(x1 - x0, F.lit(0.0)) <= page_width * 0.68) | (x0 >= page_width * 0.25) | ((x0 > page_width * 0.12) & (x1 < page_width * 0.88))
    return math_fragment(x) & ~prose & placed & c.rlike(rf"[=≈≤≥∑Σ√→←↔↦]|[{LETTERS}]|\AÍ?{_OPERATOR}\z")


def short_math_block(x: Column) -> Column:
    """A block of up to 48 signs that may belong to a formula nearby: signs, an operator, or brackets and numbers only."""
    c = strip_controls(_flat(x))
    return (c != "") & (F.char_length(c) <= 48) & ~c.rlike(f"[{CJK}]") & c.rlike(rf"[=≈≤≥∑Σ√⊤⊥]|[{LETTERS}]|\A(?:Í|Í?{_OPERATOR}|[(),.;0-9]+)\z")


def space_math_letters(x: Column) -> Column:
    """Spaces between mathematical letters and the words they are glued to; none before a dash that is glued to the next word."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+—(?=\S)", "—")
    x = F.regexp_replace(x, rf"(?<=\))(?=[{LETTERS}])", " ")
    return F.regexp_replace(x, rf"([{LETTERS}])(?=[a-z]|[A-Z][a-z])", "$1 ")


def text_formula(x: Column) -> Column:
    """One line that reads as words: a name, one equal sign, two signs or more; four ideographs at least, 160 signs at most."""
    c = _flat(x)
    named = c.rlike(rf"\A[{CJK}A-Za-z0-9（）()、/+＋*× _{{}}]+[=＝].{{2,}}\z") & ~c.rlike(r"(?i)SUM|Σ|sqrt|\\frac|[上下]标")
    return ~F.contains(F.coalesce(x, F.lit("")), F.lit("\n")) & named & (count_of(c, _EQUALS) == 1) & (count_of(c, f"[{CJK}]") >= 4) & (F.char_length(c) <= 160)


def multiline_text_formula(x: Column) -> Column:
    """Up to four lines that together are one sum of words."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), trim), lambda s: s != "")
    c = compact(F.array_join(lines, ""))
    return F.size(lines).between(1, 4) & F.char_length(c).between(10, 220) & (count_of(c, _EQUALS) == 1) & ~c.rlike(_SUMS) & (count_of(c, f"[{CJK}]") >= 8) & c.rlike("[+＋]")


def table_continuation(x: Column, pack: Pack = EMPTY) -> Column:
    """Body of a table that only looks like a formula: sixty signs or more, four of the pack's table words, and brackets,
    column gaps or labels in number; never with one of its visual labels."""
    c = _flat(x)
    terms = F.size(F.filter(F.array(*[F.lit(t) for t in pack.table_terms]), lambda t: F.contains(c, t))) if pack.table_terms else F.lit(0)
    gaps = count_of(F.coalesce(x, F.lit("")), r"[^\n]{2,}\s{2,}[^\n]{2,}")
    labels = count_of(c, pack.table_labels) if pack.table_labels else F.lit(0)
    return (F.char_length(c) >= 60) & ~_has(c, pack.visual_labels) & (terms >= 4) & ((count_of(c, "[【】]") >= 3) | (gaps >= 2) | (labels >= 8))


def safe_low_confidence(x: Column) -> Column:
    """A formula that can stay text however unsure its recognition: of words, weighted scores, or worked percentages."""
    c = _flat(x)
    weighted = F.contains(c, F.lit("得分")) & F.contains(c, F.lit("权重")) & c.rlike("W[1-4]") & c.rlike(_EQUALS)
    worked = c.rlike(r"\d+%[*×]\d+") & c.rlike(r"[=＝]\d")
    return (c != "") & (text_formula(x) | multiline_text_formula(x) | weighted | worked)


def watermark(x: Column, noise: list[str], pack: Pack = EMPTY) -> Column:
    x = F.coalesce(x, F.lit(""))
    return is_noise(x, noise) | _matches(x, pack.watermarks)


def clean_though_unsure(x: Column, noise: list[str], pack: Pack = EMPTY) -> Column:
    """Contents lines, section titles and form fields: leaders lower the confidence, the text is sound all the same."""
    t = trim(F.coalesce(x, F.lit("")))
    contents = t.rlike(r"\A.{1,40}[　.\s。·•．…⋯：:\-－—]\d{1,3}\z")
    title = t.rlike(rf"\A[一二三四五六七八九十]{{1,3}}[、.．]\s*[0-9A-Za-z{CJK}（）()《》【】\s/-]{{2,24}}[.．。…⋯]?\z")
    odd = (garbled_score(t) > 0) | _matches(t, pack.suspect_characters) | watermark(t, noise, pack)
    return (t != "") & ~odd & (contents | title | _matches(t, pack.clean_fields))


def pure_noise(x: Column, noise: list[str], pack: Pack = EMPTY) -> Column:
    """Nothing, residue of headers and footers, a code of up to eight letters and digits, or a short text with a watermark."""
    c = _flat(x)
    code = (F.char_length(c) <= 8) & c.rlike(r"\A[一二三四五六七八九十]?[A-Za-z0-9]{2,}\z")
    marked = F.char_length(c).between(1, 28) & c.rlike(r"\A[#_()（）|\\/.·\-A-Za-z0-9]+\z") & _matches(c, pack.watermarks)
    return (c == "") | is_noise(c, noise) | code | marked | ((F.char_length(c) <= 20) & _matches(c, pack.watermarks))


def image_rather_than_text(x: Column, confidence: Column, noise: list[str], pack: Pack = EMPTY) -> Column:
    """A single unsure block better shown as its picture."""
    t = F.coalesce(x, F.lit(""))
    odd = t.rlike(MATH_SIGN) | (garbled_score(t) > 0) | _matches(t, pack.suspect_characters) | watermark(t, noise, pack)
    return ~text_formula(t) & (odd | ((confidence <= 0.35) & (F.char_length(compact(t)) >= 18)))


def image_may_hold_formula(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Compact and horizontal, neither a sliver nor most of the page."""
    share = width * height / F.greatest(page_width * page_height, F.lit(1.0))
    wide = (width / F.greatest(height, F.lit(1.0)) >= 1.2) | (height <= page_height * 0.28)
    return (width >= 60) & (height >= 18) & (share <= 0.75) & wide


def image_text_is_formula(x: Column, pack: Pack = EMPTY) -> Column:
    """Signs of a formula and, beside them, a label of the pack or a short name before an equal sign or a stroke."""
    c = _flat(x)
    signs = c.rlike(r"(?i)[=＝≤≥×÷√∑Σ]|SUM|\\frac|[A-Za-z]\s*/\s*[A-Za-z]|\d+\s*/\s*\d+")
    return (F.char_length(c) >= 4) & signs & (_matches(c, pack.image_labels) | c.rlike(rf"[A-Za-z]{{1,3}}[_{CJK}]*\s*[=＝/]"))


def plain_text_formula(x: Column, pack: Pack = EMPTY, review_marker: str = "") -> Column:
    """Eight to 180 signs with one equal sign, a left side of up to sixty and six ideographs or more, and no markup."""
    c = _flat(x)
    left = F.char_length(F.regexp_extract(c, r"\A([^=＝]*)[=＝]", 1))
    right = F.char_length(F.regexp_extract(c, r"[=＝](.*)\z", 1))
    marked = F.contains(c, F.lit(review_marker)) if review_marker else F.lit(False)
    return F.char_length(c).between(8, 180) & ~marked & (count_of(c, _EQUALS) == 1) & ~c.rlike(_MARKUP) & left.between(1, 60) & (right > 0) & ~_has(c, pack.visual_labels) & (count_of(c, f"[{CJK}]") >= 6)


def text_formula_paragraph(x: Column, pack: Pack = EMPTY, review_marker: str = "") -> Column:
    """A paragraph whose amounts are sums or products in words."""
    c = _flat(x)
    marked = F.contains(c, F.lit(review_marker)) if review_marker else F.lit(False)
    return (F.char_length(c) >= 12) & ~marked & c.rlike(_EQUALS) & ~c.rlike(r"\\frac|_\{") & ~_has(c, pack.visual_labels) & _matches(c, pack.score_formula)


def visual_formula(x: Column, pack: Pack = EMPTY) -> Column:
    return _has(_flat(x), pack.visual_labels)


def needs_review(x: Column, pack: Pack = EMPTY, review_marker: str = "", templated: Column | None = None) -> Column:
    """A line with a formula that neither text nor a template can show: strokes, sums or markup beside a label of the pack."""
    c = _flat(x)
    marked = F.contains(c, F.lit(review_marker)) if review_marker else F.lit(False)
    known = F.lit(False) if templated is None else templated
    shown = marked | known | plain_text_formula(x, pack, review_marker) | text_formula_paragraph(x, pack, review_marker)
    return (F.char_length(c) >= 8) & ~shown & c.rlike(r"(?i)[=＝/÷]|SUM|Σ") & _matches(c, pack.review_labels) & c.rlike(_SUMS)


def formula_mode(x: Column, flags: Column, pack: Pack = EMPTY, templated: Column | None = None) -> Column:
    """text, latex or uncertain: by flags, then by template, then by the text itself."""
    flagged = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    known = F.lit(False) if templated is None else templated
    readable = plain_text_formula(x, pack) | text_formula_paragraph(x, pack)
    return (
        F.when(flagged("formula_text"), "text")
        .when(flagged("formula_latex"), "latex")
        .when(flagged("formula_uncertain", "needs_review"), "uncertain")
        .when(known, "latex")
        .when(readable, "text")
        .when(visual_formula(x, pack) | (trim(F.coalesce(x, F.lit(""))) == ""), "uncertain")
        .otherwise("text")
    )


def latex_expression(x: Column) -> Column:
    """Signs as commands, runs of white space as one space."""
    for sign, command in (("＝", "="), ("×", r"\times "), ("≤", r"\le "), ("≥", r"\ge "), ("∞", r"\infty")):
        x = F.replace(x, F.lit(sign), F.lit(command))
    return F.regexp_replace(trim(x), r"\s+", " ")


def latex_equation(left: Column, right: Column) -> Column:
    """The left side as text, if there is one."""
    name = trim(F.coalesce(left, F.lit("")))
    return F.when(name == "", right).otherwise(F.concat(F.lit(r"\text{"), latex_escape(name), F.lit("} = "), right))


def formula_tail(x: Column, lead_ins: list[str]) -> Column:
    """array of (kind, value): a text, or prose and the bare formula that a lead-in (a pattern) ends with."""
    t = trim(strip_controls(F.coalesce(x, F.lit(""))))
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    out = F.when(t != "", F.array(part("text", t))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    for lead in reversed(lead_ins):
        pattern = rf"(?s)\A(.*?{lead})\s+([A-Za-z{LETTERS}⊤⊥∑Σ√\x{{FE01}}]{{1,12}})\z"
        out = F.when(t.rlike(pattern), F.array(part("text", trim(F.regexp_extract(t, pattern, 1))), part("formula_text", trim(F.regexp_extract(t, pattern, 2))))).otherwise(out)
    return out


def text_is_reliable(x: Column) -> Column:
    """Recognised text worth keeping under a picture: four signs or more, not a page number nor parts of a table of contents."""
    t = trim(F.coalesce(x, F.lit("")))
    c = compact(t)
    lines = F.filter(F.transform(F.split(t, "\n"), trim), lambda s: s != "")
    contents = F.exists(lines, lambda s: s.rlike(r"\A(?:[一二三四五六七八九十]{1,3}、|\d{1,2}[.．]).{1,40}[　\s.…]\d{1,3}\z")) & F.exists(lines, lambda s: s.rlike(r"\A\d{1,3}\z"))
    return (F.char_length(c) >= 4) & ~c.rlike(r"\A\d{1,3}\z") & ~contents & ~c.rlike(r"\d[一二三四五六七八九十]{1,3}、")


def text_must_stay(x: Column, pack: Pack = EMPTY) -> Column:
    """Text of an unreadable table that holds terms of value."""
    c = _flat(x)
    return text_is_reliable(x) & (F.char_length(c) >= 60) & _has(c, pack.preserved_terms)
