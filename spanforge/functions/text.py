"""Text functions on columns. Code points throughout; a null stays null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond what Java's and RE2's \s hold, as code points that both engines read.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: CJK ideographs; leader marks of tables of contents; ends of sentences.
CJK = r"\x{4E00}-\x{9FFF}"
LEADER = r".。·•．…⋯\-_"
TERMINAL = r".!?。！？;；:："


#: The characters of WS.
WS_CHARACTERS = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def trim(x: Column) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.btrim(x, F.lit(WS_CHARACTERS))


def compact(x: Column) -> Column:
    """Without any white space."""
    # most of it is spaces, which go without a pattern; printable ASCII is told by one comparison of the class
    return F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), rf"[[^!-~]&&[{WS}]]+", "")


def compact_signs(x: Column) -> Column:
    """Compact, full-width percent and equal signs made ASCII: the form in which coverage is compared."""
    return F.translate(compact(F.coalesce(x, F.lit(""))), "％＝", "%=")


def fuzzy(x: Column) -> Column:
    """ASCII letters, digits and CJK only: marks that recognition adds or drops don't tell keys apart."""
    return F.regexp_replace(x, rf"[^0-9A-Za-z{CJK}]", "")


#: What a key may have to lose: anything but spaces and Latin-1 that is neither white space nor a digit. Single characters, as Java
#: tells those below 256 by one look at a table, and a range by a call for each class that it stands in.
_NOT_PLAIN = "[^" + "".join(rf"\x{{{c:X}}}" for c in range(256) if c == 32 or not (chr(c) in WS_CHARACTERS or chr(c).isdecimal())) + "]"


def repeat_key(x: Column) -> Column:
    """Compact, with every run of digits as #: page numbers don't tell lines apart."""
    # most lines only lose their spaces, and are looked at once
    return F.when(x.rlike(_NOT_PLAIN), F.regexp_replace(compact(x), r"[[^!-/:-~]&&\p{Nd}]+", "#")).otherwise(F.replace(x, F.lit(" "), F.lit("")))


def clean_leaders(x: Column) -> Column:
    """A contents line's leaders become one ideographic space before the page number; leaders at the end go."""
    numbered = F.regexp_replace(x, rf"[{WS}]*[{LEADER}]{{2,}}[{WS}]*(\d{{1,3}})[{WS}]*\z", "　$1")
    return trim(F.regexp_replace(numbered, rf"[{LEADER}]{{3,}}[{WS}]*\z", ""))


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def join_hyphenated(x: Column) -> Column:
    """docu- ment -> document, between lower-case letters."""
    return F.regexp_replace(x, rf"(?<=[a-z])-[{WS}]+(?=[a-z])", "")


def join_lines(lines: Column) -> Column:
    """One line of several: a space where ASCII letters or digits would meet, none between ideographs."""
    meets = lambda a, b: F.right(a, F.lit(1)).rlike(r"[A-Za-z0-9,.;:)]") & F.left(b, F.lit(1)).rlike(r"[A-Za-z0-9(]")
    return F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).when(meets(acc, x), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, x)))


def numbering(x: Column) -> Column:
    """The dotted number a heading starts with, without a final dot; empty if none."""
    return F.translate(F.regexp_extract(x, r"\A(\d{1,2}(?:[.．]\d{1,2}){0,4})[.．]?\s*\S", 1), "．", ".")


def heading_level(x: Column, fallback: Column | int = 2) -> Column:
    """Depth of the numbering plus one, 2 to 6; else the fallback."""
    number = numbering(x)
    fallback = F.lit(fallback) if isinstance(fallback, int) else fallback
    return F.when(number == "", fallback).otherwise(F.least(F.greatest(F.size(F.split(number, r"\.")) + 1, F.lit(2)), F.lit(6)))


def md_escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([*_`\[\]])", r"\\$1")


def md_cell(x: Column) -> Column:
    """A table cell: line ends as a full-width semicolon, marks and pipes escaped."""
    return F.regexp_replace(md_escape(F.regexp_replace(trim(F.coalesce(x, F.lit(""))), r"\s*\n\s*", "；")), r"\|", r"\\|")


def latex_escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\{}])", r"\\$1")


def apply_rules(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered pattern rules, each on the result of the one before."""
    for pattern, replacement in rules:
        x = F.regexp_replace(x, pattern, replacement)
    return x


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is computed once a row, however often ``use`` names it: higher-order functions share nothing by themselves."""
    return F.transform(F.array(x), use)[0]


def rule_notes(x: Column, rules: list[tuple[str, str, str]]) -> Column:
    """array of (label, n): how often each rule (pattern, replacement, label) changes the text, in order; those that do."""

    plain = [re.escape(p) == p and not set(r) & set("\\$") for p, r, _ in rules]

    def by_turn(i: Column, of: Callable[[int], Column]) -> Column:
        out = F.when(i == 0, of(0))
        for k in range(1, len(rules)):
            out = out.when(i == k, of(k))
        return out

    def count(t: Column, k: int) -> Column:
        found = F.regexp_count(t, F.lit(rules[k][0]))
        return F.when(F.contains(t, F.lit(rules[k][0])), found).otherwise(0) if plain[k] else found

    def change(t: Column, k: int) -> Column:
        pattern, replacement, _ = rules[k]
        return F.replace(t, F.lit(pattern), F.lit(replacement)) if plain[k] else F.regexp_replace(t, pattern, replacement)

    if not rules:
        return F.array().cast("array<struct<label:string,n:int>>")
    labels = F.array(*[F.lit(label) for _, _, label in rules])
    note = lambda acc, i: F.struct(F.get(labels, i).alias("label"), by_turn(i, lambda k: count(acc["t"], k)).alias("n"))
    # each rule sees the text that the one before left: kept in the fold, as no expression is shared in such functions
    start = F.struct(x.alias("t"), F.array().cast("array<struct<label:string,n:int>>").alias("notes"))
    step = lambda acc, i: F.struct(by_turn(i, lambda k: change(acc["t"], k)).alias("t"), F.concat(acc["notes"], F.array(note(acc, i))).alias("notes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), start, step, lambda acc: F.filter(acc["notes"], lambda s: s["n"] > 0))


#: Repairs of recognised text, in order.
OCR_RULES = [
    (r"(?<=\d)\s*[.．]\s+(?=\d)", "."),
    (r"(?<=\d)[Oo](?=\d|%|\b)", "0"),
    (r"(?<=[A-Za-z0-9])×(?=[A-Za-z])", "X"),
    (r"（([^（）()]{0,40})\)", "（$1）"),
    (r"\(([^（）()]{0,40})）", "（$1）"),
]


def repair_recognised(x: Column) -> Column:
    return apply_rules(x, OCR_RULES)


#: What stands for what when coverage is compared (pattern, replacement); marks and a final "rate".
SPELLINGS = [("率\\z", ""), ("≤", "<="), ("≥", ">="), ("<=", "≤"), (">=", "≥")]


def variants(term: Column, spellings: list[tuple[str, str]] = SPELLINGS) -> Column:
    """Spellings under which a compact term counts as covered: itself, each of the replacements, and all of them in order."""
    spelled = [term, *[F.regexp_replace(term, p, r) for p, r in spellings]]
    pairs = [spellings[i : i + 2] for i in (1, 3) if len(spellings) >= i + 2]
    for pair in pairs:
        spelled.append(apply_rules(term, pair))
    return F.array_distinct(F.filter(F.array(*spelled), lambda v: v != ""))


def covers(haystack: Column, term: Column) -> Column:
    """Is the term, in any of its spellings, in the compact haystack?"""
    return F.exists(variants(compact_signs(term)), lambda v: F.contains(haystack, v))


#: Fixed value: a number with an optional unit, not right after an ASCII letter.
NUMBER = rf"(?<![A-Za-z])(\d+(?:[.,]\d+)?[{WS}]*(?:%|％|s|S|秒|分|单|天气|天|公里|km|KM)?)"


def numeric_anchors(x: Column, most: int = 80) -> Column:
    """The first distinct numbers worth looking for, compact and without commas: plain integers below 100 are not, nor is what
    only reads as days because weather follows."""
    found = F.transform(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(1)), lambda t: F.replace(compact_signs(t), F.lit(","), F.lit("")))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"\A\d{1,2}\z|天气\z"))), 1, most)


def missing_numbers(source: Column, target: Column, most: int = 80) -> Column:
    """Numbers of the source that the target lacks; a percent sign may be full width, a final .0 or unit s may be missing."""
    flat = F.translate(compact_signs(target), ",，", "")
    spelled = lambda t: F.array(t, F.regexp_replace(t, r"\.0\z", ""), F.regexp_replace(t, r"[sS]\z", ""))
    return F.filter(numeric_anchors(source, most), lambda t: ~F.exists(spelled(t), lambda v: F.contains(flat, v)))


def wrap(x: Column, limit: int = 180) -> Column:
    """array of lines of about ``limit`` characters, the text itself if it is within it.

    A text with spaces and fewer ideographs than a fifth is packed by words, any other by what marks end: as many as the
    limit takes stand in a line, a longer one is a line of its own. What has neither is cut at the limit.
    """
    ideographs = F.when(F.octet_length(x) == F.char_length(x), 0).otherwise(F.char_length(F.regexp_replace(x, f"[^{CJK}]+", "")))
    by_words = F.contains(x, F.lit(" ")) & (ideographs < F.char_length(x) * 0.2)
    spaced = trim(F.regexp_replace(x, rf"[[^!-~]&&[{WS}]]+", " "))
    words = F.regexp_extract_all(spaced, F.lit(rf"(?s)(.{{1,{limit}}}|[^ ]+)(?: |\z)"), F.lit(1))
    marks = "[。；;，、+＋=＝:：]"
    pieces = F.regexp_extract_all(x, F.lit(rf"(?s)(.{{1,{limit}}}(?:(?={marks})|(?<={marks})|\z)|[^{marks[1:]}+)"), F.lit(1))
    parts = F.filter(F.transform(pieces, trim), lambda p: p != "")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1)), F.lit(limit)), lambda at: F.substring(x, at, F.lit(limit)))
    by_marks = once(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(F.filter(cut, lambda c: c != "")))
    packed = F.when(by_words, once(words, lambda p: F.when(F.size(p) > 0, p).otherwise(by_marks))).otherwise(by_marks)
    return F.when(F.char_length(x) <= limit, F.array(x)).otherwise(packed)


def split_glued_numbers(x: Column, count: int) -> Column:
    """A cell that holds several numbers as ``count`` parts. The first way that gives so many decides: a text said twice; two
    numbers, the first as short as may be; a decimal point each; numbers with marks between; one digit each. Else the cell
    and blanks."""
    s = compact(F.coalesce(x, F.lit("")))
    n = F.char_length(s)
    left = lambda i: F.left(s, i)
    right = lambda i: F.right(s, n - i)
    number = lambda c: c.rlike(r"\A\d+(?:\.\d+)?\z")
    out = F.concat(F.array(s), F.array_repeat(F.lit(""), count - 1))
    out = F.when((n == count) & s.rlike(r"\A\d+\z"), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(1)))).otherwise(out)
    spaced = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    out = F.when(F.size(spaced) == count, spaced).otherwise(out)
    # from one run of digits with a point to the next; what stands before the first is not part of any
    pointed = F.regexp_extract_all(s, F.lit(r"(\d+\.(?:(?!\d+\.).)*)"), F.lit(1))
    out = F.when(F.size(pointed) == count, pointed).otherwise(out)
    if count == 2:
        cuts = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & number(left(i)) & number(right(i)))
        out = F.when(F.size(cuts) > 0, F.array(left(cuts[0]), right(cuts[0]))).otherwise(out)
        half = F.floor(n / 2).cast("int")
        out = F.when((n > 0) & (n % 2 == 0) & (left(half) == right(half)), F.array(left(half), left(half))).otherwise(out)
    return F.when(s == "", F.array_repeat(F.lit(""), count)).otherwise(out)
