"""Tables of results, as papers print them, whose values recognition has glued or shifted: label, then as many values as the header has.

A table is told by words that stand anywhere in it. Grids are array<array<string>> columns; one that fits no shape stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trim

_GRID = "array<array<string>>"
_NUMBER = r"(\d+(?:\.\d+)?)"
#: Headers that two kinds of table get; the measures of the first.
BY_CATEGORY = ["Model", "Edit", "PPT", "Academic Paper", "Book", "Colorful Textbook", "Exam Paper", "Magazine", "Newspaper", "Note", "Research Report"]
BY_MEASURE = ["Model", "Size", "Overall ↑", "Text Edit ↓", "Formula CDM ↑", "Table TEDs ↑", "Table TEDSs ↑", "Read-order Edit ↓"]
MEASURES = ["Text", "R-order"]
#: Words by which each kind of table is told.
METRIC_WORDS, SPEED_WORDS, CATEGORY_WORDS, MEASURE_WORDS = ["Metric", "Pages", "Distinct-20"], ["TPS", "Model", "Deepseek OCR"], ["Model", "Edit", "DS-OCR", "UOW"], ["Model", "Overall", "Unlimited-OCR"]


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _line(cells: Column) -> Column:
    return F.array_join(cells, " ")


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def starts_with_values(cell: Column) -> Column:
    """Only numbers, one word of the cell apart: the first cell of a row's values."""
    tokens = F.filter(F.split(F.coalesce(cell, F.lit("")), f"[{WS}]+"), lambda t: t != "")
    numbers = F.size(F.filter(tokens, lambda t: t.rlike(r"\A(?:[↑↓]?\d+(?:\.\d+)?%?|40\+)\z")))
    return (numbers >= 1) & (numbers >= F.size(tokens) - 1)


def _first(cells: Column, test: Callable[[Column], Column]) -> Column:
    """Place of the first cell that passes, from 0; null if none does."""
    return F.get(F.filter(F.transform(cells, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull()), F.lit(0))


def _parted(cells: Column, at: Column) -> tuple[Column, Column]:
    n = F.coalesce(at, F.size(cells))
    return F.slice(cells, 1, n), F.slice(cells, n + 1, F.greatest(F.size(cells) - n, F.lit(0)))


def _labelled(rows: Column, title: str, header_of: Callable[[Column], Column], starts: Callable[[Column], Column], value: str, skip: str, needs_start: bool) -> Column:
    """A header row gives the number of values; every other row with a label and values becomes label and values."""
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("head"), F.array().cast(_GRID).alias("body"))

    def add(acc: Column, row: Column) -> Column:
        head, at = header_of(_line(row)), _first(row, starts)
        before, after = _parted(row, at)
        label = trim(F.regexp_replace(_line(F.filter(F.transform(before, trim), lambda c: (c != "") & ~(F.contains(c, F.lit(skip)) if skip else F.lit(False)))), f"[{WS}]+", " "))
        values = _all(_line(after), value)
        fits = (label != "") & (F.size(values) > 0) & (at.isNotNull() if needs_start else F.lit(True))
        longer = F.concat(acc["body"], F.array(F.concat(F.array(label), F.slice(values, 1, F.size(acc["head"])))))
        return (
            F.when(F.size(head) > 0, F.struct(head.alias("head"), acc["body"].alias("body")))
            .when(fits, F.struct(acc["head"].alias("head"), longer.alias("body")))
            .otherwise(acc)
        )

    return F.aggregate(rows, state, add, lambda a: F.when((F.size(a["head"]) > 0) & (F.size(a["body"]) > 0), F.concat(F.array(F.concat(F.array(F.lit(title)), a["head"])), a["body"])).otherwise(rows))


def metric_by_pages(rows: Column) -> Column:
    """Numbers of pages as header, then a metric and its values a row."""
    none = F.array().cast("array<string>")
    header = lambda line: F.when(F.contains(line, F.lit("Pages")), _all(line, r"(40\+|\b\d+\b)")).otherwise(none)
    return _labelled(rows, "Metric", header, starts_with_values, r"(\d+(?:\.\d+)?%?)", "Metric", False)


def speed_by_length(rows: Column) -> Column:
    """Three lengths or more as header, then a model and its speeds a row."""
    none = F.array().cast("array<string>")

    def header(line: Column) -> Column:
        lengths = _all(line, r"\b(\d{3,4})\b")
        return F.when((F.contains(line, F.lit("TPS")) | F.contains(line, F.lit("Model"))) & (F.size(lengths) >= 3), lengths).otherwise(none)

    return _labelled(rows, "Model", header, lambda c: c.rlike(r"\d+\.\d+"), _NUMBER, "", True)


def nearby_model(rows: Column, at: Column) -> Column:
    """The first cell of a row next to this one, or the next but one, that names a model and holds no measure; empty if none does."""
    named = lambda r: trim(r[0])
    rest = lambda r: _line(F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), trim))
    out = F.lit("")
    for step in (-2, 2, -1, 1):
        r = F.get(rows, at + step)
        fits = r.isNotNull() & (F.size(r) > 0) & (named(r) != "") & (named(r) != "Model") & ~rest(r).rlike(r"\d+\.\d+|Text|R-order")
        out = F.when(F.coalesce(fits, F.lit(False)), named(r)).otherwise(out)
    return out


def model_by_category(rows: Column, most: int = 9, least: int = 6) -> Column:
    """Rows of a measure each: the model stands on the row, on one near it, or on the last row that named one."""
    state = F.struct(F.lit("").alias("last"), F.array().cast(_GRID).alias("body"))
    numbered = F.transform(rows, lambda r, i: F.struct(i.alias("i"), F.transform(r, trim).alias("c")))

    def add(acc: Column, s: Column) -> Column:
        cells = s["c"]
        first, measure = F.coalesce(F.get(cells, F.lit(0)), F.lit("")), F.coalesce(F.get(cells, F.lit(1)), F.lit(""))
        near = nearby_model(rows, s["i"])
        own = F.when(first == "Model", "").otherwise(first)
        own = F.when((own == "") & (measure == "Text"), near).otherwise(own)
        model = F.when(own != "", own).when(acc["last"] != "", acc["last"]).otherwise(near)
        values = _all(_line(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))), _NUMBER)
        row = F.concat(F.array(model, measure), F.slice(values, 1, most))
        fits = measure.isin(MEASURES) & (model != "") & (F.size(values) >= least)
        names = ~measure.isin(MEASURES) & (first != "") & (first != "Model")
        return F.struct(F.when(fits, model).when(names, first).otherwise(acc["last"]).alias("last"), F.when(fits, F.concat(acc["body"], F.array(row))).otherwise(acc["body"]).alias("body"))

    return F.aggregate(numbered, state, add, lambda a: F.when(F.size(a["body"]) > 0, F.concat(F.array(_strings(BY_CATEGORY)), a["body"])).otherwise(rows))


def model_by_measure(rows: Column) -> Column:
    """Rows of six cells or more with numbers under a fixed header; lines between them that only name a group; rows that go on
    without a model."""
    n = len(BY_MEASURE)

    def one(row: Column) -> Column:
        cells = F.transform(row, trim)
        text, first = _line(cells), F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
        rest = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
        blank = (trim(text) == "") | F.array_contains(cells, "Model") | F.contains(text, F.lit("Overall"))
        group = F.concat(F.array(trim(F.regexp_replace(text, f"[{WS}]+", " "))), F.array_repeat(F.lit(""), n - 1))
        on = F.concat(F.array(F.lit(""), F.lit("")), F.slice(rest, 1, n - 2))
        whole = F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)
        return (
            F.when(blank, F.lit(None))
            .when(text.rlike(r"End-to-end\s+Model"), group)
            .when((first == "") & F.exists(rest, lambda c: c != ""), on)
            .when((first != "") & (F.size(cells) >= 6) & _line(rest).rlike(r"\d"), whole)
        )

    body = F.filter(F.transform(rows, one), lambda r: r.isNotNull())
    return F.when(F.size(body) > 0, F.concat(F.array(_strings(BY_MEASURE)), body)).otherwise(rows)


def rebuilt(rows: Column) -> Column:
    """The grid in the shape that its words tell, else as it is."""
    text = _line(F.transform(rows, lambda r: _line(F.filter(r, lambda c: c != ""))))
    told = lambda words: F.forall(_strings(words), lambda w: F.contains(text, w))
    return F.when(told(METRIC_WORDS), metric_by_pages(rows)).when(told(SPEED_WORDS), speed_by_length(rows)).when(told(CATEGORY_WORDS), model_by_category(rows)).when(told(MEASURE_WORDS), model_by_measure(rows)).otherwise(rows)
