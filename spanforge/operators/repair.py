"""Repairs of a document's blocks that look at their neighbours: contents, page numbers, torn clauses, marks for a second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions import predicates as P
from ..functions.text import CJK, compact, trim
from .pages import CONTENTS_TITLES

#: Blocks with text that are looked at: before a page number, about a contents title; any blocks about a bare number.
REACH_TEXT, REACH_CONTENTS, REACH_NOISE = 4, 5, 2
#: Entries of a contents; bare page numbers.
ENTRY, BARE = r"\A(?:[一二三四五六七八九十]{1,3}、|\d{1,2}[.．])\s*\S", r"\A\d{1,3}\z"


def _is_text() -> Column:
    return F.col("kind").isin("heading", "para")


def compressed_contents(text: Column) -> Column:
    """Contents whose entries recognition has run together: two list marks or more, one of them right after a page number."""
    flat = compact(F.coalesce(text, F.lit("")))
    return (F.regexp_count(flat, F.lit("、")) >= 2) & flat.rlike(r"\d[一二三四五六七八九十]{1,3}、")


def drop_noise(blocks: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """Without run-together contents, and without bare page numbers near those or near a picture."""
    w = Window.partitionBy(doc).orderBy(order)
    crammed = F.coalesce(_is_text() & compressed_contents(F.col("text")), F.lit(False))
    marked = blocks.withColumn("_c", crammed).withColumn("_m", (F.col("kind") == "image") | F.col("_c"))
    some = lambda a, b: F.coalesce(F.max(F.col("_m").cast("int")).over(w.rowsBetween(a, b)), F.lit(0))
    near = (some(-REACH_NOISE, -1) + some(1, REACH_NOISE)) > 0
    bare = _is_text() & trim(F.coalesce("text", F.lit(""))).rlike(BARE)
    return marked.withColumn("_out", F.col("_c") | (bare & near)).filter(~F.col("_out")).drop("_c", "_m", "_out")


def absorb_page_numbers(blocks: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """A bare page number goes to the contents entry before it, if that has none and a contents title is near."""
    t = trim(F.coalesce("text", F.lit("")))
    texts = blocks.filter(_is_text()).select(doc, order, t.alias("_t")).filter("_t <> ''")
    w = Window.partitionBy(doc).orderBy(order)
    title = F.col("_t").isin(CONTENTS_TITLES)
    near = F.max(title.cast("int")).over(w.rowsBetween(-REACH_CONTENTS, REACH_CONTENTS)) == 1
    marked = texts.withColumn("_near", near & ~title)
    plain = ~F.col("_t").rlike(BARE) & ~title
    target = F.last(F.when(plain, F.struct(F.col(order).alias("o"), (F.col("_t").rlike(ENTRY) & ~F.col("_t").rlike(r"[\s　]\d{1,3}\z") & F.col("_near")).alias("ok"))), ignorenulls=True).over(w.rowsBetween(-REACH_TEXT, -1))
    numbers = marked.withColumn("_to", target).filter(F.col("_t").rlike(BARE) & F.col("_to.ok"))
    first = numbers.groupBy(doc, F.col("_to.o").alias("_o")).agg(F.min_by(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")), order).alias("_n"))
    gone = first.select(doc, F.col("_n.o").alias(order))
    more = first.select(doc, F.col("_o").alias(order), F.col("_n.t").alias("_page"))
    out = blocks.join(gone, [doc, order], "left_anti").join(more, [doc, order], "left")
    longer = F.when(F.col("_page").isNotNull(), F.concat(F.rtrim("text"), F.lit("　"), "_page")).otherwise(F.col("text"))
    return out.withColumn("text", longer).select(*blocks.columns)


def merge_torn(blocks: DataFrame, seams: list[tuple[str, str]], doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """Neighbouring texts torn at a seam (how the first ends, how the next begins; patterns) as one block, that of the first."""
    w = Window.partitionBy(doc).orderBy(order)
    own, before = trim(F.coalesce("text", F.lit(""))), F.rtrim(F.coalesce(F.lag("text").over(w), F.lit("")))
    torn = F.lit(False)
    for end, start in seams:
        torn = torn | (before.rlike(rf"(?:{end})\z") & own.rlike(rf"\A(?:{start})"))
    joins = F.coalesce(torn & _is_text() & F.lag("kind").over(w).isin("heading", "para"), F.lit(False))
    runs = blocks.withColumn("_j", joins).withColumn("_r", F.sum((~F.col("_j")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in blocks.columns if c not in (doc, "text")]
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_j", "text"))), lambda s: s)
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(s["_j"], trim(s["text"])).otherwise(F.when(F.size(parts) > 1, F.rtrim(s["text"])).otherwise(s["text"]))), "")
    whole = runs.groupBy(doc, "_r").agg(F.min_by(F.struct(*rest, F.col("text").alias("_own")), order).alias("_b"), F.count(F.lit(1)).alias("_n"), joined.alias("_t"))
    return whole.select(doc, *[F.col(f"_b.{c}").alias(c) for c in rest], F.when(F.col("_n") > 1, F.col("_t")).otherwise(F.col("_b._own")).alias("text")).select(*blocks.columns)


def protected_table(rows: Column, flags: Column, terms: list[str]) -> Column:
    """A table read from the page itself, with few ideographs and a term of the caller's: no repair touches it."""
    text = F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), " ")
    ideographs = F.regexp_count(text, F.lit(f"[{CJK}]"))
    native = F.coalesce(F.array_contains(flags, "native_pdf_table"), F.lit(False)) & (F.coalesce(F.size(rows), F.lit(0)) > 0)
    known = F.exists(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(text, t))
    return F.coalesce(native & (trim(text) != "") & (ideographs <= F.greatest(F.lit(8), F.char_length(text) * 0.08)) & known, F.lit(False))


def mark(blocks: DataFrame, header_words: list[str], protected_terms: list[str]) -> DataFrame:
    """Blocks flagged for a second look: tables whose grid looks drifted, texts that look cut off."""
    drifted = (F.col("kind") == "table") & ~protected_table(F.col("rows"), F.col("flags"), protected_terms) & (grids.suspect_score(F.col("rows"), header_words) >= 3)
    cut = _is_text() & P.looks_truncated(F.coalesce("text", F.lit("")))
    add = lambda when, flag: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))
    return blocks.withColumn("flags", F.array_union("flags", F.concat(add(drifted, "table_low_confidence"), add(cut, "possible_truncation"))))


def later_starts_with(title: Column, doc: str = "doc_id", order: str = "seq") -> Column:
    """Does a later text, white space aside, start with this title? As a window expression over blocks; ``title`` is a literal."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    hit = _is_text() & compact(F.coalesce("text", F.lit(""))).startswith(compact(title))
    return F.coalesce(F.max(hit.cast("int")).over(w), F.lit(0)) == 1
