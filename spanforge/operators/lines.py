"""Lines of documents: splitting, repeated lines, suppression, readability, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import WS, repeat_key, trim
from ..store import cut

#: A key counts as repeated on so many pages, so large a share of pages, with so large a share at one height.
MIN_PAGES, MIN_SHARE, MIN_AT_HEIGHT, HEIGHT_BUCKET = 3, 0.6, 0.8, 20.0
#: Keys that are broadcast at most: some 100 bytes each.
BROADCAST_KEYS = 200_000
#: Hashes that are broadcast at most: some 30 bytes each.
BROADCAST_HASHES = 1_000_000


def split_lines(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep..., line_no (from 0), line; a null text has no lines."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def keyed_lines(lines: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """keep..., key: the table of the lines' keys. They cost a look at every character, so they are made once, for all that asks."""
    return cut(lines.select(*keep, repeat_key(text).alias("key")), "line-keys")


def repeated_keys(
    lines: DataFrame, doc: str, page: str, y: Column, text: Column, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_at_height: float = MIN_AT_HEIGHT
) -> DataFrame:
    """doc, key, n_pages, n_lines, at_height: text that stands on many pages of a document at one height.

    The key is the line without white space, runs of digits as #, of two characters or more. Heights are bucketed by
    half-even rounding. The share at the modal height counts lines over distinct pages. Documents of fewer than
    min_pages pages have no repeated keys.
    """
    own = lines.select(F.col(doc).alias("doc"), F.col(page).alias("page"), y.alias("y"), text.alias("text"))
    found = repeated_of(keyed_lines(own, F.col("text"), ["doc", "page", "y"]), "doc", "page", F.col("y"), min_pages, min_share, min_at_height)
    return found.withColumnRenamed("doc", doc)


def repeated_of(keyed: DataFrame, doc: str, page: str, y: Column, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_at_height: float = MIN_AT_HEIGHT) -> DataFrame:
    """As ``repeated_keys``, for a table of lines that has their keys."""
    keyed = keyed.select(F.col(doc).alias("doc"), F.col(page).alias("page"), "key", F.bround(y / HEIGHT_BUCKET, 0).cast("long").alias("bucket"))
    pages = keyed.groupBy("doc").agg(F.countDistinct("page").alias("doc_pages"))
    keyed = keyed.filter(F.col("doc").isNotNull() & (F.char_length("key") >= 2))
    # most keys stand on one page. Those on enough are told by hashes first, which are short; two keys of one hash are both looked at
    hashed = keyed.withColumn("hash", F.xxhash64("doc", "key"))
    often = cut(hashed.groupBy("hash").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= min_pages).select("hash"), "spread-hashes")
    if often.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        keyed = hashed.join(F.broadcast(often), "hash", "left_semi").drop("hash")
    spread = keyed.groupBy("doc", "key").agg(F.countDistinct("page").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    heights = keyed.groupBy("doc", "key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    modal = heights.groupBy("doc", "key").agg(F.sum("n").alias("n_lines"), F.max("n").alias("at_height"))
    return (
        spread.join(modal, ["doc", "key"])
        .join(pages, "doc")
        .filter((F.col("doc_pages") >= min_pages) & (F.col("n_pages") >= F.floor(F.col("doc_pages") * min_share)) & (F.col("at_height") >= F.col("n_pages") * min_at_height))
        .select(F.col("doc").alias(doc), "key", "n_pages", "n_lines", "at_height")
    )


def _small(keys: DataFrame) -> DataFrame:
    """Broadcast if there are few, by count."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def strip_repeated(docs: DataFrame, doc: str, page: str, repeated: DataFrame, text_col: str = "text", keyed: DataFrame | None = None) -> DataFrame:
    """page, n_lines, n_removed, text: each text without lines whose key is repeated in its document.

    keyed: doc, page, line_no, key of the texts' lines, if they are there. Only the places of removed lines are gathered
    by text; texts are put together where they stand.
    """
    if keyed is None:
        keyed = keyed_lines(split_lines(docs, [doc, page], text_col), F.col("line"), [doc, page, "line_no"])
    known = cut(repeated.select(doc, "key"), "repeated-keys")
    gone = keyed.join(_small(known), [doc, "key"], "left_semi").groupBy(page).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return docs.join(gone, page, "left").select(
        page,
        F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(kept, "\n").alias("text"),
    )


def suppression(lines: DataFrame, in_table: Column, in_visual: Column, repeated: Column, margin: Column, rotated: Column, light: Column, n_pages: Column, text: Column) -> DataFrame:
    """``lines`` with ``dropped``: the first reason that applies, null for a line that stays; watermarks alone are counted."""
    reason = (
        F.when(in_table, "table")
        .when(in_visual, "visual")
        .when(repeated & margin, "header_footer")
        .when(margin & P.is_page_number(text), "page_number")
        .when(repeated & (rotated | light), "watermark")
        .when(rotated & (n_pages < 3), "watermark")
    )
    return lines.withColumn("dropped", reason).withColumn("counted", F.coalesce(F.col("dropped") == "watermark", F.lit(False)))


def readability(lines: DataFrame, line: str = "line", limit: int = 420, cell: int = 90) -> DataFrame:
    """The rows with ``issue``, one per finding of a line: dense_breaks, long_line, glued_formula, long_cell."""
    t = F.col("_t")
    math = t.startswith("$$")
    found = F.array(
        F.when(F.contains(t, F.lit("<br>")) & ((F.char_length(t) - F.char_length(F.replace(t, F.lit("<br>"), F.lit("")))) / 4 >= 2), "dense_breaks"),
        F.when((F.char_length(t) > limit) & ~math, "long_line"),
        F.when(F.contains(t, F.lit("$$")) & (t != "$$") & ~(math & t.endswith("$$")), "glued_formula"),
        F.when(F.contains(t, F.lit("|")) & _long_cell(t, cell), "long_cell"),
    )
    return lines.withColumn("_t", trim(F.col(line))).withColumn("issue", F.explode(F.array_compact(found))).drop("_t")


def _long_cell(t: Column, cell: int) -> Column:
    """Two pipes or more, something other than white space between two of them, and a long part."""
    parts = F.split(t, r"\|")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(parts) >= 3) & F.exists(inner, lambda c: c.rlike(r"\S")) & F.exists(parts, lambda c: F.char_length(c) >= cell)


def outside_fences(lines: DataFrame, doc: str, line: str = "line", order: str = "line_no") -> DataFrame:
    """Lines that are neither fence marks nor between two of them."""
    w = Window.partitionBy(doc).orderBy(order)
    mark = F.col(line).rlike(r"\A\s*```")
    return lines.withColumn("_open", F.pmod(F.sum(mark.cast("int")).over(w), F.lit(2))).filter((F.col("_open") == 0) & ~mark).drop("_open")


def paragraphs(lines: DataFrame, doc: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """doc, paragraph (from 1), first_line, n_lines, text: lines joined while the one before breaks off and the next goes on.

    Blank lines end a paragraph and belong to none.
    """
    w = Window.partitionBy(doc).orderBy(order)
    before = F.lag(line).over(w)
    goes_on = F.coalesce(P.continues(before, F.col(line)) & (trim(before) != ""), F.lit(False))
    marked = lines.withColumn("_break", (~goes_on).cast("int")).withColumn("_blank", trim(F.col(line)) == "")
    numbered = marked.withColumn("_island", F.sum("_break").over(w)).filter(~F.col("_blank"))
    grouped = numbered.groupBy(doc, "_island").agg(
        F.min(order).alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: trim(s[line])), " ").alias("text")
    )
    return grouped.withColumn("paragraph", F.row_number().over(Window.partitionBy(doc).orderBy("first_line"))).drop("_island")


def wrap_lines(lines: DataFrame, wrapped: Column, doc: str) -> DataFrame:
    """doc, line_no, part, line for an array column of wrapped parts."""
    return lines.select(doc, "line_no", F.posexplode(wrapped).alias("part", "line"))


__all__ = ["WS", "keyed_lines", "outside_fences", "paragraphs", "readability", "repeated_keys", "repeated_of", "split_lines", "strip_repeated", "suppression", "wrap_lines"]
