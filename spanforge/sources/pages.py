"""HTML pages as blocks, with the JVM's regular expressions: headings, paragraphs, list items; navigation and footers labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

#: Parts whose text is no content, with their tags.
_HIDDEN = r"(?is)<(script|style|head|template|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def visible(html: Column) -> Column:
    return F.regexp_replace(html, _HIDDEN, "")


def unescape(x: Column) -> Column:
    for a, b in _ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, seq, kind (heading, para, item), level, area (nav, footer, body), text.

    A block runs from an opening h1-h6, p or li tag to the next tag of that kind or the end of the enclosing element, so
    unclosed paragraphs end where the next begins. Blocks without text are left out. A null page has no blocks.
    """
    area = F.regexp_replace(F.regexp_replace(visible(F.col(html)), r"(?i)<(nav|footer)\b[^>]*>", "\x02$1\x03"), r"(?i)</(?:nav|footer)\s*>", "\x02body\x03")
    opened = F.regexp_replace(area, r"(?i)<(h[1-6]|p|li)\b[^>]*>", "\x01$1\x04")
    ended = F.regexp_replace(opened, r"(?i)</(?:h[1-6]|p|li|ul|ol|article|div|body|html)\s*>", "\x01end\x04")
    parts = F.split(F.concat(F.lit("\x02body\x03"), ended), "\x02")
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(F.slice(F.split(F.regexp_extract(p, r"(?s)\x03(.*)\z", 1), "\x01"), 2, 1 << 30), lambda b: F.struct(F.lower(F.regexp_extract(p, r"(?s)\A(\w+)\x03", 1)).alias("area"), b.alias("block"))),
        )
    )
    rows = pages.select(page_id, F.posexplode(pieces).alias("seq", "s"))
    tag = F.lower(F.regexp_extract("s.block", r"(?s)\A(\w+)\x04", 1))
    text = trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace(F.regexp_extract("s.block", r"(?s)\x04(.*)\z", 1), r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "")), r"[ \t]+", " "))
    return (
        rows.select(page_id, "seq", tag.alias("tag"), F.col("s.area").alias("area"), text.alias("text"))
        .filter((F.col("tag") != "end") & (F.col("text") != ""))
        .select(
            page_id,
            "seq",
            F.when(F.col("tag").startswith("h"), "heading").when(F.col("tag") == "li", "item").otherwise("para").alias("kind"),
            F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).otherwise(0).alias("level"),
            "area",
            "text",
        )
    )
