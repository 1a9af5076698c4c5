"""Text pages: lines of spans to paragraphs, headings, captions and formulas in reading order.

The JVM decides what each line is; one fold over a page's lines, in reading order, deals them to groups; groups are put together
by an aggregation. lines: text, size, bold, x0, y0, x1, y1, line_no; page_w of the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import formulas as X
from ..functions import predicates as P
from ..functions.text import heading_level, join_hyphenated, trim

KEY = ["doc_id", "page"]
#: Sizes of a line: gaps that part paragraphs, keep a caption and a formula together; points of a caption's indent.
PARA_GAP, CAPTION_GAP, MATH_GAP, CAPTION_INDENT = 0.8, 1.35, 1.3, 24.0
#: Numbered headings of a line.
NUMBERED = r"\A(?:\d{1,2}(?:[.．]\d{1,2}){0,4}[.．]?\s*\S|[一二三四五六七八九十]{1,3}[、.．]\s*\S)"
_FACTS = ["_caption", "_closed", "_math", "_number", "_titled", "_open", "_lower", "_label"]


def _groups(lines: DataFrame, key: list[str]) -> DataFrame:
    """The lines with ``group`` and ``what`` (para, caption, formula): a caption inside a paragraph is held back until it ends."""
    at = {c: lines.columns.index(c) for c in (*key, "size", "x0", "y0", "y1", *_FACTS)}
    schema = T.StructType([*lines.schema.fields, T.StructField("group", T.IntegerType()), T.StructField("what", T.StringType())])
    target = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n = None, 0
        # open groups by kind: number, left edge of the first line, bottom of the last
        open_: dict[str, list] = {}
        last = None  # of the paragraph, if nothing came between: bottom, size, may the sentence go on

        def put(kind: str, x0: float, y1: float) -> int:
            nonlocal n
            if kind not in open_:
                open_[kind] = [n, x0, y1]
                n += 1
            open_[kind][2] = y1
            return open_[kind][0]

        for batch in batches:
            rows = {c: batch.column(i).to_pylist() for c, i in at.items()}
            group, what = np.zeros(batch.num_rows, np.int32), []
            for i in range(batch.num_rows):
                own = tuple(rows[k][i] for k in key)
                if own != page:
                    page, n, last = own, 0, None
                    open_.clear()
                size, x0, y0, y1 = (rows[c][i] for c in ("size", "x0", "y0", "y1"))
                caption, closed, math, number, titled, goes_on, lower, label = (rows[c][i] for c in _FACTS)
                kind = None
                if "formula" in open_:
                    if y0 - open_["formula"][2] <= size * MATH_GAP and (math or number):
                        kind, last = "formula", None
                    else:
                        del open_["formula"]
                if kind is None and "caption" in open_:
                    _, left, bottom = open_["caption"]
                    if y0 - bottom <= size * CAPTION_GAP and abs(x0 - left) < CAPTION_INDENT and not caption and not titled:
                        kind = "caption"
                    elif "para" not in open_:
                        del open_["caption"]
                if kind is None and caption:
                    kind, last = "caption", None
                elif kind is None and math:
                    open_.pop("para", None)
                    open_.pop("caption", None)
                    kind, last = "formula", None
                elif kind is None:
                    if last is not None and (label or ((y0 - last[0] > size * PARA_GAP or abs(size - last[1]) > 1) and not (last[2] and lower))):
                        open_.clear()
                    kind, last = "para", (y1, size, goes_on)
                alone = kind == "caption" and caption and "para" not in open_
                group[i] = put(kind, x0, y1)
                what.append(kind)
                if alone and closed:
                    del open_["caption"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(what, pa.string())], schema=target)

    return lines.repartition(*key).sortWithinPartitions(*key, "y0", "x0", "line_no").mapInArrow(fold, schema)


def _joined(texts: Column) -> Column:
    """A space where ASCII meets ASCII."""
    ascii_ = lambda c: c.rlike(r"\A[\x00-\x7F]\z")
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when((acc != "") & ascii_(F.right(acc, F.lit(1))) & ascii_(F.left(t, F.lit(1))), F.concat(acc, F.lit(" "), t)).otherwise(F.concat(acc, t)))


def text_blocks(lines: DataFrame, pages: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., seq, kind, text, level, flags, x0, y0, x1, y1 of text pages.

    The page's body size is its most frequent rounded size (of equals the first in reading order). A paragraph is a heading if it
    is larger than 1.15 of that, or one bold line of forty characters at most, and is no formula; its level follows its
    numbering, else its size. Captions are paragraphs flagged caption, formulas keep their lines and are flagged
    formula_text.
    """
    t = trim(F.col("text"))
    held = lines.join(pages.select(*key, "page_w"), key).withColumn("text", t).filter("text <> ''").withColumn("_s", F.bround("size", 0))
    order = F.struct("y0", "x0", "line_no")
    sizes = held.groupBy(*key, "_s").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    k = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))
    body = sizes.withColumn("_k", k).filter("_k = 1").select(*key, F.col("_s").alias("body"))
    text = F.col("text")
    marked = held.withColumns(
        {
            "_caption": P.is_caption(text),
            "_closed": text.rlike(r"[.。]\z"),
            "_math": X.standalone_math_line(text, F.col("x0"), F.col("x1"), F.col("page_w")),
            "_number": P.is_equation_number(text),
            "_titled": text.rlike(NUMBERED),
            "_open": ~text.rlike(r"[.!?。！？;；:：]\z"),
            "_lower": text.rlike(r"\A[a-z]"),
            "_label": P.is_bold_label(text, F.col("bold")),
        }
    ).drop("_s")
    grouped = _groups(marked, key).join(body, key)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text"))), lambda s: s["text"])
    out = grouped.groupBy(*key, "group", "what").agg(
        texts.alias("_t"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.max("body").alias("body"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    prose = X.space_math_letters(join_hyphenated(_joined(F.col("_t"))))
    out = out.withColumn("text", F.when(F.col("what") == "formula", F.array_join("_t", "\n")).otherwise(prose))
    large = (F.col("size") > F.col("body") * 1.15) | (F.col("bold") & (F.char_length("text") <= 40) & (F.size("_t") == 1))
    heading = (F.col("what") == "para") & ~X.math_fragment(F.col("text")) & large
    fallback = F.when(F.col("size") > F.col("body") * 1.6, 1).when(F.col("size") > F.col("body") * 1.3, 2).otherwise(3)
    level = F.when(F.col("text").rlike(r"\A[一二三四五六七八九十]{1,3}[、.．]\s*\S") | F.col("text").isin("Abstract", "Contents", "References", "Conclusion"), 2).otherwise(heading_level(F.col("text"), fallback))
    flags = F.when(F.col("what") == "caption", F.array(F.lit("caption"))).when(F.col("what") == "formula", F.array(F.lit("formula_text"))).otherwise(F.array().cast("array<string>"))
    seq = F.row_number().over(Window.partitionBy(*key).orderBy("y0", "x0", "group")) - 1
    return out.select(*key, seq.alias("seq"), F.when(heading, "heading").otherwise("para").alias("kind"), "text", F.when(heading, level).otherwise(0).alias("level"), flags.alias("flags"), "x0", "y0", "x1", "y1")
