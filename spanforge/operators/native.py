"""Tables of the page itself: fragments made one, words to rows and columns, tables of results rebuilt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import grids, results
from ..functions.text import WS, trim

KEY = ["doc_id", "page"]
#: Points: how far edges of fragments differ, how far apart they are; how far a word's centre is from its line's; the width of a sign.
EDGE, OVERLAP, GAP, LINE, SIGN, WORD_GAP = 18.0, 2.0, 36.0, 3.8, 3.2, 2.0
#: Words that are values of a table.
VALUE = r"\A(?:[↑↓]?\d+(?:[.,]\d+)?%?|[-–—]|\d+B)\z"


def merge_fragments(tables: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., table, x0, y0, x1, y1, rows, cells: fragments of like edges that follow each other closely, as one table.

    tables: fragment, x0, y0, x1, y1, rows, cells (array of struct x0, x1). Each, from the top, joins the first table that it
    fits, else opens one.
    """

    def groups(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0", "fragment"], kind="stable")
        boxes: list[np.ndarray] = []
        own = []
        for box in page[["x0", "y0", "x1", "y1"]].to_numpy(float):
            fits = [i for i, b in enumerate(boxes) if abs(box[0] - b[0]) < EDGE and abs(box[2] - b[2]) < EDGE and -OVERLAP <= box[1] - b[3] <= GAP]
            if fits:
                b = boxes[fits[0]]
                b[:2], b[2:] = np.minimum(b[:2], box[:2]), np.maximum(b[2:], box[2:])
            else:
                boxes.append(box.copy())
            own.append(fits[0] if fits else len(boxes) - 1)
        return page.assign(table=own, place=range(len(page)))[[*key, "fragment", "table", "place"]]

    kinds = {f.name: f.dataType.simpleString() for f in tables.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*key, "fragment"]) + ", table int, place int"
    grouped = tables.select(*key, "fragment", "x0", "y0", "x1", "y1").groupBy(*key).applyInPandas(groups, schema)
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda s: s[c]))
    return tables.join(grouped, [*key, "fragment"]).groupBy(*key, "table").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), ordered("rows").alias("rows"), ordered("cells").alias("cells"))


def words_in(words: DataFrame, regions: DataFrame, key: list[str] = KEY, pad: float = 2.0) -> DataFrame:
    """key..., table and the columns of words (text, word_no, x0, y0, x1, y1) that touch a padded region; blank words are left out."""
    r = regions.select(*key, "table", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    touch = (F.col("x0") < F.col("_x1") + pad) & (F.col("x1") > F.col("_x0") - pad) & (F.col("y0") < F.col("_y1") + pad) & (F.col("y1") > F.col("_y0") - pad)
    return words.withColumn("text", trim(F.col("text"))).filter("text <> ''").join(r, key).filter(touch).drop("_x0", "_y0", "_x1", "_y1")


def word_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """The words with ``line`` (from the top): each, by y0 and x0, joins the first line whose running mean centre is near, else opens
    one."""
    at = {c: words.columns.index(c) for c in (*key, "y0", "y1")}
    schema = T.StructType([*words.schema.fields, T.StructField("line", T.IntegerType())])
    target = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            centres = (table.column(at["y0"]).to_numpy() + table.column(at["y1"]).to_numpy()) / 2
            means, sizes, own = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
            n = 0
            for i, cy in enumerate(centres.tolist()):
                near = np.flatnonzero(np.abs(means[:n] - cy) <= LINE)
                k = near[0] if len(near) else n
                n += k == n
                sizes[k] += 1
                means[k] += (cy - means[k]) / sizes[k]
                own[i] = k
            rank = np.empty(n, np.int32)
            rank[np.argsort(means[:n], kind="stable")] = np.arange(n)
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns), pa.array(rank[own], pa.int32())], schema=target)

        for batch in batches:
            keys = list(zip(*(batch.column(at[k]).to_pylist() for k in key), strict=True))
            a = 0
            for i, k in enumerate(keys):
                if k != current:
                    if i > a:
                        held.append(batch.slice(a, i - a))
                    if held:
                        yield close()
                    held, current, a = [], k, i
            if len(keys) > a:
                held.append(batch.slice(a))
        if held:
            yield close()

    return words.repartition(*key).sortWithinPartitions(*key, "y0", "x0", "word_no").mapInArrow(fold, schema)


def wide_enough(edges: Column, most_values: Column) -> Column:
    """Six columns or more, or one more than the values of the fullest line."""
    return (F.size(edges) >= 7) | (F.size(edges) - 1 >= most_values + 1)


def edges_of_values(x0: Column, x1: Column, value_xs: Column, base: Column) -> Column:
    """Edges half way between anchors: clusters of values' left sides, and the base edges left of the first. The base edges
    where that gives no more of them."""
    anchors = G.cluster_positions(value_xs, 8.0)
    left = F.filter(F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0))), lambda x: (x < anchors[0] - 15) & (x >= x0 - 1))
    all_of = G.cluster_positions(F.concat(F.when(F.size(left) > 0, left).otherwise(F.array(x0)), anchors), 7.0)
    middle = F.zip_with(F.slice(all_of, 1, F.greatest(F.size(all_of) - 1, F.lit(0))), F.slice(all_of, 2, F.greatest(F.size(all_of) - 1, F.lit(0))), lambda a, b: (a + b) / 2)
    edges = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(x0), middle, F.array(x1)), lambda x: F.bround(x, 1))))
    return F.when((F.size(anchors) == 0) | (F.size(all_of) < 2) | (F.size(edges) <= F.size(base)), base).otherwise(edges)


def join_words(words: Column) -> Column:
    """Words (x0, text) of a cell by x0, a space where the next begins beyond the estimated end of the one before."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def add(acc: Column, w: Column) -> Column:
        space = F.when((acc["text"] != "") & (w["x0"] - acc["end"] > WORD_GAP), " ").otherwise("")
        return F.struct(F.concat(acc["text"], space, w["text"]).alias("text"), (w["x0"] + F.greatest(F.char_length(w["text"]), F.lit(1)) * SIGN).cast("double").alias("end"))

    return trim(F.regexp_replace(F.aggregate(F.array_sort(words), start, add, lambda a: a["text"]), f"[{WS}]+", " "))


def native_tables(tables: DataFrame, words: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., table, x0, y0, x1, y1, rows: tables with their rows put together anew from words, in columns of their cells' edges or,
    where those are too few, of their values; the rows that were read where there are no words or fewer than two columns."""
    merged = merge_fragments(tables, key)
    inside = word_lines(words_in(words, merged, key), [*key, "table"])
    value = F.col("text").rlike(VALUE)
    numeric = F.filter(F.collect_list(F.when(value, F.col("x0").cast("double"))), lambda x: x.isNotNull())
    of_lines = inside.groupBy(*key, "table", "line").agg(F.count_if(value).alias("n"), numeric.alias("xs"))
    facts = of_lines.groupBy(*key, "table").agg(F.max("n").alias("most"), F.flatten(F.collect_list(F.when(F.size("xs") >= 3, F.col("xs")).otherwise(F.array().cast("array<double>")))).alias("xs"))
    both = merged.join(facts, [*key, "table"], "left")
    sides = F.flatten(F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: F.array(c["x0"], c["x1"])))
    base = G.edges_of_cells(F.concat(F.array("x0", "x1"), sides))
    both = both.withColumn("_base", base)
    edges = F.when(wide_enough(F.col("_base"), F.coalesce("most", F.lit(0))), F.col("_base")).otherwise(edges_of_values(F.col("x0"), F.col("x1"), F.coalesce("xs", F.array().cast("array<double>")), F.col("_base")))
    both = both.withColumn("edges", edges).drop("_base", "xs", "most", "cells")
    placed = inside.join(both.filter(F.size("edges") >= 3).select(*key, "table", "edges"), [*key, "table"]).withColumn("c", G.column_of_word(F.col("x0"), F.col("x1"), F.col("edges")))
    cells = placed.groupBy(*key, "table", "line", "c").agg(join_words(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), "text"))).alias("t"), F.max(F.size("edges") - 1).alias("w"))
    lines = cells.groupBy(*key, "table", "line").agg(F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("m"), F.max("w").alias("w"))
    row = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda j: F.coalesce(F.element_at("m", j), F.lit("")))
    made = lines.select(*key, "table", "line", row.alias("r")).groupBy(*key, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "r"))), lambda s: s["r"]).alias("_made"))
    out = both.join(made, [*key, "table"], "left").withColumn("_made", results.rebuilt(grids.drop_blank_rows(F.col("_made"))))
    return out.select(*key, "table", "x0", "y0", "x1", "y1", F.when(F.coalesce(F.size("_made"), F.lit(0)) > 0, F.col("_made")).otherwise(F.col("rows")).alias("rows"))
