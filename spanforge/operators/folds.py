"""Ordered folds that no window expresses: state carried from row to row, one page (never a whole table) at a time.

Each takes the rows of a page as an Arrow group; pages are bounded by their nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def cluster_rows(lines: DataFrame, key: list[str], share: float = 0.6) -> DataFrame:
    """The lines with ``row`` and ``place``: visual rows of a page.

    Lines come by y0 (then x0, line_no); one joins the last row if its centre is nearer to the row's mean centre than
    share of the row's greatest height. In a row lines stand by x0 (then line_no).
    """

    columns = lines.columns
    at = {c: columns.index(c) for c in columns}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages follow each other, each in order; what is carried over is the last visual row."""
        page, row, total, height, held = None, -1, 0.0, 0.0, []

        def close() -> list[tuple]:
            held.sort(key=lambda r: (r[at["x0"]], r[at["line_no"]]))
            return [(*r, row, i) for i, r in enumerate(held)]

        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(r[at[k]] for k in key)
                y0, y1 = r[at["y0"]], r[at["y1"]]
                cy, h = (y0 + y1) / 2, y1 - y0
                if own == page and abs(cy - total / len(held)) < height * share:
                    total, height = total + cy, max(height, h)
                    held.append(r)
                    continue
                if held:
                    out += close()
                row = row + 1 if own == page else 0
                page, total, height, held = own, cy, h, [r]
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, x, strict=True)) for x in out], schema=target)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, x, strict=True)) for x in close()], schema=target)

    schema = T.StructType([*lines.schema.fields, T.StructField("row", T.IntegerType()), T.StructField("place", T.IntegerType())])
    target = to_arrow_schema(schema)
    return lines.repartition(*key).sortWithinPartitions(*key, "y0", "x0", "line_no").mapInArrow(fold, schema)


def rect_components(rects: DataFrame, key: list[str], pad: float = 12.0, min_members: int = 8) -> DataFrame:
    """key..., x0, y0, x1, y1, n: groups of rectangles that touch once padded, grown until none touches another."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        boxes = page[["x0", "y0", "x1", "y1"]].to_numpy(float)
        sizes = np.ones(len(boxes), int)
        while True:  # each pass unites what touches; the number of boxes falls until nothing does
            order = np.argsort(boxes[:, 0], kind="stable")
            boxes, sizes = boxes[order], sizes[order]
            parent = np.arange(len(boxes))

            def root(i: int, parent: np.ndarray = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i in range(len(boxes)):
                end = np.searchsorted(boxes[:, 0], boxes[i, 2] + 2 * pad, side="right")
                near = np.arange(i + 1, end)
                near = near[(boxes[near, 1] <= boxes[i, 3] + 2 * pad) & (boxes[near, 3] >= boxes[i, 1] - 2 * pad)]
                for j in near:
                    parent[root(j)] = root(i)
            roots = np.array([root(i) for i in range(len(boxes))], int)
            distinct, place = np.unique(roots, return_inverse=True)
            if len(distinct) == len(boxes):
                break
            grown = np.column_stack([np.full(len(distinct), np.inf), np.full(len(distinct), np.inf), np.full(len(distinct), -np.inf), np.full(len(distinct), -np.inf)])
            for c, f in ((0, np.minimum), (1, np.minimum), (2, np.maximum), (3, np.maximum)):
                f.at(grown[:, c], place, boxes[:, c])
            sizes = np.bincount(place, sizes).astype(int)
            boxes = grown
        out = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1"])
        out["n"] = sizes
        for k in key:
            out[k] = page[k].iloc[0]
        return out[out["n"] >= min_members][[*key, "x0", "y0", "x1", "y1", "n"]]

    kinds = {f.name: f.dataType.simpleString() for f in rects.schema.fields}
    return rects.groupBy(*key).applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", x0 double, y0 double, x1 double, y1 double, n int")


def distinct_regions(rects: DataFrame, key: list[str], share: float = 0.75) -> DataFrame:
    """Largest first; a rectangle that lies by more than ``share`` in one already kept is left out."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        area = ((page["x1"] - page["x0"]).clip(lower=0) * (page["y1"] - page["y0"]).clip(lower=0)).to_numpy(float)
        boxes = page[["x0", "y0", "x1", "y1"]].to_numpy(float)
        kept: list[int] = []
        for i in np.lexsort((-boxes[:, 1], -area)):
            inside = [max(0.0, min(boxes[i, 2], boxes[k, 2]) - max(boxes[i, 0], boxes[k, 0])) * max(0.0, min(boxes[i, 3], boxes[k, 3]) - max(boxes[i, 1], boxes[k, 1])) for k in kept]
            if area[i] <= 0 or max(inside, default=0.0) <= share * area[i]:
                kept.append(i)
        return page.iloc[kept].sort_values(["y0", "x0"], kind="stable")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rects.schema.fields)
    return rects.groupBy(*key).applyInPandas(fold, schema)


def word_grid(words: DataFrame, key: list[str], edges: list[float], tolerance: float = 3.8, gap: float = 2.0) -> DataFrame:
    """key..., row, cells: words of a table by line and column.

    A word joins any line whose running mean centre is within tolerance (the nearest); columns are those of its centre.
    Words of a cell are joined with a space where they are more than ``gap`` apart.
    """

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["y0", "x0", "word_no"], kind="stable")
        means: list[float] = []
        members: list[list[int]] = []
        for i, cy in enumerate(((table["y0"] + table["y1"]) / 2).tolist()):
            near = min(range(len(means)), key=lambda k: abs(means[k] - cy), default=None)
            if near is None or abs(means[near] - cy) > tolerance:
                means.append(cy)
                members.append([i])
            else:
                members[near].append(i)
                means[near] += (cy - means[near]) / len(members[near])
        out = []
        for row, k in enumerate(sorted(range(len(means)), key=lambda k: means[k])):
            cells, ends = [""] * (len(edges) - 1), [None] * (len(edges) - 1)
            for i in sorted(members[k], key=lambda i: table["x0"].iloc[i]):
                w = table.iloc[i]
                c = int(np.clip(np.searchsorted(edges, (w["x0"] + w["x1"]) / 2, side="right") - 1, 0, len(cells) - 1))
                cells[c] += (" " if cells[c] and w["x0"] - ends[c] > gap else "") + w["text"]
                ends[c] = w["x1"]
            out.append({**{n: table[n].iloc[0] for n in key}, "row": row, "cells": cells})
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return words.groupBy(*key).applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", row int, cells array<string>")
