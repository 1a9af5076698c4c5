"""Page images to ruling lines and table grids, with array operations on the workers.

images: doc_id, page, width, height, gray (BINARY, one byte a pixel, row by row, 0 is black). One page is in a worker's hands at a
time; a row whose bytes do not fit its size is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import compact, fuzzy
from . import intervals

KEY = ["doc_id", "page"]
#: Gray below which a pixel is a rule or a shade; ink; the dark and middle tones of a cell.
RULE, INK, DARK, MIDDLE = 232, 200, 185, 235
#: Pixels: least length of a rule and as a share of the page; gaps bridged in it; rows that are one rule.
MIN_RULE, MIN_SHARE, RUN_GAP, SAME_RULE = 220, 0.18, 3, 8
#: Pixels between rules of one table: close ones, those a vertical line bridges, those a page break parts.
CLOSE, BRIDGED, BROKEN = 100, 2400, 1400


def as_array(width: int, height: int, gray: bytes) -> np.ndarray:
    if len(gray) != width * height:
        raise ValueError(f"{len(gray)} bytes are no image of {width} x {height}")
    return np.frombuffer(gray, np.uint8).reshape(height, width)


def runs(mask: np.ndarray, gap: int) -> np.ndarray:
    """First and last place of every run of a boolean row, gaps of up to ``gap`` steps bridged."""
    at = np.flatnonzero(mask)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > gap)
    return np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]], axis=1)


def centres(mask: np.ndarray, gap: int = 4) -> list[int]:
    """The middle of every run."""
    return [int(m) for m in runs(mask, gap).sum(axis=1) // 2]


def longest_run(mask: np.ndarray, gap: int = RUN_GAP) -> tuple[int, int, int]:
    """Length (last less first place), first and last place of the longest run, the first of equals; zeros for an empty row."""
    found = runs(mask, gap)
    if not len(found):
        return 0, 0, 0
    a, b = found[np.argmax(found[:, 1] - found[:, 0])].tolist()
    return b - a, a, b


def horizontal_rules(gray: np.ndarray, dark: int = RULE) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of the rules of a page: rows with a long enough run, rows close by that overlap as one, at the first's height."""
    least = max(MIN_RULE, int(gray.shape[1] * MIN_SHARE))
    mask = gray < dark
    out: list[list[int]] = []
    for y in np.flatnonzero(mask.sum(axis=1) >= least).tolist():
        n, x0, x1 = longest_run(mask[y])
        if n < least:
            continue
        if out and y - out[-1][0] <= SAME_RULE:
            _, a, b = out[-1]
            if (min(x1, b) - max(x0, a)) / max(1, min(x1 - x0, b - a)) > 0.5:
                out[-1][1:] = [min(a, x0), max(b, x1)]
                continue
        out.append([y, x0, x1])
    return [tuple(r) for r in out]


def is_bridged(gray: np.ndarray, y0: int, y1: int, x0: int, x1: int, dark: int = RULE) -> bool:
    """Does a vertical line join two rules, over more than 0.55 of the height between?"""
    if y1 - y0 < 8:
        return True
    part = gray[y0 + 3 : y1 - 3, x0 : x1 + 1] < dark
    return bool(part.size and (part.mean(axis=0) > 0.55).any())


def column_rules(gray: np.ndarray, hy: list[int], x0: int, x1: int, dark: int = RULE) -> list[int]:
    """x of a table's columns: lines through 0.8 of a row, or the sides of shaded cells, in 0.4 of the rows that hold any ink."""
    part = gray[:, x0 : x1 + 1] < dark
    votes, counted = np.zeros(part.shape[1]), 0
    for top, bottom in zip(hy[:-1], hy[1:], strict=True):
        row = part[top + 3 : bottom - 3]
        if len(row) < 8 or not row.any():
            continue
        counted += 1
        for a, b in runs(row.mean(axis=0) > 0.8, 2).tolist():
            for x in [(a + b) // 2] if b - a <= 10 else [a, b]:
                votes[x] += 1
    if not counted:
        return []
    at = np.flatnonzero(votes)
    groups = np.split(at, np.flatnonzero(np.diff(at) > 6) + 1) if len(at) else []
    return [int(x0 + g.mean()) for g in groups if votes[g].sum() >= max(1.0, counted * 0.4)]


def has_ink(cell: np.ndarray) -> bool:
    """Is there writing in a cell, its margin aside?"""
    h, w = cell.shape
    if h < 8 or w < 8:
        return False
    y, x = min(3, h // 12), min(3, w // 12)
    core = cell[y : h - y, x : w - x]
    dark = (core < DARK).mean()
    return bool(dark > 0.0015 or (dark > 0.0006 and ((core >= DARK) & (core < MIDDLE)).mean() > 0.01))


def _each_page(images: DataFrame, facts: DataFrame, run: Callable, schema: str, key: list[str]) -> DataFrame:
    """run(gray, rows) -> rows of ``schema`` behind the key, for every page with rows in ``facts`` (key and one column ``rows``)."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    full = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", " + schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = run(as_array(row["width"], row["height"], row["gray"]), row["rows"])
                yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in key}, **r} for r in out], schema=target)

    target = to_arrow_schema(StructType.fromDDL(full))
    return images.select(*key, "width", "height", "gray").join(facts, key).mapInArrow(fold, full)


def rules(images: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., y, x0, x1: the horizontal rules of every page."""
    every = images.select(*key, F.lit(0).alias("rows"))
    return _each_page(images, every, lambda gray, _: [{"y": float(y), "x0": float(a), "x1": float(b)} for y, a, b in horizontal_rules(gray)], "y double, x0 double, x1 double", key)


def gap_has_content(pairs: DataFrame, lines: DataFrame, bands: DataFrame, anchors: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Of pairs (y0, y1 of a page), those with text between that is neither in a band, an anchor, a page number nor leaders."""
    text = F.col("text")
    plain = lines.withColumn("_c", (F.col("y0") + F.col("y1")) / 2).withColumn("key", fuzzy(text))
    plain = plain.filter((F.char_length("key") >= 2) & ~compact(text).rlike(r"\A\d{1,4}\z") & ~text.rlike(r"\A[\s.。·•．…⋯\-_—－]+\z"))
    plain = plain.join(anchors.select(*key, "key"), [*key, "key"], "left_anti").select(*key, "_c")
    plain = intervals.in_bands(plain, bands.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("y0").alias("_b0"), F.col("y1").alias("_b1")).toDF(*key, "_b0", "_b1"), key, F.col("_c"), "_b0", "_b1", "left_anti")
    on = (F.col("_c") > F.col("y0") + 5) & (F.col("_c") < F.col("y1") - 5)
    for k in key:
        on = on & (pairs[k] == plain[k])
    return pairs.join(plain, on, "left_semi")


def table_regions(images: DataFrame, found: DataFrame, lines: DataFrame, bands: DataFrame, anchors: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., region, y0, y1, x0, x1, hy, vx: three rules or more that belong together, with two column rules or more.

    found: the rules (y, x0, x1). A rule belongs to the one above if they overlap and are close, a vertical line bridges them, or
    a band lies between two of the same extent and no text does. bands: y0, y1; anchors: key.
    """
    w = Window.partitionBy(*key).orderBy("y", "x0")
    last = lambda c: F.lag(c).over(w)
    common = F.least(F.col("x1"), last("x1")) - F.greatest(F.col("x0"), last("x0"))
    shorter, longer = F.least(F.col("x1") - F.col("x0"), last("x1") - last("x0")), F.greatest(F.col("x1") - F.col("x0"), last("x1") - last("x0"))
    pairs = found.withColumns({"_gap": F.col("y") - last("y"), "_over": common / F.greatest(shorter, F.lit(1.0)), "_match": common / F.greatest(longer, F.lit(1.0)), "_p": last("y"), "_a": F.greatest(F.col("x0"), last("x0")), "_b": F.least(F.col("x1"), last("x1"))})
    asked = pairs.filter((F.col("_over") > 0.55) & (F.col("_gap") >= CLOSE) & (F.col("_gap") < BRIDGED))
    rows = asked.groupBy(*key).agg(F.collect_list(F.struct("y", "x0", "_p", "_a", "_b")).alias("rows"))

    def bridges(gray: np.ndarray, rows: list[dict]) -> list[dict]:
        return [{"y": r["y"], "x0": r["x0"]} for r in rows if is_bridged(gray, int(r["_p"]), int(r["y"]), int(r["_a"]), int(r["_b"]))]

    joined = _each_page(images, rows, bridges, "y double, x0 double", key).withColumn("_bridge", F.lit(True))
    broken = asked.filter((F.col("_gap") < BROKEN) & (F.col("_match") > 0.85)).select(*key, F.col("y").alias("_y"), F.col("x0").alias("_x"), F.col("_p").alias("y0"), F.col("y").alias("y1"))
    cover = F.greatest(F.least(F.col("_b1"), F.col("y1")) - F.greatest(F.col("_b0"), F.col("y0")), F.lit(0.0))
    covered = broken.join(bands.select(*key, F.col("y0").alias("_b0"), F.col("y1").alias("_b1")), key).groupBy(*key, "_y", "_x", "y0", "y1").agg(F.sum(cover).alias("_c")).filter(F.col("_c") / (F.col("y1") - F.col("y0")) > 0.25).drop("_c")
    filled = gap_has_content(covered, lines, bands, anchors, key)
    quiet = covered.join(filled.select(*key, "_y", "_x"), [*key, "_y", "_x"], "left_anti").select(*key, F.col("_y").alias("y"), F.col("_x").alias("x0"), F.lit(True).alias("_quiet"))
    marked = pairs.join(joined, [*key, "y", "x0"], "left").join(quiet, [*key, "y", "x0"], "left")
    same = (F.col("_over") > 0.55) & ((F.col("_gap") < CLOSE) | F.coalesce("_bridge", F.lit(False)) | F.coalesce("_quiet", F.lit(False)))
    grouped = marked.withColumn("region", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    regions = grouped.groupBy(*key, "region").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_sort(F.collect_list("y")).alias("hy")).filter(F.size("hy") >= 3)

    def edges(gray: np.ndarray, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            vx = column_rules(gray, [int(y) for y in r["hy"]], int(r["x0"]), int(r["x1"]))
            if len(vx) >= 2:
                out.append({**r, "vx": [float(x) for x in vx]})
        return out

    columns = ["region", "y0", "y1", "x0", "x1", "hy"]
    per_page = regions.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    kind = regions.schema["region"].dataType.simpleString()
    return _each_page(images, per_page, edges, f"region {kind}, y0 double, y1 double, x0 double, x1 double, hy array<double>, vx array<double>", key)


def inked_gaps(images: DataFrame, gaps: DataFrame, key: list[str] = KEY, least: float = 0.005) -> DataFrame:
    """Of gaps (gap_start, gap_end), those with something drawn in them."""
    rows = gaps.groupBy(*key).agg(F.collect_list(F.struct("gap_start", "gap_end")).alias("rows"))

    def inked(gray: np.ndarray, rows: list[dict]) -> list[dict]:
        return [r for r in rows if (part := gray[int(r["gap_start"]) : int(r["gap_end"])]).size and (part < INK).mean() >= least]

    return _each_page(images, rows, inked, "gap_start double, gap_end double", key)
