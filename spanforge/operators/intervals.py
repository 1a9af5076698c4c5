"""Intervals: merging, uncovered gaps, coverage, points in bands, sessions, grid buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import by_key


def merge(intervals: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key..., start, end, n: closed intervals that touch or overlap made one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = by_key(intervals, key).withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def uncovered(merged: DataFrame, key: list[str], start: str, end: str, low: Column, high: Column, min_gap: float) -> DataFrame:
    """key..., gap_start, gap_end: parts of [low, high] of at least min_gap that no merged interval covers.

    low and high are expressions over the rows of a key (the same for all of them).
    """
    w = Window.partitionBy(*key).orderBy(start)
    gap = lambda a, b: F.struct(a.alias("gap_start"), b.alias("gap_end"))
    inner = gap(F.greatest(F.coalesce(F.lag(end).over(w), low), low), F.least(F.col(start), high))
    # the last interval of a key has the greatest end; what follows it is told in the same pass
    last = F.when(F.lead(F.lit(1)).over(w).isNull(), gap(F.max(end).over(Window.partitionBy(*key)), high))
    found = merged.select(*key, F.array(inner, last).alias("_gaps")).select(*key, F.explode("_gaps").alias("_gap"))
    return found.select(*key, "_gap.gap_start", "_gap.gap_end").filter(F.col("gap_end") - F.col("gap_start") >= min_gap)


def covered_share(rows: DataFrame, bands: DataFrame, key: list[str], row_id: str, y0: str, y1: str, b0: str, b1: str) -> DataFrame:
    """row_id, share of [y0, y1] that merged bands of the same key cover; one for an empty interval."""
    part = F.greatest(F.lit(0.0), F.least(F.col(b1), F.col(y1)) - F.greatest(F.col(b0), F.col(y0)))
    near = rows.join(bands, key, "left").groupBy(row_id, y0, y1).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("_covered"))
    return near.select(row_id, F.when(F.col(y1) > F.col(y0), F.col("_covered") / (F.col(y1) - F.col(y0))).otherwise(1.0).alias("share"))


def in_bands(rows: DataFrame, bands: DataFrame, key: list[str], value: Column, b0: str, b1: str, how: str = "left_semi") -> DataFrame:
    """Rows whose value lies in a band (closed) of the same key; with left_anti the others."""
    on = [rows[k] == bands[k] for k in key]
    on.append(value.between(bands[b0], bands[b1]))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(bands, condition, how)


def sessions(rows: DataFrame, key: list[str], order: Column, top: Column, bottom: Column, gap: float) -> DataFrame:
    """The rows with ``session`` (from 1): a row joins while its top is within gap of the greatest bottom so far. Rows of one
    order follow each other by top, then bottom."""
    ordered = rows.withColumn("_o", order).withColumn("_t", top).withColumn("_b", bottom)
    w = Window.partitionBy(*key).orderBy("_o", "_t", "_b")
    before = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("_new", F.when(F.col("_t") - before <= gap, 0).otherwise(1)).withColumn("session", F.sum("_new").over(so_far)).drop("_o", "_t", "_b", "_new")


def periodic(rows: DataFrame, key: list[str], y: str, min_n: int = 3, min_gap: float = 500.0, max_cv: float = 0.45) -> DataFrame:
    """key..., n, median_gap, cv: keys that recur at even distances (population deviation over mean of the gaps)."""
    w = Window.partitionBy(*key).orderBy(y)
    gaps = rows.withColumn("_gap", F.col(y) - F.lag(y).over(w))
    stats = gaps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_gap").alias("least_gap"),
        F.median("_gap").alias("median_gap"),
        (F.stddev_pop("_gap") / F.greatest(F.avg("_gap"), F.lit(1.0))).alias("cv"),
    )
    return stats.filter((F.col("n") >= min_n) & (F.col("least_gap") >= min_gap) & (F.col("cv") <= max_cv))


def tiles(pages: DataFrame, height: str = "height", strip: int = 1800, overlap: int = 240) -> DataFrame:
    """The rows with tile, y0, y1, own0, own1: overlapping strips of a page; the own parts cover it once."""
    step = strip - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.col(height) - overlap, F.lit(1)) - 1, F.lit(step))
    cut = pages.select("*", F.posexplode(starts).alias("tile", "y0")).withColumn("y1", F.least(F.col("y0") + strip, F.col(height)))
    first, last = F.col("y0") == 0, F.col("y1") >= F.col(height)
    return cut.withColumn("own0", F.when(first, F.col("y0")).otherwise(F.col("y0") + overlap // 2)).withColumn("own1", F.when(last, F.col("y1")).otherwise(F.col("y1") - overlap // 2))


def grid_cells(lines: DataFrame, key: list[str], row: Column, column: Column, order: list[str], text: str) -> DataFrame:
    """key..., row, col, text, n: lines in the same bucket joined in order; lines outside the grid (null buckets) are left out."""
    placed = lines.withColumn("row", row).withColumn("col", column).filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), " ")
    return placed.groupBy(*key, "row", "col").agg(joined.alias("text"), F.count(F.lit(1)).alias("n"))
