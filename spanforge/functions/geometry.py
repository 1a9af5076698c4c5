"""Geometry on columns. A rectangle is a struct of x0, y0, x1, y1, y downwards; intervals are closed, grid buckets half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def expand(r: Column, pad: float) -> Column:
    return rect(r["x0"] - pad, r["y0"] - pad, r["x1"] + pad, r["y1"] + pad)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Area of the intersection over that of inner; zero for an empty inner."""
    return F.when(area(inner) > 0, area(intersection(inner, outer)) / area(inner)).otherwise(0.0)


def centre_inside(r: Column, outer: Column) -> Column:
    x, y = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
    return x.between(outer["x0"], outer["x1"]) & y.between(outer["y0"], outer["y1"])


def inside_visual(r: Column, region: Column, share: float = 0.55) -> Column:
    return (overlap_ratio(r, region) >= share) | centre_inside(r, region)


def _common(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def x_overlap(a: Column, b: Column) -> Column:
    """Common width over the shorter width."""
    return _common(a["x0"], a["x1"], b["x0"], b["x1"]) / F.greatest(F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]), F.lit(1e-9))


def x_match(a: Column, b: Column) -> Column:
    """Common width over the longer width."""
    return _common(a["x0"], a["x1"], b["x0"], b["x1"]) / F.greatest(a["x1"] - a["x0"], b["x1"] - b["x0"], F.lit(1e-9))


def bucket(value: Column, edges: Column) -> Column:
    """Index i with edges[i] <= value < edges[i+1]; null outside."""
    fits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(edges) - 2, F.lit(0))), lambda i: (F.get(edges, i) <= value) & (value < F.get(edges, i + 1)))
    return F.get(fits, F.lit(0))


def column_of_word(x0: Column, x1: Column, edges: Column, slack: float = 0.5) -> Column:
    """The first column that holds the word's centre, give or take the slack; outside ones go to the first or last column."""
    centre = (x0 + x1) / 2
    n = F.size(edges) - 1
    fits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (centre >= F.get(edges, i) - slack) & (centre <= F.get(edges, i + 1) + slack))
    return F.coalesce(F.get(fits, F.lit(0)), F.when(centre < F.get(edges, F.lit(0)), 0).otherwise(n - 1))


def cluster_positions(xs: Column, tolerance: float = 7.0) -> Column:
    """Means of clusters of ascending positions, each position against the running mean of the last cluster."""
    empty = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        near = (acc["n"] > 0) & (F.abs(x - acc["total"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        closed = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["total"] / acc["n"]))).otherwise(acc["done"])
        return F.when(near, F.struct(acc["done"].alias("done"), (acc["total"] + x).alias("total"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(closed.alias("done"), x.cast("double").alias("total"), F.lit(1).alias("n"))
        )

    return F.aggregate(F.array_sort(F.transform(xs, lambda x: x.cast("double"))), empty, add, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["total"] / a["n"]))).otherwise(a["done"]))


def edges_of_cells(xs: Column, least: int = 3) -> Column:
    """Distinct rounded cell edges, ascending; empty if fewer than three."""
    edges = F.array_sort(F.array_distinct(F.transform(xs, lambda x: F.bround(x, 1))))
    return F.when(F.size(edges) >= least, edges).otherwise(F.array().cast("array<double>"))


def format_bbox(r: Column) -> Column:
    return F.array_join(F.array(*[F.format_string("%.1f", r[c]) for c in ("x0", "y0", "x1", "y1")]), ",")
