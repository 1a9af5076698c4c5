"""Header and footer bands of a tall page: recurring anchors, the bands around them, and what they remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import compact, fuzzy
from .intervals import merge

#: Pixels: how far anchors may drift, how close they may come, how they are padded.
X_DRIFT, MIN_GAP, PERIOD_SLACK, SYNTH_NEAR, PAD, RULE_CLIP = 60.0, 500.0, 70.0, 120.0, 55.0, 3.0
MAX_CV, MIN_SPREAD = 0.45, 0.3


def anchors(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, key, n, period, aligned of anchor keys.

    lines: doc, text, x0, y0, x1, y1, page_h. First, keys of four characters or more that come three times, keep
    their x, spread over the page and recur at even gaps. Then, with the period P of the most frequent of those (of
    equals the longer), other keys all of whose gaps are near multiples of P.
    """
    keyed = lines.withColumn("key", fuzzy(F.col("text"))).filter(F.char_length("key") >= 4).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    w = Window.partitionBy(doc, "key").orderBy("cy")
    gaps = keyed.withColumn("gap", F.col("cy") - F.lag("cy").over(w))
    stats = gaps.groupBy(doc, "key").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("x0") - F.min("x0")).alias("drift"),
        (F.max("cy") - F.min("cy")).alias("spread"),
        F.max("page_h").alias("page_h"),
        F.min("gap").alias("least"),
        F.median("gap").alias("median"),
        (F.stddev_pop("gap") / F.greatest(F.avg("gap"), F.lit(1.0))).alias("cv"),
    )
    common = (F.col("n") >= 3) & (F.col("drift") <= X_DRIFT)
    even = stats.filter(common & (F.col("spread") >= F.col("page_h") * MIN_SPREAD) & (F.col("least") >= MIN_GAP) & (F.col("cv") <= MAX_CV))
    period = even.groupBy(doc).agg(F.max(F.struct("n", "median")).alias("m")).select(doc, F.col("m.median").alias("period"))
    phase = F.pmod("gap", "period")
    off = gaps.join(period.filter(F.col("period") > MIN_GAP), doc).filter(F.col("gap").isNotNull()).groupBy(doc, "key", "period").agg(F.max(F.least(phase, F.col("period") - phase)).alias("off"))
    aligned = stats.filter(common & (F.col("least") > MIN_GAP)).join(even.select(doc, "key"), [doc, "key"], "left_anti").join(off.filter(F.col("off") < PERIOD_SLACK), [doc, "key"])
    return (
        even.select(doc, "key", "n", F.lit(False).alias("aligned"))
        .unionByName(aligned.select(doc, "key", "n", F.lit(True).alias("aligned")))
        .join(period, doc, "left")
    )


def bands(lines: DataFrame, found: DataFrame, rules: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """doc, y0, y1: merged bands around every anchor line, and where the period wants one that is missing.

    rules: doc, y of ruling lines, which a band does not cross.
    """
    own = lines.withColumn("key", fuzzy(F.col("text"))).join(found, [doc, "key"]).select(doc, "key", "period", "y0", "y1", "page_h")
    shape = own.filter(F.col("period") > MIN_GAP).groupBy(doc, "key").agg(
        F.max("period").alias("period"), F.min("y0").alias("first"), F.max(F.col("y1") - F.col("y0")).alias("h"), F.max("page_h").alias("page_h"), F.collect_set("y0").alias("ys")
    )
    base = F.pmod("first", "period")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("page_h") - base) / F.col("period")).cast("int") - 1, F.lit(0))), lambda k: base + k * F.col("period")))
    wanted = shape.select(doc, "h", "ys", "page_h", at.alias("y0")).filter((F.col("y0") < F.col("page_h")) & ~F.exists("ys", lambda y: F.abs(y - F.col("y0")) < SYNTH_NEAR))
    raw = own.select(doc, "y0", "y1").unionByName(wanted.select(doc, "y0", (F.col("y0") + F.col("h")).alias("y1")))
    padded = raw.withColumn("a", F.col("y0") - PAD).withColumn("b", F.col("y1") + PAD)
    if rules is not None:
        near = padded.join(rules.groupBy(doc).agg(F.collect_set("y").alias("rules")), doc, "left")
        above, below = F.array_max(F.filter("rules", lambda y: y <= F.col("y0"))), F.array_min(F.filter("rules", lambda y: y >= F.col("y1")))
        padded = near.withColumn("a", F.greatest("a", F.coalesce(above + RULE_CLIP, F.col("a")))).withColumn("b", F.least("b", F.coalesce(below - RULE_CLIP, F.col("b"))))
    return merge(padded.select(doc, F.col("a").alias("y0"), F.col("b").alias("y1")), [doc], "y0", "y1").drop("n")


def strip(lines: DataFrame, found: DataFrame, merged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines that stay: no anchor (nor a line with an anchor of eight characters or more in it), and in a band only long, sure text."""
    key = fuzzy(F.col("text"))
    held = lines.withColumn("_key", key)
    long = found.filter(F.char_length("key") >= 8).groupBy(doc).agg(F.collect_set("key").alias("_long"))
    held = held.join(found.select(doc, F.col("key").alias("_key")), [doc, "_key"], "left_anti").join(long, doc, "left")
    held = held.filter(~F.coalesce(F.exists("_long", lambda a: F.contains(F.col("_key"), a)), F.lit(False))).drop("_long")
    banded = held.join(merged.groupBy(doc).agg(F.collect_list(F.struct("y0", "y1")).alias("_bands")), doc, "left")
    cy = (F.col("y0") + F.col("y1")) / 2
    inside = F.coalesce(F.exists("_bands", lambda b: cy.between(b["y0"], b["y1"])), F.lit(False))
    short = (F.char_length(compact(F.col("text"))) <= 14) | (F.col("conf") < 0.45) | P.is_page_number(F.col("text")) | P.is_leader(F.col("text"))
    return banded.filter(~(inside & short)).drop("_bands", "_key")


def watermarks(lines: DataFrame, pattern: str, doc: str = "doc_id", min_spread: float = 0.12) -> DataFrame:
    """doc, key, n: account-shaped text (by the caller's pattern) that comes three times and spreads over the page."""
    keyed = lines.withColumn("key", fuzzy(F.col("text"))).filter(F.col("key").rlike(pattern))
    stats = keyed.groupBy(doc, "key").agg(F.count(F.lit(1)).alias("n"), (F.max("y0") - F.min("y0")).alias("spread"), F.max("page_h").alias("page_h"))
    return stats.filter((F.col("n") >= 3) & (F.col("spread") > F.col("page_h") * min_spread)).select(doc, "key", "n")


__all__ = ["Column", "anchors", "bands", "strip", "watermarks"]
