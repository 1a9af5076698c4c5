"""Tables and figures of recognised pages: ruling lines to grids, gaps to figures, captions to their regions, cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact
from . import intervals

#: Pixels: gap between rules of one table; text inset; reach of a table over its lines.
RULE_GAP, INSET, REACH_Y, REACH_X = 100.0, 4.0, 6.0, 20.0


def rules_off_text(rules: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Ruling lines (y, x0, x1) that cross no text: none whose y lies inside a line of text that overlaps it in x."""
    text = lines.select(*key, F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    on = (F.col("y") > F.col("_y0") + INSET) & (F.col("y") < F.col("_y1") - INSET) & (F.col("x0") < F.col("_x1")) & (F.col("x1") > F.col("_x0"))
    for k in key:
        on = on & (rules[k] == text[k])
    return rules.join(text, on, "left_anti")


def table_regions(rules: DataFrame, key: list[str], gap: float = RULE_GAP, match: float = 0.6) -> DataFrame:
    """key..., region, y0, y1, x0, x1, hy: rules of like extent, each near to the next, three or more, as a table."""
    w = Window.partitionBy(*key).orderBy("y", "x0", "x1")
    common = F.greatest(F.least(F.col("x1"), F.lag("x1").over(w)) - F.greatest(F.col("x0"), F.lag("x0").over(w)), F.lit(0.0))
    widest = F.greatest(F.col("x1") - F.col("x0"), F.lag("x1").over(w) - F.lag("x0").over(w))
    joins = F.coalesce((F.col("y") - F.lag("y").over(w) <= gap) & (common / widest >= match), F.lit(False))
    numbered = rules.withColumn("_n", (~joins).cast("int")).withColumn("region", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*key, "region").agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_sort(F.collect_set("y")).alias("hy")
    )
    return grouped.filter(F.size("hy") >= 3)


def lines_of_tables(lines: DataFrame, regions: DataFrame, key: list[str], how: str = "left_semi") -> DataFrame:
    """Lines whose centre lies in a table, with some slack, and that overlap it in x; with left_anti the others."""
    r = regions.select(*key, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cy = (F.col("y0") + F.col("y1")) / 2
    on = cy.between(F.col("_y0") - REACH_Y, F.col("_y1") + REACH_Y) & (F.col("x1") > F.col("_x0") - REACH_X) & (F.col("x0") < F.col("_x1") + REACH_X)
    for k in key:
        on = on & (lines[k] == r[k])
    return lines.join(r, on, how)


def crosses_columns(x0: Column, x1: Column, vx: Column, slack: float = 6.0) -> Column:
    """Does a line straddle an inner column edge?"""
    inner = F.slice(vx, 2, F.greatest(F.size(vx) - 2, F.lit(0)))
    return (F.size(vx) >= 3) & F.exists(inner, lambda x: (x0 + slack < x) & (x < x1 - slack))


def figure_gaps(lines: DataFrame, tables: DataFrame, bands: DataFrame, pages: DataFrame, key: list[str], min_gap: float = 140.0, pad: float = 8.0) -> DataFrame:
    """key..., gap_start, gap_end: heights of a page that no line, table or band covers. Ink is for the caller to test."""
    covered = (
        lines.select(*key, (F.col("y0") - pad).alias("a"), (F.col("y1") + pad).alias("b"))
        .unionByName(tables.select(*key, F.col("y0").alias("a"), F.col("y1").alias("b")))
        .unionByName(bands.select(*key, F.col("y0").alias("a"), F.col("y1").alias("b")))
        .unionByName(pages.select(*key, F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))  # a page without anything is one gap
    )
    merged = intervals.merge(covered, key, "a", "b").join(pages.select(*key, "page_h"), key)
    return intervals.uncovered(merged, key, "a", "b", F.lit(0.0), F.col("page_h"), min_gap)


def caption_figures(captions: DataFrame, regions: DataFrame, key: list[str], reach: float = 0.36) -> DataFrame:
    """key..., caption, x0, y0, x1, y1: for each caption the union of the regions that end above it, within a share of the page."""
    r = regions.select(*key, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    on = (F.col("_y1") <= F.col("y0")) & (F.col("y0") - F.col("_y0") <= F.col("page_h") * reach)
    for k in key:
        on = on & (captions[k] == r[k])
    near = captions.join(r, on).select(*[captions[c] for c in (*key, "caption")], "_x0", "_y0", "_x1", "_y1")
    return near.groupBy(*key, "caption").agg(F.min("_x0").alias("x0"), F.min("_y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"))


def merge_regions(regions: DataFrame, barriers: DataFrame, key: list[str], gap: float = 160.0) -> DataFrame:
    """Regions within ``gap`` of each other as one, unless a barrier line stands between."""
    w = Window.partitionBy(*key).orderBy("y0", "y1")
    spaced = regions.withColumn("_end", F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = barriers.select(*key, F.col("y").alias("_b"))
    on = (F.col("_b") >= F.col("_end")) & (F.col("_b") <= F.col("y0"))
    for k in key:
        on = on & (spaced[k] == b[k])
    blocked = spaced.join(b, on, "left_semi").select(*key, "y0", "y1", F.lit(True).alias("_stop"))
    marked = spaced.join(blocked, [*key, "y0", "y1"], "left")
    new = F.when((F.col("y0") - F.col("_end") <= gap) & F.col("_stop").isNull(), 0).otherwise(1)
    return marked.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w)).groupBy(*key, "_g").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")).drop("_g")


def accept_rereading(
    blocks: DataFrame, second: DataFrame, key: list[str], threshold: float = 0.45, gain: float = 0.15, length: float = 0.6, clean: Callable[[Column], Column] | None = None, watermark: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Text blocks below the threshold after a second recognition; all others as they are.

    Readings that agree but for white space are trusted: the confidence is the greatest of both and the threshold. A reading
    surer by more than ``gain`` and not much shorter takes the place of the first. What is below the threshold even so, or
    has no second reading, is flagged low_confidence unless its text is ``clean``; a reading with a watermark is not
    looked at and flags the block.
    """
    s = second.select(*key, F.col("text").alias("_t"), F.col("confidence").alias("_c"))
    both = blocks.join(s, key, "left")
    flat = lambda c: compact(F.coalesce(c, F.lit("")))
    old, new, conf, conf2 = flat(F.col("text")), flat(F.col("_t")), F.col("confidence"), F.col("_c")
    looked = F.col("kind").isin("para", "heading") & (conf < threshold)
    marked = F.col("_t").isNotNull() & (watermark(F.col("_t")) if watermark else F.lit(False))
    same = F.col("_t").isNotNull() & (old == new)
    taken = F.col("_t").isNotNull() & ~same & (conf2 > conf + gain) & (F.char_length(new) >= F.char_length(old) * length)
    text = F.when(looked & ~marked & taken, F.col("_t")).otherwise(F.col("text"))
    sound = clean(text) if clean else F.lit(False)
    state = (
        F.when(~looked, "as it was")
        .when(marked, "flagged")
        .when(same, "agreed")
        .when(taken & (conf2 >= threshold), "taken")
        .when(sound, "clean")
        .otherwise("flagged")
    )
    surer = (
        F.when(F.col("_state") == "agreed", F.greatest(conf, conf2, F.lit(threshold)))
        .when(F.col("_state") == "clean", F.greatest(F.when(taken, conf2).otherwise(conf), F.lit(threshold)))
        .when(looked & ~marked & taken, conf2)
        .otherwise(conf)
    )
    flags = F.when(F.col("_state") == "flagged", F.array_union("flags", F.array(F.lit("low_confidence")))).otherwise(F.col("flags"))
    done = both.withColumn("_state", state).select(*[c for c in blocks.columns if c not in ("text", "confidence", "flags")], text.alias("text"), surer.alias("confidence"), flags.alias("flags"))
    return done.select(*blocks.columns)
