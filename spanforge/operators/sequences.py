"""Ordered neighbours: fills, sections, nearest rows, first matches, numbering gaps, wrap-around samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut


def fill_both(rows: DataFrame, key: list[str], order: list[str], columns: list[str], payload: Column) -> DataFrame:
    """Missing values take the last one before, on rows with payload; what is still missing there takes the next one after."""
    w = Window.partitionBy(*key).orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    forward = rows.withColumns({c: F.when(payload, F.last(c, ignorenulls=True).over(before)).otherwise(F.col(c)) for c in columns})
    return forward.withColumns({c: F.when(payload, F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(after))).otherwise(F.col(c)) for c in columns})


def sections(rows: DataFrame, key: list[str], order: str, heading: Column) -> DataFrame:
    """The rows with ``section``: 0 before the first heading, then the number of headings so far."""
    return rows.withColumn("section", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(Window.partitionBy(*key).orderBy(order)))


def section_text(numbered: DataFrame, key: list[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """key..., section, first, n, text of each section."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), sep)
    return numbered.groupBy(*key, "section").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), joined.alias("text"))


def last_by_token(sectioned: DataFrame, key: list[str], token: str, order: str, text: str) -> DataFrame:
    """One text per token: of tokens that come twice, the later section's."""
    return sectioned.groupBy(*key, token).agg(F.max_by(text, order).alias(text))


def slice_between(rows: DataFrame, key: list[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """Rows from the first that starts a slice up to, not with, the next one after it that ends it."""
    w = Window.partitionBy(*key)
    first = F.min(F.when(starts, F.col(order))).over(w)
    marked = rows.withColumn("_first", first).withColumn("_end", F.when(ends, F.col(order)))
    stop = F.min(F.when(F.col("_end") > F.col("_first"), F.col("_end"))).over(w)
    return marked.withColumn("_stop", stop).filter((F.col(order) >= F.col("_first")) & (F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))).drop("_first", "_stop", "_end")


def nearest(rows: DataFrame, key: list[str], order: str, value: str, eligible: Column, reach: int = 4, after: bool = True) -> Column:
    """The nearest eligible value among the next (or last) ``reach`` rows."""
    shift = F.lead if after else F.lag
    w = Window.partitionBy(*key).orderBy(order)
    return F.coalesce(*[shift(F.when(eligible, F.col(value)), i).over(w) for i in range(1, reach + 1)])


def near_flag(key: list[str], order: str, flag: Column, reach: int) -> Column:
    """Does a row within reach on either side (not the row itself) carry the flag?"""
    w = Window.partitionBy(*key).orderBy(order)
    some = lambda a, b: F.coalesce(F.max(flag.cast("int")).over(w.rowsBetween(a, b)), F.lit(0))
    return (some(-reach, -1) == 1) | (some(1, reach) == 1)


def next_index(key: list[str], order: str, flag: Column, otherwise: Column) -> Column:
    """Place of the next flagged row after this one."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.min(F.when(flag, F.col(order))).over(w), otherwise)


def drop_repeats(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_same", F.coalesce(before == F.col(value), F.lit(False))).filter(~F.col("_same")).drop("_same")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Order-preserving distinct: the first row of each key (an aggregation, so a frequent key is combined early)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def numbering_gaps(numbers: DataFrame, parent: str, child: str) -> DataFrame:
    """parent, missing: numbers between the least and the greatest child of a parent that are not there."""
    w = Window.partitionBy(parent).orderBy(child)
    steps = numbers.select(parent, child).distinct().withColumn("_before", F.lag(child).over(w)).filter(F.col(child) - F.col("_before") > 1)
    return steps.select(parent, F.explode(F.sequence(F.col("_before") + 1, F.col(child) - 1)).alias("missing"))


def order_violations(blocks: DataFrame, key: list[str], order: str, page: str, y: str) -> DataFrame:
    """Rows that stand before the row ahead of them in (page, y)."""
    w = Window.partitionBy(*key).orderBy(order)
    here, before = F.struct(page, y), F.lag(F.struct(page, y)).over(w)
    return blocks.withColumn("_v", F.coalesce(before > here, F.lit(False))).filter("_v").drop("_v")


def wrap_sample(rows: DataFrame, order: str, size: int, offset: int) -> DataFrame:
    """The rows at (offset + i) modulo their number, i below size, with ``pick`` = i. Keys of ``order`` are distinct.

    The keys are sorted over all partitions and numbered in each, from the number of keys in the partitions before: nothing
    but one count a partition comes to the driver.
    """
    n = rows.count()
    if not n:
        return rows.withColumn("pick", F.lit(0).cast("long")).limit(0)
    size, offset = min(size, n), offset % n
    keys = cut(rows.select(order).orderBy(order).withColumn("_p", F.spark_partition_id()), "sample-keys")
    starts, before = [], 0
    for r in keys.groupBy("_p").count().orderBy("_p").collect():
        starts.append((r["_p"], before))
        before += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_p int, _first long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)).cast("long") - 1 + F.col("_first")
    chosen = keys.join(F.broadcast(first), "_p").withColumn("pick", F.pmod(place - offset, F.lit(n))).filter(F.col("pick") < size)
    return rows.join(chosen.select(order, "pick"), order).select(*rows.columns, "pick")
