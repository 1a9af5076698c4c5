"""Exact deduplication by skew-safe combining; DataFrame functions only.

1. Locally: each task reduces its rows to one winner per text (the map side of the first aggregation).
2. Salted: winners meet by (digest, salt, text), so a text that holds a third of all rows is spread over the salts.
3. Globally: at most one winner per salt is left of each text; these meet by digest.
4. Back: rows meet the winner of their text, those of a hot text dealt over salts once more.
Every grouping key holds the full text, so a digest that two texts share never merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_spread, materialize, table, text_of

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, digest.

    Texts are equal when identical; a null text counts as empty. The row with the largest integer id stays; a null
    id is below every other; of rows that repeat both id and text, one stays. An empty table gives no rows.
    Other columns of the input are not looked at, whatever their names. ``digest`` may be any function of the text
    (a weak one costs time, not correctness).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    salted = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    merged = salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    check = [F.xxhash64("_text").alias("_check"), F.octet_length("_text").alias("_bytes")]
    key = ["_digest", "_check", "_bytes"]  # what stands for a text from here on, unless two texts share it
    winners = materialize(merged.select("_digest", *check, "_keep", "_n"), "exact-winners")
    # rows alike in id and text are alike in all that follows
    slim = rows.select("_id", "_digest", *check).groupBy("_id", *key).agg(F.count(F.lit(1)).alias("_rows"))
    shared = winners.groupBy(*key).agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select(*key)
    if shared.isEmpty():
        classed = join_spread(slim, winners, key, "_n", ["_id"])
    else:
        few = rows.select("*", *check).join(shared, key, "left_semi")
        by_text = few.groupBy(*key, "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        full = few.groupBy("_id", *key, "_text").agg(F.count(F.lit(1)).alias("_rows")).join(by_text, [*key, "_text"]).drop("_text")
        classed = slim.join(shared, key, "left_anti").join(winners, key).unionByName(full)
    return classed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_digest").alias("digest"),
        F.col("_rows").alias("rows"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, any one."""
    mark, own = fresh(docs, "__digest"), fresh(docs, "__id")
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = materialize(kept.select(F.col(id_col).alias(own), F.col("digest").alias(f"{mark}_kept"), F.col("rows").alias(f"{mark}_rows")), "exact-kept")
    marked = docs.withColumn(mark, sha256(text_of(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(f"{mark}_kept"))
    once = marked.join(kept.filter(F.col(f"{mark}_rows") == 1), same, "left_semi")
    more = marked.join(kept.filter(F.col(f"{mark}_rows") > 1), same, "left_semi").dropDuplicates([id_col, mark])
    return once.unionByName(more).drop(mark)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; nulls, ties and repeats as in ``exact_dedup``."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
