"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, exact_dedup, near, packing, quality
from spanforge.llm.common import fresh, materialize, table
from spanforge.llm.tokens import public_file

#: A document stays if its score is at least this.
QUALITY = 0.5
#: Pieces that a worker remembers while it packs: few, as the stages before have filled its executor's memory.
CACHE_ENTRIES = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__score")
    return quality.score(docs, model, out_col=score).filter(F.col(score) >= QUALITY).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each component of texts with a Jaccard similarity of 0.8 or more in five-word shingles, that of the
    smallest doc_id (a null one only where there is no other) and of the smallest text hash, should the doc_id repeat."""
    groups = materialize(near.near_groups(docs), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = groups.groupBy("component").agg(F.min(order).alias("least"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    gone = groups.join(least, "component").filter(~kept).select("doc_id", "text_hash").distinct()
    gone = materialize(gone, "near-gone")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no eight consecutive words with a benchmark item, and hold at most one item of fewer words."""
    found = materialize(decontaminate.contaminated_ids(docs, table(spark, sf_dir, "benchmark")), "leaks")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["text_hash"])
    return docs.join(found, same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of at most 4096 tokens."""
    return packing.pack(materialize(packing.token_pieces(docs, public_file(packing.TOKENIZER), cache_entries=CACHE_ENTRIES), "pieces"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A learned classifier has no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
