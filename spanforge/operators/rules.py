"""Rules as data: ordered rewrites with counted notes, and sections that a rule pack wants to be there.

Nothing is inserted unless a caller passes a pack; what is inserted carries origin = injected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import apply_rules, compact, rule_notes

#: Symbol and spacing repairs that hold for any text (pattern, replacement, label).
NORMALISE = [
    *[(chr(0xFF10 + d), str(d), "full_width_digits") for d in range(10)],
    (r"(?<=\d) (?=\d{3}\b)", "", "digit_space"),
    (r"[ \t]{2,}", " ", "spaces"),
    (r"(?<=[\x{4E00}-\x{9FFF}])\s+(?=[\x{4E00}-\x{9FFF}])", "", "cjk_space"),
    (r"([，。；：])\1+", "$1", "doubled_mark"),
]


#: Rules of a pack, all of which are broadcast.
MOST_RULES = 10_000


def normalise(text: Column, rules: list[tuple[str, str, str]] = NORMALISE) -> Column:
    return apply_rules(text, [(p, r) for p, r, _ in rules])


def notes(rows: DataFrame, doc: str, text: str, rules: list[tuple[str, str, str]] = NORMALISE) -> DataFrame:
    """doc, note, n over all texts of a document; rules of one label count together."""
    return rows.select(doc, F.explode(rule_notes(F.col(text), rules)).alias("s")).groupBy(doc, F.col("s.label").alias("note")).agg(F.sum("s.n").alias("n"))


def insert_missing(blocks: DataFrame, pack: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks and, where a document has a pack's trigger but lacks its required text, the pack's block after the trigger.

    pack: trigger, required, kind, text, level. The new block stands at its trigger's place (seq, then part). Every text
    is held against every trigger: a pack has ``MOST_RULES`` rows at most.
    """
    n = pack.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        raise ValueError(f"a pack has {MOST_RULES} rules at most")
    own = blocks.withColumn("part", F.lit(0)).withColumn("origin", F.lit("read"))
    flat = own.withColumn("_c", compact(F.coalesce("text", F.lit(""))))
    hits = flat.join(F.broadcast(pack.withColumnRenamed("text", "_text").withColumnRenamed("kind", "_kind").withColumnRenamed("level", "_level")), F.contains(F.col("_c"), compact(F.col("trigger"))))
    first = hits.groupBy(doc, "trigger", "required", "_kind", "_text", "_level").agg(F.min("seq").alias("seq"))
    there = flat.groupBy(doc).agg(F.array_join(F.collect_list("_c"), "").alias("_all"))
    lacking = first.join(there, doc).filter(~F.contains(F.col("_all"), compact(F.col("required"))))
    added = lacking.join(own.drop("kind", "text", "level", "part", "origin"), [doc, "seq"]).select(
        *[c for c in own.columns if c not in ("kind", "text", "level", "part", "origin")], F.col("_kind").alias("kind"), F.col("_text").alias("text"), F.col("_level").cast("int").alias("level"), F.lit(1).alias("part"), F.lit("injected").alias("origin")
    )
    return own.unionByName(added.select(*own.columns))
