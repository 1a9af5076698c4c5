"""Coverage and audit: what a source has and an output lacks; pattern findings; the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def missing_terms(pairs: DataFrame, terms: list[str], source: str, target: str) -> Column:
    """Terms seen in the source and, in no spelling, in the target; terms the source lacks are not required."""
    if not terms:
        return F.array().cast("array<string>")
    a, b = T.compact_signs(F.col(source)), T.compact_signs(F.col(target))
    # both texts once a row, not once a term and spelling
    missing = lambda s, t: F.contains(s["a"], T.compact_signs(t)) & ~T.covers(s["b"], t)
    return T.once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.array_compact(F.array(*[F.when(missing(s, F.lit(t)), F.lit(t)) for t in terms])))


def region_issues(regions: DataFrame, markdown: DataFrame, doc: str, risk: Column, anchors: Column, min_missing: int = 1, most: int = 20) -> DataFrame:
    """doc, idx, missing: risky recorded regions with min_missing anchors or more that the output lacks; the first ``most`` a document."""
    both = regions.filter(risk).withColumn("_anchors", anchors).join(markdown.select(doc, T.compact_signs(F.col("markdown")).alias("_md")), doc)
    found = both.withColumn("missing", F.filter("_anchors", lambda a: ~F.contains(F.col("_md"), T.compact_signs(a)))).filter(F.size("missing") >= min_missing)
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("idx"))
    return found.withColumn("_k", rank).filter(F.col("_k") <= most).select(doc, "idx", "missing")


def section_issues(source: DataFrame, output: DataFrame, key: list[str], terms: list[str], high_risk: list[str], most_sections: int = 120, evidence: int = 2200) -> DataFrame:
    """key..., check, detail for the first sections of each document.

    source: key..., token, title, text, first; output: key..., token, text. A section without its counterpart is one
    issue; else any missing high-risk term is one, or else three missing terms or more; four missing numbers or more are one.
    """
    ranked = source.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("first"))).filter(F.col("_k") <= most_sections)
    both = ranked.withColumn("text", F.substring("text", 1, evidence)).join(output.select(*key, "token", F.col("text").alias("_out")), [*key, "token"], "left")
    risky, plain = missing_terms(both, high_risk, "text", "_out"), missing_terms(both, terms, "text", "_out")
    numbers = T.missing_numbers(F.col("text"), F.coalesce("_out", F.lit("")))
    issue = lambda check, detail: F.struct(F.lit(check).alias("check"), detail.alias("detail"))
    found = F.when(F.col("_out").isNull(), F.array(issue("section_missing", F.col("title")))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.size(risky) > 0, issue("high_risk_terms", F.array_join(risky, ", "))).when(F.size(plain) >= 3, issue("terms", F.array_join(plain, ", "))),
                F.when(F.size(numbers) >= 4, issue("numbers", F.array_join(F.slice(numbers, 1, 8), ", "))),
            )
        )
    )
    return both.select(*key, "token", F.explode(found).alias("i")).select(*key, "token", "i.*")


def contents_missing(entries: DataFrame, bodies: DataFrame, doc: str, least: int = 4, most: int = 20) -> DataFrame:
    """doc, token, title of contents entries (if a document has ``least`` or more) found in the body under none of four spellings."""
    counted = entries.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(doc))).filter(F.col("_n") >= least)
    both = counted.join(bodies.select(doc, T.compact_signs(F.col("body")).alias("_body")), doc)
    token, title = T.compact_signs(F.col("token")), T.compact_signs(F.col("title"))
    spelled = F.array(F.concat(token, title), F.concat(token, F.lit("."), title), F.concat(token, F.lit("、"), title), title)
    missing = both.filter(~F.exists(spelled, lambda s: F.contains(F.col("_body"), s)))
    return missing.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("seq"))).filter(F.col("_k") <= most).select(doc, "token", "title")


def pattern_findings(lines: DataFrame, doc: str, patterns: dict[str, str], most: int = 8) -> DataFrame:
    """doc, type, n_found (at most ``most`` are kept), first_line (from 1) of lines that match a pattern."""
    kinds = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    hits = lines.select(doc, "line_no", F.explode(kinds).alias("type"))
    return hits.groupBy(doc, "type").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n_found"), (F.min("line_no") + 1).cast("long").alias("first_line"))


def orphan_numbers(lines: DataFrame, doc: str, context: str, reach: int = 3, most: int = 8) -> DataFrame:
    """Lines of one to three digits only, with a context pattern in a line within reach; the first ``most`` a document."""
    w = Window.partitionBy(doc).orderBy("line_no")
    marked = lines.withColumn("_c", F.col("line").rlike(context).cast("int"))
    near = F.greatest(F.coalesce(F.max("_c").over(w.rowsBetween(-reach, -1)), F.lit(0)), F.coalesce(F.max("_c").over(w.rowsBetween(1, reach)), F.lit(0)))
    found = marked.withColumn("_near", near).filter((F.col("_near") == 1) & T.trim(F.col("line")).rlike(r"\A\d{1,3}\z"))
    return found.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).select(doc, (F.col("line_no") + 1).alias("line_no"), T.trim(F.col("line")).alias("line"))


def quality_gate(docs: DataFrame, issues: DataFrame, doc: str, blocking: list[str]) -> DataFrame:
    """doc, n_blocking, n_warnings, quality_ok for every document: it passes if no issue blocks."""
    blocks = F.col("check").isin(blocking)
    counts = issues.groupBy(doc).agg(F.sum(blocks.cast("long")).alias("_b"), F.sum((~blocks).cast("long")).alias("_w"))
    zero = F.lit(0).cast("long")
    return docs.select(doc).join(counts, doc, "left").select(doc, F.coalesce("_b", zero).alias("n_blocking"), F.coalesce("_w", zero).alias("n_warnings"), (F.coalesce("_b", zero) == 0).alias("quality_ok"))


def ledger(stages: dict[str, DataFrame]) -> DataFrame:
    """The append-only record: the rows of each stage with its name."""
    out = None
    for name, df in stages.items():
        part = df.withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def note_summary(notes: DataFrame, doc: str) -> DataFrame:
    """doc, note, n, rank: notes by frequency, ties by first appearance."""
    counted = notes.groupBy(doc, "note").agg(F.sum("n").alias("n"), F.min("seq").alias("_first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "_first"))).drop("_first")
