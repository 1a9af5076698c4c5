"""The coverage audit: what a document's source has and its output lacks, as one table of issues.

Every check is evidence based: only terms, numbers, formulas and headings seen in the source are asked for. Words that only
one kind of document has come as a pack; with the empty one the checks that need words find nothing.

Inputs, keyed by doc: blocks and raw (seq, page, kind, text, rows, flags, x0, y0, x1, y1), regions (idx, stage, kind, text, rows,
page, flags, x0, y0, x1, y1), source (text), markdown (markdown). Documents without a markdown row are not audited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import geometry as G
from ..functions import grids
from ..functions.packs import EMPTY, Pack
from ..functions.text import compact, compact_signs, covers, missing_numbers, trim
from ..store import cut
from . import sequences

#: Issues of a kind that are kept for a document, and terms of one issue that are shown.
MOST_REGIONS, MOST_BLOCKS, MOST_CONTENTS, MOST_GAPS, MOST_SECTIONS, SHOWN = 20, 12, 20, 12, 120, 6


def _issues(rows: DataFrame, doc: str, check: str, detail: Column, order: list[str], most: int | None = None) -> DataFrame:
    out = rows.select(doc, F.lit(check).alias("check"), detail.alias("detail"), F.row_number().over(Window.partitionBy(doc).orderBy(*order)).alias("_k"))
    return (out.filter(F.col("_k") <= most) if most else out).select(doc, "check", "detail")


def _flat(markdown: DataFrame, doc: str) -> DataFrame:
    return markdown.select(doc, F.coalesce("markdown", F.lit("")).alias("_text")).withColumn("_md", compact_signs(F.col("_text")))


def _joined(terms: Column, n: int = SHOWN) -> Column:
    return F.array_join(F.slice(terms, 1, n), "、")


def source_text(doc: str, pdf: DataFrame | None, blocks: DataFrame, regions: DataFrame | None) -> DataFrame:
    """doc, text: the page text, the blocks' text and rows, then those of recorded regions, each on its lines."""
    parts = blocks.select(doc, F.lit(1).alias("_p"), F.col("seq").cast("long").alias("_o"), E.block_text(F.col("text"), F.col("rows")).alias("_t"))
    if pdf is not None:
        parts = parts.unionByName(pdf.select(doc, F.lit(0).alias("_p"), F.lit(0).cast("long").alias("_o"), F.col("text").alias("_t")))
    if regions is not None:
        parts = parts.unionByName(regions.select(doc, F.lit(2).alias("_p"), F.col("idx").cast("long").alias("_o"), E.block_text(F.col("text"), F.col("rows")).alias("_t")))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_o", "_t")))
    return parts.filter(F.coalesce("_t", F.lit("")) != "").groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s["_t"]), "\n").alias("text"))


def review_markers(markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    found = F.filter(F.array(*[F.lit(m) for m in pack.review_markers]).cast("array<string>"), lambda m: F.contains(F.col("_text"), m))
    return _flat(markdown, doc).select(doc, F.lit("review_marker").alias("check"), F.explode(found).alias("detail"))


def region_coverage(regions: DataFrame, markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    """Risky recorded regions with an anchor, seen in them, that the output lacks."""
    text = E.block_text(F.col("text"), F.col("rows"))
    flat = regions.withColumn("_t", text).withColumn("_c", compact_signs(F.col("_t"))).filter(E.high_risk_region(F.col("kind"), F.col("stage"), F.col("flags"), F.col("text"), F.col("_c"), pack))
    both = flat.join(_flat(markdown, doc), doc).withColumn("_m", E.missing_seen(F.col("_c"), F.col("_md"), E.region_anchors(F.col("_t"), pack))).filter(F.size("_m") > 0)
    where = G.format_bbox(G.rect(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    detail = F.concat(F.lit("page "), (F.coalesce("page", F.lit(0)) + 1).cast("string"), F.lit(" region "), F.col("idx").cast("string"), F.lit(" ["), F.coalesce(where, F.lit("")), F.lit("]: "), _joined(F.col("_m")))
    return _issues(both, doc, "region_coverage", detail, ["idx"], MOST_REGIONS)


def block_coverage(raw: DataFrame, markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    """Risky raw blocks with two anchors or more, seen in them, that the output lacks."""
    flat = raw.withColumn("_t", E.block_text(F.col("text"), F.col("rows"))).withColumn("_c", compact_signs(F.col("_t"))).filter(E.high_risk_block(F.col("kind"), F.col("rows"), F.col("_c"), pack))
    both = flat.join(_flat(markdown, doc), doc).withColumn("_m", E.missing_seen(F.col("_c"), F.col("_md"), E.raw_anchors(F.col("_t"), pack))).filter(F.size("_m") >= 2)
    return _issues(both, doc, "block_coverage", F.concat(F.lit("block "), F.col("seq").cast("string"), F.lit(": "), _joined(F.col("_m"))), ["seq"], MOST_BLOCKS)


def image_coverage(blocks: DataFrame, markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    """Pictures of formulas, of tables that fell back, and with text of value, whose text the output lacks."""
    flagged = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    text, rows = F.col("text"), F.col("rows")
    important = flagged("formula") | (flagged("auto_image") & E.image_is_important(text, rows, pack)) | flagged("table_fallback") | E.image_rows_are_important(text, rows, pack)
    lost = blocks.filter((F.col("kind") == "image") & important).join(_flat(markdown, doc), doc).filter(~E.image_exported(text, rows, F.col("flags"), F.col("_md")))
    return _issues(lost, doc, "image_coverage", F.concat(F.lit("page "), (F.coalesce("page", F.lit(0)) + 1).cast("string"), F.lit(" block "), F.col("seq").cast("string")), ["seq"])


def table_rendering(blocks: DataFrame, markdown: DataFrame, doc: str, complex_table: Column | None = None) -> DataFrame:
    """Plain tables that no pipe line of the output starts."""
    complex_table = grids.is_complex(F.col("rows")) if complex_table is None else complex_table
    pipes = F.filter(F.transform(E.lines_of(F.col("_text")), trim), lambda s: s.startswith("|") & s.endswith("|"))
    shown = grids.header_rendered(F.col("rows"), pipes) & F.exists(F.col("rows")[0], lambda c: trim(c) != "")
    lost = blocks.filter((F.coalesce(F.size("rows"), F.lit(0)) > 0) & ~complex_table).join(_flat(markdown, doc), doc).filter(~F.coalesce(shown, F.lit(False)))
    where = F.coalesce(G.format_bbox(G.rect(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])), F.lit(""))
    return _issues(lost, doc, "table_rendering", F.concat(F.lit("page "), (F.coalesce("page", F.lit(0)) + 1).cast("string"), F.lit(" block "), F.col("seq").cast("string"), F.lit(" ["), where, F.lit("]")), ["seq"])


def contents_and_body(markdown: DataFrame, doc: str) -> DataFrame:
    """doc, entries (array of token, title), body: the table of contents of an output and the text after it.

    The contents start at their title and end at the first line, after an entry, that is none and not blank; without a title
    everything is body.
    """
    lines = markdown.select(doc, E.lines_of(F.col("markdown")).alias("_l"))
    stripped = F.transform("_l", trim)
    titles = F.filter(F.transform(stripped, lambda s, i: F.when(s.rlike(r"\A(?:#{1,6}\s+)?目录\z"), i)), lambda i: i.isNotNull())
    lines = lines.withColumn("_s", stripped).withColumn("_at", F.get(titles, F.lit(0)))
    is_entry = lambda s: s.rlike(E.CONTENTS_LINE)
    after = lines.withColumn("_first", F.get(F.filter(F.transform("_s", lambda s, i: F.when((i > F.col("_at")) & is_entry(s), i)), lambda i: i.isNotNull()), F.lit(0)))
    end = F.get(F.filter(F.transform("_s", lambda s, i: F.when((i > F.col("_first")) & (s != "") & ~is_entry(s), i)), lambda i: i.isNotNull()), F.lit(0))
    cut = after.withColumn("_end", F.when(F.col("_at").isNull(), 0).otherwise(F.coalesce(end, F.size("_s"))))
    listed = F.filter(F.transform("_s", lambda s, i: F.when((i > F.col("_at")) & (i < F.col("_end")) & is_entry(s), s)), lambda s: s.isNotNull())
    title = lambda s: compact(F.regexp_replace(F.regexp_extract(s, E.CONTENTS_LINE, 2), r"[.。·•．…⋯\s]+\z", ""))
    entries = F.transform(F.coalesce(F.when(F.col("_at").isNotNull(), listed), F.array().cast("array<string>")), lambda s: F.struct(F.replace(F.regexp_extract(s, E.CONTENTS_LINE, 1), F.lit("．"), F.lit(".")).alias("token"), title(s).alias("title")))
    body = F.slice("_l", F.col("_end") + 1, F.greatest(F.size("_l") - F.col("_end"), F.lit(0)))
    return cut.select(doc, F.filter(entries, lambda e: F.char_length(e["title"]) >= 2).alias("entries"), F.array_join(body, "\n").alias("body"))


def contents_coverage(markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    """Entries of a table of contents of four entries or more that the body has under no spelling."""
    parted = contents_and_body(markdown, doc).filter(F.size("entries") >= 4).withColumn("_b", compact_signs(F.col("body")))
    each = parted.select(doc, "_b", F.posexplode("entries").alias("_i", "e"))
    title = compact_signs(F.col("e.title"))
    spelled = F.array(title, compact_signs(F.concat("e.token", "e.title")), compact_signs(F.concat_ws(".", "e.token", "e.title")))
    exempt = title.rlike(pack.contents_exempt) if pack.contents_exempt else F.lit(False)
    lost = each.filter(~exempt & ~F.exists(spelled, lambda s: F.contains(F.col("_b"), s)))
    return _issues(lost, doc, "contents_coverage", F.concat("e.token", "e.title"), ["_i"], MOST_CONTENTS)


def heading_gaps(markdown: DataFrame, doc: str) -> DataFrame:
    """Numbers that a body's headings leave out between one child of a section and the next, unless it has children itself."""
    body = contents_and_body(markdown, doc).select(doc, F.posexplode(E.lines_of(F.col("body"))).alias("_i", "_l"))
    number = F.replace(F.regexp_extract(trim(F.regexp_replace(trim(F.col("_l")), r"\A#+", "")), r"\A(\d+(?:[.．]\d+){1,3})\s*", 1), F.lit("．"), F.lit("."))
    tokens = body.withColumn("token", number).filter("token <> ''").withColumn("parent", F.regexp_replace("token", r"\.\d+\z", "")).withColumn("child", F.regexp_extract("token", r"(\d+)\z", 1).cast("long"))
    first = tokens.groupBy(doc, "parent", "child").agg(F.min("_i").alias("_i"))
    w = Window.partitionBy(doc, "parent").orderBy("_i")
    gaps = first.withColumn("_before", F.lag("child").over(w)).filter("child > _before + 1")
    wanted = gaps.select(doc, "parent", "_i", F.explode(F.sequence(F.col("_before") + 1, F.col("child") - 1)).alias("_n"))
    there = first.select(doc, "parent", F.col("child").alias("_n"))
    parents = tokens.select(doc, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("token", r"\."))), lambda k: F.array_join(F.slice(F.split("token", r"\."), 1, k), "."))).alias("_t"), "token").filter("_t <> token").select(doc, "_t").distinct()
    missing = wanted.join(there, [doc, "parent", "_n"], "left_anti").withColumn("_t", F.concat_ws(".", "parent", F.col("_n").cast("string"))).join(parents, [doc, "_t"], "left_anti")
    per = missing.groupBy(doc, "parent", "_i").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_m"))
    order = first.groupBy(doc, "parent").agg(F.min("_i").alias("_p"))
    return _issues(per.join(order, [doc, "parent"]), doc, "heading_gap", _joined(F.transform("_m", lambda s: s["_t"]), 5), ["_p", "_i"], MOST_GAPS)


def sections_of(texts: DataFrame, doc: str, pack: Pack = EMPTY, least: int = 20) -> DataFrame:
    """doc, token, title, text, line_no of a source's sections: from one probable heading to the next, of twenty signs or more."""
    lines = texts.select(doc, F.posexplode(E.lines_of(F.col("text"))).alias("line_no", "line"))
    head = trim(F.regexp_replace(trim(F.col("line")), r"\A#+", ""))
    token, title = E.heading_token(head), E.heading_title(head)
    marked = lines.withColumn("_t", token).withColumn("_h", title)
    starts = (F.col("_t") != "") & (F.char_length(compact_signs(F.col("_h"))) >= 2) & E.probable_heading(F.col("_t"), F.col("_h"), pack)
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = marked.withColumn("_s", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w)).filter("_s > 0")
    text = trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"))
    out = part.groupBy(doc, "_s").agg(F.min_by("_t", "line_no").alias("token"), F.min_by("_h", "line_no").alias("title"), text.alias("text"), F.min("line_no").alias("line_no"))
    return out.filter(F.char_length(compact_signs(F.col("text"))) >= least).select(doc, "token", "title", "text", (F.col("line_no") + 1).alias("line_no"))


def output_sections(markdown: DataFrame, doc: str) -> DataFrame:
    """doc, token, text: for each number the last section of the output whose heading has it, up to any next heading."""
    lines = markdown.select(doc, F.posexplode(E.lines_of(F.col("markdown"))).alias("line_no", "line"))
    heading = F.regexp_extract("line", r"\A#{1,6}\s+(.+?)\s*\z", 1)
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = lines.withColumn("_h", heading).withColumn("_s", F.sum((F.col("_h") != "").cast("int")).over(w)).filter("_s > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    each = part.groupBy(doc, "_s").agg(F.min_by("_h", "line_no").alias("_h"), text.alias("text")).withColumn("token", E.heading_token(F.col("_h"))).filter("token <> ''")
    return sequences.last_by_token(each, [doc], "token", "_s", "text")


def section_coverage(source: DataFrame, markdown: DataFrame, doc: str, pack: Pack = EMPTY, most_sections: int = MOST_SECTIONS) -> DataFrame:
    """The first sections of a source against theirs in the output, or all of it where they have none: title; then, for
    numbered children, key terms, four numbers or more, and the left sides of formulas."""
    ranked = sections_of(source, doc, pack).withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("line_no"))).filter(F.col("_k") <= most_sections)
    own = output_sections(markdown, doc).select(doc, "token", F.col("text").alias("_own"))
    both = ranked.join(_flat(markdown, doc), doc).join(own, [doc, "token"], "left").withColumn("_e", E.local_evidence(F.col("text")))
    both = both.withColumn("_out", F.coalesce(F.when(F.col("_own") != "", F.col("_own")), F.col("_text"))).withColumn("_oc", compact_signs(F.col("_out"))).withColumn("_ec", compact_signs(F.col("_e")))
    name = F.concat_ws(" ", "token", "title")
    terms = F.array(*[F.lit(t) for t in pack.key_terms]).cast("array<string>")
    lacking = F.filter(terms, lambda t: F.contains(F.col("_ec"), t) & ~covers(F.col("_oc"), t))
    risky = F.filter(lacking, lambda t: F.array_contains(F.array(*[F.lit(x) for x in pack.high_risk_terms]).cast("array<string>"), t))
    untitled = (F.char_length(compact_signs(F.col("title"))) >= 4) & ~covers(F.col("_md"), F.concat("token", "title")) & ~covers(F.col("_md"), F.col("title"))
    numbers, formulas = missing_numbers(F.col("_e"), F.col("_out")), E.missing_formulas(F.col("_e"), F.col("_out"), pack)
    issue = lambda when, check, detail: F.when(when, F.struct(F.lit(check).alias("check"), F.concat(name, F.lit(": "), detail).alias("detail")))
    deep = E.detailed_section(F.col("token"))
    found = F.array(
        issue(untitled, "section_title", F.col("title")),
        F.when(deep & (F.size(risky) > 0), F.struct(F.lit("section_terms").alias("check"), F.concat(name, F.lit(": "), _joined(risky)).alias("detail"))).otherwise(issue(deep & (F.size(lacking) >= 3), "section_fields", _joined(lacking))),
        issue(deep & (F.size(numbers) >= 4), "section_numbers", _joined(numbers, 8)),
        issue(deep & (F.size(formulas) > 0), "section_formulas", _joined(formulas, 4)),
    )
    return both.select(doc, F.explode(F.array_compact(found)).alias("i")).select(doc, "i.check", "i.detail")


def global_terms(source: DataFrame, markdown: DataFrame, doc: str, pack: Pack = EMPTY) -> DataFrame:
    """Terms of high risk that stand anywhere in the source and nowhere in the output."""
    terms = F.array(*[F.lit(t) for t in pack.high_risk_terms]).cast("array<string>")
    both = source.select(doc, compact_signs(F.col("text")).alias("_c")).join(_flat(markdown, doc), doc)
    return both.select(doc, F.lit("global_term").alias("check"), F.explode(F.filter(terms, lambda t: F.contains(F.col("_c"), t) & ~covers(F.col("_md"), t))).alias("detail"))


def readability(markdown: DataFrame, doc: str) -> DataFrame:
    """Lines of the output that are too long, too dense or hold glued formulas."""
    from . import lines as L

    split = L.split_lines(markdown, [doc], "markdown")
    found = L.readability(L.outside_fences(split, doc))
    return found.select(doc, F.concat(F.lit("readability_"), F.col("issue")).alias("check"), F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string")).alias("detail"))


def audit(blocks: DataFrame, raw: DataFrame, regions: DataFrame, markdown: DataFrame, doc: str = "doc_id", pack: Pack = EMPTY, pdf: DataFrame | None = None, complex_table: Column | None = None) -> DataFrame:
    """doc, check, detail: all checks united, each issue once."""
    source = cut(source_text(doc, pdf, raw, regions), "source")
    parts = [
        review_markers(markdown, doc, pack),
        contents_coverage(markdown, doc, pack),
        heading_gaps(markdown, doc),
        readability(markdown, doc),
        table_rendering(blocks, markdown, doc, complex_table),
        image_coverage(blocks, markdown, doc, pack),
        block_coverage(raw, markdown, doc, pack),
        region_coverage(regions, markdown, doc, pack),
        section_coverage(source, markdown, doc, pack),
        global_terms(source, markdown, doc, pack),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()
