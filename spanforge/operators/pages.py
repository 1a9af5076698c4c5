"""Recognised pages: lines to rows, paragraphs, tables and blocks, in one plan of windows, joins and grouped aggregates.

A page is (doc_id, page) unless a caller gives another key; lines have text, conf, x0, y0, x1, y1, line_no; pages have
page_w, page_h. Only the clustering of lines into visual rows carries state that no window expresses (``folds.cluster_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grids
from ..functions import predicates as P
from ..functions.text import clean_leaders, compact, join_lines, trim
from ..store import cut
from . import bands as B
from . import figures, folds

KEY = ["doc_id", "page"]
#: Rows that open a paragraph of their own; entries of a table of contents; its title; lines of a cell that start anew.
LIST_START = r"\A(?:\d{1,2}[.．]\d{1,2}|[a-zA-Z][.、)）]|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]|[•·▪]|[（(]\d{1,2}[)）])"
CONTENTS_ENTRY = r"\A.+?[.。·•．…⋯\-_\s]*\d{1,3}\z"
CONTENTS_TITLES = ["目录", "目錄"]
CELL_START = r"\A(?:\d{1,2}\.|[a-zA-Z][.、)）]|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]|[•·▪]|[（(]\d{1,2}[)）]|(?:场景|条件|情形)[一二三四五六])"
#: Heights of a row that part paragraphs; rows in a table of contents that end it; words of a table that end the look.
PARA_GAP, CONTENTS_MISSES = 1.25, 2
MOST_COLUMNS, MOST_ROWS = 12, 500


def rows_of(lines: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., row, text, x0, y0, x1, y1, h, conf, n: visual rows, their lines joined by spaces in order of x."""
    clustered = folds.cluster_rows(lines, key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])
    return clustered.groupBy(*key, "row").agg(
        trim(F.array_join(parts, " ")).alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.max(F.col("y1") - F.col("y0")).alias("h"),
        F.min("conf").alias("conf"),
        F.count(F.lit(1)).alias("n"),
    )


def paragraphs(rows: DataFrame, pages: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., kind, text, level, x0, y0, x1, y1, confidence: the rows of ``rows_of`` as paragraphs and headings.

    A row opens a paragraph after a gap of 1.25 of its height, if it is a heading or a list item, and after a heading. Under a
    contents title rows that end in a page number, and rows of leaders, stand alone and are no headings; bare page
    numbers go; two other rows end the contents. The title itself is a heading over the page's width.
    """
    w = Window.partitionBy(*key).orderBy("row")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    flat = compact(F.col("text"))
    body = rows.groupBy(*key).agg(F.median("h").alias("body"))
    seen = rows.join(body, key).join(pages.select(*key, "page_w"), key)
    seen = seen.withColumn("_title", flat.isin(CONTENTS_TITLES)).withColumn("_part", F.sum(F.col("_title").cast("int")).over(here))
    entry = flat.rlike(CONTENTS_ENTRY) | P.is_leader(F.col("text"))
    digits = flat.rlike(r"\A\d{1,4}\z")
    listed = F.col("_part") > 0
    seen = seen.withColumn("_miss", (listed & ~F.col("_title") & ~digits & ~entry).cast("int"))
    p = Window.partitionBy(*key, "_part").orderBy("row")
    misses = F.sum("_miss").over(p.rowsBetween(Window.unboundedPreceding, 0))
    # in the contents when the row comes, and after it
    seen = seen.withColumn("_in", listed & (misses - F.col("_miss") < CONTENTS_MISSES)).withColumn("_after", listed & (misses < CONTENTS_MISSES))
    seen = seen.withColumn("_skip", F.col("_title") | (F.col("_in") & digits)).withColumn("_alone", F.col("_in") & ~F.col("_title") & ~digits & entry)
    kind = P.heading_kind(F.col("text"), F.col("h"), F.col("body"), F.lit(1), F.col("x1") - F.col("x0"), F.col("page_w"))
    seen = seen.withColumn("_head", (kind["kind"] == "heading") & ~F.col("_alone"))
    last = lambda c: F.lag(c).over(w)
    apart = F.col("y0") - last("y1") > F.col("h") * PARA_GAP
    opens = F.col("_head") | F.col("_alone") | F.col("text").rlike(LIST_START) | last("row").isNull() | apart
    # five tables are built on these rows and two on those that are kept
    seen = cut(seen.withColumn("_opens", F.coalesce(opens, F.lit(True))), "page-rows")
    # what follows a heading, a line of the contents or their title opens too, bare page numbers in between or not
    kept = seen.filter(~F.col("_skip"))
    closed = F.coalesce(F.lag(F.col("_head") | F.col("_alone")).over(w) | (F.lag("_part").over(w) != F.col("_part")), F.lit(False))
    kept = kept.withColumn("_opens", F.col("_opens") | closed).withColumn("_para", F.sum(F.col("_opens").cast("int")).over(here))
    kept = cut(kept, "page-rows-kept")
    # a paragraph is closed by the row that opens the next, in or out of the contents by then; a title closes it as it was
    titles = seen.filter("_title").select(*key, F.col("row").alias("_t"), F.lag("_after").over(w).alias("_was"))
    ends = kept.groupBy(*key, "_para").agg(
        F.max("row").alias("_last"), F.max_by("_after", "row").alias("_own"), F.max_by("_head", "row").alias("_headed"), F.max_by("_alone", "row").alias("_listed"),
        F.array_sort(F.collect_list(F.struct("row", "text"))).alias("_rows"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.max, "h"), (F.min, "conf"), (F.max, "body"), (F.max, "page_w"))],
    )
    starts = kept.filter("_opens").select(*key, (F.col("_para") - 1).alias("_para"), F.col("row").alias("_next"), F.col("_after").alias("_then"))
    final = seen.groupBy(*key).agg(F.max_by("_after", "row").alias("_final"))
    done = ends.join(starts, [*key, "_para"], "left").join(final, key)
    title = titles.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("row"), F.col("_was").alias("was")))).alias("_titles"))
    done = done.join(title, key, "left")
    between = F.filter("_titles", lambda t: (t["row"] > F.col("_last")) & (F.col("_next").isNull() | (t["row"] < F.col("_next"))))
    contents = F.when(F.col("_headed") | F.col("_listed"), F.col("_own")).when(F.size(between) > 0, F.get(between, F.lit(0))["was"]).otherwise(F.coalesce("_then", "_final"))
    text = clean_leaders(join_lines(F.transform("_rows", lambda s: s["text"])))
    done = done.withColumn("text", text).filter("text <> ''")
    kind = P.heading_kind(F.col("text"), F.col("h"), F.col("body"), F.size("_rows"), F.col("x1") - F.col("x0"), F.col("page_w"))
    none = F.struct(F.lit("para").alias("kind"), F.lit(0).alias("level"))
    done = done.withColumn("_kind", F.when(F.coalesce(contents, F.lit(False)), none).otherwise(kind))
    heads = seen.filter("_title").select(*key, F.lit("heading").alias("kind"), F.lit(CONTENTS_TITLES[0]).alias("text"), F.lit(1).alias("level"), F.lit(0.0).alias("x0"), "y0", F.col("page_w").cast("double").alias("x1"), "y1", F.lit(1.0).alias("confidence"))
    return done.select(*key, F.col("_kind.kind").alias("kind"), "text", F.col("_kind.level").alias("level"), "x0", "y0", "x1", "y1", F.col("conf").alias("confidence")).unionByName(heads)


def join_cell(rows: Column) -> Column:
    """Rows of a cell as one text: items of a list on lines of their own, a space where ASCII meets ASCII."""
    ends = lambda a: F.right(a, F.lit(1)).rlike(r"\A[\x00-\x7F]\z") & ~F.right(a, F.lit(1)).rlike(r"[)]")

    def add(acc: Column, row: Column) -> Column:
        return (
            F.when(acc == "", row)
            .when(row.rlike(CELL_START), F.concat(acc, F.lit("\n"), row))
            .when(ends(acc) & F.left(row, F.lit(1)).rlike(r"\A[\x00-\x7F]\z"), F.concat(acc, F.lit(" "), row))
            .otherwise(F.concat(acc, row))
        )

    return F.aggregate(F.transform(rows, trim), F.lit(""), add)


def table_blocks(lines: DataFrame, regions: DataFrame, header_words: list[str], noise: list[str], key: list[str] = KEY) -> DataFrame:
    """key..., region, kind, rows, confidence, flags, x0, y0, x1, y1 of ruled regions with text in two lines or more.

    regions: region, x0, y0, x1, y1, hy, vx (edges of rows and columns). A line goes to the cell of its centre; the lines of
    a cell stand by row, then x. A grid that still looks drifted (a score of three) is an image to be looked at.
    """
    fits = (F.size("hy") >= 2) & (F.size("vx") >= 2) & (F.size("vx") - 1 <= MOST_COLUMNS) & (F.size("hy") - 1 <= MOST_ROWS)
    r = regions.filter(fits).select(*key, "region", "hy", "vx", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    both = lines.join(r, key).filter(cy.between(F.col("_y0") - 5, F.col("_y1") + 5) & cx.between(F.col("_x0") - 20, F.col("_x1") + 20))
    placed = both.withColumn("_r", G.bucket(cy, F.col("hy"))).withColumn("_c", G.bucket(cx, F.col("vx"))).filter("_r is not null and _c is not null")
    cell = [*key, "region", "_r", "_c"]
    joined = rows_of(placed, cell).groupBy(*cell).agg(
        join_cell(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"])).alias("text"), F.min("conf").alias("conf"), F.sum("n").alias("n")
    )
    cells = joined.groupBy(*key, "region").agg(F.map_from_entries(F.collect_list(F.struct((F.col("_r") * MOST_COLUMNS + F.col("_c")).alias("k"), "text"))).alias("_cells"), F.min("conf").alias("confidence"), F.sum("n").alias("n"))
    full = cells.filter("n >= 2").join(r, [*key, "region"])
    grid = F.transform(F.sequence(F.lit(0), F.size("hy") - 2), lambda i: F.transform(F.sequence(F.lit(0), F.size("vx") - 2), lambda j: F.coalesce(F.element_at("_cells", i * MOST_COLUMNS + j), F.lit(""))))
    cleaned = grids.blank_noise(grids.clean(grid), lambda c: P.is_noise(c, noise) & (compact(c) != ""))
    full = full.withColumn("rows", cleaned).filter(F.size("rows") > 0)
    suspect = grids.suspect_score(F.col("rows"), header_words) >= 3
    flags = F.when(suspect, F.array(F.lit("table_low_confidence"), F.lit("table_fallback"))).otherwise(F.array().cast("array<string>"))
    return full.select(*key, "region", F.when(suspect, "image").otherwise("table").alias("kind"), "rows", "confidence", flags.alias("flags"), *[F.col(f"_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def reread_cells(regions: DataFrame, rows: Column, score: Column, crossed: Column) -> Column:
    """Should the cells of a grid (hy, vx) be recognised one by one? Small grids that are blank, suspect or crossed by lines, or
    narrow columns of many rows."""
    n_rows, n_columns = F.size(regions["hy"]) - 1, F.size(regions["vx"]) - 1
    widths = F.zip_with(F.slice(regions["vx"], 2, F.greatest(n_columns, F.lit(1))), F.slice(regions["vx"], 1, F.greatest(n_columns, F.lit(1))), lambda b, a: b - a)
    narrow = (n_rows >= 4) & (n_columns >= 3) & (F.array_min(widths) < F.greatest(regions["x1"] - regions["x0"], F.lit(1)) * 0.16)
    small = (n_rows * n_columns <= 160) & (n_columns <= 8)
    return small & ((F.size(rows) == 0) | (score >= 2) | crossed | narrow)


def column_edges(regions: DataFrame, verticals: DataFrame, key: list[str] = KEY, reach: float = 6.0) -> DataFrame:
    """``regions`` with vx: their left and right edge and the x of vertical rules (x, y0, y1) that span half of them or more."""
    v = verticals.select(*key, F.col("x").alias("_x"), F.col("y0").alias("_a"), F.col("y1").alias("_b"))
    common = F.least(F.col("_b"), F.col("y1")) - F.greatest(F.col("_a"), F.col("y0"))
    near = regions.join(v, key, "left").filter(F.col("_x").isNull() | ((F.col("_x") > F.col("x0") + reach) & (F.col("_x") < F.col("x1") - reach) & (common >= (F.col("y1") - F.col("y0")) * 0.5)))
    inner = near.groupBy(*key, "region").agg(F.collect_set("_x").alias("_inner"))
    out = regions.join(inner, [*key, "region"], "left")
    return out.withColumn("vx", F.array_sort(F.array_distinct(F.concat(F.array("x0", "x1"), F.coalesce("_inner", F.array().cast("array<double>")))))).drop("_inner")


def near_fallback(blocks: DataFrame, refs: DataFrame, key: list[str] = KEY, reach: float = 2400.0) -> DataFrame:
    """Blocks of a page whose gap to a table that fell back to its picture is within reach."""
    r = refs.select(*key, F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    on = F.greatest(F.col("_y0") - F.col("y1"), F.col("y0") - F.col("_y1"), F.lit(0.0)) <= reach
    for k in key:
        on = on & (blocks[k] == r[k])
    return blocks.join(r, on, "left_semi")


def assemble(lines: DataFrame, pages: DataFrame, rules: DataFrame, verticals: DataFrame, header_words: list[str], noise: list[str], key: list[str] = KEY) -> DataFrame:
    """key..., seq, kind, text, level, rows, x0, y0, x1, y1, confidence, flags: blocks of pages in reading order.

    lines, pages as above; rules (y, x0, x1) and verticals (x, y0, y1) are ruling lines. Header and footer bands go, then
    noise; ruled regions become tables with the lines in them; heights without lines, tables or bands become images;
    what is left becomes paragraphs and headings.
    """
    page = F.to_json(F.struct(*key))
    tall = cut(lines.join(pages, key).withColumn("_doc", page), "lines")
    found = cut(B.anchors(tall, "_doc"), "anchors")
    clear = cut(figures.rules_off_text(rules, lines, key).withColumn("_doc", page), "rules")
    banded = cut(B.bands(tall, found, clear, "_doc"), "bands")
    kept = cut(B.strip(tall, found, banded, "_doc").filter(~P.is_noise(F.col("text"), noise)).select(*lines.columns), "kept-lines")
    regions = cut(column_edges(figures.table_regions(clear.drop("_doc"), key), verticals, key), "regions")
    tables = cut(table_blocks(kept, regions, header_words, noise, key), "tables")
    free = figures.lines_of_tables(kept, tables, key, "left_anti")
    own_bands = banded.join(pages.select(*key, page.alias("_doc")), "_doc").select(*key, "y0", "y1")
    gaps = figures.figure_gaps(lines, regions, own_bands, pages, key)
    paras = cut(paragraphs(cut(rows_of(free, key), "rows"), pages, key), "paragraphs")
    text_rows, flags = F.lit(None).cast("array<array<string>>"), F.array().cast("array<string>")
    columns = [*key, "kind", "text", "level", "rows", "x0", "y0", "x1", "y1", "confidence", "flags"]
    pictures = gaps.join(pages, key).select(*key, F.lit("image").alias("kind"), F.lit("").alias("text"), F.lit(0).alias("level"), text_rows.alias("rows"), F.lit(0.0).alias("x0"), F.col("gap_start").alias("y0"), F.col("page_w").cast("double").alias("x1"), F.col("gap_end").alias("y1"), F.lit(1.0).alias("confidence"), flags.alias("flags"))
    blocks = paras.withColumn("rows", text_rows).withColumn("flags", flags).select(*columns)
    blocks = blocks.unionByName(tables.withColumn("text", F.lit("")).withColumn("level", F.lit(0)).select(*columns)).unionByName(pictures.select(*columns))
    seq = F.row_number().over(Window.partitionBy(*key).orderBy("y0", "x0", "kind", "text")) - 1
    return blocks.withColumn("seq", seq).select(*key, "seq", *columns[len(key) :])
