"""What recognition is unsure of: pictures in the place of text, tables that fell back and the fragments about them, captions as grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import formulas as X
from ..functions import grids
from ..functions import predicates as P
from ..functions.packs import EMPTY, Pack
from ..functions.text import compact, trim

KEY = ["doc_id", "page"]
#: Pixels: about a picture of text; how far text that goes into a picture is from it.
PAD_X, PAD_Y, ABSORB = 60.0, 8.0, 160.0
#: Pixels between a table that fell back and the next, and a fragment.
NEXT_TABLE, NEXT_FRAGMENT = 900.0, 1200.0
#: What tells a fragment of a policy table (pattern, weight); what no fragment starts with; scenes and amounts.
SIGNALS = [
    (r"\d+\s*元\s*/(?:站|人|项|次|月|天)", 2),
    (r"场景\s*\d|场景[一二三四五六]|餐箱|消毒|看板|责任承担|承担违约|整改|不达标|虚假", 1),
    (r"标准站系统|基础建设", 3),
    (r"整改不达标|双倍违约金|烟感状态|功能区|配置|卧室|客厅|承担", 2),
    (r"卧室|客厅|站点各功能区|明火|大功率电器|小太阳|电丝炉|禁止存放", 2),
    (r"(?s)烟感状态.*双倍违约金|双倍违约金.*烟感状态", 2),
    (r"包括但不限于", 2),
    (r"\A\d{1,2}[.．]\s*包括但不限于", 3),
]
CLOSING_NUMBER, CLOSING_WORDS, EXAMPLE = r"\d{3,5}\s*\z", r"审核|判定|处置|提交|违约|承担", "案例说明"
SCENE, AMOUNT = r"场景\s*\d|场景[一二三四五六]", r"\d+\s*元\s*/"


def is_fallback(kind: Column, flags: Column) -> Column:
    return F.coalesce((kind == "image") & F.array_contains(flags, "table_fallback"), F.lit(False))


def fragment_signal(text: Column) -> Column:
    """How much a text looks like a piece of a table: the weights of the signals in it, one if it is cut off, two if it closes with a
    number of its case."""
    t = F.coalesce(text, F.lit(""))
    flat = compact(t)
    out = F.when(P.looks_truncated(t), 1).otherwise(0) + F.when(flat.rlike(CLOSING_NUMBER) & flat.rlike(CLOSING_WORDS), 2).otherwise(0)
    for pattern, weight in SIGNALS:
        out = out + F.when(t.rlike(pattern), weight).otherwise(0)
    return out


def is_fragment(kind: Column, text: Column, rows: Column, header_words: list[str]) -> Column:
    """Is a block a piece of a table? Text by its signals, headings and pictures by stronger ones, grids by their score too."""
    has_rows = F.coalesce(F.size(rows), F.lit(0)) > 0
    whole = trim(F.when(has_rows, E.rows_text(rows, " ")).otherwise(F.coalesce(text, F.lit(""))))
    signal, score = fragment_signal(whole), F.when(has_rows, grids.suspect_score(rows, header_words)).otherwise(0)
    by_kind = (
        F.when(kind == "image", (has_rows & ((score >= 2) | (signal >= 2))) | (signal >= 3))
        .when(kind == "table", (score >= 2) | (whole.rlike(SCENE) & whole.rlike(AMOUNT)))
        .when(kind.isin("para", "heading"), signal >= 3)
        .otherwise(F.lit(False))
    )
    return F.coalesce((F.char_length(compact(whole)) >= 4) & ~compact(whole).startswith(EXAMPLE) & by_kind, F.lit(False))


def merge_fallbacks(blocks: DataFrame, pages: DataFrame, header_words: list[str], key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """Tables that fell back, with the fragments that follow them, as one picture over the page's width; and fragments near one, each as
    a picture. Columns of blocks: key, order, kind, text, level, rows, x0, y0, x1, y1, confidence, flags."""
    columns = blocks.columns
    facts = blocks.withColumn("_fall", is_fallback(F.col("kind"), F.col("flags"))).withColumn("_frag", is_fragment(F.col("kind"), F.col("text"), F.col("rows"), header_words))

    def runs(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", order], kind="stable")
        run, n, inside, seen, bottom = [], -1, False, False, 0.0
        for y0, y1, fall, frag in zip(page["y0"], page["y1"], page["_fall"], page["_frag"], strict=True):
            goes_on = inside and ((fall and (seen or y0 - bottom <= NEXT_TABLE)) or (not fall and frag and y0 - bottom <= NEXT_FRAGMENT))
            if not goes_on:
                n, inside, seen = n + 1, bool(fall), False
            seen, bottom = seen or (goes_on and not fall), y1
            run.append(n)
        return page.assign(_run=run)[[*key, order, "_run"]]

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*key, order]) + ", _run int"
    numbered = facts.select(*key, order, "y0", "y1", "_fall", "_frag").groupBy(*key).applyInPandas(runs, schema)
    both = facts.join(numbered, [*key, order])
    w = Window.partitionBy(*key, "_run")
    both = both.withColumn("_many", (F.max(F.col("_fall").cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) > 1) & (F.max((~F.col("_fall")).cast("int")).over(w) == 1))
    none = F.array().cast("array<array<string>>")
    own_rows = F.when(F.coalesce(F.size("rows"), F.lit(0)) > 0, F.col("rows")).when(F.coalesce("text", F.lit("")) != "", F.array(F.array(F.lit("内容"), F.col("text")))).otherwise(none)
    own_text = trim(F.when(F.coalesce(F.size("rows"), F.lit(0)) > 0, E.rows_text(F.col("rows"), " ")).otherwise(F.coalesce("text", F.lit(""))))
    place = F.struct("y0", order)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), c.alias("v")))), lambda s: s["v"])
    merged = both.filter("_many").groupBy(*key, "_run").agg(
        F.min_by(order, place).alias(order), F.array_join(F.filter(ordered(own_text), lambda t: t != ""), "\n").alias("text"), F.flatten(ordered(own_rows)).alias("rows"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"),
    )
    flags = lambda *names: F.array(*[F.lit(n) for n in ("table_low_confidence", "table_fallback", *names)])
    wide = pages.select(*key, F.col("page_w").cast("double").alias("_w"))
    picture = lambda df, mark: df.join(wide, key).withColumns({"kind": F.lit("image"), "level": F.lit(0), "flags": flags(mark), "x0": F.lit(0.0), "x1": F.col("_w")}).select(*columns)
    whole = picture(merged.withColumn("rows", F.when(F.size("rows") > 0, F.col("rows"))), "merged_table_fallback")
    rest = both.filter(~F.col("_many"))
    refs = rest.filter("_fall").select(*key, "y0", "y1").unionByName(whole.select(*key, "y0", "y1"))
    from .pages import near_fallback

    loose = near_fallback(rest.filter(F.col("_frag") & ~F.col("_fall")), refs, key)
    single = picture(loose.withColumn("text", own_text).withColumn("rows", F.when(F.size(own_rows) > 0, own_rows)).drop("kind", "level", "flags", "x0", "x1"), "fragment_table_fallback")
    stay = rest.join(loose.select(*key, order), [*key, order], "left_anti").select(*columns)
    return stay.unionByName(whole).unionByName(single)


def pictures_for_text(blocks: DataFrame, pages: DataFrame, noise: list[str], pack: Pack = EMPTY, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """Runs of bad blocks as pictures of their place, residue without any text dropped, and bad blocks near a picture taken into it.

    Bad: text of confidence 0.35 or less that is flagged. A run stays text if it goes on a table or is a sum in words; a single
    block if it reads as text. A picture of mathematics is flagged formula. Columns as for ``merge_fallbacks``.
    """
    columns = blocks.columns
    text = F.coalesce("text", F.lit(""))
    rows = blocks.filter(~(F.col("kind").isin("para", "heading") & X.pure_noise(F.col("text"), noise, pack)))
    bad = F.col("kind").isin("para", "heading") & (F.col("confidence") <= 0.35) & F.arrays_overlap("flags", F.array(F.lit("low_confidence"), F.lit("garbled")))
    w = Window.partitionBy(*key).orderBy("y0", order)
    marked = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    marked = marked.withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.max("y1").over(Window.partitionBy(*key, "_run").orderBy("y0", order).rowsBetween(Window.unboundedPreceding, -1))
    held = marked.filter("_bad").withColumn("_new", (F.coalesce(F.col("y0") - below, F.lit(0.0)) > 250).cast("int"))
    held = held.withColumn("_g", F.sum("_new").over(Window.partitionBy(*key, "_run").orderBy("y0", order).rowsBetween(Window.unboundedPreceding, 0)))
    group = [*key, "_run", "_g"]
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("y0", order, text.alias("t")))), lambda s: s["t"]), lambda t: t != ""), "\n")
    facts = held.groupBy(*group).agg(
        joined.alias("_text"), F.count(F.lit(1)).alias("_n"), F.bool_or(text.rlike(X.MATH_SIGN)).alias("_math"), F.min("confidence").alias("_conf"), F.min_by(order, F.struct("y0", order)).alias("_first"),
        *[f(c).alias(f"_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    t = F.col("_text")
    table = X.table_continuation(t, pack)
    shown = ~table & ~X.multiline_text_formula(t) & ((F.col("_n") > 1) | X.image_rather_than_text(t, F.col("_conf"), noise, pack))
    chosen = facts.filter(shown).join(pages.select(*key, "page_w", "page_h"), key)
    images = chosen.select(
        *group, F.col("_first").alias(order), F.lit("image").alias("kind"), t.alias("text"), F.lit(0).alias("level"), F.lit(None).cast("array<array<string>>").alias("rows"),
        F.greatest(F.col("_x0") - PAD_X, F.lit(0.0)).alias("x0"), F.greatest(F.col("_y0") - PAD_Y, F.lit(0.0)).alias("y0"), F.least(F.col("_x1") + PAD_X, F.col("page_w")).alias("x1"), F.least(F.col("_y1") + PAD_Y, F.col("page_h")).alias("y1"),
        F.lit(1.0).alias("confidence"), F.when(F.col("_math") & ~table, F.array(F.lit("auto_image"), F.lit("formula"))).otherwise(F.array(F.lit("auto_image"))).alias("flags"),
    )
    rest = marked.filter(~F.col("_bad")).select(*columns).unionByName(held.join(images.select(*group), group, "left_anti").select(*columns))
    return _absorb(rest.unionByName(images.select(*columns)), pages, key, order)


def _absorb(blocks: DataFrame, pages: DataFrame, key: list[str], order: str) -> DataFrame:
    """Bad blocks within reach of a picture of text go; the picture grows over them, the first in reach, from top to bottom."""
    bad = F.col("kind").isin("para", "heading") & (F.col("confidence") <= 0.35) & F.arrays_overlap("flags", F.array(F.lit("low_confidence"), F.lit("garbled")))
    role = F.when(F.coalesce(bad, F.lit(False)), 1).when((F.col("kind") == "image") & F.array_contains("flags", "auto_image"), 2).otherwise(0)
    facts = blocks.select(*key, order, "x0", "y0", "x1", "y1", role.alias("_role")).filter("_role > 0").join(pages.select(*key, F.col("page_w").cast("double").alias("_w")), key)

    def grow(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", order], kind="stable").reset_index(drop=True)
        images = np.flatnonzero(page["_role"] == 2)
        box = page[["x0", "y0", "x1", "y1"]].to_numpy(float)
        gone = np.zeros(len(page), bool)
        for i in np.flatnonzero(page["_role"] == 1):
            near = images[(box[i, 1] < box[images, 3] + ABSORB) & (box[i, 3] > box[images, 1] - ABSORB)]
            if len(near):
                k, gone[i] = near[0], True
                box[k] = [max(0.0, min(box[k, 0], box[i, 0] - PAD_X)), min(box[k, 1], box[i, 1] - PAD_Y), min(page["_w"].iloc[0], max(box[k, 2], box[i, 2] + PAD_X)), max(box[k, 3], box[i, 3] + PAD_Y)]
        out = page[[*key, order, "_role"]].copy()
        out[["_x0", "_y0", "_x1", "_y1"]] = box
        out["_gone"] = gone
        return out

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*key, order]) + ", _role int, _x0 double, _y0 double, _x1 double, _y1 double, _gone boolean"
    changed = facts.groupBy(*key).applyInPandas(grow, schema)
    both = blocks.withColumn("_role", role).join(changed, [*key, order, "_role"], "left").filter(~F.coalesce("_gone", F.lit(False)))
    return both.withColumns({c: F.when(F.col("_role") == 2, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")}).select(*blocks.columns)


def caption_grids(rows: DataFrame, key: list[str]) -> DataFrame:
    """key..., titles, rows, flat: the labels of a figure as titles, a grid of columns, and what spans them.

    rows: lines with row and place (``folds.cluster_rows``), text, x0, x1. Single short lines at the top are titles; segments
    above 0.6 of the width are flat; the others stand in columns by overlap (two to six of them), else everything is flat.
    """

    def shape(figure: pd.DataFrame) -> pd.DataFrame:
        figure = figure.sort_values(["row", "place"], kind="stable")
        width = max(1.0, figure["x1"].max() - figure["x0"].min())
        held = [list(zip(g["text"].str.strip(), g["x0"], g["x1"], strict=True)) for _, g in figure.groupby("row", sort=True)]
        n = next((i for i, r in enumerate(held) if len(r) > 1 or len(r[0][0]) > 30), len(held))
        titles, held = [r[0][0] for r in held[:n]], held[n:]
        wide = lambda s: s[2] - s[1] > 0.6 * width
        columns: list[list[float]] = []
        for _, a, b in sorted((s for r in held for s in r if not wide(s)), key=lambda s: s[1]):
            fits = next((c for c in columns if min(c[1], b) - max(c[0], a) > 0.3 * min(c[1] - c[0], b - a)), None)
            if fits:
                fits[:] = [min(fits[0], a), max(fits[1], b)]
            else:
                columns.append([a, b])
        columns.sort()
        lines = [" ".join(s[0] for s in r) for r in held]
        grid, flat = [], [s[0] for r in held for s in r if wide(s)]
        if 2 <= len(columns) <= 6:
            edges = np.array(columns)
            for r in held:
                cells = [""] * len(columns)
                for text, a, b in (s for s in r if not wide(s)):
                    k = int(np.argmax(np.maximum(np.minimum(edges[:, 1], b) - np.maximum(edges[:, 0], a), 0)))
                    cells[k] = f"{cells[k]} {text}".strip()
                if any(cells):
                    grid.append(cells)
            kept = [j for j in range(len(columns)) if any(r[j] for r in grid)]
            grid = [[r[j] for j in kept] for r in grid] if len(kept) >= 2 else []
        if not grid and columns:
            flat = lines
        return pd.DataFrame([{**{k: figure[k].iloc[0] for k in key}, "titles": titles, "rows": grid or None, "flat": flat}])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*key, "row", "place", "text", "x0", "x1").groupBy(*key).applyInPandas(shape, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", titles array<string>, rows array<array<string>>, flat array<string>")


__all__ = ["caption_grids", "fragment_signal", "is_fallback", "is_fragment", "merge_fallbacks", "pictures_for_text"]
