"""Page images, pictures in the place of text, tables that fell back and captions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import fallback, pixels

BLOCK = "doc_id long, page int, seq int, kind string, text string, level int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double, confidence double, flags array<string>"


def page(width=600, height=500, rules=(), columns=()):
    """A white page with rules (y, x0, x1) and vertical lines (x, y0, y1), two pixels thick."""
    gray = np.full((height, width), 255, np.uint8)
    for y, a, b in rules:
        gray[y : y + 2, a : b + 1] = 0
    for x, a, b in columns:
        gray[a : b + 1, x : x + 2] = 0
    return gray


def images(spark, *grays):
    return spark.createDataFrame([(1, i, g.shape[1], g.shape[0], bytearray(g.tobytes())) for i, g in enumerate(grays)], "doc_id long, page int, width int, height int, gray binary")


def test_runs():
    row = np.zeros(50, bool)
    row[[3, 4, 5, 7, 20, 21]] = True
    assert pixels.longest_run(row) == (4, 3, 7) and pixels.centres(row) == [5, 20] and pixels.longest_run(row[30:]) == (0, 0, 0)
    with pytest.raises(ValueError):
        pixels.as_array(3, 3, b"x")


def test_rules_and_columns():
    gray = page(rules=[(50, 20, 500), (120, 20, 500), (200, 25, 500), (300, 10, 100)], columns=[(20, 50, 201), (250, 50, 201), (499, 50, 201)])
    found = pixels.horizontal_rules(gray)
    assert [(y, a, b) for y, a, b in found] == [(50, 20, 500), (120, 20, 500), (200, 25, 500)]
    assert pixels.column_rules(gray, [50, 120, 200], 20, 500) == [20, 250, 499]
    assert pixels.is_bridged(gray, 50, 120, 20, 500) and not pixels.is_bridged(gray, 210, 290, 20, 500) and pixels.is_bridged(gray, 0, 5, 0, 9)
    assert pixels.has_ink(gray[100:140, 100:200]) and not pixels.has_ink(gray[60:110, 100:200]) and not pixels.has_ink(gray[:5, :5])


def test_regions(spark):
    table = page(height=900, rules=[(50, 20, 500), (180, 20, 500), (250, 20, 500), (700, 20, 500)], columns=[(20, 50, 251), (250, 50, 251), (499, 50, 251)])
    broken = page(height=900, rules=[(50, 20, 500), (120, 20, 500), (520, 20, 500)], columns=[(20, 50, 121), (499, 50, 121), (20, 521, 560)])
    shots = images(spark, table, broken, page())
    rules = pixels.rules(shots)
    assert rules.groupBy("page").count().orderBy("page").collect() == [(0, 4), (1, 3)]
    bands = spark.createDataFrame([(1, 1, 200.0, 400.0)], "doc_id long, page int, y0 double, y1 double")
    anchors = spark.createDataFrame([], "doc_id long, page int, key string")
    line = "doc_id long, page int, text string, y0 double, y1 double"
    quiet = spark.createDataFrame([(1, 1, "12", 420.0, 430.0), (1, 1, "in the band", 300.0, 310.0)], line)
    got = lambda lines: sorted((r.page, r.hy, r.vx) for r in pixels.table_regions(shots, rules, lines, bands, anchors).collect())
    assert got(quiet) == [(0, [50.0, 180.0, 250.0], [20.0, 250.0, 499.0]), (1, [50.0, 120.0, 520.0], [20.0, 499.0])]
    assert got(quiet.union(spark.createDataFrame([(1, 1, "body text", 450.0, 460.0)], line))) == [(0, [50.0, 180.0, 250.0], [20.0, 250.0, 499.0])]
    gaps = spark.createDataFrame([(1, 0, 40.0, 60.0), (1, 0, 300.0, 600.0)], "doc_id long, page int, gap_start double, gap_end double")
    assert [(r.gap_start, r.gap_end) for r in pixels.inked_gaps(shots, gaps).collect()] == [(40.0, 60.0)]


def blocks(spark, *rows):
    return spark.createDataFrame([(1, 0, i, k, t, 0, r, 100.0, y, 300.0, y + 20.0, c, list(f)) for i, (k, t, r, y, c, f) in enumerate(rows)], BLOCK)


def sizes(spark):
    return spark.createDataFrame([(1, 0, 1000.0, 6000.0)], "doc_id long, page int, page_w double, page_h double")


def test_fragments(spark):
    ask = lambda t: spark.range(1).select(fallback.fragment_signal(F.lit(t)).alias("x")).first().x
    assert [ask("100元/次"), ask("标准站系统"), ask("plain"), ask("3. 包括但不限于"), ask("处置 1234")] == [2, 3, 0, 5, 2]


def test_merged_fallbacks(spark):
    fall, grid = ("table_fallback", "table_low_confidence"), [["a", "b"]]
    rows = blocks(
        spark,
        ("image", "", grid, 100.0, 0.9, fall), ("para", "包括但不限于 100元/次", None, 500.0, 0.5, ()), ("image", "", [["c"]], 2000.0, 0.8, fall), ("para", "plain words", None, 2100.0, 0.9, ()),
        ("para", "标准站系统", None, 4000.0, 0.9, ()), ("para", "标准站系统", None, 5000.0, 0.9, ()),
    )
    out = fallback.merge_fallbacks(rows, sizes(spark), []).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.text, r.rows, r.y1, r.flags[-1] if r.flags else "") for r in out] == [
        (0, "image", "a b\n包括但不限于 100元/次\nc", [["a", "b"], ["内容", "包括但不限于 100元/次"], ["c"]], 2020.0, "merged_table_fallback"),
        (3, "para", "plain words", None, 2120.0, ""),
        (4, "image", "标准站系统", [["内容", "标准站系统"]], 4020.0, "fragment_table_fallback"),
        (5, "para", "标准站系统", None, 5020.0, ""),
    ]


def test_pictures_for_text(spark):
    low = ("low_confidence",)
    rows = blocks(
        spark,
        ("para", "good text here", None, 0.0, 0.9, ()), ("para", "bad one here.", None, 100.0, 0.3, low), ("para", "x = 3*y", None, 200.0, 0.2, low), ("para", "A1b", None, 210.0, 0.9, ()), ("para", "good again now", None, 230.0, 0.9, ()),
        ("para", "short bad bit.", None, 300.0, 0.3, low), ("para", "good once more", None, 320.0, 0.9, ()), ("para", "far bad bit.", None, 2000.0, 0.3, low), ("para", "bad but sure", None, 3000.0, 0.5, low),
    )
    out = fallback.pictures_for_text(rows, sizes(spark), []).orderBy("y0").collect()
    assert [(r.kind, r.text, r.y0, r.y1, r.flags) for r in out] == [
        ("para", "good text here", 0.0, 20.0, []), ("image", "bad one here.\nx = 3*y", 92.0, 328.0, ["auto_image", "formula"]), ("para", "good again now", 230.0, 250.0, []), ("para", "good once more", 320.0, 340.0, []),
        ("para", "far bad bit.", 2000.0, 2020.0, list(low)), ("para", "bad but sure", 3000.0, 3020.0, list(low)),
    ]
    assert (out[1].x0, out[1].x1) == (40.0, 360.0)


def test_caption_grids(spark):
    lines = [(1, 0, 0, "Title", 300.0, 400.0), (1, 1, 0, "a", 0.0, 100.0), (1, 1, 1, "b", 400.0, 500.0), (1, 2, 0, "c", 420.0, 520.0), (1, 3, 0, "a wide line over everything", 0.0, 900.0), (1, 4, 0, "d", 10.0, 60.0), (2, 0, 0, "x" * 31, 0.0, 50.0), (2, 1, 0, "y", 0.0, 10.0)]
    out = fallback.caption_grids(spark.createDataFrame(lines, "fig long, row int, place int, text string, x0 double, x1 double"), ["fig"]).orderBy("fig").collect()
    assert [(r.titles, r.rows, r.flat) for r in out] == [(["Title"], [["a", "b"], ["", "c"], ["d", ""]], ["a wide line over everything"]), ([], None, ["x" * 31, "y"])]
