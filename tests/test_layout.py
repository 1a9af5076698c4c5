from pyspark.sql import functions as F

from spanforge.operators import figures, layout


def lines_of(spark, text):
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(text.split("\n"))], "d string, line_no int, line string")


def texts(df, *order):
    return [r.line for r in df.orderBy(*order).collect()]


def test_readable_lines(spark):
    out = spark.range(1).select(layout.readable_lines(F.lit("One. Note: two<br>" + "word " * 50), 60).alias("x")).first().x
    assert out[:2] == ["One.", "Note: two"] and all(len(x) <= 60 for x in out) and len(out) == 7


def test_wrap_long_leaves_code_and_tables(spark):
    long = "word " * 60
    df = lines_of(spark, f"{long}\n```\n{long}\n```\n| {long}|\n$$\n{long}\n$$")
    out = layout.wrap_long(df, "d").groupBy("line_no").count().orderBy("line_no").collect()
    assert [r["count"] for r in out] == [2, 1, 1, 1, 1, 1, 1, 1]


def test_restore_headings(spark):
    assert texts(layout.restore_headings(lines_of(spark, "a\n\n1.2 Scope\n\n1.3 Text,\n\nb\n1.4 C\n"), "d"), "line_no")[2] == "#### 1.2 Scope"
    assert texts(layout.restore_headings(lines_of(spark, "a\n1.2 Scope\n"), "d"), "line_no")[1] == "1.2 Scope"


def test_contents(spark):
    df = lines_of(spark, "Front\n# Contents\n\n1. One\n- 1.1 Two\n\nBody starts\n1. One")
    assert [r.part for r in layout.contents_and_body(df, "d").orderBy("line_no").collect()] == ["front", "contents", "contents", "contents", "contents", "contents", "body", "body"]
    entries = F.array(F.struct(F.lit("1").alias("token"), F.lit("A").alias("title"), F.lit("3").alias("page")), F.struct(F.lit("1.1").alias("token"), F.lit("B").alias("title"), F.lit("").alias("page")))
    assert spark.range(1).select(layout.nested_contents(entries).alias("x")).first().x == ["- 1 A 3", "  - 1.1 B"]


def test_missing_body_headings(spark):
    entries = spark.createDataFrame([("d", i, f"1.{i}", t) for i, t in enumerate(["Alpha one", "Beta two", "Gamma three", "Delta four"])], "d string, seq int, token string, title string")
    body = lines_of(spark, "### 1.0 Alpha one\ntext\nabout Beta two here\nGamma three\nnothing")
    assert texts(layout.missing_body_headings(entries, body, "d"), "line_no") == ["### 1.1 Beta two", "### 1.2 Gamma three"]


def test_formulas(spark):
    got = spark.range(1).select(layout.formula_latex(F.lit("rate = done / all"), [(["rate", "lost"], "no"), (["rate", "done", "all"], r"\frac{done}{all}")]).alias("x")).first().x
    assert got == r"\frac{done}{all}"
    df = lines_of(spark, "# A\n$$\\frac{a}{b}$$\nfrag a\n# B\nfrag b\nfrag b")
    assert texts(layout.drop_covered_fragments(df, "d", F.col("line").startswith("frag")), "line_no") == ["# A", "$$\\frac{a}{b}$$", "# B", "frag b", "frag b"]
    assert len(texts(layout.first_of_section(df, "d", F.col("line").startswith("frag")), "line_no")) == 5


def test_records(spark):
    df = lines_of(spark, "- class: A\n  item: one\n  more of it\nother\n  stray: x\n- class: B\n  item: two")
    out = layout.records(df, "d", "- class").orderBy("record").collect()
    assert [r.fields for r in out] == [{"class": "A", "item": "one more of it"}, {"class": "B", "item": "two"}]


def test_tables_and_figures(spark):
    rules = spark.createDataFrame([("p", y, 0.0, 100.0) for y in (10.0, 60.0, 110.0)] + [("p", 500.0, 0.0, 100.0)], "k string, y double, x0 double, x1 double")
    lines = spark.createDataFrame([("p", 1, 5.0, 20.0, 50.0, 40.0), ("p", 2, 5.0, 490.0, 50.0, 510.0), ("p", 3, 5.0, 700.0, 50.0, 720.0)], "k string, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert figures.rules_off_text(rules, lines, ["k"]).count() == 3
    regions = figures.table_regions(rules, ["k"])
    assert [(r.y0, r.y1, r.hy) for r in regions.collect()] == [(10.0, 110.0, [10.0, 60.0, 110.0])]
    assert [r.line_no for r in figures.lines_of_tables(lines, regions, ["k"]).collect()] == [1]
    pages = spark.createDataFrame([("p", 1000.0)], "k string, page_h double")
    gaps = figures.figure_gaps(lines, regions, lines.limit(0), pages, ["k"])
    assert [(r.gap_start, r.gap_end) for r in gaps.orderBy("gap_start").collect()] == [(110.0, 482.0), (518.0, 692.0), (728.0, 1000.0)]
    captions = spark.createDataFrame([("p", 1, 480.0, 1000.0)], "k string, caption int, y0 double, page_h double")
    assert figures.caption_figures(captions, gaps.select("k", F.lit(0.0).alias("x0"), F.col("gap_start").alias("y0"), F.lit(9.0).alias("x1"), (F.col("gap_end") - 10).alias("y1")), ["k"]).count() == 0
    merged = figures.merge_regions(spark.createDataFrame([("p", 0.0, 10.0), ("p", 100.0, 110.0), ("p", 200.0, 210.0)], "k string, y0 double, y1 double"), spark.createDataFrame([("p", 150.0)], "k string, y double"), ["k"])
    assert [(r.y0, r.y1, r.n) for r in merged.orderBy("y0").collect()] == [(0.0, 110.0, 2), (200.0, 210.0, 1)]


def test_rereading(spark):
    kinds = {7: "table"}
    old = {1: ("abc", 0.3), 2: ("abcd", 0.3), 3: ("abc", 0.3), 4: ("abc", 0.3), 5: ("abcdef", 0.1), 6: ("Scope ... 7", 0.2), 7: ("abc", 0.1), 8: ("abc", 0.5), 9: ("abc", 0.3), 10: ("abc", 0.2)}
    new = {1: ("a bc", 0.4), 2: ("xyz", 0.6), 3: ("q", 0.32), 5: ("vwxyz", 0.3), 6: ("other", 0.21), 7: ("xyz", 0.9), 8: ("xyz", 0.9), 9: ("xyzmark", 0.9), 10: ("xyz", 0.35)}
    blocks = spark.createDataFrame([(i, kinds.get(i, "para"), *v) for i, v in old.items()], "i int, kind string, text string, confidence double").withColumn("flags", F.array().cast("array<string>"))
    second = spark.createDataFrame([(i, *v) for i, v in new.items()], "i int, text string, confidence double")
    clean = lambda c: c.rlike(r"\d\z")
    out = figures.accept_rereading(blocks, second, ["i"], clean=clean, watermark=lambda c: c.rlike("mark")).orderBy("i").collect()
    low = ["low_confidence"]
    assert [(r.text, r.confidence, r.flags) for r in out] == [
        ("abc", 0.45, []),  # agrees
        ("xyz", 0.6, []),  # surer
        ("abc", 0.3, low),  # no surer
        ("abc", 0.3, low),  # no second reading
        ("vwxyz", 0.3, low),  # surer, yet below the threshold
        ("Scope ... 7", 0.45, []),  # unsure but clean
        ("abc", 0.1, []),  # a table
        ("abc", 0.5, []),  # above the threshold
        ("abc", 0.3, low),  # a watermark in the second reading
        ("abc", 0.2, low),  # surer by the gain, not more
    ]


def test_a_page_without_lines_is_one_gap(spark):
    nothing = spark.createDataFrame([], "p int, y0 double, y1 double")
    lines = spark.createDataFrame([(1, 200.0, 220.0)], "p int, y0 double, y1 double")
    pages = spark.createDataFrame([(1, 400.0), (2, 500.0)], "p int, page_h double")
    out = figures.figure_gaps(lines, nothing, nothing, pages, ["p"]).collect()
    assert sorted((r.p, r.gap_start, r.gap_end) for r in out) == [(1, 0.0, 192.0), (1, 228.0, 400.0), (2, 0.0, 500.0)]
