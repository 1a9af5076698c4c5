from pyspark.sql import functions as F

from spanforge.functions import predicates as P
from spanforge.operators import bands, blocks, coverage, folds, intervals, lines, rules, sequences, vote
from spanforge.sinks import markdown
from spanforge.sources.pages import html_blocks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_repeated_needs_pages_share_and_height(spark):
    data = [("d", p, 10.0, f"Header {p}") for p in range(5)] + [("d", p, 100.0 * p, "wanders") for p in range(5)] + [("d", 0, 50.0, "once"), ("e", 0, 1.0, "Header 1"), ("e", 1, 1.0, "Header 2")]
    found = lines.repeated_keys(spark.createDataFrame(data, "doc string, page int, y double, text string"), "doc", "page", F.col("y"), F.col("text"))
    assert rows(found, "key") == [("d", "Header#", 5, 5, 5)]


def test_suppression_order(spark):
    df = spark.createDataFrame([(1, True, True, False), (2, True, False, True), (3, False, False, True), (4, False, False, False)], "i int, repeated boolean, margin boolean, rotated boolean")
    no = F.lit(False)
    out = lines.suppression(df, no, no, F.col("repeated"), F.col("margin"), F.col("rotated"), no, F.lit(2), F.lit("x"))
    assert [(r.dropped, r.counted) for r in out.orderBy("i").collect()] == [("header_footer", False), ("watermark", True), ("watermark", True), (None, False)]


def test_bands_of_a_tall_page(spark):
    data = [("d", i, "Company report", 0.9, 10.0, 1000.0 * k, 100.0, 1000.0 * k + 30) for i, k in enumerate((0, 1, 3, 4))]
    data += [("d", 10, "body text stands here and is long", 0.9, 10.0, 1500.0, 400.0, 1530.0), ("d", 11, "7", 0.9, 10.0, 1040.0, 20.0, 1060.0)]
    df = spark.createDataFrame(data, "doc_id string, line_no int, text string, conf double, x0 double, y0 double, x1 double, y1 double").withColumn("page_h", F.lit(5000.0))
    found = bands.anchors(df)
    assert [(r.key, r.n, r.period) for r in found.collect()] == [("Companyreport", 4, 1000.0)]
    merged = bands.bands(df, found)
    assert [(r.y0, r.y1) for r in merged.orderBy("y0").collect()] == [(-55.0, 85.0), (945.0, 1085.0), (1945.0, 2085.0), (2945.0, 3085.0), (3945.0, 4085.0)]
    assert [r.line_no for r in bands.strip(df, found, merged).collect()] == [10]
    ruled = bands.bands(df, found, spark.createDataFrame([("d", 1040.0)], "doc_id string, y double"))
    assert (945.0, 1037.0) in [(r.y0, r.y1) for r in ruled.collect()]


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0.0, 5.0), ("k", 5.0, 8.0), ("k", 20.0, 21.0), ("j", 1.0, 2.0)], "key string, a double, b double")
    merged = intervals.merge(df, ["key"], "a", "b")
    assert rows(merged, "key", "a") == [("j", 1.0, 2.0, 1), ("k", 0.0, 8.0, 2), ("k", 20.0, 21.0, 1)]
    gaps = intervals.uncovered(merged, ["key"], "a", "b", F.lit(0.0), F.lit(30.0), 5.0)
    assert rows(gaps, "key", "gap_start") == [("j", 2.0, 30.0), ("k", 8.0, 20.0), ("k", 21.0, 30.0)]
    tiles = intervals.tiles(spark.createDataFrame([(1, 4000)], "page int, height int"))
    own = [(r.own0, r.own1) for r in tiles.orderBy("tile").collect()]
    assert own[0][0] == 0 and own[-1][1] == 4000 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    share = intervals.covered_share(spark.createDataFrame([(1, "k", 4.0, 24.0)], "id int, key string, y0 double, y1 double"), merged.withColumnsRenamed({"a": "b0", "b": "b1"}), ["key"], "id", "y0", "y1", "b0", "b1")
    assert rows(share, "id") == [(1, 0.25)]


def test_sequences(spark):
    df = spark.createDataFrame([(1, "# A", None), (2, "x", "p"), (3, "# B", None), (4, "y", None), (5, "z", "q")], "i int, t string, v string").withColumn("d", F.lit("d"))
    numbered = sequences.sections(df, ["d"], "i", F.col("t").startswith("#"))
    assert [r.text for r in sequences.section_text(numbered, ["d"], "i", "t").orderBy("section").collect()] == ["# A\nx", "# B\ny\nz"]
    filled = sequences.fill_both(df, ["d"], ["i"], ["v"], F.lit(True))
    assert [r.v for r in filled.orderBy("i").collect()] == ["p", "p", "p", "p", "q"]
    cut = sequences.slice_between(df, ["d"], "i", F.col("t") == "x", F.col("t") == "z")
    assert [r.i for r in cut.orderBy("i").collect()] == [2, 3, 4]
    near = df.withColumn("n", sequences.nearest(df, ["d"], "i", "t", ~F.col("t").startswith("#")))
    assert [r.n for r in near.orderBy("i").collect()] == ["x", "y", "y", "z", None]
    after = df.withColumn("n", sequences.next_index(["d"], "i", F.col("t").startswith("#"), F.lit(6)))
    assert [r.n for r in after.orderBy("i").collect()] == [3, 3, 6, 6, 6]
    gaps = sequences.numbering_gaps(spark.createDataFrame([("1", 1), ("1", 4), ("2", 1), ("2", 2)], "p string, c int"), "p", "c")
    assert rows(gaps, "missing") == [("1", 2), ("1", 3)]
    sample = sequences.wrap_sample(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", 4, 2)
    assert [r.k for r in sample.orderBy("pick").collect()] == ["c", "a", "b"]
    assert sequences.wrap_sample(df.limit(0), "i", 3, 1).count() == 0


def test_vote(spark):
    data = [("s", 1, "xoy " * 9), ("s", 2, "x0y"), ("s", 3, "q0z q0z q0z")]
    df = spark.createDataFrame(data, "s string, d int, text string")
    found = vote.votes(df, "s", "d", [("0", "o")])
    assert rows(found, "d", "pos") == [(2, 2, "0", "o")]
    assert {r.d: r.text for r in vote.corrected(df, found, "d").collect()}[2] == "xoy"


def test_row_clusters_follow_the_running_mean(spark):
    data = [(1, i, 0.0 + i, y, 10.0 + i, y + 10.0) for i, y in enumerate((0.0, 5.0, 9.0, 30.0, 31.0))]
    df = spark.createDataFrame(data, "p int, line_no int, x0 double, y0 double, x1 double, y1 double")
    out = {r.line_no: (r.row, r.place) for r in folds.cluster_rows(df, ["p"]).collect()}
    assert out == {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (2, 0), 4: (2, 1)}


def test_rect_components_and_regions(spark):
    data = [(1, 10.0 * i, 0.0, 10.0 * i + 5, 5.0) for i in range(9)] + [(1, 500.0, 500.0, 510.0, 510.0)]
    df = spark.createDataFrame(data, "p int, x0 double, y0 double, x1 double, y1 double")
    assert rows(folds.rect_components(df, ["p"]), "x0") == [(1, 0.0, 0.0, 85.0, 5.0, 9)]
    nested = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (1, 1.0, 1.0, 50.0, 50.0), (1, 90.0, 90.0, 200.0, 200.0)], "p int, x0 double, y0 double, x1 double, y1 double")
    assert len(folds.distinct_regions(nested, ["p"]).collect()) == 2


def test_word_grid(spark):
    words = [(1, 0, "a", 0.0, 0.0, 5.0, 10.0), (1, 1, "b", 6.0, 1.0, 9.0, 11.0), (1, 2, "c", 50.0, 0.0, 55.0, 10.0), (1, 3, "d", 50.0, 30.0, 55.0, 40.0)]
    out = folds.word_grid(spark.createDataFrame(words, "t int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"), ["t"], [0.0, 40.0, 80.0])
    assert [(r.row, r.cells) for r in out.orderBy("row").collect()] == [(0, ["ab", "c"]), (1, ["", "d"])]


def test_spans_to_blocks(spark):
    data = [(1, 0, 0, "1. Title", 14.0, True, 0.0, 0.0, 90.0, 14.0), (1, 0, 1, "The text goes", 10.0, False, 0.0, 30.0, 90.0, 40.0), (1, 0, 2, "on and ends.", 10.0, False, 0.0, 41.0, 90.0, 51.0), (1, 0, 3, "Next one.", 10.0, False, 0.0, 80.0, 90.0, 90.0)]
    df = spark.createDataFrame(data, "doc_id int, page int, line_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    out = blocks.spans_to_blocks(df).orderBy("seq").collect()
    assert [(r.kind, r.level, r.text) for r in out] == [("heading", 2, "1. Title"), ("para", 0, "The text goes on and ends."), ("para", 0, "Next one.")]


def test_low_confidence_groups(spark):
    data = [(i, "para", t, y, y + 10.0, c, ["low_confidence"] if c < 0.4 else []) for i, (t, y, c) in enumerate([("a", 0.0, 0.1), ("b", 259.0, 0.1), ("c", 520.0, 0.1), ("good", 540.0, 0.9), ("d", 560.0, 0.2)])]
    df = spark.createDataFrame(data, "seq int, kind string, text string, y0 double, y1 double, confidence double, flags array<string>").withColumn("doc_id", F.lit(1)).withColumn("page", F.lit(0))
    assert [(r.n, r.text) for r in blocks.low_confidence_groups(df).orderBy("first_seq").collect()] == [(2, "a\nb"), (1, "c"), (1, "d")]


def test_markdown_and_trailing_headings(spark):
    df = spark.createDataFrame([(1, 0, "heading", "A*", 2), (1, 1, "para", "First part ends. 1.2 Next Heading", 0), (1, 2, "item", "x", 0)], "d int, seq int, kind string, text string, level int")
    split = blocks.split_trailing_headings(df).withColumn("at", F.struct("seq", "part"))
    assert markdown.render(split, "d", "at").first().markdown == "## A\\*\n\nFirst part ends.\n\n### 1.2 Next Heading\n\n- x"


def test_html_blocks(spark):
    html = "<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li>home</li></ul></nav><h1>A &amp; B</h1><p>one <b>two</b><p>three<br>four</p><ul><li>i</li></ul><script>var x='<p>no</p>'</script><footer><p>end</p></footer></body></html>"
    out = html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("seq").collect()
    assert [(r.kind, r.area, r.text) for r in out] == [("item", "nav", "home"), ("heading", "body", "A & B"), ("para", "body", "one two"), ("para", "body", "three\nfour"), ("item", "body", "i"), ("para", "footer", "end")]


def test_coverage(spark):
    source = spark.createDataFrame([("d", "1.1", "Scope", "Scope 150 250 350 450 rate≥5", 0), ("d", "1.2", "Gone", "Gone text", 1)], "d string, token string, title string, text string, first int")
    output = spark.createDataFrame([("d", "1.1", "Scope rate>=5")], "d string, token string, text string")
    found = coverage.section_issues(source, output, ["d"], ["Scope"], ["rate≥5"])
    assert sorted((r.token, r.check, r.detail) for r in found.collect()) == [("1.1", "numbers", "150, 250, 350, 450"), ("1.2", "section_missing", "Gone")]
    gate = coverage.quality_gate(spark.createDataFrame([("d",), ("e",)], "d string"), found, "d", ["section_missing"])
    assert rows(gate, "d") == [("d", 1, 1, False), ("e", 0, 0, True)]
    regions = spark.createDataFrame([("d", 0, ["alpha", "beta"]), ("d", 1, ["gamma"])], "d string, idx int, anchors array<string>")
    md = spark.createDataFrame([("d", "al pha and gamma")], "d string, markdown string")
    assert [(r.idx, r.missing) for r in coverage.region_issues(regions, md, "d", F.lit(True), F.col("anchors")).collect()] == [(0, ["beta"])]


def test_rules(spark):
    df = spark.createDataFrame([(1, 0, "para", "the Trigger here", 0), (1, 1, "para", "rest", 0)], "doc_id int, seq int, kind string, text string, level int")
    pack = spark.createDataFrame([("Trigger", "Needed", "para", "Needed text", 0), ("Trigger", "rest", "para", "never", 0)], "trigger string, required string, kind string, text string, level int")
    out = rules.insert_missing(df, pack).orderBy("seq", "part").collect()
    assert [(r.text, r.origin) for r in out] == [("the Trigger here", "read"), ("Needed text", "injected"), ("rest", "read")]
    assert rows(rules.notes(df.withColumn("text", F.lit("a   b    c")), "doc_id", "text"), "note") == [(1, "spaces", 4)]


def test_heading_kind(spark):
    df = spark.createDataFrame([("第一章 总则", 10.0), ("2.1 Scope", 10.0), ("big", 20.0), ("plain text here, which goes on.", 10.0)], "t string, h double")
    out = df.select("t", P.heading_kind(F.col("t"), F.col("h"), F.lit(10.0), F.lit(1), F.lit(100.0), F.lit(500.0)).alias("k")).collect()
    assert [(r.k.kind, r.k.level) for r in out] == [("heading", 1), ("heading", 4), ("heading", 1), ("para", 0)]


def test_stream(spark, sf_dir, tmp_path):
    import shutil

    from spanforge.streaming import ingest

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/pages.parquet", tmp_path / "in" / "a.parquet")
    query = ingest.write(ingest.page_blocks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
