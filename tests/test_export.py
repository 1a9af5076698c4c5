"""The Markdown sink, the plan over recognised pages and the command line."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import grids
from spanforge.functions.packs import POLICY
from spanforge.operators import layout
from spanforge.sinks import export

BLOCK = "doc_id long, seq int, kind string, text string, level int, rows array<array<string>>, flags array<string>"


@pytest.fixture
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def grid(rows):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows]).cast("array<array<string>>")


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([], False),
        ([["a", "b"], ["1", "2"]], False),
        ([["a"], ["b"]], True),
        ([["x" * 41]], True),
        ([["k", "y" * 81]], True),
        ([list("abcdef"), list("123456")], True),
        ([["a", "b"], ["1\n2", "3"]], True),
        ([["a", "b<BR>c"], ["1", "2"]], True),
        ([["指标定义", "b"], ["1", "z" * 61]], True),
        ([["提报条件", "b"], ["1", "z" * 41]], True),
        ([["一级分类", "检核项目", "内容", "责任承担"], ["1", "2", "3", "4"]], True),
        ([["a", "b", "检核项目"], ["1", "2", "z" * 81]], True),
        ([["a", "b", "释义"], ["1", "2", "z" * 46]], True),
        ([["a", "b", "c"], ["1", "2", "z" * 90]], False),
        ([["a", "b", "c"], ["1", "2", "z" * 141]], True),
        ([["a", "b", "c"], ["", "2", "3"], ["1", "2", "3"]], True),
        ([["a", "b", "c"], ["", "2", "普通场景"]], True),
        ([["a", "b", "c"], ["", "2", "3"]], False),
    ],
)
def test_complex_tables(one, rows, wanted):
    assert one(grids.complex_by_rules(grid(rows), POLICY)) is wanted


def test_native_tables(one):
    flags = F.array(F.lit("native_pdf_table"))
    ask = lambda rows, f=flags: one(grids.native_prefers_pipes(grid(rows), f, POLICY))
    assert ask([list("abcdef"), list("123456")]) and not ask([["a"], ["b"]]) and not ask([["a", "b"]], F.array().cast("array<string>"))
    assert not ask([["一级分类", "检核项目", "内容", "责任承担"]]) and not ask([["a", "b<br>"]]) and not ask([["说明", "骑手" * 30]])


def test_readable_tables(one):
    text = lambda rows: one(grids.readable_table(grid(rows), layout.readable_lines, POLICY))
    assert text([["申诉的规则"], ["第二行"], [""]]) == ["- 申诉的规则", "- 第二行", ""]
    assert text([["内容", "one*"]]) == ["**内容**", "", "one\\*", ""]
    assert text([["项目", "x"], ["k", "v"], ["", ""], ["", "w"]]) == ["**k**", "", "v", "", "w", ""]
    assert text([["a", "b", ""], ["1", "", "3"], ["", "", ""]]) == ["**a / b**", "", "- a：1；列3：3", ""]
    assert text([["a", "数据来源", "c"], ["1", "2", "3"]]) == ["**a / 数据来源 / c**", "", "- a：1", "  数据来源：2", "  c：3", ""]


def rows_of(spark, *blocks):
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(blocks)], BLOCK)


def test_export(spark):
    blocks = rows_of(
        spark,
        ("heading", "Title *x*", 9, None, []),
        ("para", "• first\nplain", 0, None, []),
        ("para", "x = y", 0, None, ["formula_text"]),
        ("para", " \x01z = 1\n", 0, None, ["formula_text"]),
        ("para", "it is computed as 𝑎𝑏", 0, None, []),
        ("table", "", 0, [["a", "b"], ["1", "2|3"]], []),
        ("image", "", 0, [["a", "b"], ["1", "2"]], ["table_fallback"]),
        ("image", "12", 0, None, []),
        ("image", "a caption here", 0, None, []),
        ("image", "复合准时率=SUM(x)/y", 0, None, ["formula"]),
        ("image", None, 0, None, ["auto_image"]),
        ("table", "short", 0, None, []),
    )
    md = export.export(blocks, "doc_id", POLICY, marker="公式原文（需核对）").first().markdown
    assert md == (
        "###### Title \\*x\\*\n\n- first\nplain\n\n```text\nx = y\nz = 1\n```\n\nit is computed as\n\n```text\n𝑎𝑏\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n\n"
        "| a | b |\n| --- | --- |\n| 1 | 2 |\n\na caption here\n\n**公式原文（需核对）**\n\n复合准时率=SUM(x)/y\n"
    )
    assert export.export(rows_of(spark, ("para", None, 0, None, [])), "doc_id").first().markdown == "\n"
    assert export.export(blocks.limit(0)).count() == 0


def test_templates(spark):
    blocks = rows_of(spark, ("image", "复合准时率 = A / B", 0, None, ["formula"]), ("para", "复合准时率 = A / B", 0, None, []))
    md = export.export(blocks, "doc_id", POLICY, [(["复合准时率", "A/B"], "\\frac{A}{B}")]).first().markdown
    assert md == "$$\\frac{A}{B}$$\n\n$$\\frac{A}{B}$$\n"


def test_finish(spark):
    md = "# Contents\n\n1 Scope ... 1\n1.1 Aims ... 2\n2 Terms ... 3\n3 Rules ... 4\n\nbody text\n\n$$x$$\n\n$$x$$\n\nScope begins\n\n2.3 Alone\n\n一句话。备注：后面\n。备\n注：断开\n" + "word " * 60
    done = export.finish(spark.createDataFrame([(1, md)], "doc_id long, markdown string")).first().markdown
    lines = done.split("\n")
    assert lines.count("$$x$$") == 1 and "#### 2.3 Alone" in lines
    assert lines[lines.index("Scope begins") - 1].endswith("1 Scope") and "一句话。" in lines and "备注：后面" in lines and "备注：断开" in lines
    assert max(map(len, lines)) <= 220


def test_recognised_pages(spark):
    from spanforge.plans import recognised

    lines = [(1, 0, 0, "1. Scope", 0.9, 10.0, 10.0, 60.0, 22.0), (1, 0, 1, "text of the page (cid:3)", 0.9, 10.0, 40.0, 90.0, 52.0), (2, 0, 0, "clean words", 0.9, 10.0, 40.0, 90.0, 52.0)]
    lines = spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([(1, 0, 300.0, 100.0), (2, 0, 300.0, 100.0)], "doc_id long, page int, page_w double, page_h double")
    none = spark.createDataFrame([], "doc_id long, page int, y double, x0 double, x1 double")
    edges = spark.createDataFrame([], "doc_id long, page int, x double, y0 double, y1 double")
    done = recognised.convert_lines(lines, sizes, none, edges)
    assert {r.doc_id: r.markdown for r in done.markdown.collect()} == {1: "### 1. Scope\n\ntext of the page (cid:3)\n", 2: "clean words\n"}
    assert sorted((r.doc_id, r.quality_ok, r.n_blocks, r.n_headings) for r in done.summary.collect()) == [(1, False, 2, 1), (2, True, 1, 0)]
    assert done.ledger.groupBy("stage").count().orderBy("stage").collect() == [("assembled", 3), ("ocr_line", 3)]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from spanforge.__main__ import main

    code = main([f"{sf_dir}/pages.parquet", str(tmp_path / "out"), "--json"])
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    failed = spark.read.parquet(str(tmp_path / "out" / "summary")).filter("not quality_ok").count()
    assert capsys.readouterr().out.strip() == f"{n} documents, {failed} of them with blocking issues" and code == int(failed > 0)
    assert spark.read.text(str(tmp_path / "out" / "summary-json")).count() == n and spark.read.parquet(str(tmp_path / "out" / "markdown")).count() > 0
