import pytest
from pyspark.sql import functions as F

from spanforge.functions import geometry as G
from spanforge.functions import formulas, grids, packs, predicates, text


@pytest.fixture
def one(spark):
    def run(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return run


def rows_of(data):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in data])


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (text.trim, "　 a b \n", "a b"),
        (text.compact, " a　b\tc ", "abc"),
        (text.fuzzy, "页眉-12 A.b", "页眉12Ab"),
        (text.repeat_key, "Page 12 of 300", "Page#of#"),
        (text.clean_leaders, "1. Scope ........ 12", "1. Scope　12"),
        (text.clean_leaders, "Scope .....", "Scope"),
        (text.strip_controls, "a\x00b\tc\x1f", "ab\tc"),
        (text.join_hyphenated, "docu- ment and Co- Op", "document and Co- Op"),
        (text.numbering, "1.2.3. Title", "1.2.3"),
        (text.numbering, "Title 1", ""),
        (text.md_escape, "a*b_[c]", r"a\*b\_\[c\]"),
        (text.md_cell, "a\nb|c", r"a；b\|c"),
        (text.repair_recognised, "3. 5 and 1O%", "3.5 and 10%"),
    ],
)
def test_text(one, function, given, wanted):
    assert one(function(F.lit(given))) == wanted


def test_heading_levels(one):
    assert [one(text.heading_level(F.lit(x), 3)) for x in ("1. A", "1.1 A", "1.1.1 A", "1.1.1.1.1 A", "A")] == [2, 3, 4, 6, 3]


def test_join_lines(one):
    assert one(text.join_lines(F.array(F.lit("the end"), F.lit("of it"), F.lit("中"), F.lit("文")))) == "the end of it中文"


def test_missing_numbers(one):
    source, target = F.lit("12 items, 150 pages, 3.5% and 3.5% more, 9 left, 200s"), F.lit("3.5 ％ 200")
    assert one(text.missing_numbers(source, target)) == ["150"]


@pytest.mark.parametrize("limit", [5, 20])
def test_wrap_against_plain(one, limit):
    given = "the quick brown fox jumps over unbelievablylongwords and so on " * 3
    got, want, line = one(text.wrap(F.lit(given), limit)), [], ""
    for word in given.split():
        if line and len(line) + 1 + len(word) > limit:
            want.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    assert got == [*want, line]
    assert one(text.wrap(F.lit("ab"), limit)) == ["ab"]


def test_wrap_of_unspaced_text(one):
    assert one(text.wrap(F.lit("一二三，四五六。七八九十一二三四"), 8)) == ["一二三，四五六。", "七八九十一二三四"]
    assert one(text.wrap(F.lit("一二三四五六七八九十"), 4)) == ["一二三四", "五六七八", "九十"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("150分 of 12 天气 and 7天", ["150分", "7天"]),
        ("a12 b3456 6,789", ["456", "6789"]),
        ("3 秒 10公里 ３ 2.50", ["3秒", "10公里", "2.50"]),
    ],
)
def test_numeric_anchors(one, given, wanted):
    assert one(text.numeric_anchors(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "height", "rows", "width", "wanted"),
    [
        ("第三章 范围", 20, 1, 100, ("heading", 1)),
        ("二、内容", 20, 1, 100, ("heading", 2)),
        ("1.2 Title:", 20, 1, 100, ("heading", 4)),
        ("3. Title", 20, 1, 100, ("heading", 3)),
        ("a = b", 60, 1, 100, ("para", 0)),
        ("Tall line", 28, 1, 100, ("heading", 1)),
        ("Tall line:", 28, 1, 100, ("para", 0)),
        ("Tall line", 28, 2, 100, ("para", 0)),
        ("Tall line", 28, 1, 730, ("para", 0)),
        ("x" * 25, 28, 1, 100, ("para", 0)),
    ],
)
def test_heading_kind(one, given, height, rows, width, wanted):
    assert tuple(one(predicates.heading_kind(F.lit(given), F.lit(height), F.lit(20), F.lit(rows), F.lit(width), F.lit(1000)))) == wanted


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        (formulas.math_fragment, "𝑎", "图=1+2"),
        (formulas.math_fragment, "softmax(x)=y", "the words of prose"),
        (lambda x: formulas.standalone_math_line(x, F.lit(100.0), F.lit(300.0), F.lit(600.0)), "x = y + z", "plain words only here now"),
        (formulas.short_math_block, "(5),", "a long sentence"),
        (formulas.text_formula, "站点得分=权重*单量", "a = b"),
        (formulas.multiline_text_formula, "站点得分总计\n=权重占比+单量得分", "站点得分=权重"),
        (formulas.safe_low_confidence, "30%*50=15", "30 of 50"),
        (lambda x: formulas.clean_though_unsure(x, []), "Scope ...... 12", "free text"),
        (lambda x: formulas.pure_noise(x, []), "A1b", "real words of text"),
        (lambda x: formulas.image_rather_than_text(x, F.lit(0.3), []), "x=3*y", "short"),
        (lambda x: formulas.image_text_is_formula(x, packs.POLICY), "得分=1/2", "1/2"),
        (lambda x: formulas.plain_text_formula(x, packs.POLICY), "站点考核得分=单量", "复合准时率=单量得分"),
        (lambda x: formulas.text_formula_paragraph(x, packs.POLICY), "奖励金额合计为=单量×单价标准", "说明性的文字没有任何公式在内"),
        (lambda x: formulas.visual_formula(x, packs.POLICY), "复合准时率", "准时"),
        (lambda x: formulas.needs_review(x, packs.POLICY), "完成率=SUM(a)/b", "一般的说明文字"),
        (formulas.text_is_reliable, "some text", "12"),
        (lambda x: formulas.text_must_stay(x, packs.POLICY), "申诉路径" + "站点内容说明文字" * 8, "申诉路径"),
        (lambda x: formulas.table_continuation(x, packs.POLICY), "【站点】【骑手】排班时段出勤合格" * 4, "站点=骑手"),
    ],
)
def test_formula_predicates(one, predicate, yes, no):
    assert one(predicate(F.lit(yes))) is True
    assert one(predicate(F.lit(no))) is False


def test_formula_modes_and_latex(one):
    mode = lambda x, *flags: one(formulas.formula_mode(F.lit(x), F.array(*[F.lit(f) for f in flags]).cast("array<string>"), packs.POLICY))
    assert [mode("x", "formula_text"), mode("x", "formula_latex"), mode("x", "needs_review"), mode("复合准时率"), mode(" "), mode("站点考核得分=单量")] == ["text", "latex", "uncertain", "uncertain", "uncertain", "text"]
    assert one(formulas.latex_expression(F.lit(" a × b  ≤ ∞"))) == r"a \times b \le \infty"
    assert one(formulas.latex_equation(F.lit("a{b"), F.lit("c"))) == r"\text{a\{b} = c"
    assert one(formulas.latex_equation(F.lit(None).cast("string"), F.lit("c"))) == "c"
    assert [tuple(r) for r in one(formulas.formula_tail(F.lit("it is computed as 𝑎𝑏"), ["computed as"]))] == [("text", "it is computed as"), ("formula_text", "𝑎𝑏")]
    assert one(formulas.space_math_letters(F.lit("(x)𝑎is 𝑏Big —go"))) == "(x) 𝑎 is 𝑏 Big—go"
    assert one(formulas.image_may_hold_formula(*[F.lit(x) for x in (200.0, 50.0, 600.0, 800.0)])) and not one(formulas.image_may_hold_formula(*[F.lit(x) for x in (30.0, 50.0, 600.0, 800.0)]))


def test_split_glued_numbers(one):
    assert one(text.split_glued_numbers(F.lit("12 3.5 7"), 3)) == ["12", "3.5", "7"]
    assert one(text.split_glued_numbers(F.lit("12.53.17.9"), 3)) == ["12.", "53.", "17.9"]
    assert one(text.split_glued_numbers(F.lit("abc"), 2)) == ["abc", ""]


def test_garbled(one):
    assert one(predicates.garbled_score(F.lit("abc"))) == 0.0
    assert one(predicates.garbled_score(F.lit("a�b"))) == 1.0
    assert one(predicates.garbled_score(F.lit("(cid:12)"))) == 1.0
    assert one(predicates.garbled_score(F.lit("é​"))) == 0.5


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        (predicates.is_caption, "Figure 3: A", "Figures of speech"),
        (predicates.is_equation_number, " (5) ", "(x)"),
        (predicates.is_number, "3.14", "3.14 "),
        (predicates.is_page_number, "- 12 -", "12 men"),
        (predicates.is_leader, " ..… ", "a..."),
        (predicates.looks_truncated, "it goes on with the", "it ends with the word."),
        (formulas.math_fragment, "x*2 + 3*y = z", "the sum is ten"),
    ],
)
def test_predicates(one, predicate, yes, no):
    assert one(predicate(F.lit(yes))) is True
    assert one(predicate(F.lit(no))) is False


def test_style(one):
    assert one(predicates.is_light(F.lit(0xDDDDDD))) and not one(predicates.is_light(F.lit(0x202020)))
    assert one(predicates.is_rotated(F.lit(0.5))) and not one(predicates.is_rotated(F.lit(0.01)))


def test_geometry(one):
    a = G.rect(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    b = G.rect(F.lit(5), F.lit(0), F.lit(25), F.lit(10))
    assert one(G.area(a)) == 100 and one(G.overlap_ratio(a, b)) == 0.5
    assert one(G.x_overlap(a, b)) == 0.5 and one(G.x_match(a, b)) == 0.25
    edges = F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0))
    assert [one(G.bucket(F.lit(x), edges)) for x in (0.0, 10.0, 20.0, -1.0)] == [0, 1, None, None]
    assert one(G.column_of_word(F.lit(30.0), F.lit(40.0), edges)) == 1
    assert one(G.cluster_positions(F.array(*[F.lit(float(x)) for x in (1, 2, 30, 33, 5)]))) == [8 / 3, 31.5]
    assert one(G.format_bbox(a)) == "0.0,0.0,10.0,10.0"


def test_grids(one):
    grid = rows_of([["h1", "h2", "", "h3"], ["", "", "", ""], ["a", "", "", ""], ["", "b", "", "c"], ["d"]])
    assert one(grids.clean(grid)) == [["h1", "h2", "h3"], ["a", "b", "c"], ["d", "", ""]]
    assert one(grids.filled_cells(grid)) == 7
    assert one(grids.pipe_table(rows_of([["a", "b"], ["1|2"]]))) == ["| a | b |", "| --- | --- |", "| 1\\|2 |  |"]
    assert one(grids.grouped_text(rows_of([["k", "v"], ["a", "1"], ["", "2"]]))) == ["- k: a; v: 1", "- v: 2"]
    filled = grids.forward_fill(rows_of([["A", "x"], ["", "y"], ["", ""], ["B", ""], ["", "z"]]), 0, [1])
    assert [r[0] for r in one(filled)] == ["A", "A", "", "B", "B"]
    assert one(grids.suspect_score(rows_of([["name amount", "x"], ["5 EUR", "y"], ["q"]]), ["name", "amount"])) == 3
    assert one(grids.clean(F.array().cast("array<array<string>>"))) == []
    assert one(grids.header_rendered(rows_of([["a b", "c"]]), F.array(F.lit("| a b | c |")))) is True
