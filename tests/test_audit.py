"""The coverage audit, check by check, on small documents."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import evidence as E
from spanforge.functions.packs import POLICY
from spanforge.operators import audit

BLOCK = "doc_id long, seq int, page int, kind string, text string, rows array<array<string>>, flags array<string>, x0 double, y0 double, x1 double, y1 double"
REGION = "doc_id long, idx int, stage string, kind string, text string, rows array<array<string>>, page int, flags array<string>, x0 double, y0 double, x1 double, y1 double"
BOX = (0.0, 1.0, 2.0, 3.0)


@pytest.fixture
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def md(spark):
    return lambda *texts: spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, markdown string")


def block(seq, kind, text="", rows=None, flags=(), doc=1):
    return (doc, seq, 0, kind, text, rows, list(flags), *BOX)


def test_headings_of_a_source(one):
    heads = ["5.2.1 考核规则", "一、总则", "2024年3月5日", "3分钟以内送达", "12 only ascii", "目录"]
    assert [one(E.heading_token(F.lit(h))) for h in heads] == ["5.2.1", "一、", "2024", "3", "", ""]
    probable = lambda h: one(E.probable_heading(E.heading_token(F.lit(h)), E.heading_title(F.lit(h)), POLICY))
    assert [probable(h) for h in heads[:4]] == [True, True, False, False]
    assert [one(E.detailed_section(F.lit(t))) for t in ("四、", "5", "5．2", "5.2.1")] == [False, False, True, True]


def test_local_evidence(one):
    text = "5.1 规则说明\nfirst\nsecond\n5.2 其他内容\nthird"
    assert one(E.local_evidence(F.lit(text))) == "5.1 规则说明\nfirst\nsecond"
    assert one(E.local_evidence(F.lit("x" * 3000))) == "x" * 2200
    assert one(E.local_evidence(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    ("line", "left"),
    [
        ("站点得分=单量×权重", ["站点得分"]),
        ("核算公式：站点得分 = 单量", ["站点得分"]),
        ("| 项目：完成单占比＝完成/总数", ["完成单占比"]),
        ("得分≥90时SUM不计", []),
        ("前文。站点得分=单量×权重", []),
        ("正向指标的得分=单量", []),
        ("a = b + c + d", []),
        ("得分=1", []),
    ],
)
def test_left_sides(one, line, left):
    assert one(E.formula_left_sides(F.lit(line), POLICY)) == left


def test_missing_formulas(one):
    source = "站点得分=单量×权重\n完成单占比=完成/总数"
    assert one(E.missing_formulas(F.lit(source), F.lit("$$\\text{站点（得分）} = x$$"), POLICY)) == ["完成单占比"]


def test_review_markers(md):
    got = audit.review_markers(md("ok", "公式原文（需核对） x", None), "doc_id", POLICY).collect()
    assert [(r.doc_id, r.detail) for r in got] == [(2, "公式原文（需核对）")]
    assert audit.review_markers(md("公式原文（需核对）"), "doc_id").count() == 0


CONTENTS = "# 目录\n\n1 总则说明 ... 1\n2 考核规则 2\n\n3 数据来源 3\n4 附则 9\n\n# 1 总则说明\ntext\n# 3、数据来源\n"


def test_contents(md):
    parted = audit.contents_and_body(md(CONTENTS, "no contents\nat all", "# 目录\n"), "doc_id").orderBy("doc_id").collect()
    assert [(e.token, e.title) for e in parted[0].entries] == [("1", "总则说明"), ("2", "考核规则"), ("3", "数据来源"), ("4", "附则")]
    assert parted[0].body.startswith("# 1 总则说明") and parted[1].body == "no contents\nat all" and parted[1].entries == [] and parted[2].entries == []
    got = audit.contents_coverage(md(CONTENTS), "doc_id", POLICY).collect()
    assert [(r.check, r.detail) for r in got] == [("contents_coverage", "2考核规则")]


def test_heading_gaps(md):
    text = "# 1.1 a\n# 1.2 b\n# 1.5 e\n# 1.4 d\n## 2.1 a\n## 2.3.1 x\n## 2.4 y\n# 3.2 q\n# 3.1 p"
    got = audit.heading_gaps(md(text), "doc_id").orderBy("detail").collect()
    assert [r.detail for r in got] == ["1.3", "2.2"]


def test_sections(spark, md):
    source = spark.createDataFrame([(1, "前言\n5.1 考核规则\n内容内容内容内容内容内容内容内容\n5.2 短标题\n2024年3月5日\n这里是第二节的内容，足够长的一段文字")], "doc_id long, text string")
    got = audit.sections_of(source, "doc_id", POLICY).orderBy("line_no").collect()
    assert [(r.token, r.title, r.line_no) for r in got] == [("5.1", "考核规则", 2), ("5.2", "短标题", 4)]
    out = audit.output_sections(md("# 5.1 考核规则\na\n## 其他\nb\n# 5.1 考核规则\nc"), "doc_id").collect()
    assert [(r.token, r.text) for r in out] == [("5.1", "# 5.1 考核规则\nc")]


def test_section_coverage(spark, md):
    body = "核算公式：站点得分=单量×权重\n数据来源：平台 150 单 2500 单 88% 12.5 公里 300 秒\n考核目标：满分"
    source = spark.createDataFrame([(1, f"5.1 考核规则说明\n{body}"), (2, f"5.1 考核规则说明\n{body}"), (3, f"5.1 考核规则说明\n{body}")], "doc_id long, text string")
    full = f"# 5.1 考核规则说明\n{body}"
    got = audit.section_coverage(source, md(full, "# 5.1 考核规则说明\nnothing", "other"), "doc_id", POLICY)
    by_doc = {d: sorted(r.check for r in got.collect() if r.doc_id == d) for d in (1, 2, 3)}
    assert by_doc == {1: [], 2: ["section_formulas", "section_numbers", "section_terms"], 3: ["section_formulas", "section_numbers", "section_terms", "section_title"]}


def test_regions_and_blocks(spark, md):
    regions = spark.createDataFrame(
        [(1, 0, "text_extract", "para", "责任承担与整改要求", None, 0, [], *BOX), (1, 1, "ocr_line", "para", "责任承担与整改要求", None, 0, [], *BOX), (1, 2, "ocr_line", "para", "5.3 考核规则", None, 1, [], *BOX), (1, 3, "text_extract", "para", "整改", None, 0, [], *BOX)], REGION
    )
    got = audit.region_coverage(regions, md("整改"), "doc_id", POLICY).orderBy("detail").collect()
    assert [r.detail for r in got] == ["page 1 region 0 [0.0,1.0,2.0,3.0]: 责任承担", "page 2 region 2 [0.0,1.0,2.0,3.0]: 考核规则、5.3"]
    raw = spark.createDataFrame([block(0, "table", rows=[["指标", "权重"], ["达标率", "满分目标 150 分 2000 单"]]), block(1, "heading", "指标定义" * 8), block(2, "para", "数据来源")], BLOCK)
    got = audit.block_coverage(raw, md("指标 达标率"), "doc_id", POLICY).collect()
    assert [r.detail for r in got] == ["block 0: 满分目标、权重、150分、2000单"]


def test_images_and_tables(spark, md):
    grid = [["name", "value"], ["first row", "second cell"]]
    blocks = spark.createDataFrame([block(0, "image", "a = b\nlong line one", flags=["formula"]), block(1, "image", "x"), block(2, "image", rows=grid, flags=["table_fallback"]), block(3, "image", "指标 y", flags=["auto_image"]), block(4, "table", rows=grid), block(5, "table", rows=[["other", "head"], ["1", "2"]])], BLOCK)
    text = "long line one\n| name | value |\n| --- | --- |\n| first row | second cell |"
    assert [r.detail for r in audit.image_coverage(blocks, md(text), "doc_id", POLICY).collect()] == ["page 1 block 3"]
    assert [r.detail for r in audit.table_rendering(blocks, md(text), "doc_id").collect()] == ["page 1 block 5 [0.0,1.0,2.0,3.0]"]


def test_audit(spark, md):
    blocks = spark.createDataFrame([block(0, "para", "核算公式 全文"), block(0, "para", None, doc=2)], BLOCK)
    regions = spark.createDataFrame([], REGION)
    got = audit.audit(blocks, blocks, regions, md("nothing here", ""), pack=POLICY).collect()
    assert sorted((r.doc_id, r.check, r.detail) for r in got) == [(1, "global_term", "核算公式")]
    assert audit.audit(blocks.limit(0), blocks.limit(0), regions, md("x").limit(0)).count() == 0
