"""Assembly of recognised pages against a plain form of each step."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.operators import pages

LINE = "doc_id long, page int, line_no int, text string, conf double, x0 double, y0 double, x1 double, y1 double"
ROW = "doc_id long, page int, row int, text string, x0 double, y0 double, x1 double, y1 double, h double, conf double, n long"
PAGE = "doc_id long, page int, page_w double, page_h double"


def plain_heading(text, h, body, n, width, page_w):
    if n > 1 or len(text) > 40 or re.search("[=＝]", text) or width > page_w * 0.72 or text[-1:] in "，、；,;":
        return "para", 0
    if re.match("第[一二三四五六七八九十百0-9]{1,3}[章节条部分]", text):
        return "heading", 1
    if re.match("[（(]?[一二三四五六七八九十]{1,3}[、）)．.]", text):
        return "heading", 2
    number = re.match(r"(\d{1,2}(?:[.．]\d{1,2}){0,3})\s*[、.．\s]", text)
    if number and len(text) <= 30:
        return "heading", min(3 + len(re.findall("[.．]", number[1])), 4)
    if text[-1:] in "：:":
        return "para", 0
    return ("heading", 1) if h > body * 1.35 and len(text) <= 24 else ("para", 0)


def plain_leaders(text):
    text = re.sub(r"\s*[.。·•．…⋯\-_]{2,}\s*(\d{1,3})\s*$", "　\\1", text)
    return re.sub(r"[.。·•．…⋯\-_]{3,}\s*$", "", text).strip()


def plain_join(texts):
    out = ""
    for t in texts:
        meets = out and re.search(r"[A-Za-z0-9,.;:)]$", out) and re.match(r"[A-Za-z0-9(]", t)
        out = f"{out} {t}" if meets else out + t
    return out


def plain_paragraphs(rows, page_w):
    """One page, row by row with the state in hand."""
    hs = sorted(r["h"] for r in rows)
    body = (hs[(len(hs) - 1) // 2] + hs[len(hs) // 2]) / 2
    out, para, contents, misses, before = [], [], False, 0, None

    def flush():
        if para:
            text = plain_leaders(plain_join([r["text"] for r in para]))
            x0, x1 = min(r["x0"] for r in para), max(r["x1"] for r in para)
            kind = ("para", 0) if contents else plain_heading(text, max(r["h"] for r in para), body, len(para), x1 - x0, page_w)
            if text:
                out.append((*kind, text, x0, min(r["y0"] for r in para), x1, max(r["y1"] for r in para), min(r["conf"] for r in para)))
            para.clear()

    for r in rows:
        flat = re.sub(r"\s+", "", r["text"])
        if flat in ("目录", "目錄"):
            flush()
            contents, misses = True, 0
            out.append(("heading", 1, "目录", 0.0, r["y0"], page_w, r["y1"], 1.0))
            before = r
            continue
        if contents:
            if re.fullmatch(r"\d{1,4}", flat):
                before = r
                continue
            if re.fullmatch(r".+?[.。·•．…⋯\-_\s]*\d{1,3}", flat) or re.fullmatch(r"[\s.。·•．…⋯\-_—－]+", r["text"]):
                flush()
                para.append(r)
                flush()
                before = r
                continue
            misses += 1
            contents = misses < 2
        heading = plain_heading(r["text"], r["h"], body, 1, r["x1"] - r["x0"], page_w)[0] == "heading"
        if before and para and (r["y0"] - before["y1"] > r["h"] * 1.25 or heading or re.match(r"\d{1,2}[.．]\d{1,2}|[a-zA-Z][.、)）]|[•·▪]|[（(]\d{1,2}[)）]", r["text"])):
            flush()
        para.append(r)
        if heading:
            flush()
        before = r
    flush()
    return out


def random_rows(rng, doc, page):
    y, rows = 10.0, []
    texts = ["目录", "Scope ..... 12", "1.2 Title here", "12", "…………", "plain text goes on", "二、中文标题", "（3）条目", "中文正文继续", "• item", "a = b", "Ends here:", "part", "More words (and) so", "345"]
    for i in range(rng.randint(1, 25)):
        h = rng.choice([10.0, 10.0, 10.0, 11.0, 20.0])
        x0 = rng.choice([5.0, 20.0])
        rows.append({"doc_id": doc, "page": page, "row": i, "text": rng.choice(texts), "x0": x0, "y0": y, "x1": x0 + rng.choice([50.0, 60.0, 85.0]), "y1": y + h, "h": h, "conf": rng.random(), "n": 1})
        y += h + rng.choice([2.0, 2.0, 5.0, 30.0])
    return rows


def test_paragraphs_against_plain(spark):
    rng = random.Random(1)
    by_page = {(d, p): random_rows(rng, d, p) for d in range(30) for p in range(3)}
    rows = spark.createDataFrame([tuple(r.values()) for p in by_page.values() for r in p], ROW)
    sizes = spark.createDataFrame([(d, p, 100.0, 1000.0) for d, p in by_page], PAGE)
    got = {}
    for r in pages.paragraphs(rows, sizes).collect():
        got.setdefault((r.doc_id, r.page), []).append((r.kind, r.level, r.text, r.x0, r.y0, r.x1, r.y1, r.confidence))
    for key, own in by_page.items():
        assert sorted(got.get(key, []), key=lambda b: (b[4], b[2])) == sorted(plain_paragraphs(own, 100.0), key=lambda b: (b[4], b[2])), [r["text"] for r in own]
    assert pages.paragraphs(rows.limit(0), sizes).count() == 0


@pytest.mark.parametrize(("given", "wanted"), [(["a b", "c"], "a b c"), (["中文", "继续"], "中文继续"), (["x", "1. y", "• z"], "x\n1. y\n• z"), (["end)", "word"], "end)word"), ([], "")])
def test_join_cell(spark, given, wanted):
    cells = F.array(*[F.lit(g) for g in given]).cast("array<string>")
    assert spark.range(1).select(pages.join_cell(cells).alias("x")).first().x == wanted


def grid_page(spark):
    lines = [
        (1, 0, 0, "name", 0.9, 12.0, 105.0, 60.0, 120.0), (1, 0, 1, "amount", 0.8, 110.0, 105.0, 150.0, 120.0),
        (1, 0, 2, "first", 0.7, 12.0, 130.0, 60.0, 142.0), (1, 0, 3, "row", 0.9, 12.0, 146.0, 40.0, 158.0), (1, 0, 4, "5", 0.9, 110.0, 140.0, 120.0, 152.0),
        (1, 0, 5, "body text above", 0.9, 10.0, 20.0, 90.0, 32.0), (1, 0, 6, "on the edge", 0.9, 12.0, 163.0, 60.0, 177.0), (1, 0, 7, "2", 0.9, 110.0, 175.0, 120.0, 185.0),
    ]
    regions = [(1, 0, 1, 10.0, 100.0, 200.0, 200.0, [100.0, 125.0, 170.0, 200.0], [10.0, 100.0, 200.0])]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(regions, "doc_id long, page int, region long, x0 double, y0 double, x1 double, y1 double, hy array<double>, vx array<double>")


def test_table_blocks(spark):
    lines, regions = grid_page(spark)
    out = pages.table_blocks(lines, regions, [], []).collect()
    assert [(r.kind, r.rows, r.confidence, r.flags) for r in out] == [("table", [["name", "amount"], ["first row", "5"], ["on the edge", "2"]], 0.7, [])]
    one = pages.table_blocks(lines.filter("line_no = 0"), regions, [], [])
    assert one.count() == 0  # a single line is no table
    wide = regions.withColumn("vx", F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: i.cast("double")))
    assert pages.table_blocks(lines, wide, [], []).count() == 0


def test_column_edges_and_rereading_of_cells(spark):
    _, regions = grid_page(spark)
    v = spark.createDataFrame([(1, 0, 100.0, 100.0, 190.0), (1, 0, 150.0, 100.0, 120.0), (1, 0, 12.0, 100.0, 200.0)], "doc_id long, page int, x double, y0 double, y1 double")
    out = pages.column_edges(regions.drop("vx"), v)
    assert [r.vx for r in out.collect()] == [[10.0, 100.0, 200.0]]
    blank, full = F.array().cast("array<array<string>>"), F.array(F.array(F.lit("a")))
    assert out.select(pages.reread_cells(out, blank, F.lit(0), F.lit(False)).alias("x")).first().x
    assert not out.select(pages.reread_cells(out, full, F.lit(0), F.lit(False)).alias("x")).first().x
    assert out.select(pages.reread_cells(out, full, F.lit(2), F.lit(False)).alias("x")).first().x


def test_assemble(spark):
    lines, _ = grid_page(spark)
    sizes = spark.createDataFrame([(1, 0, 300.0, 700.0), (2, 0, 300.0, 400.0)], PAGE)
    rules = spark.createDataFrame([(1, 0, y, 10.0, 200.0) for y in (100.0, 125.0, 170.5, 200.0)], "doc_id long, page int, y double, x0 double, x1 double")
    rules = rules.filter("y <> 170.5").union(spark.createDataFrame([(1, 0, 160.0, 10.0, 200.0)], rules.schema))
    v = spark.createDataFrame([(1, 0, 100.0, 100.0, 200.0)], "doc_id long, page int, x double, y0 double, y1 double")
    out = pages.assemble(lines, sizes, rules, v, [], []).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.kind, r.text, r.rows) for r in out] == [
        (1, "para", "body text above", None),
        (1, "table", "", [["name", "amount"], ["first row", "5"], ["on the edge", "2"]]),
        (1, "image", "", None),
        (2, "image", "", None),
    ]
    assert pages.assemble(lines.limit(0), sizes.limit(0), rules, v, [], []).count() == 0


def test_near_fallback(spark):
    blocks = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 0, 5000.0, 5010.0), (1, 1, 0.0, 10.0)], "doc_id long, page int, y0 double, y1 double")
    refs = spark.createDataFrame([(1, 0, 2400.0, 2500.0)], "doc_id long, page int, y0 double, y1 double")
    assert [r.y0 for r in pages.near_fallback(blocks, refs).collect()] == [0.0]

