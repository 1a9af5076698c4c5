"""Text pages, native tables and repairs against plain forms and small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions import results, text
from spanforge.operators import native, repair, spans

SPAN = "doc_id long, page int, line_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
PAGE = "doc_id long, page int, page_w double, page_h double"
WORD = "doc_id long, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def grid(rows):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows]).cast("array<array<string>>")


# --- text pages --------------------------------------------------------------------------------------

TEXTS = ["Figure 3: A plot", "Table 1 Results.", "x = y + z", "(5)", "1.2 Scope of it", "plain words go on and on", "goes on in lower case", "It ends here.", "Label: bold value", "二、中文标题", "𝑎 + 𝑏 = 𝑐", "more (words) here"]


def is_caption(t):
    return bool(re.match(r"(?:Figure|Fig\.?|Table|图|表)\s*\d+\s*(?:[|:：.]|\s)", t, re.I))


def is_math(t):
    c = re.sub(r"\s", "", t)
    letters = "𝑎-𝑧𝐴-𝑍α-ωΑ-Ω"
    signs, abc = len(re.findall(rf"[=+\-*/×÷√∑Σ≤≥→←↔↦(){{}}\[\]|{letters}]", c)), len(re.findall("[A-Za-z]", c))
    fragment = 0 < len(c) <= 80 and not re.search("[一-鿿]", c) and (re.fullmatch(f"[{letters}]", c) or (signs >= 2 and signs + abc >= max(3, len(c) * 0.55)))
    return bool(fragment and re.search(rf"[=≈≤≥∑Σ√→←↔↦]|[{letters}]", c))


def is_titled(t):
    return bool(re.match(r"\d{1,2}(?:[.．]\d{1,2}){0,4}[.．]?\s*\S|[一二三四五六七八九十]{1,3}[、.．]\s*\S", t))


def plain_groups(lines):
    """Sets of line numbers by kind: one page, line by line, with lists in hand."""
    para, caption, math, done, last = [], [], [], [], None

    def flush(kind, held):
        if held:
            done.append((kind, tuple(r["line_no"] for r in held)))
            held.clear()

    for r in lines:
        t, size = r["text"], r["size"]
        if math:
            if r["y0"] - math[-1]["y1"] <= size * 1.3 and (is_math(t) or re.fullmatch(r"\(?\d{1,3}\)?", re.sub(r"\s", "", t))):
                math.append(r)
                last = None
                continue
            flush("formula", math)
        if caption:
            if r["y0"] - caption[-1]["y1"] <= size * 1.35 and abs(r["x0"] - caption[0]["x0"]) < 24 and not is_caption(t) and not is_titled(t):
                caption.append(r)
                continue
            if not para:
                flush("caption", caption)
        if is_caption(t):
            caption.append(r)
            if not para and t.endswith((".", "。")):
                flush("caption", caption)
            last = None
            continue
        if is_math(t):
            flush("para", para)
            flush("caption", caption)
            math.append(r)
            last = None
            continue
        if last:
            goes_on = not last["text"].endswith((".", "。", "!", "！", "?", "？", ":", "：", ";", "；")) and re.match("[a-z]", t)
            label = r["bold"] and re.match(r"(?:[A-Z][A-Za-z0-9 /&()'\-]{1,48}|[一-鿿]{2,16})[:：]\s*\S", t)
            if label or ((r["y0"] - last["y1"] > size * 0.8 or abs(size - last["size"]) > 1) and not goes_on):
                flush("para", para)
                flush("caption", caption)
                flush("formula", math)
        para.append(r)
        last = r
    flush("para", para)
    flush("formula", math)
    flush("caption", caption)
    return done


def random_page(rng, doc, page):
    y, out = 10.0, []
    for i in range(rng.randint(1, 22)):
        size = rng.choice([10.0, 10.0, 10.0, 14.0])
        x0 = rng.choice([100.0, 100.0, 150.0])
        out.append({"doc_id": doc, "page": page, "line_no": i, "text": rng.choice(TEXTS), "size": size, "bold": rng.random() < 0.3, "x0": x0, "y0": y, "x1": x0 + 200.0, "y1": y + size})
        y += size + rng.choice([2.0, 2.0, 6.0, 12.5, 30.0])
    return out


def test_text_blocks_against_plain(spark):
    rng = random.Random(2)
    by_page = {(d, p): random_page(rng, d, p) for d in range(25) for p in range(4)}
    lines = spark.createDataFrame([tuple(r.values()) for p in by_page.values() for r in p], SPAN)
    sizes = spark.createDataFrame([(*k, 600.0, 800.0) for k in by_page], PAGE)
    got = {}
    for r in spans.text_blocks(lines, sizes).collect():
        kind = {"caption": "caption", "formula_text": "formula"}.get(r.flags[0] if r.flags else "", "para")
        got.setdefault((r.doc_id, r.page), []).append((kind, r.y0, r.y1, r.text.count("\n") + 1 if kind == "formula" else 0))
    for key, own in by_page.items():
        want = [(kind, own[n[0]]["y0"], max(own[i]["y1"] for i in n), len(n) if kind == "formula" else 0) for kind, n in plain_groups(own)]
        assert sorted(got[key]) == sorted(want), [r["text"] for r in own]
    assert spans.text_blocks(lines.limit(0), sizes).count() == 0


def test_text_blocks_of_one_page(spark):
    rows = [("Big title", 16.0, False, 10.0), ("First line of a docu-", 10.0, False, 40.0), ("ment goes on", 10.0, False, 52.0), ("1.1 Bold one", 10.0, True, 90.0), ("softmax(x) = y", 10.0, False, 130.0), ("(1)", 10.0, False, 141.0), (" ", 10.0, False, 160.0)]
    lines = spark.createDataFrame([(1, 0, i, t, s, b, 100.0, y, 300.0, y + s) for i, (t, s, b, y) in enumerate(rows)], SPAN)
    out = spans.text_blocks(lines, spark.createDataFrame([(1, 0, 600.0, 800.0)], PAGE)).orderBy("seq").collect()
    assert [(r.kind, r.level, r.text, r.flags) for r in out] == [("heading", 2, "Big title", []), ("para", 0, "First line of a document goes on", []), ("heading", 3, "1.1 Bold one", []), ("para", 0, "softmax(x) = y\n(1)", ["formula_text"])]


# --- native tables -----------------------------------------------------------------------------------


def words_of(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x), float(y), x + 4.0 * len(t), y + 8.0) for i, (t, x, y) in enumerate(rows)], WORD)


def tables_of(spark, rows):
    cells = "array<struct<x0:double,x1:double>>"
    return spark.createDataFrame(rows, f"doc_id long, page int, fragment int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>, cells {cells}")


def test_fragments(spark):
    out = native.merge_fragments(tables_of(spark, [(1, 0, 0, 10.0, 10.0, 200.0, 50.0, [["a"]], [(10.0, 100.0)]), (1, 0, 1, 15.0, 70.0, 190.0, 90.0, [["b"]], []), (1, 0, 2, 10.0, 140.0, 200.0, 160.0, [["c"]], []), (1, 0, 3, 60.0, 95.0, 200.0, 99.0, [["d"]], None)])).orderBy("y0", "x0").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.rows) for r in out[:1]] == [(10.0, 10.0, 200.0, 90.0, [["a"], ["b"]])] and [r.rows for r in out[1:]] == [[["d"]], [["c"]]]


def test_native_tables(spark):
    words = words_of(spark, [("name", 12, 12), ("one", 112, 12), ("two", 162, 13), ("first", 12, 30), ("row", 36, 30), ("1.5", 112, 31), ("2", 162, 30), ("outside", 400, 30), (" ", 12, 40)])
    read = [(1, 0, 0, 10.0, 10.0, 210.0, 45.0, [["read"]], [(10.0, 110.0), (110.0, 160.0), (160.0, 210.0)])]
    out = native.native_tables(tables_of(spark, read), words).collect()
    assert [r.rows for r in out] == [[["name", "one", "two"], ["first row", "1.5", "2"]]]
    assert [r.rows for r in native.native_tables(tables_of(spark, read), words.limit(0)).collect()] == [[["read"]]]


def test_columns_of_values(spark):
    values = [("m", 12, 12), ("1", 100, 12), ("2", 140, 12), ("3", 180, 12), ("n", 12, 30), ("4", 101, 30), ("5", 141, 30), ("6", 181, 30)]
    read = [(1, 0, 0, 10.0, 10.0, 210.0, 45.0, [["read"]], [(10.0, 210.0)])]
    assert [r.rows for r in native.native_tables(tables_of(spark, read), words_of(spark, values)).collect()] == [[["m", "1", "2", "3"], ["n", "4", "5", "6"]]]


def test_join_words(one):
    words = lambda *w: F.array(*[F.struct(F.lit(float(x)).alias("x0"), F.lit(t).alias("text")) for x, t in w])
    assert one(native.join_words(words((30, "b"), (10, "aa"), (33, "c")))) == "aa bc"


def test_results_tables(one):
    metric = [["Metric Pages", "10", "40+"], ["Distinct-20", "95%", "90.5%"], ["Overall score", "x", "1 2 3"]]
    assert one(results.rebuilt(grid(metric))) == [["Metric", "10", "40+"], ["Distinct-20", "95%", "90.5%"], ["Overall score x", "1", "2"]]
    speed = [["TPS Model", "256 512", "1024"], ["Deepseek OCR", "base", "10.5 9.25 8"], ["no values", "", ""]]
    assert one(results.rebuilt(grid(speed))) == [["Model", "256", "512", "1024"], ["Deepseek OCR base", "10.5", "9.25", "8"]]
    category = [["Model", "Edit", "UOW"], ["DS-OCR", "", ""], ["Model", "Text", "1 2 3 4 5 6"], ["", "R-order", "1 2 3 4 5 6 7 8 9 10"], ["other", "Text", "1 2"]]
    assert one(results.rebuilt(grid(category)))[1:] == [["DS-OCR", "Text", *"123456"], ["DS-OCR", "R-order", *"123456789"]]
    measure = [["Model", "Size", "Overall", "", "", ""], ["End-to-end  Model", "", "", "", "", ""], ["Unlimited-OCR", "3B", "90.1", "0.1", "2", "3"], ["", "", "91", "", "", ""], ["short", "1"]]
    assert one(results.rebuilt(grid(measure)))[1:] == [["End-to-end Model"] + [""] * 7, ["Unlimited-OCR", "3B", "90.1", "0.1", "2", "3", "", ""], ["", "", "91", "", "", ""]]
    assert one(results.rebuilt(grid([["a", "b"]]))) == [["a", "b"]]


@pytest.mark.parametrize(
    ("given", "count", "wanted"),
    [("", 2, ["", ""]), ("1212", 2, ["12", "12"]), ("123", 2, ["1", "23"]), ("1.52.5", 2, ["1.5", "2.5"]), ("12 3.5 7", 3, ["12", "3.5", "7"]), ("1.2 3.4 5.6", 3, ["1.", "23.", "45.6"]), ("345", 3, ["3", "4", "5"]), ("abc", 2, ["abc", ""])],
)
def test_glued_numbers(one, given, count, wanted):
    assert one(text.split_glued_numbers(F.lit(given), count)) == wanted


# --- repairs -----------------------------------------------------------------------------------------


def blocks_of(spark, *rows):
    full = [(1, i, kind, t, None, []) for i, (kind, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, seq int, kind string, text string, rows array<array<string>>, flags array<string>")


def test_noise_blocks(spark):
    out = repair.drop_noise(blocks_of(spark, ("para", "text"), ("para", "12"), ("para", "x"), ("para", "一、总则1二、范围2三、附则"), ("heading", "7"), ("para", "more"), ("para", "8"), ("para", "y"), ("para", "z"), ("image", ""), ("para", None))).orderBy("seq").collect()
    assert [r.text for r in out] == ["text", "x", "more", "8", "y", "z", "", None]


def test_page_numbers(spark):
    out = repair.absorb_page_numbers(blocks_of(spark, ("heading", "目录"), ("para", "一、总则"), ("para", "1"), ("para", "2"), ("para", "二、范围 3"), ("para", "4"), ("image", "5"), ("para", "plain"), ("para", "6"))).orderBy("seq").collect()
    assert [r.text for r in out] == ["目录", "一、总则　1", "2", "二、范围 3", "4", "5", "plain", "6"]
    assert repair.absorb_page_numbers(blocks_of(spark, ("para", "一、总则"), ("para", "1"))).count() == 2


def test_torn_clauses(spark):
    seams = [(r"（编号", r"AB-"), ("主制", "度")]
    out = repair.merge_torn(blocks_of(spark, ("para", "see（编号 "), ("para", " AB-1) 主制"), ("para", "度 ends"), ("image", "度"), ("para", " own "), ("para", None)), seams).orderBy("seq").collect()
    assert [(r.seq, r.text) for r in out] == [(0, "see（编号AB-1) 主制度 ends"), (3, "度"), (4, " own "), (5, None)]


def test_marks(spark, one):
    blocks = blocks_of(spark, ("para", "a text that is cut off by the"), ("para", "whole."), ("table", "")).withColumn("rows", F.when(F.col("kind") == "table", grid([["name amount", "x"], ["5 EUR", "y"], ["q"]])))
    assert [r.flags for r in repair.mark(blocks, ["name", "amount"], []).orderBy("seq").collect()] == [["possible_truncation"], [], ["table_low_confidence"]]
    native_flag = F.array(F.lit("native_pdf_table"))
    assert one(repair.protected_table(grid([["Model", "1"]]), native_flag, ["Model"])) and not one(repair.protected_table(grid([["模型一二三四五六七八九"]]), native_flag, ["模型"])) and not one(repair.protected_table(grid([["Model"]]), F.array().cast("array<string>"), ["Model"]))


def test_later_titles(spark):
    blocks = blocks_of(spark, ("para", "a"), ("para", "一、 总则"), ("para", "b"))
    assert [r.x for r in blocks.select("seq", repair.later_starts_with(F.lit("一、总则")).alias("x")).orderBy("seq").collect()] == [True, False, False]
