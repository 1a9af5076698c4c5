"""Registered queries of recognised pages, formulas, sections and table shapes, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import evidence as E
from .functions import formulas as X
from .functions import grids
from .functions import predicates as P
from .operators import audit, lines, pages


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, turns: dict[int, Column], by: int) -> DataFrame:
    """Lines of documents, each by its turn made into something to find."""
    split = lines.split_lines(_t(spark, sf_dir, "documents"), ["doc_id"])
    text = F.col("line")
    for turn, made in turns.items():
        text = F.when(F.col("line_no") % by == turn, made).otherwise(text)
    return split.withColumn("x", text)


def row_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as recognised rows of heights 20, 30 and 40, ten to a character wide."""
    line = F.col("line")
    turns = {
        0: F.concat(F.lit("第三章 "), F.left(line, F.lit(10))),
        1: F.concat((F.col("line_no") % 100).cast("string"), F.lit(".2 "), F.left(line, F.lit(20))),
        2: F.left(line, F.lit(20)),
        4: F.concat(F.left(line, F.lit(15)), F.lit(":")),
        5: F.concat(F.lit("二、"), F.left(line, F.lit(12))),
        6: F.concat(F.left(line, F.lit(8)), F.lit("=1")),
    }
    made = _made(spark, sf_dir, turns, 7)
    kind = P.heading_kind(F.col("x"), F.lit(20) + F.col("line_no") % 3 * 10, F.lit(20), F.lit(1), F.char_length("x") * 10, F.lit(1000))
    return made.withColumn("k", kind).groupBy("doc_id").agg(F.count_if(F.col("k.kind") == "heading").alias("n_headings"), F.sum(F.col("k.level")).cast("long").alias("levels"), F.count_if(F.col("k.level") == 1).alias("n_first"))


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    turns = {0: F.concat(F.left(line, F.lit(12)), F.lit("=x+y")), 1: F.lit("(5), "), 3: F.concat(F.lit("站点得分=单量×"), F.left(line, F.lit(5))), 4: F.lit("𝑎"), 5: F.concat(F.lit("30%*50=15 "), F.left(line, F.lit(3)))}
    made, x = _made(spark, sf_dir, turns, 6), F.col("x")
    n = lambda c, name: F.count_if(c).alias(name)
    return made.groupBy("doc_id").agg(
        n(X.math_fragment(x), "n_fragments"), n(X.short_math_block(x), "n_short"), n(X.text_formula(x), "n_text"), n(X.image_text_is_formula(x), "n_pictures"), n(X.safe_low_confidence(x), "n_safe"), n(X.text_is_reliable(x), "n_reliable")
    )


def source_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line a numbered heading of a source."""
    turns = {0: F.concat(F.lit("5."), (F.col("line_no") + 1).cast("string"), F.lit(" 考核规则")), 3: F.lit("2024年3月5日")}
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x"))), lambda s: s["x"]), "\n")
    texts = _made(spark, sf_dir, turns, 5).groupBy("doc_id").agg(joined.alias("text"))
    return audit.sections_of(texts, "doc_id").select("doc_id", "token", "title", F.char_length("text").cast("long").alias("n_chars"), F.col("line_no").cast("long").alias("line_no"), E.detailed_section(F.col("token")).alias("detailed"))


def complex_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of their lines: some with blank first cells, long cells or many columns."""
    items = _t(spark, sf_dir, "lineitem")
    first = F.when(F.col("l_quantity") > 40, "").otherwise(F.col("l_linenumber").cast("string"))
    long = F.repeat(F.lit("ab"), F.col("l_quantity").cast("int") + F.when(F.col("l_tax") > 0.07, 50).otherwise(0))
    wide = F.array_repeat(F.lit("w"), F.when(F.col("l_discount") > 0.09, 4).otherwise(1))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat(F.array(first, long), wide).alias("r")))).alias("s"))
    table = F.concat(F.array(F.array(F.lit("no"), F.lit("text"), F.lit("flag"))), F.transform("s", lambda s: s["r"]))
    return rows.select("l_orderkey", grids.complex_by_rules(table).alias("is_complex"), grids.filled_cells(table).cast("long").alias("n_cells"))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rows of a page, 12 high, with a wider gap before every fourth; every seventh a list item. Without
    contents a paragraph opens after a gap, at an item and about a heading."""
    made = _made(spark, sf_dir, {3: F.concat(F.lit("• "), F.left(F.col("line"), F.lit(30))), 5: F.concat(F.lit("二、"), F.left(F.col("line"), F.lit(9)))}, 7)
    top = F.col("line_no") * 14 + F.floor(F.col("line_no") / 4) * 20
    rows = made.filter(F.regexp_replace("x", r"\s", "") != "").select("doc_id", F.lit(0).alias("page"), F.col("line_no").alias("row"), "x", top.cast("double").alias("y0"))
    rows = rows.select("doc_id", "page", "row", F.translate("x", ".·_-", "").alias("text"), F.lit(0.0).alias("x0"), "y0", F.lit(900.0).alias("x1"), (F.col("y0") + 12).alias("y1"), F.lit(12.0).alias("h"), F.lit(0.9).alias("conf"), F.lit(1).cast("long").alias("n"))
    sizes = rows.select("doc_id", "page").distinct().withColumn("page_w", F.lit(5000.0))
    out = pages.paragraphs(rows, sizes)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.round(F.sum(F.col("y1") - F.col("y0")), 3).alias("heights"))


QUERIES = [row_headings, formula_lines, source_sections, complex_tables, page_paragraphs]

_W = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LN = "ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_CN = r"\x{4E00}-\x{9FFF}"
_L = r"\x{1D44E}-\x{1D467}\x{1D434}-\x{1D44D}α-ωΑ-Ω"
_N = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
_HEAD = rf"""CASE WHEN length(t) > 40 OR regexp_matches(t, '[=＝]') OR w > 720 OR regexp_matches(t, '[，、；,;]\z') THEN 0
    WHEN regexp_matches(t, '\A第[一二三四五六七八九十百\d]{{1,3}}[章节条部分]') THEN 1 WHEN regexp_matches(t, '\A[（(]?[一二三四五六七八九十]{{1,3}}[、）)．.]') THEN 2
    WHEN regexp_matches(t, '\A\d{{1,2}}(?:[.．]\d{{1,2}}){{0,3}}\s*[、.．\s]') AND length(t) <= 30 THEN least(3 + {_N(r"regexp_extract(t, '\A(\d{1,2}(?:[.．]\d{1,2}){0,3})\s*[、.．\s]', 1)", "[.．]")}, 4)
    WHEN regexp_matches(t, '[：:]\z') THEN 0 WHEN h > 27 AND length(t) <= 24 THEN 1 ELSE 0 END"""
_LETTERS3 = "regexp_extract_all(x, '[A-Za-z]{3,}')"

SQL = {
    "row_headings": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, CASE line_no % 7 WHEN 0 THEN '第三章 ' || left(line, 10) WHEN 1 THEN (line_no % 100) || '.2 ' || left(line, 20) WHEN 2 THEN left(line, 20)
            WHEN 4 THEN left(line, 15) || ':' WHEN 5 THEN '二、' || left(line, 12) WHEN 6 THEN left(line, 8) || '=1' ELSE line END AS x FROM ln),
        f AS (SELECT doc_id, regexp_replace(x, '\A{_W}+|{_W}+\z', '', 'g') AS t, 20 + line_no % 3 * 10 AS h, length(x) * 10 AS w FROM m), k AS (SELECT doc_id, {_HEAD} AS level FROM f)
        SELECT doc_id, count(*) FILTER (level > 0) AS n_headings, CAST(sum(level) AS BIGINT) AS levels, count(*) FILTER (level = 1) AS n_first FROM k GROUP BY doc_id""",
    "formula_lines": rf"""WITH {_LN}, m AS (SELECT doc_id, CASE line_no % 6 WHEN 0 THEN left(line, 12) || '=x+y' WHEN 1 THEN '(5), ' WHEN 3 THEN '站点得分=单量×' || left(line, 5) WHEN 4 THEN '𝑎' WHEN 5 THEN '30%*50=15 ' || left(line, 3) ELSE line END AS x FROM ln),
        c AS (SELECT doc_id, x, translate(regexp_replace(x, '{_W}+', '', 'g'), '％＝', '%=') AS k, regexp_replace(x, '{_W}+', '', 'g') AS c FROM m),
        s AS (SELECT doc_id, x, c, length(c) AS n, {_N("c", rf"[=+\-*/×÷√∑Σ≤≥→←↔↦(){{}}\[\]|{_L}]")} AS signs, {_N("c", "[A-Za-z]")} AS abc, regexp_matches(c, '[{_CN}]') AS cn, {_N("c", f"[{_CN}]")} AS n_cn, {_N("c", "[=＝]")} AS eq FROM c),
        p AS (SELECT *, n BETWEEN 1 AND 80 AND NOT cn AND (regexp_matches(c, '\A(?:[{_L}]|[→←↔↦]+\d*\.?|exp|sqrt|log|min|max|sum|SUM)\z') OR (signs >= 2 AND signs + abc >= greatest(3, n * 0.55))) AS frag,
            eq = 1 AND n_cn >= 4 AND n <= 160 AND regexp_matches(c, '\A[{_CN}A-Za-z0-9（）()、/+＋*× _{{}}]+[=＝].{{2,}}\z') AND NOT regexp_matches(c, '(?i)SUM|Σ|sqrt|\\frac|[上下]标') AS txt,
            n BETWEEN 10 AND 220 AND eq = 1 AND n_cn >= 8 AND regexp_matches(c, '[+＋]') AND NOT regexp_matches(c, '(?i)SUM|Σ|\\frac|_\{{|[A-Z]\s*/\s*[A-Z]') AS multi FROM s)
        SELECT doc_id, count(*) FILTER (frag) AS n_fragments,
            count(*) FILTER (n BETWEEN 1 AND 48 AND NOT cn AND regexp_matches(c, '[=≈≤≥∑Σ√⊤⊥]|[{_L}]|\A(?:Í|Í?(?:exp|sqrt|log|min|max|sum|SUM)|[(),.;0-9]+)\z')) AS n_short,
            count(*) FILTER (txt) AS n_text,
            count(*) FILTER (n >= 4 AND regexp_matches(c, '(?i)[=＝≤≥×÷√∑Σ]|SUM|\\frac|[A-Z]/[A-Z]|\d+/\d+') AND regexp_matches(c, '[A-Za-z]{{1,3}}[_{_CN}]*[=＝/]')) AS n_pictures,
            count(*) FILTER (n > 0 AND (txt OR multi OR (contains(c, '得分') AND contains(c, '权重') AND regexp_matches(c, 'W[1-4]') AND eq > 0) OR (regexp_matches(c, '\d+%[*×]\d+') AND regexp_matches(c, '[=＝]\d')))) AS n_safe,
            count(*) FILTER (n >= 4 AND NOT regexp_matches(c, '\d[一二三四五六七八九十]{{1,3}}、')) AS n_reliable
        FROM p GROUP BY doc_id""",
    "source_sections": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN '5.' || (line_no + 1) || ' 考核规则' WHEN 3 THEN '2024年3月5日' ELSE line END AS x FROM ln),
        g AS (SELECT *, line_no // 5 AS g FROM m), t AS (SELECT doc_id, g, min(line_no) AS l, regexp_replace(string_agg(x, chr(10) ORDER BY line_no), '\A{_W}+|{_W}+\z', '', 'g') AS t FROM g GROUP BY ALL)
        SELECT doc_id, '5.' || (l + 1) AS token, '考核规则' AS title, length(t) AS n_chars, l + 1 AS line_no, true AS detailed FROM t WHERE length(regexp_replace(t, '{_W}+', '', 'g')) >= 20""",
    "complex_tables": """WITH r AS (SELECT l_orderkey, l_quantity > 40 AS blank, 2 * (CAST(floor(l_quantity) AS INT) + CASE WHEN l_tax > 0.07 THEN 50 ELSE 0 END) AS n, CASE WHEN l_discount > 0.09 THEN 6 ELSE 3 END AS cols FROM lineitem),
        t AS (SELECT l_orderkey, count(*) + 1 AS n_rows, max(greatest(n, 4)) AS longest, max(cols) AS cols, count(*) FILTER (blank) AS blanks, sum(cols - CASE WHEN blank THEN 1 ELSE 0 END - CASE WHEN n = 0 THEN 1 ELSE 0 END) + 3 AS cells FROM r GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN cols > 5 THEN true WHEN longest <= 90 AND blanks = 0 THEN false WHEN longest > 140 THEN true WHEN n_rows >= 3 AND blanks >= greatest(1, n_rows // 3) THEN true ELSE false END AS is_complex, CAST(cells AS BIGINT) AS n_cells FROM t""",
    "page_paragraphs": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, line_no * 14 + line_no // 4 * 20 AS y0, CASE line_no % 7 WHEN 3 THEN '• ' || left(line, 30) WHEN 5 THEN '二、' || left(line, 9) ELSE line END AS x FROM ln),
        r AS (SELECT doc_id, line_no, y0, translate(x, '.·_-', '') AS x FROM m WHERE regexp_replace(x, '\s', '', 'g') <> ''),
        h AS (SELECT *, regexp_replace(x, '\A{_W}+|{_W}+\z', '', 'g') AS t, 12 AS h, 900 AS w FROM r),
        k AS (SELECT *, {_HEAD.replace("h > 27", "false").replace("w > 720", "false")} > 0 AS head FROM h),
        b AS (SELECT *, coalesce(lag(head) OVER w OR head OR regexp_matches(x, '\A(?:\d{{1,2}}[.．]\d{{1,2}}|[a-zA-Z][.、)）]|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]|[•·▪]|[（(]\d{{1,2}}[)）])') OR y0 - (lag(y0) OVER w + 12) > 15, true) AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        p AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS p FROM b),
        q AS (SELECT doc_id, p, bool_or(head) AS head, min(y0) AS a, max(y0) + 12 AS b, count(*) AS n, min(t) AS t FROM p GROUP BY ALL)
        SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (head AND n = 1) AS n_headings, round(sum(b - a)::DOUBLE, 3) AS heights FROM q GROUP BY doc_id""",
}
