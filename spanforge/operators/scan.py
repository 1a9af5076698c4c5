"""The pattern audit of finished Markdown: where which pattern of a pack is found, orphan page numbers, records out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, compact, trim
from . import layout

#: Findings of a kind that are kept for a document, and characters of each that are shown.
MOST, SHOWN = 8, 80
#: Residue that recognition and conversion leave in a Chinese policy document, by kind.
RESIDUE = {
    "页眉水印残留": r"(?m)保密资料|^(?!.*(?:编号|以下简称|制度|协议|内容)).*MTPS[-A-Z0-9]*.*$",
    "低置信文字残留": r"识别置信度低",
    "公式需核对": r"公式原文（需核对）|需对照原 PDF 核对",
    "旧式图片占位残留": r"!\[(?:图片|表格截图|公式)\]\(<[^>]+>\)",
    "未文本化图片占位残留": r"图片区域未能可靠文本化|不写入外部图片",
    "申诉误识别": r"中诉|甲诉|不子申诉",
    "为/沩误识别": r"沩",
    "已/己误识别": r"己离职|己经",
    "符号/数字误识别": r"项//次|工有单天数|2 0:00|8 0%",
    "目录标点噪声": r"[一二三四五六七八九十]{1,3}、[，,；;:：]",
    "目录孤立编号": r"(?m)^[一二三四五六七八九十]{1,3}、\s*$",
    "标题正文夹页码": r"协议\s+\d{1,3}本协议内容",
    "编号段落断裂": r"编号\s*\n\s*度”|主制\s*\n\s*度",
    "乱码字符残留": r"[\x{FFFD}俁仴雲抇讳冏昇銷埃門哭伿怯奂沩亥導抯]",
}
ORPHAN = "孤立页码残留"
TABLE_FALLBACK = r"表格结构识别不稳定|表格结构需核对|!\[表格截图\]"
_CONTEXT = r"目录|第\s*\d+\s*页|保密资料|协议|制度|考核"


def matches(text: Column, pattern: str, most: int = MOST) -> Column:
    """array of (line, text) of the first matches of a pattern, lines from 1."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    breaks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
    pairs = F.slice(F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), 1, most)
    empty = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("found"))

    def add(acc: Column, p: Column) -> Column:
        line = acc["line"] + breaks(p["gap"])
        return F.struct((line + breaks(p["hit"])).alias("line"), F.concat(acc["found"], F.array(F.struct(line.alias("line"), F.left(p["hit"], F.lit(SHOWN)).alias("text")))).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, empty, add)["found"]).otherwise(F.array().cast("array<struct<line:int,text:string>>"))


def pattern_matches(markdown: DataFrame, doc: str, patterns: dict[str, str] | None = None, most: int = MOST) -> DataFrame:
    """doc, type, line, text of the first matches of each pattern, over line ends too."""
    def named(kind: str, pattern: str) -> Column:
        return F.transform(matches(F.col("markdown"), pattern, most), lambda m: F.struct(F.lit(kind).alias("type"), m["line"].alias("line"), m["text"].alias("text")))

    kinds = [named(*each) for each in (RESIDUE if patterns is None else patterns).items()]
    return markdown.filter("markdown is not null").select(doc, F.explode(F.concat(*kinds)).alias("m")).select(doc, "m.*")


def orphan_numbers(markdown: DataFrame, doc: str, reach: int = 3, most: int = MOST) -> DataFrame:
    """doc, type, line, text of lines of one to three digits about which the document is Chinese: four ideographs, or a word for it,
    in the lines within reach."""
    lines = markdown.select(doc, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    w = Window.partitionBy(doc).orderBy("line_no")
    about = lambda a, b: F.collect_list("line").over(w.rowsBetween(a, b))
    near = F.array_join(F.concat(about(-reach, -1), about(1, reach)), "\n")
    fits = (F.regexp_count("_near", F.lit(f"[{CJK}]")) >= 4) | F.col("_near").rlike(_CONTEXT)
    found = lines.withColumn("_near", near).filter(trim(F.col("line")).rlike(r"\A\d{1,3}\z") & fits)
    return found.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).select(doc, F.lit(ORPHAN).alias("type"), (F.col("line_no") + 1).alias("line"), trim(F.col("line")).alias("text"))


def tail_is_cut(text: Column, endings: str, pattern: str) -> Column:
    """Does a value, white space and marks at its end aside, end in the middle of a phrase?"""
    flat = F.regexp_replace(compact(F.coalesce(text, F.lit(""))), r"[。；;，,]+\z", "")
    return flat.rlike(rf"(?:{endings})\z") | flat.rlike(pattern)


#: Fixed values of the records of a policy table: labels, cells that are no category or item, how a cut content begins, cut tails.
RECORD = {"start": "- 一级分类：", "category": "一级分类", "item": "检核项目", "content": "内容", "duty": "责任承担"}
_NO_CATEGORY, _NO_ITEM = ["内容", "项目", "检核项目", "责任承担", "说明"], ["控", "报", "舍", "建设", "配置"]
_CUT_CONTENT, _GLUED_ITEM = r"\A(?:感|设备|屏幕|理规范|违约金)", rf"\d{{1,2}}[.．]\s*[{CJK}]{{1,8}}\s+\S"
_CUT_TAIL = r"元/项/次，?整改(?:违约金)?\z"


def record_issues(markdown: DataFrame, doc: str) -> DataFrame:
    """doc, type, line, text: records of a policy table whose fields stand on one line, or whose category, item, content or duty
    cannot be."""
    lines = markdown.select(doc, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    found = layout.records(lines, doc, RECORD["start"])
    first = lines.select(doc, F.col("line_no").alias("first_line"), F.col("line").alias("_line"))
    field = lambda k: F.coalesce(F.element_at("fields", RECORD[k]), F.lit(""))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_line").rlike(f"；{RECORD['item']}：|；{RECORD['content']}："), "one line"),
            F.when(field("category").isin(_NO_CATEGORY), "category"),
            F.when(field("item") == "", "no item"),
            F.when(field("item").isin(_NO_ITEM), "item"),
            F.when(field("content").rlike(_CUT_CONTENT), "content"),
            F.when(field("content").rlike(_GLUED_ITEM), "glued item"),
            F.when((field("duty") != "") & tail_is_cut(field("duty"), "整|整改|整改违约金", _CUT_TAIL), "duty"),
        )
    )
    both = found.join(first, [doc, "first_line"])
    return both.select(doc, F.lit("中国式表格上下文异常").alias("type"), (F.col("first_line") + 1).alias("line"), F.explode(reasons).alias("text"))


def scan(markdown: DataFrame, doc: str = "doc_id", patterns: dict[str, str] | None = None) -> DataFrame:
    """doc, type, line, text: everything that the pattern audit finds, lines from 1."""
    return pattern_matches(markdown, doc, patterns).unionByName(orphan_numbers(markdown, doc)).unionByName(record_issues(markdown, doc))


def report(markdown: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, issue_count, table_fallbacks, ok of every document."""
    counts = found.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    falls = F.regexp_count(F.coalesce("markdown", F.lit("")), F.lit(TABLE_FALLBACK)).cast("long")
    out = markdown.select(doc, falls.alias("table_fallbacks")).join(counts, doc, "left")
    return out.select(doc, F.coalesce("_n", F.lit(0).cast("long")).alias("issue_count"), "table_fallbacks", F.col("_n").isNull().alias("ok"))
