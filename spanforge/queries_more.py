"""Further registered queries: functions over whole tables, neighbours, tiles, tables of rules, records, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import predicates as P
from .functions import text
from .operators import coverage, figures, intervals, layout, lines, sequences


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(_t(spark, sf_dir, "documents"), ["doc_id"])


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return _t(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.compact(x).cast("binary")).alias("compact_md5"),
        F.md5(text.fuzzy(x).cast("binary")).alias("fuzzy_md5"),
        F.md5(text.repeat_key(x).cast("binary")).alias("key_md5"),
        F.md5(text.md_escape(x).cast("binary")).alias("escaped_md5"),
        F.md5(text.latex_escape(x).cast("binary")).alias("latex_md5"),
        F.md5(text.md_cell(x).cast("binary")).alias("cell_md5"),
        F.md5(text.strip_controls(F.concat(F.lit("\x01"), x)).cast("binary")).alias("controls_md5"),
    )


def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered into their lines give headings, page numbers and leaders to find."""
    made = _lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.col("line_no").cast("string"), F.lit(".1 "), F.left("line", F.lit(30)))).when(F.col("line_no") % 5 == 1, F.concat(F.lit("- "), F.col("line_no").cast("string"), F.lit(" -"))).when(F.col("line_no") % 5 == 2, F.lit(" ..... ")).otherwise(F.col("line")))
    n = lambda c, name: F.count_if(c).alias(name)
    x = F.col("line")
    return made.groupBy("doc_id").agg(
        n(P.is_page_number(x), "n_page_numbers"), n(P.is_leader(x), "n_leaders"), n(text.numbering(x) != "", "n_numbered"), F.sum(text.heading_level(x, 0)).cast("long").alias("levels"), n(P.is_number(x), "n_numbers"), n(P.is_caption(F.concat(F.lit("Figure "), F.col("line_no").cast("string"), F.lit(": "), x)), "n_captions")
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as rectangles, against the square from 10 to 40."""
    a = G.rect(F.col("l_linenumber") * 5, F.col("l_quantity") / 2, F.col("l_linenumber") * 5 + 12, F.col("l_quantity") / 2 + 10)
    b = G.rect(F.lit(10), F.lit(10), F.lit(40), F.lit(40))
    items = _t(spark, sf_dir, "lineitem")
    return items.groupBy("l_orderkey").agg(
        F.round(F.sum(G.area(a)), 4).alias("area"), F.round(F.sum(G.overlap_ratio(a, b)), 4).alias("overlap"), F.count_if(G.inside_visual(a, b)).alias("n_inside"), F.round(F.sum(G.x_overlap(a, b)), 4).alias("x_overlap"), F.round(F.sum(G.x_match(a, b)), 4).alias("x_match")
    )


def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tall pages: the total price as height."""
    pages = _t(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 20) + 300).cast("int").alias("height"))
    out = intervals.tiles(pages)
    return out.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("tile", "y0", "y1", "own0", "own1")])


def band_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each order's span (0 to 60) that its lines cover."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("b0"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity") / 2).alias("b1"))
    merged = intervals.merge(items, ["l_orderkey"], "b0", "b1")
    spans = items.select("l_orderkey").distinct().select("l_orderkey", F.col("l_orderkey").alias("k"), F.lit(0.0).alias("y0"), F.lit(60.0).alias("y1"))
    out = intervals.covered_share(spans, merged, ["l_orderkey"], "k", "y0", "y1", "b0", "b1")
    return out.select(F.col("k").alias("l_orderkey"), F.round("share", 6).alias("share"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn: the next user turn's place, and the last assistant text's length within four turns."""
    turns = _t(spark, sf_dir, "conversations").withColumn("n", F.char_length("text"))
    after = sequences.next_index(["conv_id"], "turn", F.col("role") == "user", F.lit(-1).cast("long"))
    before = sequences.nearest(turns, ["conv_id"], "turn", "n", F.col("role") == "assistant", 4, after=False)
    return turns.select("conv_id", "turn", after.alias("next_user"), F.coalesce(before, F.lit(-1)).cast("long").alias("last_assistant"))


def slices_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation from its first assistant turn to the next user turn."""
    turns = _t(spark, sf_dir, "conversations")
    return sequences.slice_between(turns, ["conv_id"], "turn", F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn", "role")


def last_of_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    return sequences.last_by_token(turns, ["conv_id"], "role", "turn", "text").select("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    return sequences.drop_repeats(events, ["user_id"], "event_id", "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def restored_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line short and numbered, blank lines about it."""
    base = _lines(spark, sf_dir)
    made = base.withColumn("line", F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("2."), F.col("line_no").cast("string"), F.lit(" Part"))).when((F.col("line_no") % 7).isin(2, 4), F.lit("")).otherwise(F.col("line")))
    out = layout.restore_headings(made, "doc_id")
    return out.groupBy("doc_id").agg(F.count_if(F.col("line").startswith("#")).alias("n_headings"))


def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as ruling lines of like extent, 40 apart."""
    rules = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 40.0).alias("y"), F.lit(0.0).alias("x0"), (F.col("l_quantity") + 100.0).alias("x1"))
    out = figures.table_regions(rules, ["l_orderkey"])
    return out.select("l_orderkey", "y0", "y1", "x0", "x1", F.size("hy").cast("long").alias("n_rules"))


def lines_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines (by price and quantity) in the tables of their order."""
    rules = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 40.0).alias("y"), F.lit(0.0).alias("x0"), (F.col("l_quantity") + 100.0).alias("x1"))
    y = F.col("l_extendedprice") / 200
    found = _t(spark, sf_dir, "lineitem").select("l_orderkey", y.alias("y0"), (y + 10).alias("y1"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 30).alias("x1"))
    return figures.lines_of_tables(found, figures.table_regions(rules, ["l_orderkey"]), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def orphan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth line a bare number; the context is a line with a long number."""
    made = _lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 6 == 5, F.concat(F.lit(" "), (F.col("line_no") % 1000).cast("string"))).otherwise(F.col("line")))
    return coverage.orphan_numbers(made, "doc_id", r"[0-9]{5,}").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def note_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user as notes."""
    notes = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("note"), F.lit(1).alias("n"), F.col("event_id").alias("seq"))
    return coverage.note_summary(notes, "user_id").select("user_id", "note", "n", F.col("rank").cast("long").alias("rank"))


def outside_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth line made a fence mark."""
    made = _lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 9 == 4, F.lit("```")).otherwise(F.col("line")))
    return lines.outside_fences(made, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def watermark_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppression ladder over lines of orders: flags from their columns."""
    items = _t(spark, sf_dir, "lineitem").withColumn("text", F.col("l_linenumber").cast("string"))
    out = lines.suppression(
        items, F.col("l_quantity") > 45, F.col("l_discount") > 0.09, F.col("l_returnflag") == "R", F.col("l_tax") > 0.06, F.col("l_linestatus") == "O", F.col("l_quantity") < 5, F.lit(2), F.col("text")
    )
    return out.groupBy("l_suppkey", F.coalesce("dropped", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if("counted").alias("n_counted"))


def covering_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as source sections, assistant turns as the output; numbers and terms that are lost."""
    turns = _t(spark, sf_dir, "conversations")
    token = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("string")
    numbered = turns.withColumn("token", token)
    source = numbered.filter("role = 'user'").select("conv_id", "token", F.lit("t").alias("title"), F.col("text"), F.col("turn").alias("first"))
    output = numbered.filter("role = 'assistant'").select("conv_id", "token", "text")
    return coverage.section_issues(source, output, ["conv_id"], ["the", "of", "and", "in", "is"], ["token ="])


QUERIES = [
    text_functions, predicate_counts, rectangles, page_tiles, band_cover, neighbours, slices_between, last_of_token, drop_repeats, restored_headings, ruled_tables, lines_in_tables,
    orphan_numbers, note_summary, outside_fences, watermark_ladder, covering_sections,
]

_W = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LN = "ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_REGIONS = """r AS (SELECT l_orderkey, l_linenumber * 40.0::DOUBLE AS y, 0.0::DOUBLE AS x0, l_quantity + 100.0 AS x1 FROM lineitem),
    j AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 100 AND (least(x1, lag(x1) OVER w) - 0) / greatest(x1, lag(x1) OVER w) >= 0.6 THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, x0, x1)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY y, x0, x1 ROWS UNBOUNDED PRECEDING) AS region FROM j),
    reg AS (SELECT l_orderkey, min(y) AS y0, max(y) AS y1, min(x0) AS x0, max(x1) AS x1, count(DISTINCT y) AS n_rules FROM g GROUP BY l_orderkey, region HAVING count(DISTINCT y) >= 3)"""

SQL = {
    "text_functions": rf"""SELECT doc_id, md5(regexp_replace(text, '{_W}+', '', 'g')) AS compact_md5, md5(regexp_replace(text, '[^0-9A-Za-z\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS fuzzy_md5,
        md5(regexp_replace(regexp_replace(text, '{_W}+', '', 'g'), '\p{{Nd}}+', '#', 'g')) AS key_md5, md5(regexp_replace(text, '([*_`\[\]])', '\\\1', 'g')) AS escaped_md5, md5(regexp_replace(text, '([\\{{}}])', '\\\1', 'g')) AS latex_md5,
        md5(replace(regexp_replace(regexp_replace(regexp_replace(text, '\A{_W}+|{_W}+\z', '', 'g'), '\s*\n\s*', '；', 'g'), '([*_`\[\]])', '\\\1', 'g'), '|', '\|')) AS cell_md5, md5(text) AS controls_md5 FROM documents""",
    "predicate_counts": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN line_no || '.1 ' || left(line, 30) WHEN 1 THEN '- ' || line_no || ' -' WHEN 2 THEN ' ..... ' ELSE line END AS x FROM ln),
        f AS (SELECT doc_id, x, line_no, regexp_extract(x, '\A(\d{{1,2}}(?:[.．]\d{{1,2}}){{0,4}})[.．]?\s*\S', 1) AS num FROM m)
        SELECT doc_id, count(*) FILTER (regexp_matches(regexp_replace(x, '{_W}+', '', 'g'), '\A(?:[-–—]?\d{{1,4}}[-–—]?|第\d{{1,4}}页|(?i:page\d{{1,4}}(?:of\d{{1,4}})?))\z')) AS n_page_numbers,
            count(*) FILTER (regexp_matches(x, '\A[\s.。·•．…⋯\-_]+\z')) AS n_leaders, count(*) FILTER (num <> '') AS n_numbered,
            CAST(sum(CASE WHEN num = '' THEN 0 ELSE least(greatest(len(string_split(num, '.')) + 1, 2), 6) END) AS BIGINT) AS levels, count(*) FILTER (regexp_matches(x, '\A\d+(\.\d+)?\z')) AS n_numbers, count(*) AS n_captions FROM f GROUP BY doc_id""",
    "rectangles": """WITH a AS (SELECT l_orderkey, l_linenumber * 5.0 AS x0, l_quantity / 2 AS y0, l_linenumber * 5.0 + 12 AS x1, l_quantity / 2 + 10 AS y1 FROM lineitem),
        o AS (SELECT *, greatest(least(x1, 40) - greatest(x0, 10), 0) AS ox, greatest(least(y1, 40) - greatest(y0, 10), 0) AS oy FROM a)
        SELECT l_orderkey, round(sum(120.0::DOUBLE), 4) AS area, round(sum(ox * oy / 120.0::DOUBLE), 4) AS overlap, count(*) FILTER (ox * oy / 120 >= 0.55 OR ((x0 + x1) / 2 BETWEEN 10 AND 40 AND (y0 + y1) / 2 BETWEEN 10 AND 40)) AS n_inside,
               round(sum(ox / 12.0::DOUBLE), 4) AS x_overlap, round(sum(ox / 30.0::DOUBLE), 4) AS x_match FROM o GROUP BY l_orderkey""",
    "page_tiles": """WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice / 20) + 300 AS BIGINT) AS h FROM orders), t AS (SELECT o_orderkey, h, unnest(range(0, greatest(h - 240, 1), 1560)) AS y0 FROM p),
        u AS (SELECT *, least(y0 + 1800, h) AS y1 FROM t)
        SELECT o_orderkey, CAST(y0 // 1560 AS BIGINT) AS tile, y0, y1, CASE WHEN y0 = 0 THEN 0 ELSE y0 + 120 END AS own0, CASE WHEN y1 >= h THEN y1 ELSE y1 - 120 END AS own1 FROM u""",
    "band_cover": """WITH i AS (SELECT l_orderkey, l_linenumber * 10.0::DOUBLE AS a, l_linenumber * 10.0::DOUBLE + l_quantity / 2 AS b FROM lineitem),
        m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
        c AS (SELECT l_orderkey, greatest(0, least(b, 60) - greatest(a, coalesce(p, 0), 0)) AS c FROM m) SELECT l_orderkey, round(sum(c) / 60.0, 6) AS share FROM c GROUP BY l_orderkey""",
    "neighbours": """SELECT conv_id, turn, coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_user,
        coalesce(lag(CASE WHEN role = 'assistant' THEN length(text) END, 1) OVER w, lag(CASE WHEN role = 'assistant' THEN length(text) END, 2) OVER w, lag(CASE WHEN role = 'assistant' THEN length(text) END, 3) OVER w, lag(CASE WHEN role = 'assistant' THEN length(text) END, 4) OVER w, -1) AS last_assistant
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "slices_between": """WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS f FROM conversations GROUP BY conv_id), s AS (SELECT c.conv_id, f, min(turn) FILTER (role = 'user' AND turn > f) AS s FROM conversations c JOIN f USING (conv_id) GROUP BY ALL)
        SELECT c.conv_id, turn, role FROM conversations c JOIN s ON c.conv_id = s.conv_id WHERE turn >= f AND (s IS NULL OR turn < s)""",
    "last_of_token": "SELECT conv_id, role, md5(max_by(text, turn)) AS text_md5 FROM conversations GROUP BY ALL",
    "drop_repeats": "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) AS n FROM l WHERE p IS NULL OR p <> event_type GROUP BY user_id",
    "restored_headings": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN '2.' || line_no || ' Part' WHEN line_no % 7 IN (2, 4) THEN '' ELSE line END AS x FROM ln),
        n AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
        SELECT doc_id, count(*) FILTER (starts_with(x, '#') OR (coalesce(p, '') = '' AND coalesce(q, '') = '' AND regexp_matches(x, '\A\d{{1,2}}\.\d{{1,2}}(\.\d{{1,2}})*\.?\s*\S') AND length(x) <= 60 AND NOT regexp_matches(x, '[。；;，,.:：]\z'))) AS n_headings FROM n GROUP BY doc_id""",
    "ruled_tables": f"WITH {_REGIONS} SELECT * FROM reg",
    "lines_in_tables": f"""WITH {_REGIONS}, t AS (SELECT row_number() OVER () AS i, l_orderkey, l_extendedprice / 200 AS y0, l_quantity AS x0 FROM lineitem)
        SELECT l_orderkey, count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM reg WHERE reg.l_orderkey = t.l_orderkey AND t.y0 + 5 BETWEEN reg.y0 - 6 AND reg.y1 + 6 AND t.x0 + 30 > reg.x0 - 20 AND t.x0 < reg.x1 + 20) GROUP BY l_orderkey""",
    "orphan_numbers": rf"""WITH {_LN}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 5 THEN ' ' || (line_no % 1000) ELSE line END AS x FROM ln), c AS (SELECT *, CASE WHEN regexp_matches(x, '[0-9]{{5,}}') THEN 1 ELSE 0 END AS c FROM m),
        n AS (SELECT *, greatest(coalesce(max(c) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), coalesce(max(c) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0)) AS near FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        k AS (SELECT doc_id, line_no, trim(x) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM n WHERE near = 1 AND regexp_matches(trim(x), '\A\d{{1,3}}\z')) SELECT doc_id, line_no + 1 AS line_no, line FROM k WHERE k <= 8""",
    "note_summary": """WITH g AS (SELECT user_id, event_type AS note, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, note, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM g""",
    "outside_fences": f"""WITH {_LN}, m AS (SELECT doc_id, line_no, line_no % 9 = 4 OR regexp_matches(line, '\\A\\s*```') AS mk FROM ln), o AS (SELECT *, sum(CASE WHEN mk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS o FROM m)
        SELECT doc_id, count(*) AS n FROM o WHERE o = 0 AND NOT mk GROUP BY doc_id""",
    "watermark_ladder": r"""WITH d AS (SELECT l_suppkey, CASE WHEN l_quantity > 45 THEN 'table' WHEN l_discount > 0.09 THEN 'visual' WHEN l_returnflag = 'R' AND l_tax > 0.06 THEN 'header_footer' WHEN l_tax > 0.06 AND regexp_matches(CAST(l_linenumber AS VARCHAR), '\A\d{1,4}\z') THEN 'page_number'
        WHEN l_returnflag = 'R' AND (l_linestatus = 'O' OR l_quantity < 5) THEN 'watermark' WHEN l_linestatus = 'O' THEN 'watermark' ELSE 'kept' END AS reason FROM lineitem) SELECT l_suppkey, reason, count(*) AS n, count(*) FILTER (reason = 'watermark') AS n_counted FROM d GROUP BY ALL""",
}
