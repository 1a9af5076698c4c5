"""The registered queries of the document-structure operators, over whole tables, and their SQL.

Tables stand in for the engine's own inputs where the shape is the same: a source for a document and its documents for
pages, order lines for geometry, events for places on a tall page. Each query names its stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_more, queries_pages
from .functions import geometry as G
from .functions import grids, text
from .functions import predicates as P
from .operators import blocks as B
from .operators import coverage, folds, intervals, lines, rules, sequences, vote
from .plans.convert import convert_pages
from .sinks import markdown
from .sources.pages import html_blocks

#: What the queries ask for.
CONFUSIONS = [("ê", "e"), ("ç", "c"), ("ö", "o"), ("ß", "s"), ("ñ", "n"), ("z", "s")]
PATTERNS = {"license": r"Licensed under", "secret": r"token = ", "shout": r"[A-Z]{3,}!!", "pipes": r" \| ", "number": r"\d{4,}"}
TERMS = ["License", "example.com", "token", "Apache", "the", "tion", "und", "que"]
DANGLING = ["the", "of", "and", "der", "und", "de", "la", "el"]
GRID_ROWS, GRID_COLUMNS = [1.0, 11.0, 21.0, 31.0, 41.0, 51.0], [0.0, 0.025, 0.055, 0.085, 0.2]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds() -> Column:
    """Of ts, a time without zone, since 1970."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) / 1e6D")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(_t(spark, sf_dir, "documents"), ["source", "doc_id"])


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.keyed_lines(_lines(spark, sf_dir), F.col("line"), ["source", "doc_id", "line_no"])


def _repeated(keyed: DataFrame) -> DataFrame:
    return lines.repeated_of(keyed, "source", "doc_id", F.col("line_no"), min_pages=3, min_share=0.0)


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(_keyed(spark, sf_dir))


def strip_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir)
    out = lines.strip_repeated(_t(spark, sf_dir, "documents"), "source", "doc_id", _repeated(keyed), keyed=keyed)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.readability(_lines(spark, sf_dir))
    return found.groupBy("doc_id", "issue").agg(F.count(F.lit(1)).alias("n"), (F.min("line_no") + 1).cast("long").alias("first_line"))


def paragraph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.paragraphs(_lines(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("first_line").cast("long").alias("first_line"), "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.bigrams(_t(spark, sf_dir, "documents"), "source")


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return vote.votes(docs, "source", "doc_id", CONFUSIONS).select("doc_id", F.col("pos").cast("long").alias("pos"), "old", "new")


def garbled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("​‍"))).otherwise(F.col("text")))
    return docs.select("doc_id", F.round(P.garbled_score(F.col("text")), 9).alias("score"))


def truncated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", r"[.,]\z", ""))
    return cut.filter(P.looks_truncated(F.col("line"), DANGLING)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


def numeric_anchors_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source: the text; output: the text without lines above 420 characters."""
    docs = _t(spark, sf_dir, "documents").withColumn("out", F.array_join(F.filter(F.split("text", "\n"), lambda x: F.char_length(x) <= 420), "\n"))
    missing = text.missing_numbers(F.col("text"), F.col("out"))
    return docs.select("doc_id", F.size(missing).cast("long").alias("n_missing"), F.array_join(missing, ",").alias("missing"))


def seen_but_missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("out", F.array_join(F.filter(F.split("text", "\n"), lambda x: F.char_length(x) <= 420), "\n"))
    missing = coverage.missing_terms(docs, TERMS, "text", "out")
    return docs.select("doc_id", F.size(missing).cast("long").alias("n_missing"), F.array_join(missing, ",").alias("missing"))


def pattern_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.pattern_findings(_lines(spark, sf_dir), "doc_id", PATTERNS)


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    split = _lines(spark, sf_dir)
    issues = lines.readability(split).select("doc_id", F.col("issue").alias("check"))
    secrets = split.filter(F.col("line").rlike(PATTERNS["secret"])).select("doc_id", F.lit("secret").alias("check"))
    return coverage.quality_gate(docs, issues.unionByName(secrets), "doc_id", ["secret", "glued_formula"])


def section_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn opens a section of a conversation."""
    turns = _t(spark, sf_dir, "conversations")
    out = sequences.section_text(sequences.sections(turns, ["conv_id"], "turn", F.col("role") == "user"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "section", F.col("first").alias("first_turn"), "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, an hour of value after value: a session goes on while the next starts 6 hours or less after its end."""
    seconds = _seconds()
    events = _t(spark, sf_dir, "events")
    found = intervals.sessions(events, ["user_id"], F.struct(seconds, "event_id"), seconds, seconds + F.coalesce("value", F.lit(0.0)), 6 * 3600.0)
    return found.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as intervals: 10 apart, as long as half their quantity."""
    start = F.col("l_linenumber") * 10.0
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("a"), (start + F.col("l_quantity") / 2).alias("b"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_order_intervals(spark, sf_dir), ["l_orderkey"], "a", "b")


def uncovered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(_order_intervals(spark, sf_dir), ["l_orderkey"], "a", "b")
    return intervals.uncovered(merged, ["l_orderkey"], "a", "b", F.lit(0.0), F.lit(100.0), 5.0)


def forward_backward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand on lines of the first return flag only; lines with a quantity above 5 carry payload."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("label"), "l_quantity", "l_partkey", "l_suppkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    filled = sequences.fill_both(rows, ["l_orderkey"], order, ["label"], F.col("l_quantity") > 5)
    return filled.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_filled"), F.count_if(F.col("label") == "F").alias("n_f"))


def range_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands: 10 % around each supplier's account balance, scaled; lines whose price lies in their supplier's band."""
    bands = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.abs("s_acctbal") * 5).alias("y0"), (F.abs("s_acctbal") * 6 + 5000).alias("y1"))
    items = _t(spark, sf_dir, "lineitem")
    inside = intervals.in_bands(items, bands, ["l_suppkey"], F.col("l_extendedprice"), "y0", "y1")
    outside = intervals.in_bands(items, bands, ["l_suppkey"], F.col("l_extendedprice"), "y0", "y1", "left_anti")
    count = lambda df, n: df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias(n))
    return count(items, "n").join(count(inside, "n_in"), "l_suppkey", "left").join(count(outside, "n_out"), "l_suppkey", "left").fillna(0)


def periodic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", _seconds().alias("y"))
    found = intervals.periodic(events, ["user_id", "event_type"], "y", 3, 0.0, 0.9)
    return found.select("user_id", "event_type", "n", F.round("median_gap", 3).alias("median_gap"), F.round("cv", 6).alias("cv"))


def grid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in the cells of a fixed grid: quantity for y, discount for x."""
    edges = lambda xs: F.array(*[F.lit(x) for x in xs])
    items = _t(spark, sf_dir, "lineitem").withColumn("line", F.col("l_partkey").cast("string"))
    out = intervals.grid_cells(items, ["l_orderkey"], G.bucket(F.col("l_quantity"), edges(GRID_ROWS)), G.bucket(F.col("l_discount"), edges(GRID_COLUMNS)), ["l_linenumber", "l_partkey"], "line")
    return out.select("l_orderkey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text", "n")


def sample_wraparound(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.wrap_sample(_t(spark, sf_dir, "customer"), "c_custkey", 40, 1480)
    return out.select("pick", "c_custkey", "c_name")


def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with a quantity above 20 as numbered children."""
    items = _t(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 20)
    return sequences.numbering_gaps(items, "l_orderkey", "l_linenumber").select("l_orderkey", F.col("missing").cast("long").alias("missing"))


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _lines(spark, sf_dir).select(text.compact(F.col("line")).alias("key"), "doc_id", "line_no").filter("key <> ''")
    first = sequences.keep_first(split.withColumn("at", F.struct("doc_id", "line_no")), ["key"], "at")
    return first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_first"))


def near_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a long turn within two on either side."""
    turns = _t(spark, sf_dir, "conversations")
    flagged = turns.withColumn("near", sequences.near_flag(["conv_id"], "turn", F.char_length("text") > 300, 2))
    return flagged.select("conv_id", "turn", "near")


def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the order of their values, checked against their times."""
    events = _t(spark, sf_dir, "events").withColumn("day", F.dayofyear("ts")).withColumn("o", F.struct("value", "event_id"))
    return sequences.order_violations(events, ["user_id"], "o", "day", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pipes as grids: a line is a row, pipes part cells."""
    docs = _t(spark, sf_dir, "documents").filter(F.contains("text", F.lit(" | ")))
    rows = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda r: F.split(r, r" \| ")).alias("rows"))
    return rows.select(
        "doc_id",
        F.size("rows").cast("long").alias("n_rows"),
        grids.filled_cells(F.col("rows")).cast("long").alias("filled"),
        F.array_max(F.transform("rows", F.size)).cast("long").alias("width"),
        F.md5(F.array_join(grids.pipe_table(F.col("rows")), "\n").cast("binary")).alias("table_md5"),
    )


def html_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks(_t(spark, sf_dir, "pages"))
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return found.groupBy("page_id").agg(n(F.col("kind") == "heading", "n_headings"), n((F.col("kind") == "item") & (F.col("area") == "nav"), "n_nav_items"))


def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = convert_pages(_t(spark, sf_dir, "pages"))
    return done.markdown.select("page_id", F.char_length("markdown").cast("long").alias("n_chars"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def convert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(_t(spark, sf_dir, "pages")).summary


def provenance_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(_t(spark, sf_dir, "pages")).ledger.groupBy("page_id", "stage").agg(F.count(F.lit(1)).alias("n"))


def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = lines.wrap_lines(_lines(spark, sf_dir), text.wrap(F.col("line"), 180), "doc_id")
    return wrapped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.char_length("line")).cast("long").alias("longest"))


def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as recognised lines: price for y, discount for x."""
    items = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line_no"), F.col("l_discount").alias("x0"), (F.col("l_extendedprice") / 100).alias("y0"), (F.col("l_extendedprice") / 100 + F.col("l_quantity")).alias("y1")
    )
    found = folds.cluster_rows(items, ["l_orderkey"])
    return found.groupBy("l_orderkey").agg((F.max("row") + 1).cast("long").alias("n_rows"), F.max("place").cast("long").alias("last_place"))


def normalised_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.notes(_t(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("e "), F.lit("e   "))), "doc_id", "text")


def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_blocks(_t(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "seq", "kind", F.regexp_replace("text", r"[.,]\z", "").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"), F.array().cast("array<string>").alias("flags"))
    return B.scan(blocks, ["Metric", "Value"]).groupBy("doc_id", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def render_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of their lines, rendered as Markdown."""
    items = _t(spark, sf_dir, "lineitem")
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_shipmode") if "l_shipmode" in items.columns else F.col("l_returnflag"))
    tables = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("cells")))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flag"))), F.transform("r", lambda s: s["cells"]))
    out = markdown.render(tables.select("l_orderkey", F.lit(0).alias("seq"), F.lit("table").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), rows.alias("rows")), "l_orderkey", has_rows=True)
    return out.select("l_orderkey", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


QUERIES = [
    repeated_lines, strip_repeated, readability, paragraph_fold, bigram_counts, majority_vote, garbled_scores, truncated_lines, numeric_anchors_missing,
    seen_but_missing_terms, pattern_audit, quality_gate, section_slices, gap_sessions, interval_merge, uncovered_gaps, forward_backward_fill, range_semi_anti,
    periodic_gaps, grid_assignment, sample_wraparound, numbering_gaps, keep_first, near_flags, order_check, table_grids, html_block_counts, markdown_render,
    convert_summary, provenance_ledger, wrap_lines, row_clusters, normalised_notes, block_scan, render_tables,
]


def queries() -> dict:
    return {q.__name__: q for q in [*QUERIES, *queries_more.QUERIES, *queries_pages.QUERIES]}


_W = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = lambda x: f"regexp_replace({x}, '\\A{_W}+|{_W}+\\z', '', 'g')"
_LINES = "ln AS (SELECT source, doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_REPEATED = rf"""{_LINES},
    k AS (SELECT source, doc_id, line_no, regexp_replace(regexp_replace(line, '{_W}+', '', 'g'), '\p{{Nd}}+', '#', 'g') AS key, CAST(round_even(line_no / 20.0, 0) AS BIGINT) AS bucket FROM ln),
    pg AS (SELECT source, count(DISTINCT doc_id) AS pages FROM k GROUP BY source),
    hb AS (SELECT source, key, bucket, count(*) AS n FROM k WHERE length(key) >= 2 GROUP BY ALL),
    md AS (SELECT source, key, CAST(sum(n) AS BIGINT) AS n_lines, max(n) AS at_height FROM hb GROUP BY ALL),
    sp AS (SELECT source, key, count(DISTINCT doc_id) AS n_pages FROM k WHERE length(key) >= 2 GROUP BY ALL),
    rep AS (SELECT sp.source, sp.key, n_pages, n_lines, at_height FROM sp JOIN md ON sp.source = md.source AND sp.key = md.key JOIN pg ON pg.source = sp.source
            WHERE n_pages >= 3 AND pages >= 3 AND at_height >= 0.8 * n_pages)"""
_SHORT = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) <= 420), chr(10))"
_COMPACT = lambda x: rf"translate(regexp_replace({x}, '{_W}+', '', 'g'), '％＝', '%=')"
_FINDINGS = rf"""fi AS (SELECT doc_id, line_no, unnest(list_filter([
        CASE WHEN (length(t) - length(replace(t, '<br>', ''))) / 4 >= 2 THEN 'dense_breaks' END,
        CASE WHEN length(t) > 420 AND NOT starts_with(t, '$$') THEN 'long_line' END,
        CASE WHEN contains(t, '$$') AND t <> '$$' AND NOT (starts_with(t, '$$') AND ends_with(t, '$$')) THEN 'glued_formula' END,
        CASE WHEN regexp_matches(t, '\|[^|]*[^|\s][^|]*\|') AND len(list_filter(string_split(t, '|'), lambda c: length(c) >= 90)) > 0 AND length(t) - length(replace(t, '|', '')) >= 2 THEN 'long_cell' END
    ], lambda x: x IS NOT NULL)) AS issue FROM (SELECT doc_id, line_no, {_TRIM("line")} AS t FROM ln))"""

SQL = {
    "repeated_lines": f"WITH {_REPEATED} SELECT * FROM rep",
    "strip_repeated": f"""WITH {_REPEATED},
        g AS (SELECT k.doc_id, k.line_no FROM k JOIN rep ON k.source = rep.source AND k.key = rep.key),
        t AS (SELECT ln.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed, string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY ln.line_no) AS t
              FROM ln LEFT JOIN g ON ln.doc_id = g.doc_id AND ln.line_no = g.line_no GROUP BY ln.doc_id)
        SELECT doc_id, n_lines, n_removed, md5(coalesce(t, '')) AS text_md5 FROM t""",
    "readability": f"WITH {_LINES}, {_FINDINGS} SELECT doc_id, issue, count(*) AS n, min(line_no) + 1 AS first_line FROM fi GROUP BY ALL",
    "paragraph_fold": rf"""WITH {_LINES}, b AS (SELECT doc_id, line_no, line, {_TRIM("line")} AS t, lag(line) OVER w AS p FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        m AS (SELECT *, CASE WHEN p IS NOT NULL AND {_TRIM("p")} <> '' AND NOT regexp_matches({_TRIM("p")}, '[.!?。！？;；:：]\z') AND regexp_matches(line, '\A\s*[a-z]') THEN 0 ELSE 1 END AS brk FROM b),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) AS isl FROM m),
        g AS (SELECT doc_id, isl, min(line_no) AS first_line, count(*) AS n_lines, md5(string_agg(t, ' ' ORDER BY line_no)) AS text_md5 FROM i WHERE t <> '' GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS paragraph, first_line, n_lines, text_md5 FROM g""",
    "bigram_counts": """SELECT source, bigram, count(*) AS n FROM (SELECT source, unnest(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS bigram FROM documents) GROUP BY ALL""",
    "majority_vote": """WITH bg AS (SELECT source, bigram, count(*) AS n FROM (SELECT source, unnest(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS bigram FROM documents) GROUP BY ALL),
        p(old, new, rank) AS (VALUES ('ê','e',0), ('ç','c',1), ('ö','o',2), ('ß','s',3), ('ñ','n',4), ('z','s',5)),
        c AS (SELECT source, doc_id, text, unnest(range(1, length(text) + 1)) AS pos FROM documents),
        o AS (SELECT source, doc_id, pos, substring(text, pos, 1) AS old, CASE WHEN pos > 1 THEN substring(text, pos - 1, 1) END AS b, CASE WHEN pos < length(text) THEN substring(text, pos + 1, 1) END AS a FROM c),
        t AS (SELECT o.*, p.new, p.rank FROM o JOIN p ON o.old = p.old),
        v AS (SELECT t.*, greatest(coalesce(o1.n, 0), coalesce(o2.n, 0)) AS so, greatest(coalesce(n1.n, 0), coalesce(n2.n, 0)) AS sn FROM t
            LEFT JOIN bg o1 ON o1.source = t.source AND o1.bigram = t.b || t.old LEFT JOIN bg o2 ON o2.source = t.source AND o2.bigram = t.old || t.a
            LEFT JOIN bg n1 ON n1.source = t.source AND n1.bigram = t.b || t.new LEFT JOIN bg n2 ON n2.source = t.source AND n2.bigram = t.new || t.a)
        SELECT doc_id, pos, old, min_by(new, rank) AS new FROM v WHERE sn >= 3 AND sn >= 3 * greatest(so, 1) GROUP BY doc_id, pos, old""",
    "garbled_scores": rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(8203) || chr(8205) ELSE text END AS t FROM documents),
        c AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\x{{80}}-\x{{9F}}]|\x{{AD}}|[\x{{200B}}-\x{{200F}}]|[\x{{2060}}-\x{{2064}}]|\x{{FEFF}}')) AS odd, len(regexp_extract_all(t, '[^\x00-\x7F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')) AS beyond FROM d)
        SELECT doc_id, round(CASE WHEN regexp_matches(t, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]|\(cid:[0-9]+\)') THEN 1.0 WHEN beyond = 0 THEN 0.0 ELSE odd / beyond END, 9) AS score FROM c""",
    "truncated_lines": rf"""WITH {_LINES}, t AS (SELECT doc_id, line_no, {_TRIM("regexp_replace(line, '[.,]\\z', '')")} AS t FROM ln)
        SELECT doc_id, count(*) AS n, min(line_no) AS first_line FROM t WHERE length(t) >= 12 AND regexp_matches(t, '(?:\A|{_W})(?:the|of|and|der|und|de|la|el)\z') GROUP BY doc_id""",
    "numeric_anchors_missing": rf"""WITH d AS (SELECT doc_id, text, {_SHORT} AS o FROM documents),
        m AS (SELECT doc_id, o, list_transform(regexp_extract_all(regexp_replace(text, '([A-Za-z])\d', '\1!', 'g'), '\d+(?:[.,]\d+)?{_W}*(?:%|％|s|S|秒|分|单|天气|天|公里|km|KM)?'), lambda t: replace({_COMPACT("t")}, ',', '')) AS ts FROM d),
        f AS (SELECT doc_id, o, list_filter(ts, lambda t: NOT regexp_matches(t, '\A\d{{1,2}}\z|天气\z')) AS ts FROM m),
        u AS (SELECT doc_id, o, list_transform(range(1, len(ts) + 1), lambda i: {{'i': i, 't': ts[i]}}) AS ts FROM f),
        e AS (SELECT doc_id, min(i) AS i, t FROM (SELECT doc_id, unnest(ts).i AS i, unnest(ts).t AS t FROM u) GROUP BY doc_id, t),
        r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
        x AS (SELECT r.doc_id, r.t, r.k FROM r JOIN d ON r.doc_id = d.doc_id WHERE k <= 80
              AND NOT contains(translate({_COMPACT("o")}, ',，', ''), translate(t, '％', '%')) AND NOT contains(translate({_COMPACT("o")}, ',，', ''), regexp_replace(translate(t, '％', '%'), '\.0\z', ''))
              AND NOT contains(translate({_COMPACT("o")}, ',，', ''), regexp_replace(translate(t, '％', '%'), '[sS]\z', '')))
        SELECT d.doc_id, count(x.t) AS n_missing, coalesce(string_agg(x.t, ',' ORDER BY x.k), '') AS missing FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id""",
    "seen_but_missing_terms": rf"""WITH d AS (SELECT doc_id, {_COMPACT("text")} AS a, {_COMPACT(_SHORT)} AS b FROM documents),
        m AS (SELECT doc_id, list_filter(['License', 'example.com', 'token', 'Apache', 'the', 'tion', 'und', 'que'], lambda t: contains(a, t) AND NOT contains(b, t)) AS m FROM d)
        SELECT doc_id, len(m) AS n_missing, array_to_string(m, ',') AS missing FROM m""",
    "pattern_audit": rf"""WITH {_LINES}, h AS (SELECT doc_id, line_no, unnest(list_filter([CASE WHEN regexp_matches(line, 'Licensed under') THEN 'license' END, CASE WHEN regexp_matches(line, 'token = ') THEN 'secret' END,
        CASE WHEN regexp_matches(line, '[A-Z]{{3,}}!!') THEN 'shout' END, CASE WHEN regexp_matches(line, ' \| ') THEN 'pipes' END, CASE WHEN regexp_matches(line, '\d{{4,}}') THEN 'number' END], lambda x: x IS NOT NULL)) AS type FROM ln)
        SELECT doc_id, type, least(count(*), 8) AS n_found, min(line_no) + 1 AS first_line FROM h GROUP BY ALL""",
    "quality_gate": rf"""WITH {_LINES}, {_FINDINGS}, i AS (SELECT doc_id, issue FROM fi UNION ALL SELECT doc_id, 'secret' FROM ln WHERE regexp_matches(line, 'token = '))
        SELECT d.doc_id, count(*) FILTER (issue IN ('secret', 'glued_formula')) AS n_blocking, count(*) FILTER (issue NOT IN ('secret', 'glued_formula')) AS n_warnings,
               count(*) FILTER (issue IN ('secret', 'glued_formula')) = 0 AS quality_ok FROM documents d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id""",
    "section_slices": """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
        SELECT conv_id, CAST(section AS BIGINT) AS section, min(turn) AS first_turn, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM s GROUP BY conv_id, section""",
    "gap_sessions": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + coalesce(value, 0) AS b FROM events),
        m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
        s AS (SELECT *, sum(CASE WHEN a - p <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS session FROM m)
        SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, session""",
    "interval_merge": """WITH i AS (SELECT l_orderkey, l_linenumber * 10.0::DOUBLE AS a, l_linenumber * 10.0::DOUBLE + l_quantity / 2 AS b FROM lineitem),
        m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
        s AS (SELECT *, sum(CASE WHEN a <= p THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS n FROM s GROUP BY l_orderkey, k""",
    "uncovered_gaps": """WITH i AS (SELECT l_orderkey, l_linenumber * 10.0::DOUBLE AS a, l_linenumber * 10.0::DOUBLE + l_quantity / 2 AS b FROM lineitem),
        m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
        g AS (SELECT l_orderkey, coalesce(p, 0.0::DOUBLE) AS gap_start, a AS gap_end FROM m WHERE a > coalesce(p, 0) UNION ALL SELECT l_orderkey, max(b), 100.0::DOUBLE FROM i GROUP BY l_orderkey)
        SELECT * FROM g WHERE gap_end - gap_start >= 5""",
    "forward_backward_fill": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS label FROM lineitem),
        f AS (SELECT *, CASE WHEN l_quantity > 5 THEN last_value(label IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE label END AS l1 FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
        b AS (SELECT *, CASE WHEN l_quantity > 5 THEN coalesce(l1, first_value(l1 IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ELSE l1 END AS l2 FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
        SELECT l_orderkey, count(*) AS n, count(l2) AS n_filled, count(*) FILTER (l2 = 'F') AS n_f FROM b GROUP BY l_orderkey""",
    "range_semi_anti": """WITH x AS (SELECT l_suppkey, l_extendedprice BETWEEN abs(s_acctbal) * 5 AND abs(s_acctbal) * 6 + 5000 AS i FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)
        SELECT l_suppkey, count(*) AS n, count(*) FILTER (i) AS n_in, count(*) FILTER (i IS NOT TRUE) AS n_out FROM x GROUP BY l_suppkey""",
    "periodic_gaps": """WITH g AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events),
        s AS (SELECT user_id, event_type, count(*) AS n, min(gap) AS l, median(gap) AS m, stddev_pop(gap) / greatest(avg(gap), 1) AS cv FROM g GROUP BY ALL)
        SELECT user_id, event_type, n, round(m, 3) AS median_gap, round(cv, 6) AS cv FROM s WHERE n >= 3 AND l >= 0 AND cv <= 0.9""",
    "grid_assignment": """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 1 AND l_quantity < 11 THEN 0 WHEN l_quantity >= 11 AND l_quantity < 21 THEN 1 WHEN l_quantity >= 21 AND l_quantity < 31 THEN 2 WHEN l_quantity >= 31 AND l_quantity < 41 THEN 3 WHEN l_quantity >= 41 AND l_quantity < 51 THEN 4 END AS r,
        CASE WHEN l_discount >= 0 AND l_discount < 0.025 THEN 0 WHEN l_discount >= 0.025 AND l_discount < 0.055 THEN 1 WHEN l_discount >= 0.055 AND l_discount < 0.085 THEN 2 WHEN l_discount >= 0.085 AND l_discount < 0.2 THEN 3 END AS c FROM lineitem)
        SELECT l_orderkey, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS text, count(*) AS n FROM g WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY ALL""",
    "sample_wraparound": """WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i, n FROM customer, n),
        p AS (SELECT c_custkey, c_name, ((i - 1480 % n) % n + n) % n AS pick, n FROM r) SELECT pick, c_custkey, c_name FROM p WHERE pick < least(40, n)""",
    "numbering_gaps": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20), g AS (SELECT l_orderkey, l_linenumber AS b, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a FROM d)
        SELECT l_orderkey, CAST(unnest(range(a + 1, b)) AS BIGINT) AS missing FROM g WHERE b - a > 1""",
    "keep_first": rf"""WITH {_LINES}, k AS (SELECT doc_id, line_no, regexp_replace(line, '{_W}+', '', 'g') AS key FROM ln), f AS (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id, line_no) AS r FROM k WHERE key <> '')
        SELECT doc_id, count(*) AS n_first FROM f WHERE r = 1 GROUP BY doc_id""",
    "near_flags": """WITH f AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 1 WHEN text IS NOT NULL THEN 0 END AS g FROM conversations)
        SELECT conv_id, turn, coalesce(max(g) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(g) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS near FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "order_check": """WITH e AS (SELECT user_id, event_id, value, dayofyear(ts) AS d, lag(dayofyear(ts)) OVER w AS pd, lag(event_id) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id))
        SELECT user_id, count(*) AS n FROM e WHERE pd > d OR (pd = d AND pe > event_id) GROUP BY user_id""",
    "html_block_counts": r"""WITH v AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<!--.*?-->', '', 'g') AS h FROM pages)
        SELECT page_id, CAST(len(regexp_extract_all(h, '(?i)<h[1-6]\b[^>]*>')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(regexp_extract(h, '(?is)<nav\b.*?</nav\s*>'), '(?i)<li\b[^>]*>')) AS BIGINT) AS n_nav_items FROM v""",
    "render_tables": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' AS x FROM lineitem)
        SELECT l_orderkey, md5('| line | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(x, chr(10) ORDER BY l_linenumber, l_partkey, x)) AS markdown_md5 FROM r GROUP BY l_orderkey""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | queries_more.SQL | queries_pages.SQL
