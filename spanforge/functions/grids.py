"""Table grids: array<array<string>> columns, ragged rows allowed, the first row is the header."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packs import EMPTY, Pack
from .text import CJK, compact, md_cell, md_escape, trim

_blank = lambda c: trim(F.coalesce(c, F.lit(""))) == ""


def filled_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: ~_blank(c)))


def drop_blank_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: ~_blank(c)))


def pad(rows: Column) -> Column:
    """Rows of one width, with empty cells."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))


def drop_blank_columns(rows: Column) -> Column:
    """Without columns that are blank in every row; rows are of one width."""
    used = F.filter(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: F.exists(rows, lambda r: ~_blank(F.get(r, j))))
    return F.when((F.size(rows) > 0) & (F.size(rows[0]) > 0), F.transform(rows, lambda r: F.transform(used, lambda j: F.get(r, j)))).otherwise(rows)


def stitch(rows: Column) -> Column:
    """Adjacent rows without a column filled in both become one; the result is held against the next row."""

    def apart(a: Column, b: Column) -> Column:
        return F.forall(F.zip_with(a, b, lambda x, y: _blank(x) | _blank(y)), lambda t: t) & F.exists(a, lambda c: ~_blank(c)) & F.exists(b, lambda c: ~_blank(c))

    def add(acc: Column, r: Column) -> Column:
        n = F.size(acc)
        last = F.get(acc, n - 1)
        merged = F.zip_with(last, r, lambda x, y: F.when(_blank(x), y).otherwise(x))
        return F.when((n > 0) & apart(last, r), F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(rows, F.array().cast("array<array<string>>"), add)


def clean(rows: Column) -> Column:
    """Blank rows go, rows are padded, blank columns go, split rows are stitched, in this order."""
    return stitch(drop_blank_columns(pad(drop_blank_rows(rows))))


def blank_noise(rows: Column, noise) -> Column:
    """Cells that the predicate calls noise are blanked; rows then blank go."""
    return drop_blank_rows(F.transform(rows, lambda r: F.transform(r, lambda c: F.when(noise(c), F.lit("")).otherwise(c))))


def flat_text(rows: Column) -> Column:
    return F.array_join(F.flatten(rows), " ")


def fill_ratio(rows: Column) -> Column:
    return filled_cells(rows) / F.greatest(F.size(F.flatten(rows)), F.lit(1))


def suspect_score(rows: Column, header_words: list[str], amount: str = r"\d+\s*(?:元|%|％|USD|EUR)", long_cell: int = 120) -> Column:
    """An integer that grows with signs of drifted columns: three and more mean low confidence.

    One each for: a header cell with two header words or more (at most two of them); ragged rows; a cell above
    ``long_cell`` characters; a row whose amount stands outside the last column; a fill ratio under a third.
    """
    words = F.array(*[F.lit(w) for w in header_words])
    glued = F.size(F.filter(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), lambda c: F.size(F.filter(words, lambda w: F.contains(c, w))) >= 2))
    ragged = F.size(F.array_distinct(F.transform(rows, F.size))) > 1
    long = F.exists(F.flatten(rows), lambda c: F.char_length(c) > long_cell)
    drift = F.exists(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: F.exists(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c.rlike(amount)))
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.least(glued, F.lit(2)) + as_int(ragged) + as_int(long) + as_int(drift) + as_int(fill_ratio(rows) < 1 / 3)


def forward_fill(rows: Column, column: int, payload: list[int]) -> Column:
    """Blank cells of a column take the last value above, on rows with a value in a payload column."""
    state = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("done"))

    def add(acc: Column, r: Column) -> Column:
        own = F.get(r, F.lit(column))
        carries = ~_blank(own)
        has = F.exists(F.array(*[F.get(r, F.lit(p)) for p in payload]), lambda c: ~_blank(c))
        value = F.when(carries, own).when(has, acc["last"]).otherwise(own)
        row = F.transform(r, lambda c, j: F.when(j == column, value).otherwise(c))
        return F.struct(F.when(carries, own).otherwise(acc["last"]).alias("last"), F.concat(acc["done"], F.array(row)).alias("done"))

    return F.aggregate(rows, state, add, lambda a: a["done"])


def is_complex(rows: Column, most_columns: int = 8, long_cell: int = 90) -> Column:
    """Better rendered as grouped text than as a pipe table."""
    widths = F.transform(rows, F.size)
    return (F.array_max(widths) > most_columns) | F.exists(F.flatten(rows), lambda c: (F.char_length(c) > long_cell) | (F.regexp_count(c, F.lit("\n")) >= 3))


def pipe_table(rows: Column) -> Column:
    """Markdown lines of a table: header, rule, rows; empty for an empty grid."""
    padded = pad(rows)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, md_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(padded[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.concat(F.array(line(padded[0]), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(padded), F.lit(1))), line))).otherwise(F.array().cast("array<string>"))


def grouped_text(rows: Column) -> Column:
    """A complex table as one line per row: header cell, colon, value, joined by semicolons; blank cells are left out."""
    header = rows[0]

    def line(r: Column) -> Column:
        named = F.zip_with(header, r, lambda h, c: F.when(_blank(c), F.lit("")).when(_blank(h), trim(c)).otherwise(F.concat(trim(h), F.lit(": "), trim(c))))
        return F.concat(F.lit("- "), F.array_join(F.filter(named, lambda s: F.coalesce(s, F.lit("")) != ""), "; "))

    return F.when(F.size(rows) > 1, F.transform(F.slice(rows, 2, F.size(rows)), line)).otherwise(F.transform(rows, lambda r: F.array_join(r, " ")))


def header_rendered(rows: Column, lines: Column, most: int = 3) -> Column:
    """Does a pipe line hold the first header cells that are not blank?"""
    heads = F.slice(F.filter(F.transform(rows[0], compact), lambda c: c != ""), 1, most)
    return F.exists(lines, lambda x: x.startswith("|") & F.forall(heads, lambda h: F.contains(compact(x), h)))


def complex_by_rules(rows: Column, pack: Pack = EMPTY) -> Column:
    """Better as grouped text than as a pipe table, by size, shape and, with a pack, by its words. The first rule that applies decides.

    Wide tables, single columns and pairs with long cells, and cells with line ends are; two to five columns of short cells with
    a filled first column are not; of the rest very long cells, a first column blank in a third of the rows, and merged
    headers are.
    """
    padded = pad(rows)
    n_rows, n_columns = F.size(rows), F.array_max(F.transform(rows, F.size))
    cells = F.filter(F.transform(F.flatten(padded), trim), lambda c: c != "")
    longest = F.coalesce(F.array_max(F.transform(cells, F.char_length)), F.lit(0))
    joined = F.array_join(cells, " ")
    header = F.filter(F.transform(padded[0], trim), lambda c: c != "")
    head_line = F.array_join(header, " ")
    blank_first = F.size(F.filter(F.slice(padded, 2, F.greatest(n_rows, F.lit(1))), lambda r: _blank(r[0])))
    has = lambda x, pattern: x.rlike(pattern) if pattern else F.lit(False)
    policy = has(joined, pack.policy_words)
    whole = F.array(*[F.lit(h) for h in pack.policy_header]).cast("array<string>")
    titled = (F.size(F.array_except(whole, header)) == 0) if pack.policy_header else F.lit(False)
    broken = F.exists(F.flatten(padded), lambda c: F.contains(c, F.lit("\n")) | F.contains(F.lower(c), F.lit("<br")))
    ladder = [
        (titled, True),
        ((n_columns <= 1) & ((n_rows > 1) | (longest > 40)), True),
        ((n_rows == 1) & (n_columns == 2) & (longest > 80), True),
        (n_columns > 5, True),
        (broken, True),
        ((n_columns == 2) & policy & (longest > 60), True),
        ((n_columns == 2) & policy & has(head_line, pack.condition_header) & (longest > 40), True),
        (n_columns.isin(2, 3) & policy & (longest > 85), True),
        ((n_columns >= 3) & (longest > 80) & has(head_line, pack.content_header), True),
        ((n_columns >= 3) & (longest > 45) & has(head_line, pack.detail_header), True),
        ((n_columns <= 5) & (longest <= 90) & (blank_first == 0), False),
        (longest > 140, True),
        ((n_rows >= 3) & (blank_first >= F.greatest(F.lit(1), F.floor(n_rows / 3))), True),
        ((n_columns >= 3) & has(joined, pack.merged_words), True),
    ]
    out = F.lit(False)
    for when, then in reversed(ladder):
        out = F.when(when, F.lit(then)).otherwise(out)
    return F.coalesce((F.size(rows) > 0) & out, F.lit(False))


def native_prefers_pipes(rows: Column, flags: Column, pack: Pack = EMPTY) -> Column:
    """A table read from the page itself, of two columns or more, stays a pipe table unless it is the pack's kind of prose or has
    markup for line ends."""
    padded = pad(rows)
    cells = F.filter(F.transform(F.flatten(padded), trim), lambda c: c != "")
    joined = F.array_join(cells, " ")
    header = F.transform(padded[0], trim)
    titled = (F.size(F.array_except(F.array(*[F.lit(h) for h in pack.policy_header]), header)) == 0) if pack.policy_header else F.lit(False)
    prose = (joined.rlike(pack.native_words) if pack.native_words else F.lit(False)) & (F.regexp_count(joined, F.lit(f"[{CJK}]")) > F.char_length(joined) * 0.25) & (F.array_max(F.transform(cells, F.char_length)) > 45)
    marked = F.exists(F.flatten(padded), lambda c: F.contains(F.lower(c), F.lit("<br")))
    native = F.coalesce(F.array_contains(flags, "native_pdf_table"), F.lit(False)) & (F.size(rows) > 0)
    return F.coalesce(native & (F.array_max(F.transform(rows, F.size)) >= 2) & ~titled & ~F.coalesce(prose, F.lit(False)) & ~marked, F.lit(False))


#: Headers of pairs; of a single column; of answers; labels whose values stand on lines of their own; where a row breaks.
_PAIR_KEYS, _PAIR_VALUES, _SINGLE_KEYS = ["项目", "指标", "类型", "要求", "维度"], ["内容", "说明", "数值", "得分"], ["内容", "说明", "项目", "备注"]
_COLUMN_HEADER = r"项目|内容|说明|指标|数据|路径|问题|答案|备注|目标|管理"
_ANSWER = r"申诉|查询路径|数据来源|考核|得分|目标|规则"
_OWN_LINES = r"参考指标|释义|数据来源|说明|考核范围|查询路径"
_ROW_BREAK = r"[；;]\s*(?:注[①②]?[:：]|数据来源[:：]|考核范围[:：]|指标说明[:：]|举例\d*[:：]|举例如下[:：]|示例[:：]|剔除方式[:：]|其中|特殊说明[:：]|同时满足如下条件|【[^】]{2,24}】[:：]|条件[一二三四五六七八九十][:：]|[1-9][.．]\s*[^0-9]|PS[:：]|备注[:：])"


def readable_table(rows: Column, readable: Callable[[Column], Column], pack: Pack = EMPTY, most: int = 220) -> Column:
    """Markdown lines of a complex table, a blank line at the end. ``readable`` breaks a cell into lines.

    A single column of answers is a list; one row of two cells, and pairs, are a bold key over its value; any other table is
    its header in bold, then a list of rows as label and value, on one line where they are short.
    """
    padded = pad(rows)
    header = F.transform(padded[0], trim)
    n_columns, n_rows = F.size(header), F.size(rows)
    body = F.when(n_rows > 1, F.slice(padded, 2, F.greatest(n_rows, F.lit(1)))).otherwise(padded)
    none = F.array().cast("array<string>")
    bold = lambda x: F.concat(F.lit("**"), md_escape(x), F.lit("**"))
    indented = lambda lines: F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "- ").otherwise("  "), md_escape(x)))
    first = header[0]
    titled = (F.char_length(first) <= 12) & first.rlike(_COLUMN_HEADER)
    answers = (n_columns == 1) & (n_rows > 1) & ~titled & ((F.char_length(first) > 18) | first.rlike(_ANSWER))
    listed = F.concat(F.flatten(F.transform(F.filter(padded, lambda r: ~_blank(r[0])), lambda r: indented(readable(trim(r[0]))))), F.array(F.lit("")))
    single = (n_rows == 1) & (n_columns == 2) & first.isin(_SINGLE_KEYS)

    def keyed(key: Column, value: Column) -> Column:
        lines = F.transform(readable(value), md_escape)
        named = F.concat(F.when(key != "", F.array(bold(key), F.lit(""))).otherwise(none), lines, F.array(F.lit("")))
        return F.when((key == "") & (F.size(lines) == 0), none).otherwise(named)

    pairs = (n_columns == 2) & (first.isin(_PAIR_KEYS) | F.get(header, F.lit(1)).isin(_PAIR_VALUES))
    two = F.flatten(F.transform(body, lambda r: keyed(trim(r[0]), trim(F.get(r, F.lit(1))))))
    whole = (F.size(F.array_except(F.array(*[F.lit(h) for h in pack.policy_header]), header)) == 0) if pack.policy_header else F.lit(False)

    def row_lines(r: Column) -> Column:
        label = lambda j: F.when(F.coalesce(F.get(header, j), F.lit("")) != "", F.get(header, j)).otherwise(F.concat(F.lit("列"), (j + 1).cast("string")))
        named = F.filter(F.transform(r, lambda c, j: F.struct(label(j).alias("k"), trim(c).alias("c"))), lambda s: s["c"] != "")
        named = F.transform(named, lambda s: F.struct(s["k"].alias("k"), F.when(F.size(readable(s["c"])) > 0, readable(s["c"])).otherwise(F.array(s["c"])).alias("v")))
        line = F.array_join(F.transform(named, lambda s: F.concat(s["k"], F.lit("："), F.array_join(s["v"], "；"))), "；")
        short = ~whole & ~F.exists(named, lambda s: s["k"].rlike(_OWN_LINES)) & (F.char_length(line) <= most) & ~line.rlike(_ROW_BREAK)
        long = indented(F.flatten(F.transform(named, lambda s: F.transform(s["v"], lambda v, i: F.when(i == 0, F.concat(s["k"], F.lit("："), v)).otherwise(v)))))
        return F.when(F.size(named) == 0, none).when(short, F.array(F.concat(F.lit("- "), md_escape(line)))).otherwise(long)

    head = F.filter(header, lambda c: c != "")
    general = F.concat(F.when(F.size(head) > 0, F.array(bold(F.array_join(head, " / ")), F.lit(""))).otherwise(none), F.flatten(F.transform(body, row_lines)), F.array(F.lit("")))
    return F.when(F.size(rows) == 0, none).when(answers, listed).when(single, keyed(first, trim(F.get(padded[0], F.lit(1))))).when(pairs, F.concat(two)).otherwise(general)
