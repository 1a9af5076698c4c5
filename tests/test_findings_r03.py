"""What the findings of round 3 named, on small tables."""

from pyspark.sql import functions as F

from spanforge import queries, store
from spanforge.functions import text
from spanforge.llm.tokens import Encoder, public_file
from spanforge.operators import figures, intervals, lines


def test_rules_of_one_height_are_parted_by_their_right_end(spark):
    rows = [(1, y, 0.0, 100.0) for y in (10.0, 20.0, 40.0)] + [(1, y, 0.0, 300.0) for y in (40.0, 50.0, 60.0)]
    found = figures.table_regions(spark.createDataFrame(rows, "k int, y double, x0 double, x1 double"), ["k"]).collect()
    assert sorted((r.y0, r.y1, r.x1) for r in found) == [(10.0, 40.0, 100.0), (40.0, 60.0, 300.0)]


def test_merging_takes_more_parts_as_the_input_grows(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), (F.col("id") * 1.0).alias("a"), (F.col("id") + 0.5).alias("b"))
    rows.write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(store, "PART_BYTES", 200)
    merged = intervals.merge(read, ["k"], "a", "b")
    assert merged.rdd.getNumPartitions() > 4
    assert merged.count() == 1000
    gaps = intervals.uncovered(merged, ["k"], "a", "b", F.lit(0.0), F.lit(1000.0), 1.0)
    assert gaps.count() == 100 * 9 + 99 + 99


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_lines_are_made_once(spark, sf_dir):
    for query in (queries.repeated_lines, queries.strip_repeated):
        assert "regexp_replace" not in plan_of(query(spark, sf_dir))


def test_repeated_keys_do_not_depend_on_the_way_they_are_found(spark, monkeypatch):
    rows = [("d", p, float(k), f"line {k} of p{p}" if k % 3 else f"l{'abcdefgh'[k]} é　{p}") for p in range(9) for k in range(8)]
    rows += [("d", 1, 9.0, None), ("d", None, 0.0, "la é　5"), (None, 1, 0.0, "la é　5"), ("short", 1, 0.0, "la é　5")]
    lines_ = spark.createDataFrame(rows, "doc string, page int, y double, text string")
    found = lambda: sorted(map(tuple, lines.repeated_keys(lines_, "doc", "page", F.col("y"), F.col("text")).collect()))
    few = found()
    assert ("d", "laé#", 9, 10, 10) in few and ("d", "line#ofp#", 9, 45, 45) in few and len(few) == 4
    monkeypatch.setattr(lines, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    assert found() == few


def test_keys_of_characters_beyond_ascii(spark):
    signs = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + [0xFF11, 0x1D7CE, 0x1F600]
    texts = [f"a {chr(c)} {chr(c)}b" for c in signs]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.repeat_key(F.col("t")).alias("k"), F.regexp_replace(F.regexp_replace("t", f"[{text.WS}]+", ""), r"\p{Nd}+", "#").alias("plain"))
    assert [r for r in got.collect() if r.k != r.plain] == []


def test_marks_after_a_word_make_no_new_pieces():
    own = Encoder(public_file("byte_bpe_50k.json"), True)
    words, marks = [f"w{c}é" for c in "abcdefgh"] + ["don", "wörd", "x"], ["$$$", "...", "'t", "!", "-", "×", "_", "’", "%)", ".", "''s"]
    texts = [f"{w}{m} {w}{m}\n{w}{m}" for w in words for m in marks] + ["a.", ". b", "", "c\n", "d 。e", "f g", "h  i"]
    assert [x.tolist() for x in own.many([t.encode() for t in texts])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.runs.index) < 120  # 242 if each mark went with its word


def test_frequent_pieces_stay_when_the_cache_is_full():
    own = Encoder(public_file("byte_bpe_50k.json"), True, entries=40)
    often = [b" the", b" of", b" and"]
    own.runs.places(often)
    own.runs.places([f" q{i}".encode() for i in range(50)])
    own.runs.places([b" more"])
    assert list(own.runs.index)[:3] == often and len(own.runs.index) == 11
    for piece, i in own.runs.index.items():
        at = own.runs.start[i]
        assert own.runs.ids[at : at + own.runs.size[i]].tolist() == own.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
