"""Rows that repeat, columns of clashing names, very long texts and empty tables, operator by operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, lm, packing, simhash
from spanforge.llm.common import bound_batches, join_spread

from test_plain import awkward, plain_fingerprint, plain_hits, sentence

NAMES = ["score", "words", "seed", "_id", "_hash", "_fp", "node", "piece", "length", "held_out", "__text", "n_tokens", "places", "spans", "id", "hash"]


@pytest.fixture
def clash(spark, folder):
    """A folder whose documents have extra columns of names that the operators use, and whose rows repeat."""

    def make(rows, **tables):
        sf = folder(rows, **tables)
        docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.lit("x") for n in NAMES})
        docs.write.parquet(f"{sf}/clash/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{sf}/clash/{name}.parquet")
        return f"{sf}/clash"

    return make


ROWS = [*awkward(), (None, "no id here"), (None, None), (203, "another text of an id that repeats")]


def test_simhash(spark, clash):
    got = simhash.op10_simhash(spark, clash(ROWS)).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter((i, plain_fingerprint(t)) for i, t in ROWS)
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[r.fingerprint] = min(least.get(r.fingerprint, r.doc_id), r.doc_id)
    assert all(r.component_id is None or r.component_id <= least.get(r.fingerprint, r.component_id) for r in got)


def test_language_model(spark, clash):
    got = lm.op3_lm_score(spark, clash(ROWS)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").split()) + 1) for i, t in ROWS)
    same = {(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id == 203 and r.n_tokens == 46}
    assert len(same) == 1  # rows alike score alike
    assert lm.op3_lm_score(spark, spark_tables(spark)).count() == 0


def test_contamination(spark, docs):
    rng = random.Random(31)
    items = [(1, sentence(rng, 12)), (2, sentence(rng, 9))]
    rows = [*ROWS, (400, items[0][1]), (400, items[0][1]), (None, items[1][1]), (401, sentence(rng, 20_000) + " " + items[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({n: F.lit("x") for n in NAMES})
    got = decontaminate.contamination(docs(rows).withColumns({n: F.lit("x") for n in NAMES}), table).collect()
    want = Counter()
    for i, t in rows:  # by row, not by id
        n_words, n_hit, found = plain_hits([(0, t)], items)[0]
        want[(i, n_words, n_hit, tuple(found))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want


def test_packing(spark, clash):
    got = packing.op9_packing(spark, clash([*ROWS, (900, sentence(random.Random(32), 12_000))])).toPandas()
    assert got.doc_id.isna().sum() == 2 and len(got[got.doc_id == 203]) == 3 and len(got[got.doc_id == 900]) > 2
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and got.groupby("sequence_id").length.sum().max() <= 4096


def test_pipeline(spark, clash):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, spark_tables(spark)).count() == 0
    rows = [*ROWS, (950, sentence(random.Random(33), 30_000)), (951, None), (952, "")]
    packed = pipeline.run(spark, clash(rows)).toPandas()
    assert {int(i) for i in packed.doc_id.dropna()} <= {i for i, _ in rows if i is not None} and 950 in set(packed.doc_id.dropna())
    docs = spark.read.parquet(f"{spark_tables(spark, rows)}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, spark_tables(spark, rows))
        assert set(kept.columns) == set(docs.columns)


def spark_tables(spark, rows=()):
    import tempfile

    out = tempfile.mkdtemp()
    spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.mark.parametrize("broadcast", [10, 0])
def test_hot_keys_are_spread(spark, monkeypatch, broadcast):
    from spanforge.llm import common

    monkeypatch.setattr(common, "BROADCAST_HOT", broadcast)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k long, i long")
    keys = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (4, 9, "c")], "k long, n long, v string")
    out = join_spread(rows, keys, ["k"], "n", ["i"], hot_rows=10, salts=4)
    assert sorted((r.k, r.i, r.v) for r in out.collect()) == sorted([(1, i, "a") for i in range(50)] + [(2, i, "b") for i in range(3)])
    assert out.columns == ["k", "i", "n", "v"]


def test_batches_stay_bounded(spark):
    bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")  # no bound
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
