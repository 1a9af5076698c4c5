"""Majority-vote correction: a doubtful character is replaced where the corpus clearly prefers the pair with its twin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_VOTES, MIN_RATIO = 3, 3


def bigrams(texts: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """scope, bigram, n over all texts of a scope."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes = batch.column(0).dictionary_encode()
            groups = np.asarray(scopes.indices.fill_null(len(scopes.dictionary)))
            for group in np.unique(groups):
                rows = np.flatnonzero(groups == group)
                chars, own = _characters(batch.column(1).take(pa.array(rows)).to_pylist())
                pair = (chars[:-1].astype(np.int64) << 32 | chars[1:])[own[:-1] == own[1:]]
                found, n = np.unique(pair, return_counts=True)
                texts = [chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in found.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), rows[0]))), pa.array(texts, pa.string()), pa.array(n, pa.int64())], [scope, "bigram", "n"])

    kept = texts.select(scope, text)
    schema = T.StructType([kept.schema[0], T.StructField("bigram", T.StringType()), T.StructField("n", T.LongType())])
    # a batch's pairs are counted where the texts are
    return kept.mapInArrow(count, schema).groupBy(scope, "bigram").agg(F.sum("n").alias("n"))


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and for each the text it is of."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    return np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(texts)), sizes)


def _places(texts: DataFrame, scope: str, doc: str, text: str, olds: list[str]) -> DataFrame:
    """scope, doc, pos (from 1), old, before, after: each place of one of ``olds``; null beyond either end of a text."""
    sought = np.array(sorted(map(ord, olds)), np.uint32)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, own = _characters(batch.column(2).to_pylist())
            at = np.flatnonzero(np.isin(chars, sought))
            starts = np.searchsorted(own, own[at])
            near = np.concatenate([[0], chars, [0]]).astype(np.uint32)
            joined = np.concatenate([[-1], own, [-1]])
            letters = [_letters(near[at + 1 + d], joined[at + 1 + d] == own[at]) for d in (0, -1, 1)]
            rows = pa.array(own[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - starts + 1, pa.int32()), *letters], target)

    kept = texts.select(F.col(scope), F.col(doc), F.col(text))
    target = [scope, doc, "pos", "old", "before", "after"]
    fields = [T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in target[3:]]]
    return kept.mapInArrow(find, T.StructType([kept.schema[0], kept.schema[1], *fields]))


def _letters(codes: np.ndarray, known: np.ndarray) -> pa.Array:
    """Code points as strings, null where not known."""
    distinct, place = np.unique(codes, return_inverse=True)
    return pa.array([chr(c) for c in distinct.tolist()], pa.string()).take(pa.array(place.ravel(), mask=~known))


def votes(texts: DataFrame, scope: str, doc: str, confusions: list[tuple[str, str]], text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """doc, pos (from 1), old, new: corrections that the scope's bigram counts support.

    A place of ``old`` is corrected to ``new`` if the better of the two bigrams with ``new`` comes MIN_VOTES times or more and
    MIN_RATIO times as often as the better of the two with ``old`` (at least once). Bigrams are those of the unchanged
    texts; the first pair of ``confusions`` that qualifies wins.
    """
    counts = bigrams(texts, scope, text) if counts is None else counts
    olds = sorted({a for a, _ in confusions})
    places = _places(texts, scope, doc, text, olds)
    spark = texts.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(confusions)], "old string, new string, rank int"))
    tried = places.join(pairs, "old")
    # the context decides, so each distinct context is looked up once
    context = tried.select(scope, "old", "new", "before", "after").distinct()
    for name, pair in (
        ("o1", F.concat("before", "old")),
        ("o2", F.concat("old", "after")),
        ("n1", F.concat("before", "new")),
        ("n2", F.concat("new", "after")),
    ):
        context = context.withColumn("bigram", pair).join(counts.withColumnRenamed("n", name), [scope, "bigram"], "left").drop("bigram")
    zero = lambda c: F.coalesce(c, F.lit(0))
    so, sn = F.greatest(zero("o1"), zero("o2")), F.greatest(zero("n1"), zero("n2"))
    won = context.filter((sn >= MIN_VOTES) & (sn >= MIN_RATIO * F.greatest(so, F.lit(1)))).select(scope, "old", "new", "before", "after")
    same = [tried[c] == won[c] for c in (scope, "old", "new")] + [tried[c].eqNullSafe(won[c]) for c in ("before", "after")]
    kept = tried.join(won, same, "left_semi")
    return kept.groupBy(doc, "pos", "old").agg(F.min_by("new", "rank").alias("new"))


def corrected(texts: DataFrame, found: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, n_fixed, text after the corrections."""
    edits = found.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("edits"))
    chars = F.transform(F.split(text, ""), lambda c, i: F.coalesce(F.col("edits")[i + 1], c))
    return texts.join(edits, doc, "left").select(
        doc, F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias("n_fixed"), F.when(F.col("edits").isNull(), F.col(text)).otherwise(F.array_join(chars, "")).alias(text)
    )
