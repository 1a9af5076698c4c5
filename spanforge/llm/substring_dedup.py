"""Removal of repeated passages by level-wise doubling.

Only windows that repeat at one length are extended to twice that length. The first level has windows of half the asked
length; of these only the kept ones of winnowing are counted (least hash in each run of half+1), since every window
of the asked length holds one, at a place that its own words decide. A window of the asked length is a candidate if
its kept half-window repeats somewhere. ``longest_repeats`` goes on doubling until no candidates survive.

Windows are told apart by 96 bits of hash over their words' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, join_spread, join_words, materialize, mix, release, slices, span_hashes, table, text_of, word_bounds

WINDOW = 20
#: Keys of whole copies up to this number are broadcast, after a count: 16 bytes each.
BROADCAST_COPIES = 2_000_000


def _inside(counts: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram of the joined words: does it lie in one text?"""
    total = int(counts.sum())
    if total < k:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(total - k + 1) + k <= ends[: total - k + 1]


def _hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    joined, counts = join_words(texts)
    return span_hashes(*word_bounds(joined)), counts


def _kept(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half-window hashes, the window starts (in the joined words), and the place of the half-window each keeps."""
    half = window // 2
    halves = gram_hashes(words, half)
    starts = np.flatnonzero(_inside(counts, window))
    if not len(starts):
        return halves, starts, starts
    runs = sliding_window_view(halves, window - half + 1)
    # the first of the least: a running minimum over offsets, for the windows that lie in one text
    best, at = runs[starts, 0].copy(), np.zeros(len(starts), np.int64)
    for o in range(1, window - half + 1):
        x = halves[starts + o]
        less = x < best
        best[less] = x[less]
        at[less] = o
    return halves, starts, starts + at


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each kept half-window of a text once, with its places."""
    for batch in slices(batches, 2):
        words, counts = _hashes(batch.column(2).to_pylist())
        halves, _, kept = _kept(words, counts, window)
        kept = np.unique(kept)
        first = np.cumsum(counts) - counts
        doc = np.searchsorted(np.cumsum(counts), kept, side="right")
        half, pos = halves[kept], (kept - first[doc]).astype(np.int32)
        order = np.lexsort((pos, half, doc))
        half, doc, pos = half[order], doc[order], pos[order]
        new = np.flatnonzero(np.r_[len(half) > 0, (half[1:] != half[:-1]) | (doc[1:] != doc[:-1])]) if len(half) else np.zeros(0, np.int64)
        at = pa.array(doc[new])
        places = pa.ListArray.from_arrays(pa.array(np.r_[new, len(half)].astype(np.int32)), pa.array(pos))
        yield pa.RecordBatch.from_arrays([pa.array(half[new].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), places], ["half", "id", "hash", "pos"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Candidate windows, the first of each text only where it repeats in the text."""
    for batch in slices(batches, 2):
        words, counts = _hashes(batch.column(2).to_pylist())
        _, starts, kept = _kept(words, counts, window)
        first = np.cumsum(counts) - counts
        lists = batch.column(3)
        repeated = np.zeros(len(words) + 1, bool)
        flat = lists.flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        repeated[flat + np.repeat(first, sizes)] = True
        starts = starts[repeated[kept]]
        doc = np.searchsorted(np.cumsum(counts), starts, side="right")
        a, b = gram_hashes(words, window, 1)[starts], gram_hashes(words, window, 2)[starts]
        _, once = np.unique(a ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        once.sort()
        a, b, starts, doc = a[once], b[once], starts[once], doc[once]
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a.view(np.int64)),
                pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array((starts - first[doc]).astype(np.int32)),
            ],
            ["w", "check", "id", "hash", "start"],
        )


def _removal(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Cut out what cross-text starts and repeats within the text cover."""
    for batch in slices(batches, 2):
        texts = batch.column(2).to_pylist()
        words, counts = _hashes(texts)
        first = np.cumsum(counts) - counts
        covered = np.zeros(len(words) + 1, np.int64)
        lists = batch.column(3)
        sizes = np.nan_to_num(np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy().astype(np.int64)
        cut = [(flat + np.repeat(first, sizes))[flat >= 0]]
        cut += [np.arange(first[i], first[i] + max(counts[i] - window + 1, 0)) for i in np.repeat(np.arange(len(sizes)), sizes)[flat < 0]]
        starts = np.flatnonzero(_inside(counts, window))
        if len(starts):
            doc = np.searchsorted(np.cumsum(counts), starts, side="right")
            a = gram_hashes(words, window, 1)[starts] ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, once = np.unique(a, return_index=True)
            again = np.ones(len(starts), bool)
            again[once] = False
            cut.append(starts[again])
        cut = np.concatenate(cut)
        np.add.at(covered, cut, 1)
        np.add.at(covered, cut + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(first, len(words))) * (counts > 0)
        kept = []
        for text, a, n, r in zip(texts, first.tolist(), counts.tolist(), removed.tolist(), strict=True):
            own = text.split() if text else []
            kept.append(b" ".join(own if not r else [w for w, g in zip(own, gone[a : a + n].tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.array(removed), pa.array([k.decode() for k in kept])], ["shown", "n_words", "n_removed", "kept_text"]
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text_of(text_col)).alias("hash")]
    return docs.select(*key, F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("shown"))


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of hash of each text's word sequence."""
    for batch in slices(batches, 2):
        words, counts = _hashes(batch.column(2).to_pylist())
        first = np.cumsum(counts) - counts
        place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
        both = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            spread = mix(words + mix(place * np.uint64(seed) + np.uint64(1)))
            total = np.add.reduceat(np.r_[spread, np.uint64(0)], np.minimum(first, len(words))) * (counts > 0)
            both.append(pa.array(mix(total + counts.astype(np.uint64)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], ["id", "hash", "a", "b"])


def whole_copies(keyed: DataFrame) -> DataFrame:
    """id, hash of the texts all of whose words are, in order, those of a text of smaller id: every window of theirs repeats."""
    wholes = keyed.mapInArrow(_wholes, "id long, hash long, a long, b long")
    wholes = materialize(wholes, "wholes")
    first = materialize(wholes.groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first-wholes")
    return materialize(join_spread(wholes, first, ["a", "b"], "n", ["id"]).filter("id > least").select("id", "hash").distinct(), "copies")


def repeated_starts(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash, starts: where windows start that also start in a text of smaller id (repeats within a text not included).

    starts is [-1] for a text that is a whole copy: all of its windows do. Such texts need no levels, and the first of
    their kind stands for them at every level.
    """
    keyed = _keyed(docs, id_col, text_col).select("id", "hash", "text")
    copies = whole_copies(keyed)
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    keyed = keyed.join(F.broadcast(copies) if few else copies, ["id", "hash"], "left_anti")
    anchors = keyed.mapInArrow(lambda it: _anchors(it, window), "half long, id long, hash long, pos array<int>")
    again = materialize(anchors.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "halves")
    places = join_spread(anchors, again, ["half"], "n", ["id", "hash"]).groupBy("id", "hash").agg(F.flatten(F.collect_list("pos")).alias("places"))
    places = materialize(places, "anchors")
    release(docs.sparkSession)
    windows = keyed.join(places, ["id", "hash"]).mapInArrow(lambda it: _windows(it, window), "w long, check int, id long, hash long, start int")
    first = materialize(windows.groupBy("w", "check").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first-windows")
    later = join_spread(windows, first, ["w", "check"], "n", ["id", "hash"]).filter("id > least")
    starts = later.groupBy("id", "hash").agg(F.collect_list("start").alias("starts"))
    starts = materialize(starts.unionByName(copies.withColumn("starts", F.array(F.lit(-1)))), "repeats")
    release(docs.sparkSession)
    return starts


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept_text (the kept words joined by one space).

    A word goes if a window of ``window`` consecutive words covers it whose words also start earlier: in a text of
    smaller id, or earlier in the same text, all judged on the input. A null text has no words. A null id is below
    every other. Rows that repeat an id are not compared with each other: each counts its own repeats and those in
    smaller ids. Texts of fewer words than a window stay whole. No rows give no rows. Other columns are ignored.
    """
    starts = repeated_starts(docs, window, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    both = keyed.join(starts, ["id", "hash"], "left").select("shown", "id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    out = both.mapInArrow(lambda it: _removal(it, window), "shown long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("shown", id_col)


def longest_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, longest: the greatest window * 2^i words at which a window of the text repeats anywhere; texts without are not listed.

    Each level takes only the texts that had a repeat at the level before, until none survives.
    """
    found = None
    left = docs.filter(F.col(id_col).isNotNull())
    while True:
        n = window
        keyed = _keyed(left, id_col, text_col).select("id", "hash", "text")
        size = n

        def every(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2):
                words, counts = _hashes(batch.column(2).to_pylist())
                starts = np.flatnonzero(_inside(counts, size))
                doc = np.searchsorted(np.cumsum(counts), starts, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(words, size, 1)[starts].view(np.int64)), batch.column(0).take(pa.array(doc))], ["w", "id"])

        windows = keyed.mapInArrow(every, "w long, id long")
        again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w")
        hit = materialize(windows.join(again, "w").select("id").distinct(), "level")
        if hit.isEmpty():
            break
        level = hit.select(F.col("id").alias(id_col), F.lit(window).alias("longest"))
        found = level if found is None else found.union(level)
        left = left.join(hit.withColumnRenamed("id", id_col), id_col, "left_semi")
        window *= 2
    if found is None:
        return docs.select(F.col(id_col).cast("long"), F.lit(0).alias("longest")).limit(0)
    return found.groupBy(id_col).agg(F.max("longest").alias("longest"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; nulls, ties and repeats as in ``substring_dedup``."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
        per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
        word AS (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
                 WHERE gone.p IS NULL GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
}
