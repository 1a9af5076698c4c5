"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, scored by memory map.

Words are known by their 64-bit hash, and by their rank among the sorted hashes (the word id). Tasks count the words or
n-grams of their texts and hand on sorted keys, in packed chunks, to the bucket of each key; a bucket adds
equal keys and writes its sorted keys and counts. Buckets are ranges of evenly spread keys, so frequent words load none.
Model: two words, with three discounts each for pairs and for continuation counts, interpolated down to an even
share for every known word and one unknown word. A text is scored with its end, from a begin context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedArrays, fold, fresh, join_words, materialize, release, shared_path, slices, span_hashes, table, word_bounds

BATCH_BYTES, BUCKET_BYTES = 1 << 22, 1 << 26
END = np.uint64(0x0123456789ABCDEF)
#: Word ids are below this; it stands for the begin of a text as a context.
BEGIN = np.uint64((1 << 32) - 1)
_U32 = np.uint64(32)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UNSPREAD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _spread(keys: np.ndarray) -> np.ndarray:
    """A bijection; its high bits depend on all bits of the key."""
    x = keys * _SPREAD
    x = x ^ (x >> _U32)
    return x * _SPREAD


def _unspread(keys: np.ndarray) -> np.ndarray:
    x = keys * _UNSPREAD
    x = x ^ (x >> _U32)
    return x * _UNSPREAD


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack_chunk(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts: differences, byte by byte, so that the shuffle's compression finds the zeros."""
    return len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(counts.astype(np.uint32))


def unpack_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(_unplanes(data[8 : 8 + 8 * n], np.uint64, n), dtype=np.uint64), _unplanes(data[8 + 8 * n :], np.uint32, n).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (the words, then the end, of each text), and the number of tokens of each text."""
    joined, counts = join_words(texts, lower=True)
    words = span_hashes(*word_bounds(joined))
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, counts + 1


class HashArrays:
    """The sorted keys of all buckets, mapped on first use."""

    def __init__(self, store: SharedArrays, name: str, bits: int):
        self.store, self.name, self.bits = store, name, bits
        self.keys = [store.mapped(f"{name}-{b:06d}.keys", np.uint64) for b in range(1 << bits)]
        self.first = np.r_[0, np.cumsum([len(k) for k in self.keys])]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The rank of each key among all, -1 for a key that is not there; wanted ascending."""
        out = np.full(len(wanted), -1, np.int64)
        edge = np.searchsorted(wanted, (np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.uint64))
        for b, (i, j) in enumerate(zip(edge, [*edge[1:], len(wanted)], strict=True)):
            own = self.keys[b]
            if i < j and len(own):
                at = np.minimum(np.searchsorted(own, wanted[i:j]), len(own) - 1)
                out[i:j] = np.where(own[at] == wanted[i:j], at + self.first[b], -1)
        return out

    def values(self, what: str, dtype, ranks: np.ndarray) -> np.ndarray:
        """Values at ranks (ascending, none below 0)."""
        out = np.zeros(len(ranks), dtype)
        edge = np.searchsorted(ranks, self.first)
        for b in range(1 << self.bits):
            i, j = edge[b], edge[b + 1]
            if i < j:
                out[i:j] = self.store.mapped(f"{self.name}-{b:06d}.{what}", dtype)[ranks[i:j] - self.first[b]]
        return out


def _count(docs: DataFrame, emit: Callable, store: SharedArrays, name: str, bits: int, more: Callable | None = None) -> DataFrame:
    """Count keys over all texts into the bucket files of ``name``; a row per bucket with its figures, and what ``more`` adds.

    docs: one binary column. emit(texts) -> keys, counts, with the spread keys' order left to this function.
    """
    shift = np.uint64(64 - bits)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BATCH_BYTES):
            keys, counts = emit(batch.column(0).to_pylist())
            bucket = (_spread(keys) >> shift).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            order = np.argsort(bucket, kind="stable")  # keys stay ascending in each bucket
            own, edge = np.unique(bucket[order], return_index=True)
            parts = [pack_chunk(keys[i], counts[i]) for i in np.split(order, edge[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "chunk"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, rows = None, [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            return _sums(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))

        def close() -> pa.RecordBatch:
            keys, counts = combined()
            spread = _spread(keys)
            order = np.argsort(spread)
            store.write(f"{name}-{current:06d}.keys", spread[order])
            store.write(f"{name}-{current:06d}.counts", counts[order].astype(np.int64))
            figures = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
            extra = more(keys, counts) if more else []
            heads = [(current, -1, len(keys), int(counts.sum()), *figures, None)] + [(current, r, 0, 0, 0, 0, 0, 0, data) for r, data in extra]
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*heads, strict=True), kinds, strict=True)], ["bucket", "range", "n", "total", "n1", "n2", "n3", "n4", "data"])

        for batch in batches:
            for bucket, chunk in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != current and waiting:
                    yield close()
                    waiting, rows = [], 0
                current = bucket
                waiting.append(unpack_chunk(chunk.as_py()))
                rows += len(waiting[-1][0])
                if len(waiting) > 1 and rows > 2 * len(waiting[0][0]) + (1 << 20):
                    waiting = [combined()]
                    rows = len(waiting[0][0])
        if waiting:
            yield close()

    dealt = docs.mapInArrow(chunks, "bucket int, chunk binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "bucket int, range int, n long, total long, n1 long, n2 long, n3 long, n4 long, data binary")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """For counts 0 (none), 1, 2, and 3 or more; a half of each count where the counts of counts don't allow the estimate."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if a and b:
                out[i] = min(max(i - (i + 1) * y * b / a, 0.0), float(i))
    return out


class Model:
    """Where the arrays are, and a few numbers."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits = uri, bits
        self.n_tokens = self.n_words = self.n_texts = self.n_pairs = 0
        self.d_pair = self.d_word = np.zeros(4)
        self.left_word = self.left_begin = 1.0
        self._open: dict[str, HashArrays] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def arrays(self, name: str) -> HashArrays:
        if name not in self._open:
            self._open[name] = HashArrays(SharedArrays(self.uri), name, self.bits)
        return self._open[name]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of tokens, -1 for unknown ones."""
        distinct, place = np.unique(_spread(hashes), return_inverse=True)
        return self.arrays("words").find(distinct)[place]

    def word_values(self, what: str, dtype, ids: np.ndarray) -> np.ndarray:
        """Values of words, 0 for unknown ones."""
        distinct, place = np.unique(ids, return_inverse=True)
        known = distinct >= 0
        out = np.zeros(len(distinct), dtype)
        out[known] = self.arrays("words").values(what, dtype, distinct[known])
        return out[place]

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        hashes, n = tokens(texts)
        first = np.cumsum(n) - n
        ids = self.word_ids(hashes)
        counts = self.word_values("counts", np.int64, ids)
        base = np.log10((counts + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        before = np.r_[np.int64(0), ids[:-1]]
        starts = np.zeros(len(ids), bool)
        starts[first] = True
        context = np.where(starts, np.int64(self.n_texts), np.r_[np.int64(0), counts[:-1]]).astype(float)
        left = np.r_[0.0, self.word_values("left", np.float64, ids)[:-1]]
        left[starts] = self.left_begin
        known = (before >= 0) | starts
        pair = (np.where(starts, BEGIN, before.astype(np.uint64)) << _U32) | ids.astype(np.uint64) & np.uint64((1 << 32) - 1)
        distinct, place = np.unique(_spread(pair), return_inverse=True)
        pairs = self.arrays("pairs")
        rank = pairs.find(distinct)
        seen = np.zeros(len(distinct), np.int64)
        seen[rank >= 0] = pairs.values("counts", np.int64, rank[rank >= 0])
        c = np.where((ids >= 0) & known, seen[place], 0)
        word = self.word_values("share", np.float64, ids) + self.left_word / (self.n_words + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.where(context > 0, (c - self.d_pair[np.minimum(c, 3)]) / context, 0.0)
        p = np.where(known & (context > 0), high + left * word, word)
        return {
            "n_tokens": n,
            "n_known": np.add.reduceat((ids >= 0).astype(np.int64), first),
            "base_score": np.add.reduceat(base, first),
            "score": np.add.reduceat(np.log10(p), first),
        }


def train(docs: DataFrame, text_col: str = "text", buckets: int | None = None) -> Model:
    """The model of all texts of ``docs``; a null text is empty, texts that repeat count each. Without texts every token has
    the same probability. More than 2^32 - 2 distinct words are a ValueError. ``buckets``: files of each kind, by default as
    many as keep the pairs of one within ``BUCKET_BYTES`` of text, the session's shuffle partitions at least."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    n_parts = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    bits = max(0, (n_parts - 1).bit_length())
    uri = shared_path(spark, "lm")
    store, model = SharedArrays(uri), Model(uri, bits)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))

    def words(batch: list) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(tokens(batch)[0], return_counts=True)

    found = materialize(_count(texts, words, store, "words", bits), "lm-words")
    _fill(store, found, "words", bits)
    row = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()
    model.n_words, model.n_tokens = row["n"], row["t"]
    if model.n_words >= int(BEGIN):
        raise ValueError(f"{model.n_words} distinct words; word ids have 32 bits")
    release(spark)

    def pair_keys(batch: list) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = tokens(batch)
        ids = model.word_ids(hashes).astype(np.uint64)
        before = np.r_[np.uint64(0), ids[:-1]]
        before[np.cumsum(n) - n] = BEGIN
        return np.unique((before << _U32) | ids, return_counts=True)

    span = max(1, -(-model.n_words // (1 << bits)))

    def per_word(keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
        """By range of word ids: how often a pair of count 1, 2, 3+ begins with the word, and how many pairs end with it."""
        first, last = (keys >> _U32).astype(np.int64), (keys & BEGIN).astype(np.int64)
        out = []
        word = np.r_[first * 4 + np.minimum(counts, 3) - 1, last * 4 + 3]
        key, n = np.unique(word.astype(np.uint64), return_counts=True)
        bucket = (key // np.uint64(4 * span)).astype(np.int64)
        own, edge = np.unique(bucket, return_index=True)
        for r, k, c in zip(own.tolist(), np.split(key, edge[1:]), np.split(n, edge[1:]), strict=True):
            out.append((min(r, 1 << bits), pack_chunk(k, c)))
        return out

    figures = materialize(_count(texts, pair_keys, store, "pairs", bits, per_word), "lm-pairs")
    _fill(store, figures, "pairs", bits)
    release(spark)
    heads = figures.filter("range < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "n1", "n2", "n3", "n4")]).first()
    model.n_pairs = heads["n"]
    model.d_pair = discounts(heads["n1"], heads["n2"], heads["n3"], heads["n4"])

    # per word: pairs that begin with it, by count, and its continuation count; ranges of word ids meet in one task each
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table_ = None, None

        def close() -> pa.RecordBatch:
            cont = table_[:, 3]
            begin = table_[:, :3].sum(axis=0) if current == 1 << bits else np.zeros(3, np.int64)
            if current < 1 << bits:
                store.write(f"stats-{current:06d}", table_)
            row = [current, *[int((cont == i).sum()) for i in (1, 2, 3, 4)], int((cont >= 3).sum()), int(cont.sum()), *begin.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["range", "n1", "n2", "n3", "n4", "n3p", "total", "b1", "b2", "b3"])

        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != current:
                    if current is not None:
                        yield close()
                    current, table_ = r, np.zeros((span if r < 1 << bits else 1, 4), np.int64)
                key, n = unpack_chunk(data.as_py())
                key = key.astype(np.int64) - (r * span * 4 if r < 1 << bits else int(BEGIN) * 4)
                np.add.at(table_.reshape(-1), key, n)
        if current is not None:
            yield close()

    stats = figures.filter("range >= 0").select("range", "data").repartition("range").sortWithinPartitions("range").mapInArrow(gather, "range long, n1 long, n2 long, n3 long, n4 long, n3p long, total long, b1 long, b2 long, b3 long")
    stats = materialize(stats, "lm-stats")
    s = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns[1:]]).first()
    model.d_word = discounts(s["n1"], s["n2"], s["n3"], s["n4"])
    total = max(s["total"], 1)
    model.left_word = float(model.d_word[1] * s["n1"] + model.d_word[2] * s["n2"] + model.d_word[3] * s["n3p"]) / total if s["total"] else 1.0
    begin = np.array([s["b1"], s["b2"], s["b3"]])
    model.n_texts = docs.count()
    model.left_begin = float(model.d_pair[1:] @ begin) / max(model.n_texts, 1)
    _word_arrays(spark, store, model, span, total)
    return model


def _fill(store: SharedArrays, figures: DataFrame, name: str, bits: int) -> None:
    """Empty files for buckets without keys (at most as many as there are buckets)."""
    there = {r[0] for r in figures.select("bucket").distinct().collect()}
    for b in set(range(1 << bits)) - there:
        for what, kind in (("keys", np.uint64), ("counts", np.int64)):
            store.write(f"{name}-{b:06d}.{what}", np.zeros(0, kind))


def _word_arrays(spark: SparkSession, store: SharedArrays, model: Model, span: int, total: int) -> None:
    """Beside the keys of each bucket of words: ``left`` (what its pairs leave to shorter contexts) and ``share``."""
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                words = model.arrays("words")
                a, z = int(words.first[b]), int(words.first[b + 1])
                rows = np.zeros((z - a, 4), np.int64)
                for r in range(a // span, -(-z // span)) if z > a else []:
                    i, j = max(a, r * span), min(z, (r + 1) * span)
                    own = store.map(f"stats-{r:06d}", np.int64).reshape(-1, 4)
                    rows[i - a : j - a] = own[i - r * span : j - r * span]
                counts = store.map(f"words-{b:06d}.counts", np.int64)
                left = rows[:, :3] @ model.d_pair[1:] / np.maximum(counts, 1)
                cont = rows[:, 3]
                store.write(f"words-{b:06d}.left", left.astype(np.float64))
                store.write(f"words-{b:06d}.share", ((cont - model.d_word[np.minimum(cont, 3)]) / total).astype(np.float64))
            yield batch

    spark.range(1 << bits, numPartitions=min(1 << bits, 64)).mapInArrow(run, "id long").count()


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; nulls and repeats as in ``train`` and ``score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    return score(docs.withColumn("held_out", held_out), train(docs.filter(~held_out)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score (in place of columns of those names).

    A null text is empty: its end alone is scored. Rows that repeat each get a row, an empty table gives none.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = docs.withColumn(fresh(docs, "__text"), F.col(text_col).cast("binary")).drop(text_col)
    at = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, BATCH_BYTES):
            found = model.score(batch.column(at).to_pylist())
            arrays = [pa.array(found["n_tokens"]), pa.array(found["n_known"]), pa.array(np.full(batch.num_rows, model.n_tokens)), pa.array(found["base_score"]), pa.array(found["score"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], [*batch.schema.names[:at], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:at])
    return rows.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
