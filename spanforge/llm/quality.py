"""A document classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words). Every passage is encoded (character and word
statistics, one hidden layer), a gated attention unit w . (tanh(V h) * sigmoid(U h)) weighs the passages of a document against
each other, and the weighted passage representation is scored. Weights are learned from document labels alone, on at most
``TRAIN_DOCS`` labelled documents (those of least hash); every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, join_words, slices, span_hashes, table, text_of, word_bounds

PASSAGE_WORDS, TRAIN_DOCS, HIDDEN, ATTENTION, EPOCHS = 50, 6000, 24, 12, 40
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte classes: other, lower, upper, digit, space, first and further bytes of characters beyond ASCII, then each mark.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[32] = 4
_CLASS[0xC0:] = 5
_CLASS[0x80:0xC0] = 6
_CLASS[list(_MARKS)] = 7 + np.arange(len(_MARKS))
_N_CLASSES = 7 + len(_MARKS)
N_FEATURES = _N_CLASSES + 6


def passages(texts: list[bytes | None], size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text: one at least, all zero, for a text without words."""
    joined, counts = join_words(texts)
    data, starts, ends = word_bounds(joined)
    per_text = np.maximum(-(-counts // size), 1)
    n = int(per_text.sum())
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(starts):
        return out, per_text
    first_word, first_passage = np.cumsum(counts) - counts, np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(texts)), counts)
    of_word = first_passage[owner] + (np.arange(len(starts)) - first_word[owner]) // size
    lengths = ends - starts
    of_byte = np.repeat(of_word, lengths + 1)
    by_class = np.bincount(of_byte * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    size_of = np.maximum(by_class.sum(axis=1, keepdims=True), 1)
    out[:, :_N_CLASSES] = np.sqrt(by_class / size_of)
    words = np.bincount(of_word, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(of_word, lengths, n) / some
    hashes = span_hashes(data, starts, ends)
    pairs = hashes ^ (of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(pairs, return_index=True)
    distinct = np.bincount(of_word[once], minlength=n)
    marked = _CLASS[data[ends - 1]] >= 7
    out[:, _N_CLASSES:] = np.stack(
        [
            np.minimum(mean, 40) / 10,
            np.sqrt(np.minimum(np.bincount(of_word, lengths.astype(float) ** 2, n) / some - mean**2, 400).clip(0)) / 10,
            np.bincount(of_word, lengths <= 3, n) / some,
            (words - distinct) / some,
            np.bincount(of_word, marked, n) / some,
            np.minimum(words, size) / size,
        ],
        axis=1,
    )
    return out, per_text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BagModel:
    """Gated attention over the passages of a bag; ``p`` holds the arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - p["mean"]) / p["std"]
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["w"]
        first = np.cumsum(sizes) - sizes
        bag = np.repeat(np.arange(len(sizes)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "first": first, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; error: (score - label) / number of bags."""
        p = self.p
        dz = error[:, None] * p["c"]
        dzp = dz[f["bag"]]
        da = (dzp * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["bag"]])
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dzp + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w1": f["x"].T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN, attention: int = ATTENTION, seed: int = 7) -> BagModel:
    """Adam over small groups of bags. Without both labels the score is the share of label 1 (a half without any)."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    p = {
        "mean": x.mean(axis=0) if len(x) else np.zeros(n),
        "std": x.std(axis=0) + 1e-2 if len(x) else np.ones(n),
        "w1": rng.normal(0, n**-0.5, (n, hidden)),
        "b1": np.zeros(hidden),
        "v": rng.normal(0, hidden**-0.5, (hidden, attention)),
        "u": rng.normal(0, hidden**-0.5, (hidden, attention)),
        "w": np.zeros(attention),
        "c": np.zeros(hidden),
        "d": np.zeros(1),
    }
    model = BagModel(p)
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        p["d"] += np.log((share * 0.98 + 0.01) / (0.99 - share * 0.98))
        return model
    first = np.cumsum(sizes) - sizes
    moment = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in ("w1", "b1", "v", "u", "w", "c", "d")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            rows = np.concatenate([np.arange(first[b], first[b] + sizes[b]) for b in own])
            f = model.forward(x[rows], sizes[own])
            step += 1
            for k, g in model.gradients(f, (f["y"] - labels[own]) / len(own)).items():
                g = g + 1e-4 * p[k]
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= 0.01 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> BagModel:
    """docs, labels: those to learn from. At most max_docs labelled ids are taken, those of least hash.

    Null labels and null ids are not learned from; an id with several labels counts by their majority, 1 where they are
    even. Rows that repeat a labelled id count each. Without labels every score is a half.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id", F.lit("train")), "_id")
        .limit(max_docs)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x, sizes = passages(batch.column(0).to_pylist())
            ends = np.cumsum(sizes)
            raw = [x[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], ["x", "label", "id"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id")
    found = rows.select("_text", "_label", "_id").mapInArrow(run, "x binary, label double, id long").toArrow()  # max_docs ids
    bags = sorted(zip(found.column("id").to_pylist(), found.column("x").to_pylist(), found.column("label").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(b for _, b, _ in bags), np.float32).reshape(-1, N_FEATURES).astype(float)
    sizes = np.array([len(b) // (4 * N_FEATURES) for _, b, _ in bags], np.int64)
    return fit(x, sizes, np.array([y for _, _, y in bags]))


def score(docs: DataFrame, model: BagModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with the score of each whole text (0 to 1) as ``out_col``, in place of a column of that name.

    A null or empty text is one blank passage. Rows that repeat each get a row, an empty table gives none.
    """
    docs = docs.drop(out_col)
    own = fresh(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for batch in slices(batches, batch_column):
            if place is None:
                place = batch.schema.get_field_index(own)
            x, sizes = passages(batch.column(place).to_pylist())
            y = model.forward(x, sizes)["y"]
            names = [n for n in batch.schema.names if n != own]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(y)], [*names, out_col])

    rows = docs.withColumn(own, F.col(text_col).cast("binary"))
    batch_column = len(rows.columns) - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out_col}` double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on) of every document; nulls and repeats as in ``train`` and ``score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    scored = score(docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), text_of("text").alias("text")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
