"""Language identification by word-first backoff.

A word that was seen in learning is scored by its log frequency in each language. An unseen word falls back to its
character n-grams: the longest length of which any n-gram was seen is used, down to single characters. All words and
n-grams of the learning sample are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, slices, table, text_of

#: The bound of the fit, documents to learn from per language; and the longest n-grams.
LANG_DOCS, MAX_GRAM = 3000, 4
#: Tokens that a worker remembers; numbers of a table that is kept whole, as a row for each word or n-gram.
MEMO_ENTRIES, DENSE = 800_000, 1 << 24
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789«»„“”‘’¿¡…–—"


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(_EDGES) for t in text.lower().split()) if w]


class Model:
    """Log probabilities of words (place 0) and n-grams of each length: what unseen ones have, and for those seen how much more in which languages."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.unseen = np.zeros((MAX_GRAM + 1, len(langs)))
        self.places: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        self.first = [np.zeros(1, np.int64)] * (MAX_GRAM + 1)
        self.lang = [np.zeros(0, np.int16)] * (MAX_GRAM + 1)
        self.more = [np.zeros(0)] * (MAX_GRAM + 1)
        self.dense: list[np.ndarray | None] = [None] * (MAX_GRAM + 1)

    def whole(self) -> None:
        """Keep tables of up to ``DENSE`` numbers as rows over all languages: faster, and of the same values."""
        self.dense = [self._rows(n, np.arange(len(self.places[n]))) if len(self.places[n]) * len(self.langs) <= DENSE else None for n in range(MAX_GRAM + 1)]

    def _rows(self, n: int, at: np.ndarray) -> np.ndarray:
        out = np.repeat(self.unseen[n][None, :], len(at), axis=0)
        sizes = self.first[n][at + 1] - self.first[n][at]
        own = np.repeat(np.arange(len(at)), sizes)
        flat = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[n][at], sizes)
        out[own, self.lang[n][flat]] += self.more[n][flat]
        return out

    def log_p(self, n: int, grams: list[str]) -> np.ndarray | None:
        """The sum over those that any language has, in each language; None if there are none."""
        place = self.places[n]
        at = [place[g] for g in grams if g in place]
        if not at:
            return None
        if self.dense[n] is not None:
            return self.dense[n][at[0]] if len(at) == 1 else self.dense[n][at].sum(axis=0)
        return self._rows(n, np.array(at)).sum(axis=0)


def train(docs: DataFrame, lang_docs: int = LANG_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of about lang_docs documents a language (those of least hash of their id).

    Rows with a null text or language are not learned from, null ids are an id like any other, rows that repeat count
    each. Without rows there are no languages. Other columns are ignored.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(id_col), F.lit("train")).alias("h")
    )
    # one row a language: the sample is chosen where the texts are, nothing else moves
    shares = [(r["lang"], lang_docs / r["count"]) for r in labelled.groupBy("lang").count().collect()]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    chosen = labelled.join(F.broadcast(share), "lang").filter(F.col("share") * 2.0**63 >= F.abs(F.col("h").cast("double"))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 23):
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(words_of(text.decode()))
            rows = []
            for lang, counted in words.items():
                rows += [(lang, 0, w, c) for w, c in counted.items()]
                for n in range(1, MAX_GRAM + 1):
                    parts: Counter = Counter()
                    for w, c in counted.items():
                        for g in grams(w, n):
                            parts[g] += c
                    rows += [(lang, n, g, c) for g, c in parts.items()]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "n", "gram", "c"])

    counts = chosen.mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # bounded by the sample
    langs = sorted(found.column("lang").unique().to_pylist())
    model = Model(langs)
    lang_at = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([lang_at[x] for x in found.column("lang").to_pylist()], np.int16)
    n_of, c_of, gram_of = found.column("n").to_numpy(), found.column("c").to_numpy(), np.array(found.column("gram").to_pylist(), object)
    for n in range(MAX_GRAM + 1):
        own = np.flatnonzero(n_of == n)
        own = own[np.argsort(gram_of[own], kind="stable")]
        gram, c, li = gram_of[own], c_of[own], lang[own]
        new = np.r_[np.ones(min(len(own), 1), bool), gram[1:] != gram[:-1]]
        total = np.bincount(li, c, len(langs)) + 0.5 * (np.bincount(li, minlength=len(langs)) + 1)
        model.unseen[n] = np.log(0.5 / total)
        model.places[n] = {g: i for i, g in enumerate(gram[new].tolist())}
        model.first[n] = np.r_[np.flatnonzero(new), len(own)]
        model.lang[n] = li
        model.more[n] = np.log((c + 0.5) / total[li]) - model.unseen[n][li]
    return model


def evidence(model: Model, token: str) -> np.ndarray:
    """Log probability of a token's word in each language; zero for a token without letters."""
    word = token.strip(_EDGES)
    if word:
        known = model.log_p(0, [word])
        if known is not None:
            return known
        for n in range(MAX_GRAM, 0, -1):
            found = model.log_p(n, grams(word, n))
            if found is not None:
                return found / n
    return np.zeros(len(model.langs))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score: ``und`` and 0 for a null text, a text without letters, or without any language learned.

    They take the place of columns of those names. Of languages of equal score the first by name is taken. Rows that
    repeat each get a row, an empty table gives none.
    """
    docs = docs.drop("lang_pred", "score")
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.whole()
        memo: dict[str, int] = {}
        vectors = np.zeros((1024, len(langs)))
        for batch in slices(batches, at_text):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            names, scores = [], []
            for raw in batch.column(at_text).to_pylist():
                text = raw.decode() if raw else ""
                if not langs or not _LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                tokens = text.lower().split()
                try:
                    ids = list(map(memo.__getitem__, tokens))
                except KeyError:
                    for t in tokens:
                        if t not in memo:
                            if len(memo) == len(vectors):
                                vectors = np.r_[vectors, np.zeros_like(vectors)]
                            vectors[len(memo)] = evidence(own, t)
                            memo[t] = len(memo)
                    ids = list(map(memo.__getitem__, tokens))
                total = vectors[ids].sum(axis=0)
                p = np.exp(total - total.max())
                best = int(np.argmax(p))
                names.append(langs[best])
                scores.append(float(p[best] / p.sum()))
            keep = [i for i in range(batch.num_columns) if i != at_text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(batch.schema.names[i] for i in keep), "lang_pred", "score"])

    rows = docs.withColumn(fresh(docs, "__text"), F.col(text_col).cast("binary"))
    at_text = len(rows.columns) - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, nulls and repeats as in ``train`` and ``predict``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), text_of("text").alias("text")), model).drop("text")
