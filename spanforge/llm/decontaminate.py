"""Benchmark decontamination by winnowing; DataFrame functions only.

Every run of w = window - k + 1 consecutive k-grams keeps the one of least hash (the first of equals), so two texts
that share ``window`` words share a kept k-gram at the same place in the shared span. Kept k-grams of training and
test texts are joined; each hit is extended word by word to either side, by w - 1 words at most, and counts if it then
spans ``window`` words. Hits of one span overlap and are united. An item of fewer words than a window is looked for
as a whole: for each such length that occurs, all grams of that length are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_of

WINDOW, K = 8, 4
MIN_ITEMS = 2
#: Sides up to these sizes are broadcast, after a count: rows of about 100 and 50 bytes.
BROADCAST_SEEDS, BROADCAST_POSITIONS = 300_000, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z only."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(hashes: Column, k: int) -> Column:
    at = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def _seed(seed: Column, at: Column, k: int) -> Column:
    return F.struct(seed.alias("seed"), at.cast("int").alias("pos"), F.lit(k).alias("k"))


def winnowed(hashes: Column, window: int, k: int) -> Column:
    """Kept k-grams of a list of word hashes: array of (seed, pos, k)."""
    w = window - k + 1
    low = (1 << (w - 1).bit_length()) - 1  # the lowest bits hold the place in the run: ties go to the first

    def minima(g: Column) -> Column:
        at = F.when(F.size(g) >= w, F.sequence(F.lit(0), F.size(g) - w)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda j: F.least(*[F.get(g, j + o).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(o)) for o in range(w)]))

    def places(m: Column) -> Column:
        return F.transform(m, lambda x, j: _seed(x.bitwiseAND(F.lit(~low)), j + x.bitwiseAND(F.lit(low)), k))

    def once(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["pos"] != x["pos"]))

    return let(let(let(_grams(hashes, k), minima), places), once)


def _whole(hashes: Column, k: int) -> Column:
    return F.transform(_grams(hashes, k), lambda g, i: _seed(g, i, k))


def _context(words: Column, seed: Column, reach: int) -> Column:
    """The words around a seed, and where it starts among them."""
    start = F.greatest(seed["pos"] - reach, F.lit(0))
    return F.struct(
        seed["seed"].alias("seed"),
        seed["pos"].alias("pos"),
        seed["k"].alias("k"),
        F.slice(words, start + 1, seed["pos"] - start + seed["k"] + reach).alias("ctx"),
        (seed["pos"] - start).alias("off"),
    )


def _run(equal: list[Column]) -> Column:
    """How many of the conditions hold before the first that does not."""
    out = F.lit(len(equal))
    for i, e in reversed(list(enumerate(equal))):
        out = F.when(F.coalesce(e, F.lit(False)), out).otherwise(F.lit(i))
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
    broadcast_seeds: int = BROADCAST_SEEDS,
    broadcast_positions: int = BROADCAST_POSITIONS,
) -> DataFrame:
    """One row per document: ``id_col``, text_hash, n_words, n_hit, spans (array of start, end, item_id), items (array of string).

    A null text has no words. A null item id is no item; an item id may be on several texts and counts once. Rows that
    repeat an id each get the result of their own text. Without documents there are no rows, without items no hits.
    Other columns of either table are ignored.
    """
    reach = window - k
    of_items = items.filter(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("string").alias("item_id"), words_of(text_of(item_text_col)).alias("words"))
    of_items = materialize(of_items.filter(F.size("words") > 0).withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x))), "items")
    short = sorted(r[0] for r in of_items.filter(F.size("words") < window).select(F.size("words")).distinct().collect())  # window - 1 values at most
    own = F.when(F.size("words") >= window, winnowed(F.col("hashes"), window, k))
    for m in short:
        own = own.when(F.size("words") == m, _whole(F.col("hashes"), m))
    seeds = of_items.select("item_id", F.explode(F.transform(own, lambda s: _context(F.col("words"), s, reach))).alias("s")).select("item_id", "s.*")
    seeds = materialize(seeds, "item-seeds")
    few_seeds = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    small = F.broadcast if few_seeds else (lambda x: x)

    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash")]
    texts = docs.select(*key, F.col(id_col).alias("_shown"), words_of(text_of(text_col)).alias("words"))
    kept = let(
        F.transform("words", lambda x: F.xxhash64(x)),
        lambda h: F.concat(winnowed(h, window, k), *[_whole(h, m) for m in short]),
    )
    found = texts.select("_id", "_hash", F.explode(kept).alias("s")).select("_id", "_hash", "s.*")
    found = found.join(small(seeds.select("seed", "k").distinct()), ["seed", "k"], "left_semi")
    places = materialize(found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("seed", "pos", "k")).alias("places")), "places")
    n_places = places.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0]
    near = F.broadcast(places) if n_places <= broadcast_positions else places

    looked = texts.join(near, ["_id", "_hash"], "left").select(
        "_id", "_hash", "_shown", F.size("words").cast("long").alias("n_words"), F.transform("places", lambda s: _context(F.col("words"), s, reach)).alias("hits")
    )
    looked = materialize(looked, "contexts")
    hits = looked.select("_id", "_hash", F.explode("hits").alias("s")).select("_id", "_hash", "s.*").distinct()
    both = hits.join(
        small(seeds.select("seed", "k", "item_id", F.col("ctx").alias("ctx2"), F.col("off").alias("off2"))), ["seed", "k"]
    )
    same = lambda by: F.get("ctx", F.col("off") + by) == F.get("ctx2", F.col("off2") + by)
    middle = F.lit(True)
    for j in range(max([k, *short])):
        middle = middle & ((F.lit(j) >= F.col("k")) | F.coalesce(same(F.lit(j)), F.lit(False)))
    whole = F.col("k").isin(short) & (F.size("ctx2") == F.col("k")) & (F.col("off2") == 0) if short else F.lit(False)
    left = F.when(whole, 0).otherwise(_run([same(F.lit(-j)) for j in range(1, reach + 1)]))
    right = F.when(whole, 0).otherwise(_run([same(F.col("k") + j) for j in range(reach)]))
    spans = (
        both.filter(middle)
        .select("_id", "_hash", "item_id", (F.col("pos") - left).alias("start"), (F.col("pos") + F.col("k") + right).alias("end"), whole.alias("whole"))
        .filter((F.col("end") - F.col("start") >= window) | F.col("whole"))
        .select("_id", "_hash", "item_id", "start", "end")
        .distinct()
    )
    per_doc = spans.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "item_id"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).cast("long").alias("n"), F.greatest(acc["to"], s["end"]).alias("to")
        ),
    )["n"]
    per_doc = per_doc.withColumn("n_hit", covered).withColumn("items", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))))
    out = looked.drop("hits").join(per_doc, ["_id", "_hash"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_shown").alias(id_col), F.col("_hash").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", none).alias("items")
    )


def contaminated_ids(docs: DataFrame, items: DataFrame, min_items: int = MIN_ITEMS, min_words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_hash of the documents that share ``min_words`` consecutive words with an item, or have occurring windows of ``min_items`` items.

    The second part is for items of fewer words than a window: one of these in a text is no evidence. Nulls, repeated
    rows and empty tables are as in ``contamination``; each id and text comes once.
    """
    leaked = F.exists("spans", lambda s: s["end"] - s["start"] >= min_words) | (F.size("items") >= min_items)
    return contamination(docs, items, id_col, text_col).filter(leaked).select(id_col, "text_hash").distinct()


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return out.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = f"""
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bl AS (SELECT item_id, w, least(len(w), 8) AS l FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, l, w[i:i + l - 1] AS g FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
    dl AS (SELECT doc_id, w, l FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l),
    dw AS (SELECT doc_id, l, i, w[i:i + l - 1] AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dl)),
    hits AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g)"""

SQL = {
    "op8_decontaminate": f"""
        WITH {HITS_SQL},
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""
}
