"""Near-duplicates by word shingles: every pair of texts whose Jaccard similarity reaches a bound, with certainty.

A text is its set of shingles (all its words, where it has fewer). In one order for all sets, two sets of similarity t or
more share one of their first n - ceil(t * n) + 1 shingles each (prefix filtering), whatever the order is. Shingles that
a sample of the texts repeats stand last in it, which keeps buckets small and changes no result.

Covering locality-sensitive hashing over SimHash fingerprints of the same shingles (``simhash.links``) gives the first
pairs, prefixes find those beyond its radius. All pairs are verified on their whole sets, after a bound that loses none: each
set has a map of parities, four or more for each member, and two maps of one size differ in at most as many bits as the sets
differ in members; a map folds to half its size. To spare the pairs of large groups, each bucket is first held against one
of its own members; texts that links connect by then need no pair of their own. What still shares a bucket and is not connected is compared map by map where the bucket stands, in blocks,
and only pairs whose maps allow the similarity leave it; nothing is capped. Rows of a bucket carry maps folded to half their size
and 32-bit names of the node's lesser keys (keys of one name are one bucket); the whole sets are held
against each other for what leaves it. A bucket is looked at again only if it had more to give.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, join_words, materialize, mix, release, slices, span_hashes, text_of, word_bounds
from .graph import components
from .simhash import RADIUS, links as covering_links, majority_bits

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: About so many texts are looked at for common shingles, and at most so many of those are known. Only time depends on it.
SAMPLE_DOCS, COMMON = 5_000, 200_000
#: Rounds of one comparison a member before maps are compared, then rounds of one partner a member before all pairs that maps
#: allow; and the rows of a block of a bucket. Only time depends on them.
STAR_ROUNDS, MAP_ROUNDS, BLOCK_ROWS = 1, 1, 4096
#: Words of maps that are compared at a time.
_CELLS = 1 << 22
#: Texts that share a bucket are found by a broadcast up to so many.
BROADCAST_TEXTS = 2_000_000
#: Bits of the map of a set: a power of two, of so many at least and so many for each member.
MAP_BITS, MAP_SHARE = 1024, 4


def shingle_sets(texts: list[bytes | None], words: int = SHINGLE_WORDS, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, one text after the other, rare ones first; and where each text's begin."""
    joined, counts = join_words(texts, lower=True)
    data, starts, ends = word_bounds(joined)
    shingles = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    first = np.cumsum(counts) - counts
    begins = np.cumsum(shingles) - shingles
    at = np.arange(int(shingles.sum())) - np.repeat(begins, shingles) + np.repeat(first, shingles)
    last = np.minimum(at + words, np.repeat(first + counts, shingles)) - 1
    hashes = span_hashes(data, starts[at], ends[last])
    owner = np.repeat(np.arange(len(texts)), shingles)
    rank = np.zeros(len(hashes), np.int64)
    if common is not None and len(common[0]) and len(hashes):
        place = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        rank = np.where(common[0][place] == hashes, common[1][place], 0)
    order = np.lexsort((hashes, rank, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that a sample repeats, in order, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(0).to_pylist(), words)[0].view(np.int64))], ["gram"])

    part = max(1, texts.count() // SAMPLE_DOCS)
    grams = texts.filter(F.pmod("text_hash", F.lit(part)) == 0).select(F.col("text").cast("binary")).mapInArrow(run, "gram long")
    top = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "gram").limit(COMMON).toPandas()
    gram = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], top["n"].to_numpy(np.int64)[order]


def set_maps(grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of all sets as 64-bit words, one after the other, and the words of each: a bit says whether an odd number of members have its remainder."""
    n = np.diff(begins)
    bits = np.maximum(MAP_BITS, 1 << np.ceil(np.log2(np.maximum(n * MAP_SHARE, 1))).astype(np.int64))
    first = np.cumsum(bits) - bits
    at = np.repeat(first, n) + (grams & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64), bits // 64


def _possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (src, dst), those whose maps allow the similarity: sets that reach it differ in (1 - s) / (1 + s) of their members at most."""
    one = maps.select(F.col("node").alias("src"), F.col("n").alias("_n"), F.col("map").alias("_a"))
    two = maps.select(F.col("node").alias("dst"), F.col("n").alias("_m"), F.col("map").alias("_b"))
    xor = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))

    def folded(own: str, other: str) -> Column:  # sizes of which one is 0.8 of the other or more have maps that are equal or one the double
        return F.when(F.size(own) > F.size(other), xor(F.slice(own, 1, F.size(other)), F.slice(own, F.size(other) + 1, F.size(other)))).otherwise(F.col(own))

    apart = F.aggregate(F.transform(xor(folded("_a", "_b"), folded("_b", "_a")), lambda w: F.bit_count(w)), F.lit(0), lambda x, y: x + y)
    most = (1 - similarity) / (1 + similarity)
    both = F.col("_n") + F.col("_m")
    fits = F.least("_n", "_m") >= similarity * F.greatest("_n", "_m") - 1e-9
    return pairs.join(one, "src").join(two, "dst").filter(fits).filter(F.when(F.greatest(F.size("_a"), F.size("_b")) <= 2 * F.least(F.size("_a"), F.size("_b")), apart).otherwise(0) <= most * both + 1e-6).select("src", "dst")


def _allowed(n1: np.ndarray, maps1: np.ndarray, n2: np.ndarray, maps2: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose sizes and maps (rows of one width) allow the similarity."""
    most = (1 - similarity) / (1 + similarity)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, _CELLS // max(maps2.size, 1))
    for i in range(0, len(n1), step):
        a, b = n1[i : i + step, None], n2[None, :]
        fits = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
        apart = np.bitwise_count(maps1[i : i + step, None, :] ^ maps2[None, :, :]).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero(fits & (apart <= most * (a + b) + 1e-6))
        first.append(x + i)
        second.append(y)
    return np.concatenate(first), np.concatenate(second)


def block_pairs(n: np.ndarray, label: np.ndarray, side: np.ndarray, maps: list[np.ndarray], similarity: float) -> np.ndarray:
    """Index pairs of unlike labels that the maps allow: of rows of sides 0 and 1, or of any rows where all are on side 2."""
    width = np.array([len(m) for m in maps], np.int64)
    found = []
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        wide = np.flatnonzero(width == 2 * w)
        here = np.stack([maps[i] for i in own])
        pairs = [(own, here, own, here)]
        if len(wide):
            folded = np.stack([maps[i] for i in wide])
            pairs.append((own, here, wide, folded[:, :w] ^ folded[:, w:]))
        for left, m1, right, m2 in pairs:
            x, y = _allowed(n[left], m1, n[right], m2, similarity)
            x, y = left[x], right[y]
            keep = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2)) & ((left is not right) | (x < y))
            found.append(np.stack([x[keep], y[keep]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _least_only(pairs: np.ndarray, lesser: list[np.ndarray]) -> np.ndarray:
    """The pairs that share no key below that of this bucket: each pair leaves one bucket only."""
    own = [not len(np.intersect1d(lesser[x], lesser[y], assume_unique=True)) for x, y in pairs.tolist()]
    return pairs[np.array(own, bool)]


def _one_each(pairs: np.ndarray, node: np.ndarray, turn: int) -> np.ndarray:
    """Of the pairs, for each row that with the partner of least hash; another hash in each turn."""
    both = np.concatenate([pairs, pairs[:, ::-1]])
    rank = mix(node.view(np.uint64) + np.uint64(turn))[both[:, 1]]
    both = both[np.lexsort((rank, both[:, 0]))]
    return both[np.r_[True, both[1:, 0] != both[:-1, 0]]] if len(both) else both


def _folded(of_map: str) -> Column:
    """The map of half the size: its bits tell of the same set."""
    half = (F.size(of_map) / 2).cast("int")
    return F.zip_with(F.slice(of_map, F.lit(1), half), F.slice(of_map, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _bucket_pairs(rows: DataFrame, similarity: float, block_rows: int, turn: int | None) -> DataFrame:
    """src, dst of pairs that maps allow in each bucket, and rows that hold only the key of a bucket that has more of them; rows:
    key, c (rows of the key), node, n, label, map, lesser (those of the node's keys that are looked at and below this one).

    A bucket above block_rows is dealt into blocks, each pair of which is a bucket of its own. With a turn each node gets one
    partner a bucket; without, all pairs leave.
    """
    blocks = F.ceil(F.col("c") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    part = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side"))))
    columns = ["node", "n", "label", "key", "map", "lesser"]
    dealt = rows.select(*columns, part.alias("p")).select(F.xxhash64("key", "p.i", "p.j").alias("bucket"), "p.side", *columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one may cross batches."""

        def lists(column: pa.ListArray) -> list[np.ndarray]:
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
            return [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]

        def pairs(bucket: pa.RecordBatch) -> pa.RecordBatch:
            side, node, n, label, key = (bucket.column(i).to_numpy() for i in range(1, 6))
            found = block_pairs(n, label, side, [m.view(np.uint64) for m in lists(bucket.column(6))], similarity)
            if len(found):
                found = _least_only(found, lists(bucket.column(7)))
            more = np.zeros(0, np.int32)
            if turn is not None and len(found):
                every, found = len(found), np.unique(np.sort(_one_each(found, node, turn), axis=1), axis=0)
                more = np.unique(key) if len(found) < every else more
            x, y = node[found[:, 0]], node[found[:, 1]]
            ends = [pa.concat_arrays([pa.array(end), pa.nulls(len(more), pa.int64())]) for end in (np.maximum(x, y), np.minimum(x, y))]
            return pa.RecordBatch.from_arrays([*ends, pa.concat_arrays([pa.nulls(len(x), pa.int32()), pa.array(more)])], ["src", "dst", "key"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield pairs(batch.slice(a, b - a))
            rest = batch.slice(int(edge[-1]))
        if rest is not None:
            yield pairs(rest)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "src long, dst long, key int")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (src, dst), those whose sets reach the similarity."""
    one = sets.select(F.col("node").alias("src"), F.col("grams").alias("_a"))
    two = sets.select(F.col("node").alias("dst"), F.col("grams").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "src").join(two, "dst").filter(both >= similarity * (F.size("_a") + F.size("_b") - both) - 1e-9).select("src", "dst")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, text_hash (of the text, a null as empty), component (long).

    Texts link at a Jaccard similarity of their sets of ``words``-word shingles of ``similarity`` or more; component names
    what links connect; ``radius`` (of the first pairs) and ``block_rows`` change no result. Words are compared in lower case (ASCII); texts without words link to each other only. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    known = spark.sparkContext.broadcast(_common(texts, words))

    def looked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, begins = shingle_sets(batch.column(1).to_pylist(), words, known.value)
        nodes = np.array([xxhash.xxh64_intdigest(grams[a:b].tobytes()) for a, b in zip(begins[:-1], begins[1:], strict=True)], np.uint64)
        return grams, begins, nodes.view(np.int64)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            grams, begins, nodes = looked(batch)
            n = np.diff(begins)
            size = np.array([x - ceil(similarity * x - 1e-9) + 1 if x else 0 for x in n.tolist()], np.int64)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[:-1], size)
            maps, words_of = set_maps(grams, begins)
            prints = majority_bits(grams, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes), pa.array(n.astype(np.int64)), pa.array(prints.view(np.int64)), _lists(maps, words_of), _lists(grams[at], size)],
                ["text_hash", "node", "n", "fp", "map", "keys"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            grams, begins, nodes = looked(batch)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(grams, np.diff(begins))], ["node", "grams"])

    plain = texts.select("text_hash", F.col("text").cast("binary").alias("text"))
    found = materialize(plain.mapInArrow(prefixes, "text_hash long, node long, n long, fp long, map array<long>, keys array<long>"), "near-prefixes")
    rows = found.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    # of shingles that the same texts share, as those of a passage are, one is enough
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *members).filter("c > 1").groupBy("c", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    buckets = materialize(rows.join(shared, "key").select("node", F.hash("key").alias("key")), "near-buckets")
    release(spark)
    # a text of each set; its map for the sets that share a bucket or a fingerprint
    meant = materialize(found.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("map").alias("map")), "near-meant")

    def checked(pairs: DataFrame, possible: bool = False) -> DataFrame:
        pairs = materialize(pairs if possible else _possible(pairs, meant, similarity), "near-pairs")
        ends = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
        wanted = materialize(meant.select("node", "text_hash").join(ends, "node", "left_semi").select("text_hash"), "near-wanted")
        few = wanted.count() <= BROADCAST_TEXTS
        sets = materialize(plain.join(F.broadcast(wanted) if few else wanted, "text_hash", "left_semi").mapInArrow(whole, "node long, grams array<long>").dropDuplicates(["node"]), "near-sets")
        good = materialize(_verified(pairs, sets, similarity), "near-links")
        for old in (pairs, wanted, sets):
            drop_shared(old)
        release(spark)
        return good

    # texts of one fingerprint meet its first one, which covering tables hold against others within the radius
    prints = materialize(meant.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    near_prints = covering_links(prints.select("node", "fp"), radius)
    alike = meant.select("fp", F.col("node").alias("dst")).join(prints.select("fp", F.col("node").alias("src")), "fp").filter("src <> dst").select("src", "dst")
    links = checked(near_prints.union(alike).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    labels = materialize(components(links), "near-labels")
    sized = buckets.join(meant.select("node", "n"), "node")
    more = None
    for turn in range(STAR_ROUNDS + MAP_ROUNDS + 1):
        named = sized.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        seed = F.lit(turn)
        # a centre of each bucket that is not yet connected: another one in each round
        centre = named.groupBy("key").agg(
            F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("node", seed).alias("h"), "node", "n", "label")).alias("top")
        )
        centre = centre.filter("low <> high")
        if more is not None:  # what other buckets still hold has been compared: labels only grow together
            centre = centre.join(more, "key", "left_semi")
        loose = materialize(centre.select("key", "c", F.col("top.node").alias("dst"), F.col("top.n").alias("m"), F.col("top.label").alias("to")), "near-loose")
        if loose.isEmpty():
            break
        if turn < STAR_ROUNDS:
            mine = named.join(loose, "key")
            apart = mine.filter("label <> to").filter(F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
            good = checked(apart.select(F.greatest("node", "dst").alias("src"), F.least("node", "dst").alias("dst")).distinct())
        else:
            open_ = materialize(named.join(loose.select("key", "c"), "key").select("key", "c", "node", "n", "label"), "near-open")
            shared = open_.groupBy("node").agg(F.collect_set("key").alias("shared"))  # a text's own shingles at most
            rows = open_.join(meant.select("node", _folded("map").alias("map")).join(shared, "node"), "node")
            rows = rows.withColumn("lesser", F.filter("shared", lambda other: other < F.col("key"))).drop("shared")
            found_pairs = materialize(_bucket_pairs(rows, similarity, block_rows, turn if turn < STAR_ROUNDS + MAP_ROUNDS else None), "near-found")
            good = checked(found_pairs.filter("src is not null").select("src", "dst").distinct(), possible=True)
            more = found_pairs.filter("src is null").select("key").distinct()
            drop_shared(open_)
        links = links.union(good)
        labels = materialize(components(links), "near-labels")
        drop_shared(loose)
    out = texts.select("id", "text_hash").join(found.select("text_hash", "node").distinct(), "text_hash")
    return out.join(labels, "node", "left").select(F.col("id").alias(id_col), "text_hash", F.coalesce("label", "node").alias("component"))
