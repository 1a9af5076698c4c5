"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r, each bit position i gets a vector m(i) of r+1 bits; table v (a nonzero
vector of r+1 bits) looks only at the positions where <m(i), v> = 1 (mod 2). Two fingerprints that differ at
positions i1..ij, j <= r, agree in table v if v is orthogonal to m(i1)..m(ij): j vectors span at most r of the
r+1 dimensions, so such a v != 0 exists. 2^(r+1)-1 tables thus find every pair within the radius, with certainty.

Buckets hold distinct fingerprints. A bucket above ``bucket_rows`` is split by a second set of masks over the bits that
its own mask leaves open, again with certainty, and so on. Inside a bucket pairs are compared in blocks and only a
spanning forest of the links is returned, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, join_words, materialize, slices, table, word_bounds
from .graph import components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Rows of unpacked bits at a time: 64 bytes each.
_BLOCK = 1 << 16


def simhashes(texts: list[bytes | None], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; a text without words has fingerprint zero."""
    joined, counts = join_words(texts, lower=True)
    _, starts, ends = word_bounds(joined)
    shingles = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    first = np.cumsum(counts) - counts  # word index at which each text begins
    begins = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    # word index of every shingle's first word, and of its last
    at = np.arange(total) - np.repeat(begins, shingles) + np.repeat(first, shingles)
    last = np.minimum(at + words, np.repeat(first + counts, shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    return majority_bits(hashes, shingles)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of hashes that stand group by group, the bits set in over half of each group; zero for an empty group."""
    ones = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[i : i + _BLOCK]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    majority = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (its 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = simhashes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(run, "id long, fp long")
        .select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"))
    )


def covering_masks(bits: list[int], radius: int, level: int = 0) -> list[int]:
    """2^(radius+1)-1 masks over the given bit positions."""
    size = 1 << (radius + 1)
    # a fixed spread of the positions over the vectors, another one at each level
    vectors = [((i * 7 + level * 5 + i // size) % (size - 1)) + 1 for i in range(len(bits))]
    return [sum(1 << b for b, m in zip(bits, vectors, strict=True) if (m & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints."""
    label = np.arange(len(fps))
    edges = []
    for a in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= radius) + a + 1
        while len(near := near[label[near] != label[a]]):  # each turn unites two trees
            edges.append((a, int(near[0])))
            label[label == label[near[0]]] = label[a]
    return edges


def links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = 4096) -> DataFrame:
    """src, dst (nodes) of enough links among distinct fingerprints to connect all that links connect.

    prints: node long, fp long; fp distinct.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may cross batches, and holds bucket_rows rows at most."""

        def close(nodes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            return [(int(nodes[a]), int(nodes[b])) for a, b in _forest(fps, radius)]

        rest: tuple | None = None
        for batch in batches:
            key, node, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            if rest:
                key, node, fp = (np.concatenate(x) for x in zip(rest, (key, node, fp), strict=True))
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[edge, len(key)])
            out = []
            pair = edge[:-1][size[:-1] == 2]  # most buckets hold two
            near = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= radius]
            out += zip(node[near].tolist(), node[near + 1].tolist(), strict=True)
            for a, n in zip(edge[:-1], size[:-1], strict=True):
                if n > 2:
                    out += close(node[a : a + n], fp[a : a + n].view(np.uint64))
            rest = tuple(x[edge[-1] :] for x in (key, node, fp))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["src", "dst"])
        if rest:
            out = close(rest[1], rest[2].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["src", "dst"])

    spark = prints.sparkSession
    every = covering_masks(list(range(64)), radius)
    found = []
    # a bucket: the masks so far as one mask (its open bits are the ones not yet looked at), and the values there
    rows = prints.select("node", "fp", F.explode(F.array(*[F.lit(_signed(m)) for m in every])).alias("mask"))
    level = 0
    while True:  # each level opens bits that the masks before left: distinct fingerprints part in the end
        level += 1
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = materialize(rows.join(sizes, ["mask", "value"]), "simhash-buckets")
        small = rows.filter(F.col("n") <= bucket_rows)
        found.append(
            small.select(F.xxhash64("mask", "value").alias("key"), "node", "fp")
            .repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(compare, "src long, dst long")
        )
        large = rows.filter(F.col("n") > bucket_rows)
        masks = [r.mask & (2**64 - 1) for r in large.select("mask").distinct().collect()]  # at most 15^level
        if not masks:
            break
        if level > 64:
            raise RuntimeError(f"a bucket of {bucket_rows} distinct fingerprints can't be split further; give a larger bucket_rows")
        split = {m: [_signed(m | s) for s in covering_masks([b for b in range(64) if not m >> b & 1], radius, level)] for m in masks}
        deeper = spark.createDataFrame([(_signed(m), s) for m, subs in split.items() for s in set(subs)], "mask long, sub long")
        rows = large.join(F.broadcast(deeper), "mask").select("node", "fp", F.col("sub").alias("mask")).distinct()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_rows: int = 4096) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (long), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id that links reach. A null
    or empty text has fingerprint zero, linked like any other. A null id is not a candidate for component_id unless its
    component has no other. Rows that repeat an id each get a row. An empty table gives no rows. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("fingerprint").alias("_fp")), "simhash")
    nodes = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")), "simhash-nodes")
    # the fingerprint itself names the node; labels are found on it and then carried to the smallest id
    edges = links(nodes.select(F.col("_fp").alias("node"), F.col("_fp").alias("fp")), radius, bucket_rows)
    labels = components(edges)
    labelled = nodes.join(labels, nodes["_fp"] == labels["node"], "left").select("_fp", "_least", "_rows", F.coalesce("label", "_fp").alias("_label"))
    least = labelled.groupBy("_label").agg(F.min("_least").alias("_component"))
    classes = materialize(labelled.join(least, "_label").select("_fp", "_component", "_rows"), "simhash-classes")
    return join_spread(prints, classes, ["_fp"], "_rows", ["_id"]).select(F.col("_id").alias(id_col), F.col("_fp").alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; nulls, ties and repeats as in ``simhash_groups``."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
