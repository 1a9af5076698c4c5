"""Best-fit packing into sequences, certified by dual-feasible-function bounds.

Pieces are dealt to groups of bounded size. Each group is packed by best-fit decreasing and gets a lower bound on its
sequences: the largest total of a dual feasible function over its lengths. A group whose count equals its bound is
certified optimal. Groups with a gap give up the pieces of their sequences that are not full, the others those of
their emptiest sequence; these exchange places in new groups and are packed again. A round is taken over only if it
needs fewer sequences than it took apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .tokens import CACHE_ENTRIES, encoder, public_file

SIZE, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Sequences and pieces of a group, about.
GROUP_SEQUENCES, GROUP_PIECES = 512, 50_000
ROUNDS = 4


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and end_id, cut only where longer than a sequence.

    ``cache_entries``: pieces that a worker remembers, about 150 bytes each; only time depends on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, False, cache_entries).ids
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1, tokens=True):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or b"") + end
                n = len(ids) // 4
                rows += [(doc, i, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)])) for i, s in enumerate(range(0, n, size))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The least number of sequences that any packing needs, as far as two families of dual feasible functions tell."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    n = np.r_[0, np.cumsum(count)]  # pieces shorter than x
    total = np.r_[0, np.cumsum(count * np.arange(size + 1))]
    eps = np.arange(size // 2 + 1)
    # above size - eps counts as a whole sequence, below eps as nothing
    whole = n[size + 1] - n[size - eps + 1]
    best = int(np.max(-(-(whole * size + total[size - eps + 1] - total[eps]) // size)))
    x = np.arange(size + 1)
    for k in range(1, 33):
        exact = ((k + 1) * x) % size == 0
        value = np.where(exact, x * k, (k + 1) * x // size * size)  # in units of size * k
        best = max(best, -(-int((value * count).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The sequence of each piece: longest first, into the fullest sequence that still takes it."""
    place = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0  # bit r: some sequence has r places left
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = there >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            seq = rooms[room].pop()
            if not rooms[room]:
                there &= ~(1 << room)
        else:
            room, seq, n = size, n, n + 1
        place[i] = seq
        rooms[room - x].append(seq)
        there |= 1 << (room - x)
    return place


def _pack(pieces: DataFrame, n_groups: int, tag: int, size: int) -> DataFrame:
    """Deal the pieces to groups and pack each group; ``loose``: its sequence is to be taken apart in the next round."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        place = best_fit_decreasing(lengths, size)
        n = int(place.max()) + 1
        fill = np.bincount(place, lengths, n).astype(np.int64)
        gap = n - lower_bound(lengths, size)
        emptiest = int(np.argmin(fill))
        loose = fill[place] < size if gap else (place == emptiest) & (fill[place] < size)
        order = np.lexsort((np.arange(len(place)), place))
        ends = np.cumsum(lengths[order])
        first = np.r_[True, np.diff(place[order]) != 0]
        offset = np.empty(len(place), np.int64)
        offset[order] = ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        g = int(group.column("g")[0].as_py())
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(place + (((tag << 30) + g) << 26))).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(tag)), F.lit(n_groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean")


def pack(pieces: DataFrame, size: int = SIZE, group_sequences: int = GROUP_SEQUENCES, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32; lengths from 1 to size) with sequence_id and offset."""

    def groups(df: DataFrame) -> int:
        n, tokens = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return max(1, -(-tokens // (size * group_sequences)), -(-n // group_pieces))

    packed = materialize(_pack(pieces, groups(pieces), 0, size), "packed")
    done = []
    for tag in range(1, rounds):
        loose = packed.filter("loose").drop("sequence_id", "offset", "loose")
        before = packed.filter("loose").select("sequence_id").distinct().count()
        if before < 2:
            break
        again = materialize(_pack(loose, groups(loose), tag, size), "packed")
        if again.select("sequence_id").distinct().count() >= before:
            break
        done.append(packed.filter("not loose"))
        packed = again
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("loose")


def op9_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Null texts are empty: one piece, the end id. A null or repeated doc_id is carried along. No rows give no rows."""
    pieces = materialize(token_pieces(table(spark, sf_dir, "documents"), tokenizer or public_file(TOKENIZER)), "pieces")
    return pack(pieces)
