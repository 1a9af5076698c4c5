"""Token ids of all documents as files of the codec's format, in ascending order of doc_id, and back.

A file holds a run of documents with their ids; files stand in a table of the shared folder (part, seq, payload), which Spark
commits and retries like any other output. Parts follow the order of doc_id, files that of their part. Everything that is read
back comes from the files, their heads included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import HEAD_BYTES, read_file, read_head, write_file
from .common import materialize, slices, table, text_of
from .tokens import encoder, public_file

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids of a file, about: as many blocks as are coded side by side.
FILE_IDS = 1 << 23
#: Text that is tokenized at once, about.
TEXT_BYTES = 1 << 23


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of the rows, about ``TEXT_BYTES`` of text at a time: more text has fewer distinct words to look up."""
    ids, texts, n = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        n += batch.column(1).nbytes
        if n >= TEXT_BYTES:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """The files, one row each: part, seq, payload.

    A null text is empty: its end id alone. Null ids come first; rows that repeat an id come in the order of their
    texts' hashes. No rows give no files. Other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, True).many
        part = TaskContext.get().partitionId()
        seq, before, n, doc_ids, docs = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            rows = [[part], [seq], [write_file(doc_ids, docs, part=part, seq=seq, first=before)]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "seq", "payload"])

        for own, texts in _gathered(slices(batches, 1, tokens=True)):
            for doc, ids in zip(own, ids_of(texts), strict=True):
                docs.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc)
                n += len(docs[-1])
                if n >= file_ids:
                    yield close()
                    seq, before, n, doc_ids, docs = seq + 1, before + n, 0, [], []
        if docs:
            yield close()

    text = text_of(text_col)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"))
        .repartitionByRange("id", "hash")
        .sortWithinPartitions("id", "hash")
    )
    return materialize(ordered.mapInArrow(run, "part int, seq int, payload binary"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, part, place (of the document's first id in the part), n_tokens, ids_crc32, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                head, doc_ids, lengths, ids = read_file(payload.as_py())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(lengths), head.part, np.int32)), pa.array(head.first + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "part", "place", "n_tokens", "ids_crc32"],
                )

    return files.select("payload").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")


def part_starts(files: DataFrame) -> list[tuple[int, int]]:
    """(part, ids of all parts before it) from the heads of the files: as many rows as the write had tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_head(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h.part for h in heads], pa.int32()), pa.array([h.n_ids for h in heads], pa.int64())], ["part", "n"])

    sizes = files.select(F.substring("payload", 1, HEAD_BYTES)).mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    starts, before = [], 0
    for part, n in sizes.orderBy("part").collect():
        starts.append((part, before))
        before += n
    return starts


def op2_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Rows that repeat an id, null ids and null texts each have their own place; an empty table gives no rows.
    """
    files = write_tokens(table(spark, sf_dir, "documents"), tokenizer or public_file(TOKENIZER))
    base = F.broadcast(spark.createDataFrame(part_starts(files), "part int, base long"))
    return read_tokens(files).join(base, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
