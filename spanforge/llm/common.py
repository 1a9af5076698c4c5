"""What the operators of this subpackage share: tables, the shared folder, word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder (tests, a laptop).
LOCAL_SHARED = "/tmp/checkpoints/spanforge"
#: White space that separates words, as byte values: what bytes.split() splits at.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


#: Rows and bytes of a batch that a worker gets: texts may be long, and the JVM holds a batch outside of its heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ``BATCH``; lower ones stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        size = int(now) if now and now.isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; set here only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{LOCAL_SHARED}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_path(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


#: Rows of one key above which a join spreads it, over so many salts; hot keys are told by a broadcast up to so many.
HOT_ROWS, HOT_SALTS, BROADCAST_HOT = 10_000, 64, 500_000


def join_spread(rows: DataFrame, keys: DataFrame, on: list[str], count_col: str, spread: list[str], hot_rows: int = HOT_ROWS, salts: int = HOT_SALTS) -> DataFrame:
    """``rows`` joined to ``keys`` on ``on``, the rows of hot keys dealt over salts by the columns ``spread``.

    keys: one row per key, with count_col, how many rows have it. A hot key is repeated once for each salt; all others
    keep their one row. It is read more than once: give a table.
    """
    hot = keys.filter(F.col(count_col) > hot_rows).select(*on)
    n_hot = hot.limit(BROADCAST_HOT + 1).count()
    if not n_hot:
        return rows.join(keys, on)
    salt, is_hot = fresh(rows, fresh(keys, "__salt")), fresh(rows, "__hot")
    dealt = F.pmod(F.xxhash64(*spread), F.lit(salts))
    if n_hot <= BROADCAST_HOT:
        rows = rows.join(F.broadcast(hot.withColumn(is_hot, F.lit(True))), on, "left").withColumn(salt, F.when(F.col(is_hot), dealt).otherwise(0)).drop(is_hot)
        copies = F.when(F.col(count_col) > hot_rows, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    else:  # too many to tell: every key is spread
        rows = rows.withColumn(salt, dealt)
        copies = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    return rows.join(keys.withColumn(salt, F.explode(copies)), [*on, salt]).drop(salt)


def text_of(column: str | Column = "text") -> Column:
    """The text, a null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(of_id: Column, modulus: int) -> Column:
    """The remainder that tells learning rows from held-out ones; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(of_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _tidy() -> None:
    """Give memory that a finished partition left behind back to the system: workers are kept for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 1 << 20, tokens: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about max_bytes of the given binary column, one row at least.

    Tokenizers that a worker has kept from other work go first, unless ``tokens`` says that they are asked for.
    """
    if not tokens and (kept := sys.modules.get(f"{__package__}.tokens")):
        kept.encoder.cache_clear()
        _tidy()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1])
        group = np.cumsum(sizes, dtype=np.int64) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
    _tidy()


# --- words and hashes of a batch of texts, without a loop over words ---------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        tables = []
        for b in (_BASE, _INVERSE):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubling: b^0..b^(2m) from b^0..b^m
                more = min(done, size - done)
                np.multiply(out[:more], np.uint64(pow(b, done, 1 << 64)), out=out[done : done + more])
                done += more
            tables.append(out)
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_words(texts: list[bytes | None], lower: bool = False) -> tuple[bytes, np.ndarray]:
    """All words of all texts, one space after each; and the number of words of each text."""
    rows = [((t.lower() if lower else t).split() if t else []) for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    joined = b" ".join([b" ".join(r) for r in rows if r])
    return (joined + b" " if joined else b""), counts


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where each word starts and ends."""
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return data, starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: a polynomial over the bytes, mixed."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes, across text borders too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0xA0761D6478BD642F % (1 << 64) | 1
        out += words[i : i + n] * np.uint64(factor)
    return mix(out)


# --- arrays in the shared folder -----------------------------------------------------------------------


class SharedArrays:
    """Files of the shared folder that workers write whole and map into memory. Sent to workers as its address only."""

    def __init__(self, uri: str):
        self.uri = uri
        self._maps: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "_maps": {}}

    def mapped(self, name: str, dtype) -> np.ndarray:
        """The map of a file that doesn't change any more, opened once by a worker."""
        key = (name, np.dtype(dtype).str)
        if key not in self._maps:
            self._maps[key] = self.map(name, dtype)
        return self._maps[key]

    def _local(self, name: str) -> str | None:
        path = self.uri.removeprefix("file://")
        return None if "://" in path else os.path.join("/" + path.lstrip("/"), name)

    def write(self, name: str, array: np.ndarray) -> None:
        """Under another name first: a task that is run again or twice leaves whole files only."""
        if path := self._local(name):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            own = f"{path}.{uuid.uuid4().hex}"
            array.tofile(own)
            os.replace(own, path)
            return
        fs, folder = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(array.tobytes())
        fs.move(own, f"{folder}/{name}")

    def map(self, name: str, dtype) -> np.ndarray:
        """Read-only; a file of a remote store is copied to a file that goes when the worker does."""
        path = self._local(name)
        if path:
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        fs, folder = pa.fs.FileSystem.from_uri(self.uri)
        with tempfile.TemporaryFile() as own, fs.open_input_stream(f"{folder}/{name}") as f:
            while part := f.read(1 << 24):
                own.write(part)
            own.flush()
            return np.memmap(own, dtype, "r") if own.tell() else np.zeros(0, dtype)


def release(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that the shuffle files of finished work go from the disks.

    The first round frees the driver's handles on them, the second what they held; removal itself runs beside.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)
