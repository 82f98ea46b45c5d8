"""Pieces that several training-data operators share: scratch tables, the tokenizer files, and
vectorised word hashing over Arrow string buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The code points that separate words, \x20 and \x09-\x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Of eight bytes read at once, those that belong to a word of which so many are left.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (tests) gets one
    for all its later calls; elsewhere executors would write to their own disks, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/lodestrata-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor
    costs no more than reading the files again."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of so many rows and 8 MB at most, so that a run of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, unless LODESTRATA_TOKENIZERS names another folder."""
    if folder := os.environ.get("LODESTRATA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: A task that reads fewer bytes leaves the worker's memory as it is.
LITTLE = 2 << 20
#: What a Python worker keeps between tasks, by the operator that it belongs to.
_KEPT: dict = {}


def kept(owner: str, key, make):
    """make(), kept in the worker for later tasks of the same operator."""
    if next(iter(_KEPT), owner) != owner:
        _KEPT.clear()
    held = _KEPT.setdefault(owner, {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def settle(owner: str | None) -> None:
    """Lets go of what other operators keep in this worker."""
    if next(iter(_KEPT), owner) != owner:
        _KEPT.clear()


def trim() -> None:
    """Hands freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, owner: str | None = None):
    """A batch function that first lets go of what other operators keep in the worker, and hands its
    memory back when it ends: workers live on through later stages. Tasks of few rows have none to
    hand back."""

    def wrapped(batches):
        settle(owner)
        held = 0

        def counted():
            nonlocal held
            for b in batches:
                held += b.nbytes
                yield b

        try:
            yield from run(counted())
        finally:
            if held > LITTLE:
                trim()

    return wrapped


def crc_bucket(col: str, modulus: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) > 1 else np.zeros(0, np.uint8)
    return raw, (at - at[0]) if len(at) else np.zeros(1, np.int64)


class Words:
    """The words of a batch of texts: begin and end in `data`, `first[d]` is the first word of
    text d, and `first` ends with the number of words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, self.at = text_bytes(texts)
        self.data = _LOWER[raw] if lower else raw
        ink = ~_IS_SPACE[self.data]
        full = self.at[:-1] < self.at[1:]
        head, tail = ink.copy(), ink.copy()
        if len(ink):
            head[1:] &= ~ink[:-1]
            tail[:-1] &= ~ink[1:]
            one = self.at[:-1][full]
            head[one] = ink[one]
            last = self.at[1:][full] - 1
            tail[last] = ink[last]
        self.begin, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.begin, self.at)

    def hashes(self, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of the byte ranges given (rising, none empty): the mixed sum of
        its eight-byte pieces, each mixed with its place. Different words meet by chance alone (2**-64)."""
        begin, end = (self.begin, self.end) if begin is None else (begin, end)
        if not len(begin):
            return np.zeros(0, np.uint64)
        size = end - begin
        pieces = (size + 7) >> 3
        start = np.cumsum(pieces) - pieces
        at = np.arange(int(pieces.sum())) - np.repeat(start, pieces)  # a piece's place in its word
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data),), "<u8", padded, strides=(1,))
        piece = eight[np.repeat(begin, pieces) + 8 * at] & _OWN[np.minimum(np.repeat(size, pieces) - 8 * at, 8)]
        sums = np.add.reduceat(mixed(piece + (at + 1).astype(np.uint64) * _STEP), start)
        return mixed(sums ^ (size.astype(np.uint64) << np.uint64(40)))

    def units(self, begin: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
        """The byte ranges given (rising, disjoint, with nothing but white space between them)."""
        size = end - begin
        data = self.data if int(size.sum()) == len(self.data) else self.data[~_IS_SPACE[self.data]]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def blocks(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts have about `most` bytes at most (one text at least)."""
    size = np.cumsum(_lengths(batch.column(column)))
    k = 0
    while k < batch.num_rows:
        past = size[k - 1] if k else 0
        j = max(k + 1, int(np.searchsorted(size, past + most, "right")))
        yield batch.slice(k, j - k)
        k = j


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
