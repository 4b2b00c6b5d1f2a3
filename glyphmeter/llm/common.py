"""Helpers that the corpus operators share: tables, the shared folder, word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a Parquet table; other columns, whatever their names, are never read."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="glyphmeter-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch at most: batches of texts stay within a few MB on both sides of the pipe.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS where it allows more, as the default is meant for short rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives a worker's freed memory back to the system; workers are reused, so later stages would carry it along."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


# --- words and shingles of UTF-8 texts, vectorised over a batch -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Any ASCII character but letters and digits, for words without the punctuation around them.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd base and its inverse modulo 2**64: a word's hash is a difference of prefix sums, shifted back to its start.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLY = U64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once; bounds the memory of a task.
SLICE_BYTES = 512 << 10
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:  # a larger one is for a single word and not kept
            _powers[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _hash_block(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _SPACE, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of one block of bytes, and the first word of each document in it.

    With stem, a second row holds the hashes of the words cut to so many bytes.
    """
    n = len(data)
    if not n:
        return np.empty((2, 0) if stem else 0, U64), np.zeros(len(bounds), np.int64)
    inside = ~gaps[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    starts[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _power_table(_BASE, n)[:n], out=sums[1:])
    if stem:
        begin, end = np.stack([begin, begin]), np.stack([end, np.minimum(end, begin + stem)])
    words = (sums[end] - sums[begin]) * _power_table(_INVERSE, n)[begin]
    return mix64(words ^ ((end - begin).astype(U64) << U64(56))), np.searchsorted(begin[0] if stem else begin, bounds)


def word_hashes(texts: pa.Array, gaps: np.ndarray = _SPACE, stem: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, hashes of words, first word of each row and the end) of a batch of texts.

    Words are runs of bytes outside gaps (ASCII white space), with A-Z lower-cased; null texts have none. A text longer
    than a block is hashed piece by piece and comes as a block of its own, so whole texts of any length are covered.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        if stop > row:
            stop = min(stop, len(texts))
            hashes, first = _hash_block(raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], gaps, stem)
            yield row, hashes, first
        else:
            stop, parts, at, end = row + 1, [], int(offsets[row]), int(offsets[row + 1])
            while at < end:
                to = min(end, at + SLICE_BYTES)
                while to < end and not gaps[raw[to - 1]]:
                    ahead = np.flatnonzero(gaps[raw[to : to + SLICE_BYTES]])
                    to = min(end, to + (int(ahead[0]) + 1 if len(ahead) else SLICE_BYTES))
                parts.append(_hash_block(raw[at:to], np.array([0, to - at]), gaps, stem)[0])
                at = to
            hashes = np.concatenate(parts, -1)
            yield row, hashes, np.array([0, hashes.shape[-1]])
        row = stop


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLY
        out += words[k : k + n]
    return mix64(out)


def shingle_hashes(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its shingles in order) for every text; fewer words than width make one shingle, none make none."""
    for row, words, first in word_hashes(texts):
        rolled = _fold(words, width) if len(words) >= width else None
        for k in range(len(first) - 1):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield row + k, rolled[a : b - width + 1]
            elif b > a:
                yield row + k, _fold(words[a:b], b - a) ^ U64(b - a)
            else:
                yield row + k, np.empty(0, U64)
