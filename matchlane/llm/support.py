"""Shared pieces: slices of Arrow batches, word and shingle hashes, table access."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_POWER = 0xD6E8FEB86659FD93 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of a few MB, so a task never holds thousands of very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def crc_mod(column: str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``max_bytes`` of text; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()  # a reused worker would keep it


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_POWER, pow(_POWER, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


# Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each row's range in them.

    Words are runs of bytes outside ``separator`` (9-13 and 32); a row's end also ends a word.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edges = offsets[offsets < n]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[(offsets > 0)] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power_tables(n)
    value = _LOWER_BYTE[data] * power
    total = np.cumsum(value)
    hashes = (total[end] - total[start] + value[start]) * inverse[start]
    hashes = mix(hashes + (end - start + 1).astype(np.uint64) * np.uint64(_STEP))
    return hashes, np.searchsorted(start, offsets)


def row_grams(words: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all ``k``-word sequences that lie within one row."""
    grams = shingle_hashes(words, k) if len(words) >= k else words[:0]
    ends = np.repeat(ranges[1:], np.diff(ranges))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + k <= ends)
    return at, grams[at]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one row; all its words as one where it has fewer."""
    n = min(k, len(words))
    if n == 0:
        return words
    total = np.full(len(words) - n + 1, (n * _STEP) & _MASK, np.uint64)
    for i in range(n):
        total = mix(total + words[i : len(words) - n + 1 + i])
    return total
