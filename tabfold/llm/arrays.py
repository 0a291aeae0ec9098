"""Texts as flat byte arrays inside Arrow tasks: slices of bounded size, words, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text worked on at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Odd multiplier of the rolling hash, and the constants of the 64-bit finaliser. Fixed values.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


#: Rows of a record batch while whole texts travel to Python.
TEXT_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Let the session send ``TEXT_ROWS`` rows at once to Python: of whole texts the usual 10,000 take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def give_back() -> None:
    """Return freed memory of this Python worker to the system.

    Workers outlive their tasks, and what one operation has freed would stay theirs while the next one runs in others.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column end to end, and ``len + 1`` offsets. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@lru_cache(maxsize=1)
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, _inverse(BASE), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(length + 1).bit_length())
    return _power_tables(size)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(MIX_A)
        values ^= values >> np.uint64(27)
        values *= np.uint64(MIX_B)
        values ^= values >> np.uint64(31)
    return values


class Rolling:
    """Hashes of any byte ranges of one array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data))
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)]
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of ``width`` bytes from every position that has as many."""
        count = len(self.sums) - width
        if count <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:count]) * self.down[:count] + np.uint64(width))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end, A-Z in lower case.

    Returns the text number, start, end and 64-bit hash of each word; no word crosses two texts.
    """
    capital = (data >= 65) & (data <= 90)
    lower = data + (capital.astype(np.uint8) << 5)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start, end, Rolling(lower).ranges(start, end)


def text_list(column: pa.Array) -> list[str]:
    """Python strings; a null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]
