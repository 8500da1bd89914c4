"""Whole-batch work on UTF-8 bytes with numpy: views of Arrow text, span hashes, word bounds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: The separators of words: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _lean(batches: Iterator[pa.RecordBatch], step: Callable, rows: int, **how) -> Iterator[pa.RecordBatch]:
    yield from step((batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows)), **how)
    release()


def map_batches(df: DataFrame, step: Callable, schema: str, rows: int = 2000, **how) -> DataFrame:
    """``mapInArrow`` with at most ``rows`` rows in a batch, and with the worker's freed memory given back at the end."""
    return df.mapInArrow(partial(_lean, step=step, rows=rows, **how), schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column as one array, and the n + 1 offsets of its rows; NULL has no bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges (i, j) of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return _powers[kind][:n]


class SpanHash:
    """64-bit hashes of any spans of a byte array, each found from two prefix sums (arithmetic modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power("up", len(data)), out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of all rows; a word ends with its row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first = np.zeros(len(data), bool)
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | first))
    last = np.zeros(len(data), bool)
    last[inner[inner > 0] - 1] = True
    last[-1] = True
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | last)) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows
