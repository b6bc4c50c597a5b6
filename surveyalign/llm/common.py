"""Helpers shared by the operators: vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.session import materialize  # noqa: F401  (re-exported to the operators)

#: Words are maximal runs of anything but these ASCII blanks; ``bytes.split()`` cuts at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

CHUNK_BYTES = 4 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Freed memory goes back to the system: Spark keeps Python workers for later tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


class Remembered(dict):
    """Values by key, computed when first asked for.

    ``rest`` ends a unit of work: a generation that has grown over ``limit`` becomes the older
    one, whose values are taken over as they are asked for and forgotten with the next.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def rest(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is several times faster here than ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text_column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text each."""
    _, at = text_buffer(batch.column(text_column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_PART = 1 << 17
_POWER, _INVERSE = _powers(_BASE, _PART), _powers(_BASE_INVERSE, _PART)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; spans are in order and do not overlap.

    One prefix sum of byte codes times powers of an odd base per 128 KB of text, so the memory
    does not grow with the text unless one span does.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        origin = starts[i]
        j = max(int(np.searchsorted(ends, origin + _PART, side="right")), i + 1)
        low, high = starts[i:j] - origin, ends[i:j] - origin
        n = int(high[-1])
        power, inverse = (_POWER[:n], _INVERSE) if n <= _PART else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[origin:origin + n]] * power, out=total[1:])
        out[i:j] = (total[high] - total[low]) * inverse[np.minimum(low, n - 1)] + (high - low).astype(np.uint64)
        i = j
    return mix(out)


def word_spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every row the index of its first word (n + 1 entries)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    solid = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; entry i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _BASE + words[j:j + n]
    return mix(total + np.uint64(size))


def window_rows(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, row) of every window that lies inside one row."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first_word[:-1][rows] + inside, rows


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


#: A key with more than 1 / HOT_KEYS of all rows meets its facts by broadcast; there are at most as many.
HOT_KEYS = 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``facts`` per key, however the keys are spread.

    ``size`` is the column of ``facts`` with the number of rows of its key, ``total`` the number
    of all rows. It is not part of the result.
    """
    hot = F.col(size) * HOT_KEYS > total
    often, rest = facts.where(hot).drop(size), facts.where(~hot).drop(size)
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rest, keys))
