"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes that are no separators. Everything here works on one slice of a
batch at a time, so memory follows the slice budget (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000

#: Bytes of words hashed at once: a hash takes some 40 bytes of arrays for every byte of text.
HASH_BYTES = 128_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)


@dataclass
class Texts:
    """Texts laid end to end: `data[offsets[i]:offsets[i + 1]]` is text i."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Byte bounds of all words, and the number of the first word of every text (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts stay below the budget; no row is lost."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > budget:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def texts_of(column: pa.Array) -> Texts:
    """Bytes and offsets of a string column; a null text is an empty one."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def lowered(texts: Texts) -> Texts:
    """A-Z lower-cased; every other byte stays."""
    return Texts(_LOWER[texts.data], texts.offsets)


def words_of(texts: Texts, separators: np.ndarray = _BLANK) -> Words:
    inside = ~separators[texts.data]
    before = np.zeros(len(inside) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(inside) + 1, dtype=bool)
    after[: len(inside)] = inside
    before[texts.offsets] = False
    after[texts.offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values ^ (values >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    known = _tables.get(int(base))
    if known is None or len(known[0]) < size:
        inverse = pow(int(base), -1, 1 << 64)
        length = max(size, 1 << 16)
        up, down = np.full(length, base, np.uint64), np.full(length, inverse, np.uint64)
        up[0] = down[0] = 1
        known = np.cumprod(up), np.cumprod(down)
        if length <= 2 * SLICE_BYTES:
            _tables[int(base)] = known
    return known


def give_back() -> None:
    """Return free memory of this process to the system."""
    _tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, which gives back what it held when its task ends: workers are used again and wait between tasks."""

    @functools.wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of `values[start:end]`, the same wherever the span lies."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes, some words at a time."""
    spread = mixed(np.arange(1, 257, dtype=np.uint64))
    out, a = np.empty(len(words.start), np.uint64), 0
    while a < len(out):
        low = words.start[a]
        b = max(a + 1, int(np.searchsorted(words.end, low + HASH_BYTES, "right")))
        values = spread[texts.data[low : words.end[b - 1]]]
        out[a:b] = mixed(_spans(values, words.start[a:b] - low, words.end[a:b] - low, _BASE))
        a = b
    return out


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` values (across text ends too: the caller masks those)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    start = np.arange(len(hashes) - size + 1)
    return mixed(_spans(hashes, start, start + size, _GRAM) + np.uint64(size))


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of any length."""
    if not len(hashes):
        return np.zeros(len(start), np.uint64)
    return mixed(_spans(hashes, start, end, _GRAM) + (end - start).astype(np.uint64))
