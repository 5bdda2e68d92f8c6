"""Words and word hashes of whole Arrow batches, by numpy over the string bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; these bytes occur in no longer UTF-8 character, so bytes and
code points give the same words. A word's 64-bit hash depends on its bytes alone.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x51ED270B7A3F + 1))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = stream(256, 1) | np.uint64(1)
_POWER = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd number, modulo 2**64."""
    if len(_POWER[0]) < n:
        base = np.full(max(n, 2 * len(_POWER[0]), 1024), 0xD6E8FEB86659FD93, np.uint64)
        base[0] = 1
        _POWER[0] = np.multiply.accumulate(base)
    return _POWER[0][:n]


@dataclass
class Words:
    """Words of some texts, in order; begin[i]:begin[i + 1] are those of text i."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # first byte of each text, and the end
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        first = np.cumsum(lens) - lens
        at = np.arange(first[-1] + lens[-1]) - np.repeat(first, lens)
        byte = _BYTE[LOWER] if lower else _BYTE
        values = byte[self.data[at + np.repeat(self.start, lens)]]
        values *= powers(int(lens.max()))[at]
        return mix(np.add.reduceat(values, first) + lens.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split_words(texts: pa.Array, apart: np.ndarray = IS_SPACE) -> Words:
    """Runs of the bytes that are not ``apart``; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(apart[data], out=word[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def runs(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one text, and the place of each run's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(words.begin[1:], np.diff(words.begin)) - np.arange(len(hashes))
    places = np.flatnonzero(left >= n)
    return mix(window_sums(hashes, n)[places] + np.uint64(n)), places


def window_sums(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each window of n values, a sum modulo 2**64 that depends on their order."""
    factor = powers(n)
    m = len(hashes) - n + 1
    if n <= 8:
        total = hashes[:m].copy()
        for j in range(1, n):
            total += hashes[j : j + m] * factor[j]
        return total
    # By halves, so that a wide window costs few passes.
    half = n // 2
    low = window_sums(hashes, half)
    total = low[:m] + low[half : half + m] * factor[half]
    if n % 2:
        total += hashes[n - 1 :] * factor[n - 1]
    return total


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, size_of: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size_of`` bytes of text each; a text is never cut."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + size_of, "right")))
            yield batch.slice(at, to - at)
            at = to


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which also returns the worker's freed memory to the system before and after: workers live on for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns freed memory, which the allocators keep, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from those taken (case aside)."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out
