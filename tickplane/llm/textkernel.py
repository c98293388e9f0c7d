"""Vectorised text kernels over Arrow string buffers.

Everything works on the UTF-8 bytes of a column slice, so no Python string is
made per word.  White space is the byte set ``\\x20 \\x09-\\x0D``; every other
byte belongs to a word.  Nulls read as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 18
#: Rows of a batch that an operator works on together.
BATCH_ROWS = 2000

_RNG = np.random.default_rng(20240607)
_BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM_KEYS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES + 1)

        def series(base: np.uint64) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        _POWERS, _INVERSES = series(_BASE), series(_BASE_INVERSE)
    return _POWERS, _INVERSES


def release() -> None:
    """Give the memory that a finished task held back to the system."""
    global _POWERS, _INVERSES
    _POWERS = _INVERSES = np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function of Arrow batches, on slices of them, that leaves nothing behind in its worker.

    Spark bounds what a batch holds; a slice of BATCH_ROWS bounds what is made of
    it at once.  Python workers outlive tasks, and one of another stage may work
    beside them.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            release()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Rows ``first:first+len(offsets)-1`` of a column: bytes and row offsets."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Split a string column into pieces of about ``max_bytes``, whole rows each."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield Texts(whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def word_pieces(texts: Texts, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """(byte offset, piece) of a single long text, cut between words.

    Only a piece that has no white space to cut at is longer.
    """
    at, n = 0, len(texts.data)
    while at < n:
        end = min(at + max_bytes, n)
        if end < n:
            blanks = np.flatnonzero(_SPACE[texts.data[at:end]])
            if len(blanks) and blanks[-1] > 0:
                end = at + int(blanks[-1])
            else:
                end = at + 1
                while end < n:
                    blanks = np.flatnonzero(_SPACE[texts.data[end : end + max_bytes]])
                    if len(blanks):
                        end += int(blanks[0])
                        break
                    end = min(end + max_bytes, n)
        yield at, Texts(texts.data[at:end], np.array([0, end - at]), texts.first)
        at = end


@dataclass
class Words:
    """All words of a piece in text order; ``bounds[i]:bounds[i+1]`` are row i's."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row bounds among them."""
    n = len(texts.data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[texts.data], out=inside[1:-1])
    opens = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    opens[cuts] = True
    closes[cuts] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    return start, end, np.searchsorted(start, texts.offsets)


def byte_sums(texts: Texts) -> np.ndarray:
    """Running sums from which ``hashes_between`` takes hashes of byte ranges as they stand."""
    powers, _ = _powers(len(texts.data) + 1)
    sums = np.empty(len(texts.data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_KEYS[texts.data] * powers[: len(texts.data)], out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def lowered(texts: Texts) -> Texts:
    """The same rows in lower case, by Unicode's rules."""
    rows = [texts.bytes_of(i).decode().lower().encode() for i in range(len(texts))]
    return joined(rows, texts.first)


def joined(rows: list[bytes], first: int = 0) -> Texts:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64))).astype(np.int64)
    return Texts(np.frombuffer(b"".join(rows), np.uint8), offsets, first)


def span_hashes(texts: Texts, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges in text order; ``lower`` folds A-Z first.

    Sums run over CHUNK_BYTES of text at once, as a hash doesn't depend on where
    the range stands; a longer range is summed in parts.
    """
    keys = _BYTE_KEYS[_LOWER] if lower else _BYTE_KEYS
    out, first = np.empty(len(start), np.uint64), 0
    while first < len(start):
        low = int(start[first])
        last = int(np.searchsorted(end, low + CHUNK_BYTES, "right"))
        if last <= first:
            out[first] = _long_hash(texts.data[low : end[first]], keys)
            first += 1
            continue
        size = int(end[last - 1]) - low
        powers, inverses = _powers(size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(keys[texts.data[low : low + size]] * powers[:size], out=sums[1:])
        a, b = start[first:last] - low, end[first:last] - low
        out[first:last] = mix64((sums[b] - sums[a]) * inverses[a])
        first = last
    return out


def _long_hash(data: np.ndarray, keys: np.ndarray) -> np.uint64:
    powers, _ = _powers(CHUNK_BYTES + 1)
    total = 0
    for at in range(0, len(data), CHUNK_BYTES):
        part = keys[data[at : at + CHUNK_BYTES]]
        total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return mix64(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def words(texts: Texts, lower: bool = True) -> Words:
    """Words with 64-bit hashes; ``lower`` folds A-Z first."""
    start, end, bounds = word_spans(texts)
    return Words(start, end, span_hashes(texts, start, end, lower), bounds)


def hash_word(word: str | bytes, lower: bool = True) -> int:
    """The hash that ``words`` gives to one word."""
    raw = word.encode() if isinstance(word, str) else word
    return int(words(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0), lower).hash[0])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words, across row ends as well."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _GRAM_KEYS[i]
    return mix64(out)


def shingle_sets(found: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row, and the row bounds.

    A row of fewer than k words has its whole word sequence as its one shingle;
    a row without words has none.
    """
    every = grams(found.hash, k)
    sets, sizes = [], []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            part = np.sort(every[a : b - k + 1])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        elif b > a:
            part = mix64(grams(found.hash[a:b], b - a) + np.uint64(b - a))
        else:
            part = every[:0]
        sets.append(part)
        sizes.append(len(part))
    bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)
    return (np.concatenate(sets) if sets else every[:0]), bounds
