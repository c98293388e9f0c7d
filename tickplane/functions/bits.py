"""Byte-level primitives: base-128 integers, bit packing, canonical Huffman codes."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

HUFFMAN_MAGIC = b"HUF1"
LONGEST_CODE = 32
#: A code longer than LONGEST_CODE takes a Fibonacci number of bytes, more than these.
SHORT_CODES = 1 << 20
#: Codes of up to so many bits are read from a table of all that may follow.
TABLE_BITS = 14


class FormatError(ValueError):
    """Bytes that break a format's rule."""


def put_varuint(n: int) -> bytes:
    if not 0 <= n < 1 << 32:
        raise FormatError("not an unsigned 32-bit value")
    groups = max(1, -(-n.bit_length() // 7))
    return bytes((n >> 7 * i & 0x7F) | (0x80 if i + 1 < groups else 0) for i in range(groups))


def get_varuint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, next place); over-long and over-wide forms are errors."""
    end = at
    while end < len(raw) and end < at + 5 and raw[end] & 0x80:
        end += 1
    if end >= len(raw):
        raise FormatError("truncated integer")
    if end == at + 5 or (end == at + 4 and raw[end] > 0x0F):
        raise FormatError("integer over 32 bits")
    if end > at and raw[end] == 0:
        raise FormatError("over-long integer")
    return sum((raw[i] & 0x7F) << 7 * (i - at) for i in range(at, end + 1)), end + 1


def pack_low_first(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values one after the other, each from its lowest bit, zero-padded to a byte."""
    values, widths = np.asarray(values, np.int64), np.asarray(widths, np.int64)
    if (values < 0).any() or (values >> widths).any():
        raise FormatError("value too wide")
    return np.packbits(_bits(values, widths), bitorder="little").tobytes()


def _bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(values)), widths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)
    return (values[owner] >> place & 1).astype(np.uint8)


def unpack_low_first(raw: bytes, widths: np.ndarray) -> np.ndarray:
    widths = np.asarray(widths, np.int64)
    total = int(widths.sum())
    if len(raw) != -(-total // 8):
        raise FormatError("packed length")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(np.int64)
    if bits[total:].any():
        raise FormatError("padding bits")
    first = np.cumsum(widths) - widths
    place = np.arange(total) - np.repeat(first, widths)
    out = np.zeros(len(widths), np.int64)
    np.add.at(out, np.repeat(np.arange(len(widths)), widths), bits[:total] << place)
    return out


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """``code_lengths`` of the symbols that occur."""
    n = len(counts)
    if n == 1:
        return dict.fromkeys(counts, 1)
    heap = [(c, s, i) for i, (s, c) in enumerate(sorted(counts.items()))]
    symbols = [s for _, s, _ in heap]
    heapq.heapify(heap)
    above = [0] * max(1, 2 * n - 1)
    for made in range(n, 2 * n - 1):
        c1, s1, i1 = heapq.heappop(heap)
        c2, s2, i2 = heap[0]
        heapq.heapreplace(heap, (c1 + c2, s1 if s1 < s2 else s2, made))
        above[i1] = above[i2] = made
    deep = [0] * len(above)
    for i in range(2 * n - 3, -1, -1):
        deep[i] = deep[above[i]] + 1
    if max(deep) > LONGEST_CODE:
        raise FormatError("code too long")
    return dict(zip(symbols, deep, strict=False))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol (0: absent).

    The two lightest trees merge first; of equal weights, the one with the least
    symbol, then the older.
    """
    lengths = np.zeros(len(counts), np.int64)
    for symbol, length in _lengths({s: c for s, c in enumerate(np.asarray(counts).tolist()) if c}).items():
        lengths[symbol] = length
    return lengths


def huffman_size(counts: np.ndarray) -> int:
    """How many bytes ``huffman_encode`` makes of bytes that occur so often.

    All shortest codes take the same bits in all; only where a code might be too long
    must the lengths be known.
    """
    weights = sorted(counts[counts > 0].tolist())
    if sum(weights) >= SHORT_CODES:
        bits = int((code_lengths(counts) * counts).sum())
    else:
        heap, bits = weights[:], sum(weights) if len(weights) == 1 else 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heap[0]
            heapq.heapreplace(heap, both)
            bits += both
    return 14 + 2 * len(weights) + -(-bits // 8)


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by length and then symbol."""
    code, before, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - before
        if code >> length:
            raise FormatError("too many codes")
        out[symbol] = (code, length)
        code, before = code + 1, length
    return out


def canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """``_canonical`` of an array of lengths (0: absent)."""
    return _canonical({s: n for s, n in enumerate(np.asarray(lengths).tolist()) if n})


def huffman_encode(raw: bytes) -> bytes:
    table = _canonical(_lengths(Counter(raw)))
    text = {symbol: f"{code:0{length}b}" for symbol, (code, length) in table.items()}
    bits = "".join(map(text.__getitem__, raw))
    size = -(-len(bits) // 8)
    head = HUFFMAN_MAGIC + struct.pack("<IHI", len(raw), len(table), len(bits))
    return head + bytes(x for s in sorted(table) for x in (s, table[s][1])) + int(bits.ljust(8 * size, "0") or "0", 2).to_bytes(size)


def _decoded(raw: bytes, found: dict[int, tuple[int, int]], longest: int, n_bits: int, size: int) -> bytes:
    """What the bits say, a look at the table for each symbol."""
    symbols, sizes = bytearray(1 << longest), bytearray(1 << longest)
    for symbol, (code, length) in found.items():
        free = longest - length
        first, many = code << free, 1 << free
        symbols[first : first + many], sizes[first : first + many] = bytes((symbol,)) * many, bytes((length,)) * many
    # The 24 bits from each byte on hold any code that begins in it.
    wide = np.frombuffer(raw + b"\0\0", np.uint8).astype(np.int64)
    wide = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]).tolist()
    shift, low = 24 - longest, (1 << longest) - 1
    out, at = bytearray(), 0
    while at < n_bits:
        look = wide[at >> 3] >> shift - (at & 7) & low
        length = sizes[look]
        if not length:
            raise FormatError("unknown code")
        out.append(symbols[look])
        at += length
    if at != n_bits or len(out) != size:
        raise FormatError("Huffman payload")
    return bytes(out)


def huffman_decode(raw: bytes, most: int = 64 << 20) -> bytes:
    if len(raw) < 14 or raw[:4] != HUFFMAN_MAGIC:
        raise FormatError("no Huffman header")
    size, symbols, n_bits = struct.unpack_from("<IHI", raw, 4)
    start = 14 + 2 * symbols
    if size > most or symbols > 256 or start + -(-n_bits // 8) != len(raw) or bool(size) != bool(symbols) or bool(size) != bool(n_bits):
        raise FormatError("Huffman sizes")
    lengths: dict[int, int] = {}
    for symbol, length in zip(raw[14:start:2], raw[15:start:2], strict=True):
        if symbol in lengths or not 1 <= length <= LONGEST_CODE:
            raise FormatError("Huffman table")
        lengths[symbol] = length
    found = _canonical(lengths)
    if n_bits % 8 and raw[-1] & (1 << -n_bits % 8) - 1:
        raise FormatError("padding bits")
    longest = max(lengths.values(), default=0)
    if 0 < longest <= TABLE_BITS:
        return _decoded(raw[start:], found, longest, n_bits, size)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=start))
    known = {(length, code): symbol for symbol, (code, length) in found.items()}
    out, code, length = bytearray(), 0, 0
    for bit in bits[:n_bits].tolist():
        code, length = code << 1 | bit, length + 1
        if (symbol := known.get((length, code))) is not None:
            out.append(symbol)
            code, length = 0, 0
        elif length > LONGEST_CODE:
            raise FormatError("unknown code")
    if length or len(out) != size:
        raise FormatError("Huffman payload")
    return bytes(out)
