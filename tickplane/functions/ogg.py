"""Ogg pages that carry one Opus stream."""

from __future__ import annotations

import functools
import struct

from tickplane.functions.audio import Run, packet_samples
from tickplane.functions.bits import FormatError

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
POLYNOMIAL = 0x04C11DB7


@functools.cache
def _table() -> tuple[int, ...]:
    def entry(r: int) -> int:
        r <<= 24
        for _ in range(8):
            r = (r << 1 ^ POLYNOMIAL if r >> 31 else r << 1) & 0xFFFFFFFF
        return r

    return tuple(map(entry, range(256)))


def checksum(raw: bytes) -> int:
    table, value = _table(), 0
    for byte in raw:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def pages(raw: bytes):
    """(flags, granule, serial, number, segment sizes, body) of each page, checked."""
    at = 0
    while at < len(raw):
        if at + PAGE.size > len(raw):
            raise FormatError("truncated page")
        mark, version, flags, granule, serial, number, crc, count = PAGE.unpack_from(raw, at)
        sizes = raw[at + PAGE.size : at + PAGE.size + count]
        end = at + PAGE.size + count + sum(sizes)
        if mark != b"OggS" or version or len(sizes) < count or end > len(raw):
            raise FormatError("page")
        if checksum(raw[at : at + 22] + bytes(4) + raw[at + 26 : end]) != crc:
            raise FormatError("page checksum")
        yield flags, granule, serial, number, sizes, raw[at + PAGE.size + count : end]
        at = end


def read_opus(raw: bytes) -> Run:
    """The packets of a stream, what its head skips and what its last page trims."""
    packets, open_, final, serials = [], b"", None, set()
    for due, (flags, granule, serial, number, sizes, body) in enumerate(pages(raw)):
        serials.add(serial)
        if number != due or bool(flags & CONTINUED) != bool(open_) or bool(flags & FIRST) != (due == 0) or final is not None or len(serials) > 1:
            raise FormatError("page order")
        if flags & LAST:
            final = granule
        at = 0
        for size in sizes:
            open_, at = open_ + body[at : at + size], at + size
            if size < 255:
                packets.append(open_)
                open_ = b""
    if open_ or final is None or len(packets) < 3 or packets[0][:8] != b"OpusHead" or packets[1][:8] != b"OpusTags":
        raise FormatError("stream")
    head = packets[0]
    if len(head) < 19 or head[8] != 1 or head[9] != 1 or head[18] != 0:
        raise FormatError("Opus head")
    (skipped,) = struct.unpack_from("<H", head, 10)
    decoded = sum(map(packet_samples, packets[2:]))
    if not skipped <= final <= decoded:
        raise FormatError("granule")
    return Run(packets[2:], skipped, decoded - final)


def write_opus(run: Run, serial: int = 1, rate: int = 48_000) -> bytes:
    """A stream of one page for each packet."""

    def page(number: int, flags: int, granule: int, packet: bytes) -> bytes:
        sizes = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        head = lambda crc: PAGE.pack(b"OggS", 0, flags, granule, serial, number, crc, len(sizes))
        return head(checksum(head(0) + sizes + packet)) + sizes + packet

    name = b"tickplane"
    out = [page(0, FIRST, 0, struct.pack("<8sBBHIhB", b"OpusHead", 1, 1, run.skipped, rate, 0, 0)), page(1, 0, 0, b"OpusTags" + struct.pack("<I", len(name)) + name + struct.pack("<I", 0))]
    at = 0
    for i, packet in enumerate(run.packets):
        at += packet_samples(packet)
        last = i + 1 == len(run.packets)
        out.append(page(i + 2, LAST if last else 0, run.decoded - run.trimmed if last else at, packet))
    return b"".join(out)
