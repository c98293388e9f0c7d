"""PCM and packet bytes: WAV files, Opus packet lengths, audio run payloads."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tickplane.functions.bits import FormatError

RATE = 48_000
MOST_PACKETS, LONGEST_PACKET, LONGEST_SAMPLES = 65_535, 1_275, 5_760
RUN = struct.Struct("<BBHIIIIIII")
#: Samples of an Opus frame at 48 kHz by configuration number.
FRAME_SAMPLES = [(480, 960, 1920, 2880)[c % 4] if c < 12 else (480, 960)[c % 2] if c < 16 else (120, 240, 480, 960)[c % 4] for c in range(32)]


def write_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    data = np.asarray(samples, "<i2").tobytes()
    if len(data) % (2 * channels):
        raise FormatError("samples and channels")
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data


def read_wav(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples) of a 16-bit PCM file; other chunks are passed over."""
    if len(raw) < 44 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise FormatError("no WAV header")
    parts, at = {}, 12
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if at + 8 + size > len(raw):
            raise FormatError("truncated WAV chunk")
        parts[name] = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    form, data = parts.get(b"fmt ", b""), parts.get(b"data")
    if len(form) < 16 or data is None:
        raise FormatError("WAV without format or data")
    code, channels, rate, bytes_a_second, block, width = struct.unpack_from("<HHIIHH", form)
    if (code, width) != (1, 16) or not channels or not rate or block != 2 * channels or bytes_a_second != rate * block or len(data) % 2:
        raise FormatError("not 16-bit PCM")
    return rate, channels, np.frombuffer(data, "<i2")


def packet_samples(packet: bytes) -> int:
    if not packet:
        raise FormatError("empty packet")
    code = packet[0] & 3
    if code == 3 and len(packet) < 2:
        raise FormatError("truncated packet")
    total = FRAME_SAMPLES[packet[0] >> 3] * (1 if code == 0 else packet[1] & 63 if code == 3 else 2)
    if not 0 < total <= LONGEST_SAMPLES:
        raise FormatError("packet length")
    return total


@dataclass
class Run:
    """Packets with what is cut off at either end of their decoded samples."""

    packets: list[bytes]
    skipped: int
    trimmed: int

    @property
    def decoded(self) -> int:
        return sum(map(packet_samples, self.packets))

    @property
    def kept(self) -> int:
        return self.decoded - self.skipped - self.trimmed


def write_run(run: Run) -> bytes:
    if not 0 < len(run.packets) <= MOST_PACKETS or max(map(len, run.packets)) > LONGEST_PACKET or run.kept < 1:
        raise FormatError("run")
    size = sum(map(len, run.packets))
    head = RUN.pack(1, 1, 0, RATE, run.skipped, run.trimmed, run.kept, run.decoded, len(run.packets), size)
    return head + b"".join(struct.pack("<HH", len(p), packet_samples(p)) for p in run.packets) + b"".join(run.packets)


def read_run(raw: bytes) -> Run:
    if len(raw) < RUN.size:
        raise FormatError("truncated run")
    version, channels, zero, rate, skipped, trimmed, kept, decoded, count, size = RUN.unpack_from(raw)
    first = RUN.size + 4 * count
    if (version, channels, zero, rate) != (1, 1, 0, RATE) or not kept or not 0 < count <= MOST_PACKETS or not size or first + size != len(raw):
        raise FormatError("run header")
    told = np.frombuffer(raw, "<u2", 2 * count, RUN.size).reshape(-1, 2).astype(int)
    if (told[:, 0] < 1).any() or (told[:, 0] > LONGEST_PACKET).any() or told[:, 0].sum() != size:
        raise FormatError("packet sizes")
    ends = first + np.cumsum(told[:, 0])
    run = Run([raw[e - n : e] for e, n in zip(ends.tolist(), told[:, 0].tolist(), strict=True)], skipped, trimmed)
    if [packet_samples(p) for p in run.packets] != told[:, 1].tolist() or run.decoded != decoded or run.kept != kept:
        raise FormatError("run accounting")
    return run


#: Fixed values: (seconds, frequency, amplitude) of a synthetic voice; a pause has no amplitude.
SPEECH = ((0.25, 440, 0.35), (0.40, 0, 0), (0.40, 880, 0.25), (0.08, 0, 0), (0.32, 330, 0.30), (0.55, 0, 0))


def synthetic_speech(rate: int = RATE) -> np.ndarray:
    """Three tones and three pauses, two seconds in all."""
    waves = [np.floor(np.sin(2 * np.pi * f * np.arange(round(s * rate)) / rate) * a * 32767 + 0.5) for s, f, a in SPEECH]
    return np.clip(np.concatenate(waves), -32768, 32767).astype(np.int16)
