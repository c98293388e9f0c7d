"""Sparse mask planes over frames: codecs and stabilisation.

A plane's rows are (stream, frame, cell, fore, back, mask) with 16-byte masks.
"""

from __future__ import annotations

import struct as _struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.functions.bits import FormatError, get_varuint, put_varuint
from tickplane.schema import struct

HEAD = _struct.Struct("<4sIIHH")
#: Marks of a single plane and of a sequence; opcodes of a sequence.
ONE, MANY = b"SM1\0", b"SM2\0"
AGAIN, FULL, DELTA = 0, 1, 2
MASK_BYTES = 16
Plane = dict[int, tuple[int, int, bytes]]


def _records(plane: Plane) -> bytes:
    cells = sorted(plane)
    return b"".join(put_varuint(c - p) + bytes(plane[c][:2]) + plane[c][2] for p, c in zip([-1, *cells], cells, strict=False))


def _read_records(raw: bytes, at: int, count: int, cells: int, depth: int) -> tuple[Plane, int]:
    plane, cell = {}, -1
    for _ in range(count):
        step, at = get_varuint(raw, at)
        cell += step
        if not step or cell >= cells or at + 2 + MASK_BYTES > len(raw) or max(raw[at], raw[at + 1]) >= depth:
            raise FormatError("plane record")
        plane[cell] = (raw[at], raw[at + 1], raw[at + 2 : at + 2 + MASK_BYTES])
        at += 2 + MASK_BYTES
    return plane, at


def write_plane(plane: Plane, cells: int, depth: int) -> bytes:
    return HEAD.pack(ONE, cells, len(plane), depth, 0) + _records(plane)


def _head(raw: bytes, mark: bytes) -> tuple[int, int, int]:
    if len(raw) < HEAD.size:
        raise FormatError("truncated plane")
    found, cells, count, depth, zero = HEAD.unpack_from(raw)
    if found != mark or zero or not cells or not 2 <= depth <= 256:
        raise FormatError("plane header")
    return cells, count, depth


def read_plane(raw: bytes) -> Plane:
    cells, count, depth = _head(raw, ONE)
    if count > cells:
        raise FormatError("plane entries")
    plane, at = _read_records(raw, HEAD.size, count, cells, depth)
    if at != len(raw):
        raise FormatError("bytes after the plane")
    return plane


def write_sequence(frames: list[Plane], cells: int, depth: int) -> bytes:
    """Planes one after the other: repeats as spans, else the shorter of a delta and the whole."""
    out, before, again = [HEAD.pack(MANY, cells, len(frames), depth, 0)], None, 0
    for plane in [*frames, None]:
        if plane is not None and plane == before:
            again += 1
            continue
        if again:
            out.append(bytes([AGAIN]) + put_varuint(again))
            again = 0
        if plane is None:
            break
        whole = bytes([FULL]) + put_varuint(len(plane)) + _records(plane)
        if before is not None:
            gone = sorted(before.keys() - plane.keys())
            new = {c: v for c, v in plane.items() if before.get(c) != v}
            steps = b"".join(put_varuint(c - p) for p, c in zip([-1, *gone], gone, strict=False))
            delta = bytes([DELTA]) + put_varuint(len(gone)) + steps + put_varuint(len(new)) + _records(new)
            whole = min(whole, delta, key=len)
        out.append(whole)
        before = plane
    return b"".join(out)


def read_sequence(raw: bytes) -> list[Plane]:
    cells, count, depth = _head(raw, MANY)
    frames: list[Plane] = []
    at = HEAD.size
    while len(frames) < count:
        if at >= len(raw) or raw[at] > DELTA or (raw[at] != FULL and not frames):
            raise FormatError("sequence opcode")
        op, (n, at) = raw[at], get_varuint(raw, at + 1)
        if op == AGAIN:
            if not 0 < n <= count - len(frames):
                raise FormatError("repeat span")
            frames += [frames[-1]] * n
            continue
        plane: Plane = {}
        if op == DELTA:
            plane, cell = dict(frames[-1]), -1
            for _ in range(n):
                step, at = get_varuint(raw, at)
                cell += step
                if not step or plane.pop(cell, None) is None:
                    raise FormatError("removal")
            n, at = get_varuint(raw, at)
        if n > cells:
            raise FormatError("plane entries")
        new, at = _read_records(raw, at, n, cells, depth)
        frames.append({**plane, **new})
    if at != len(raw):
        raise FormatError("bytes after the sequence")
    return frames


def encode_sequences(planes: DataFrame, frames: Column | int | None, cells: int, depth: int, run: int = 120) -> DataFrame:
    """(stream, run_no, payload): sequences of ``run`` frames, each decodable alone.

    A stream has ``frames`` frames, by default up to its last one with a cell;
    runs without a cell are written as well, so that all runs of a stream make it.
    """
    stream = planes.schema["stream"]
    length = F.max("frame") + 1 if frames is None else F.max(frames if isinstance(frames, Column) else F.lit(frames))
    lengths = planes.groupBy("stream").agg(length.cast("long").alias("length"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / run).cast("long"))).alias("run_no")
    size = F.least(F.lit(run), F.col("length") - F.col("run_no") * run).cast("long").alias("size")
    # One more row for each run says how many frames it has.
    runs = lengths.select("stream", "length", number).select("stream", "run_no", size, *(F.lit(-1).cast("long").alias(c) for c in ("frame", "cell", "fore", "back")), F.lit(b"").alias("mask"))
    listed = planes.select(
        "stream", F.floor(F.col("frame") / run).cast("long").alias("run_no"), F.lit(0).cast("long").alias("size"), *(F.col(c).cast("long").alias(c) for c in ("frame", "cell", "fore", "back")), "mask"
    )

    def write(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["run_no"].iloc[0])
        made: list[Plane] = [{} for _ in range(int(group["size"].max()))]
        for frame, cell, fore, back, mask in group.loc[group["cell"] >= 0, ["frame", "cell", "fore", "back", "mask"]].itertuples(index=False, name=None):
            made[int(frame) - number * run][int(cell)] = (int(fore), int(back), bytes(mask))
        return pd.DataFrame({"stream": [group["stream"].iloc[0]], "run_no": [number], "payload": [write_sequence(made, cells, depth)]})

    schema = T.StructType([stream, *struct("run_no long, payload binary")])
    return listed.unionByName(runs).groupBy("stream", "run_no").applyInPandas(write, schema)


def decode_sequences(coded: DataFrame, run: int = 120) -> DataFrame:
    """(stream, frame, cell, fore, back, mask) of coded runs of ``run`` frames."""
    schema = T.StructType([coded.schema["stream"], *struct("frame long, cell long, fore long, back long, mask binary")])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (stream, number * run + i, cell, fore, back, mask)
                for stream, number, raw in zip(frame["stream"], frame["run_no"], frame["payload"], strict=True)
                for i, plane in enumerate(read_sequence(bytes(raw)))
                for cell, (fore, back, mask) in sorted(plane.items())
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return coded.select("stream", "run_no", "payload").mapInPandas(read, schema)


def consensus_mask(mask: Column, share: float) -> Column:
    """The bits set in at least ``share`` of a group's 16-byte masks, as BINARY.

    Each bit is a count of its own, so masks are pre-aggregated and no list is made.
    """
    rows = []
    for row in range(MASK_BYTES):
        byte = F.conv(F.hex(F.substring(mask, row + 1, 1)), 16, 10).cast("int")
        value = sum((F.when(F.avg(F.shiftright(byte, b).bitwiseAND(F.lit(1))) >= share, F.lit(1 << b)).otherwise(0) for b in range(8)), F.lit(0))
        rows.append(F.lpad(F.hex(value), 2, "0"))
    return F.unhex(F.concat(*rows))


def ink(mask: Column) -> Column:
    """Set bits of a 16-byte mask."""
    half = lambda at: F.bit_count(F.conv(F.hex(F.substring(mask, at, 8)), 16, -10).cast("long"))
    return half(1) + half(9)


def stabilised(planes: DataFrame, key: list[str], frames: Column, frame_share: float = 0.25, bit_share: float = 0.35, least_ink: int = 3, most_ink: int = 112) -> DataFrame:
    """(key, cell, fore, back, mask): one lasting plane for each key.

    A cell stays if it is in ``frame_share`` of the frames; it gets its commonest
    color pair (the least as text among equals) and the bits set in ``bit_share``
    of its masks, if they have a fair number of bits.  ``frames`` is the frames
    of a key, a literal or a column of ``planes``.
    """
    pair = F.concat_ws(",", F.col("fore").cast("string"), F.col("back").cast("string"))
    counts = planes.groupBy(*key, "cell", pair.alias("pair"), "fore", "back").agg(F.count("*").alias("n"))
    best = counts.groupBy(*key, "cell").agg(F.min(F.struct((-F.col("n")).alias("m"), "pair", "fore", "back")).alias("b"))
    masks = planes.groupBy(*key, "cell").agg(F.count("*").alias("seen"), F.max(frames).alias("frames"), consensus_mask(F.col("mask"), bit_share).alias("mask"))
    kept = masks.where(F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.col("frames") * frame_share)))
    out = kept.join(best, [*key, "cell"]).select(*key, "cell", F.col("b.fore").alias("fore"), F.col("b.back").alias("back"), "mask")
    return out.where(ink(F.col("mask")).between(least_ink, most_ink))


def measured(planes: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """(key, planes, distinct_planes, changed_planes) of planes given by their hashes."""
    before = F.lag(digest).over(Window.partitionBy(*key).orderBy(*order))
    marked = planes.withColumn("__changed", F.coalesce((before != F.col(digest)).cast("long"), F.lit(0)))
    return marked.groupBy(*key).agg(F.count("*").alias("planes"), F.countDistinct(digest).alias("distinct_planes"), F.sum("__changed").alias("changed_planes"))


def span_consensus(planes: DataFrame, spans: DataFrame, **rules) -> DataFrame:
    """(stream, start, cell, fore, back, mask): one lasting plane for each span of a stream.

    Planes meet the span that holds their frame; a span's frames are those of its
    length, with or without cells.
    """
    of = spans.select(F.col("stream").alias("__stream"), "start", "end")
    held = F.col("stream").eqNullSafe(F.col("__stream")) & (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end"))
    met = planes.join(of, held).withColumn("__frames", F.col("end") - F.col("start"))
    return stabilised(met, ["stream", "start"], F.col("__frames"), **rules)
