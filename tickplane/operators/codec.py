"""Timelines of grid states, encoded and decoded group by group.

A keyframe starts a group, and nothing in a group depends on another; so groups
of at most ``interval`` frames are the unit of work, however long a stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.functions import grid_codec as gc
from tickplane.functions.bits import FormatError
from tickplane.functions.scalars import CADENCES
from tickplane.schema import struct

CHUNKS = "path string, seq long, type string, timestamp long, duration long, payload binary"
KEY_KIND, DELTA_KIND = b"\0", b"\1"


def _state(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, 3)


def first_rows(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Marks rows whose keys aren't those of the row before; the first row is marked."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for key in keys:
        column = table[key].combine_chunks() if isinstance(table, pa.Table) else table[key]
        number = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= number[1:] != number[:-1]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, row: [batch[k][row].as_py() for k in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(first_rows(batch, keys))[-1])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def state_array(column: pa.ChunkedArray) -> np.ndarray:
    """(state, cell, part) of equally long states."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1, 3)


def in_groups(frames: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """Rows that ``run`` makes of many whole groups of frames at once: (rows, states), sorted by keys and place.

    A task holds one batch and one group; states of a group are equally long, and
    only such are given together.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(rows, keys):
            sizes = np.array([len(x) for x in table["state"].to_pylist()])
            for size in np.unique(sizes).tolist():
                own = table if (sizes == size).all() else table.take(np.flatnonzero(sizes == size))
                yield from run(own, state_array(own["state"])).to_batches()

    return frames.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(batches, schema)


def encode_timelines(frames: DataFrame, columns: int, depth: int, cadence_id: int, interval: int = 120, use_dictionary: bool = True, group: Column | None = None) -> DataFrame:
    """Chunk rows of (path, place, state) frames, place counting from 0 in each path.

    Each ``interval`` frames a keyframe, or where ``group`` (scenes, say) says so;
    equal neighbours inside a group become one repeat chunk.
    """
    ticks = CADENCES[cadence_id][4]
    number = F.floor(F.col("place") / interval) if group is None else group
    grouped = frames.select("path", F.col("place").cast("long").alias("place"), "state", number.cast("long").alias("group_no"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, out, before = group.sort_values("place"), [], None
        for path, place, raw in zip(group["path"], group["place"], group["state"], strict=True):
            state = _state(raw)
            if before is not None and np.array_equal(state, before):
                if out[-1][2] == "RPTF":
                    out[-1][4] += ticks
                else:
                    out.append([path, place, "RPTF", place * ticks, ticks, b""])
                continue
            commands = gc.plain_encode(state, before, columns, depth, use_dictionary)
            out.append([path, place, "VFRM", place * ticks, ticks, (KEY_KIND if before is None else DELTA_KIND) + commands])
            before = state
        return pd.DataFrame(out, columns=["path", "seq", "type", "timestamp", "duration", "payload"])

    return grouped.groupBy("path", "group_no").applyInPandas(run, CHUNKS)


def with_groups(chunks: DataFrame) -> DataFrame:
    """Video chunks with ``group_no``: how many keyframes a file has up to there."""
    key = F.coalesce((F.col("type") == "VFRM") & (F.hex(F.substring("payload", 1, 1)) == "00"), F.lit(False))
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.where(F.col("type").isin("VFRM", "RPTF")).withColumn("keyframe", key).withColumn("group_no", F.sum(key.cast("long")).over(w))


def decode_timelines(chunks: DataFrame, cells: int, columns: int, depth: int) -> DataFrame:
    """(path, timestamp, duration, keyframe, repeat, state, error) of video chunk rows.

    An error ends its group; what stands before it stays, as the state that was
    there is never written to.
    """
    schema = struct("path string, timestamp long, duration long, keyframe boolean, repeat boolean, state binary, error string")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, state = [], None
        for _, row in group.sort_values("seq").iterrows():
            repeat, error = row["type"] == "RPTF", None
            try:
                if repeat:
                    if state is None or len(row["payload"]):
                        raise FormatError("repeat without a frame, or with a payload")
                else:
                    if not row["keyframe"] and (state is None or row["payload"][:1] != DELTA_KIND):
                        raise FormatError("delta without a keyframe")
                    state = gc.plain_apply(bytes(row["payload"][1:]), None if row["keyframe"] else state, cells, columns, depth)
            except FormatError as problem:
                error = str(problem)
            out.append((row["path"], row["timestamp"], row["duration"], bool(row["keyframe"]), repeat, None if error else state.tobytes(), error))
            if error:
                break
        return pd.DataFrame(out, columns=schema.names)

    return with_groups(chunks).groupBy("path", "group_no").applyInPandas(run, schema)


def command_sizes(frames: DataFrame, columns: int, depth: int, interval: int, literal_run: int = 64) -> DataFrame:
    """(path, place, keyframe, plain_bytes, packed_bytes, exact): both command languages on the same frames."""
    schema = struct("path string, place long, keyframe boolean, plain_bytes long, packed_bytes long, exact boolean")
    grouped = frames.select("path", F.col("place").cast("long").alias("place"), "state", F.floor(F.col("place") / interval).cast("long").alias("group_no"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for path, place, raw in group.sort_values("place")[["path", "place", "state"]].itertuples(index=False, name=None):
            state = _state(raw)
            plain = gc.plain_encode(state, before, columns, depth)
            packed = gc.packed_encode(gc.packed_plan(state, before, depth, literal_run), depth)
            exact = np.array_equal(gc.plain_apply(plain, before, len(state), columns, depth), state) and np.array_equal(gc.packed_apply(packed, before, len(state), depth), state)
            out.append((path, place, before is None, len(plain), len(packed), exact))
            before = state
        return pd.DataFrame(out, columns=schema.names)

    return grouped.groupBy("path", "group_no").applyInPandas(run, schema)


def entropy_refined(frames: DataFrame, columns: int, depth: int, interval: int, literal_run: int = 32, alpha: float = 0.5, passes: int = 2) -> DataFrame:
    """(path, group_no, pass, command_bytes, deflate_bytes, selected): packed parses under learnt byte costs.

    The first parse counts bytes; each further pass prices bytes by the smoothed
    frequencies of the parse before it.  Of all, the least deflated size is
    selected, then the least command size, then the earliest.
    """
    import zlib

    schema = struct("path string, group_no long, pass int, command_bytes long, deflate_bytes long, selected boolean")
    grouped = frames.select("path", F.col("place").cast("long").alias("place"), "state", F.floor(F.col("place") / interval).cast("long").alias("group_no"))

    def run(rows: pa.Table, states: np.ndarray) -> pa.Table:
        keyed = first_rows(rows, ["path", "group_no"])
        firsts, owner = np.flatnonzero(keyed), np.cumsum(keyed) - 1
        before, costs, tried = np.concatenate((states[:1], states[:-1])), None, []
        for _ in range(passes + 1):
            data, places = gc.packed_streams(states, before, keyed, depth, literal_run, costs, owner)
            places = places[np.append(firsts, len(states))]
            deflated = []
            for raw in gc.cut(data, places):
                engine = zlib.compressobj(9, zlib.DEFLATED, -15)
                deflated.append(len(engine.compress(raw) + engine.flush()))
            tried.append((np.array(deflated), np.diff(places)))
            counts = np.bincount(np.repeat(np.arange(len(firsts)) * 256, np.diff(places)) + np.frombuffer(data, np.uint8), minlength=256 * len(firsts)).reshape(-1, 256)
            costs = -np.log2((counts + alpha) / (counts.sum(1, keepdims=True) + 256 * alpha))
        best = np.zeros(len(firsts), np.int64)
        for i in range(1, passes + 1):
            (size, packed), (least, least_packed) = tried[i], (np.stack([t[k] for t in tried])[best, np.arange(len(firsts))] for k in (0, 1))
            best = np.where((size < least) | (size == least) & (packed < least_packed), i, best)
        keys = rows.select(["path", "group_no"]).take(np.repeat(firsts, passes + 1))
        number = np.tile(np.arange(passes + 1, dtype=np.int32), len(firsts))
        found = [np.stack([t[k] for t in tried], 1).ravel() for k in (1, 0)]
        return pa.Table.from_arrays([keys["path"], keys["group_no"], *map(pa.array, (number, *found, number == np.repeat(best, passes + 1)))], schema.names)

    return in_groups(grouped, ["path", "group_no"], run, schema)


def byte_code(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """``keep``, raw and Huffman-coded sizes of a BINARY column, and whether it decodes to itself."""
    from tickplane.functions.bits import huffman_decode, huffman_encode

    schema = T.StructType([*(df.schema[c] for c in keep), *struct("raw_bytes long, coded_bytes long, exact boolean")])

    def run(frames):
        for frame in frames:
            made = [(len(x), huffman_encode(x)) for x in (bytes(v or b"") for v in frame["__raw"])]
            out = frame[keep].copy()
            out["raw_bytes"], out["coded_bytes"] = [n for n, _ in made], [len(c) for _, c in made]
            out["exact"] = [huffman_decode(c) == bytes(v or b"") for (_, c), v in zip(made, frame["__raw"], strict=True)]
            yield out

    return df.select(*keep, F.col(raw).alias("__raw")).mapInPandas(run, schema)


#: Fixed value: the mark of a stream of decoded states.
STATES_MAGIC = bytes.fromhex("563634474f4c4431")


def _low_first(n: Column, size: int) -> Column:
    """Hex digits of a number in ``size`` bytes, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def state_records(decoded: DataFrame) -> DataFrame:
    """(path, timestamp, record) of decoded frames: times, flags, size and state as one BINARY."""
    flag = lambda c: F.when(F.col(c), "01").otherwise("00")
    head = F.concat(_low_first(F.col("timestamp"), 8), _low_first(F.col("duration"), 8), flag("keyframe"), flag("repeat"), F.lit("0000"), _low_first(F.octet_length("state"), 4))
    return decoded.where("error is null").select("path", "timestamp", F.concat(F.unhex(head), "state").alias("record"))


def state_streams(records: DataFrame, columns: int, rows: int) -> DataFrame:
    """(path, content): all records of a file in order of time behind a header.

    A file's records are gathered, as a file is one value; for files that don't
    fit one, write the records of ``state_records`` instead.
    """
    listed = F.array_sort(F.collect_list(F.struct("timestamp", F.hex("record").alias("h"))))
    whole = records.groupBy("path").agg(listed.alias("l"))
    head = F.concat(F.lit(STATES_MAGIC.hex().upper()), _low_first(F.lit(columns), 2), _low_first(F.lit(rows), 2), _low_first(F.size("l"), 4))
    return whole.select("path", F.unhex(F.concat(head, F.array_join(F.transform("l", lambda x: x["h"]), ""))).alias("content"))
