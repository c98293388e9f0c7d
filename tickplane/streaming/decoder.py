"""Grid states decoded from live command streams, with keyed state.

The state is a stream's last grid and how many frames it has had; it is written
only after a whole batch of the stream has been decoded, so a batch that fails
leaves what the last sound one left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickplane.functions import grid_codec as gc
from tickplane.functions.bits import FormatError
from tickplane.schema import struct

OUTPUT = struct("stream string, place long, state binary")
_STATE = struct("place long, state binary")
#: Kinds of frames: a whole grid, a change of the one before, the one before again.
KEY, DELTA, AGAIN = 0, 1, 2


def advance(state: np.ndarray | None, kind: int, commands: bytes, cells: int, columns: int, depth: int) -> np.ndarray:
    """The grid after a frame; the one before is left as it is."""
    if kind == KEY:
        return gc.plain_apply(commands, None, cells, columns, depth)
    if state is None:
        raise FormatError("a stream starts with a whole grid")
    if kind == AGAIN:
        if commands:
            raise FormatError("repeat with a payload")
        return state
    return gc.plain_apply(commands, state, cells, columns, depth)


class DecoderProcessor(StatefulProcessor):
    """Rows (stream, place, kind, commands), in order of place from 0, to grids."""

    def __init__(self, cells: int, columns: int, depth: int):
        self.grid = (cells, columns, depth)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("grid", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place, raw = self.state.get() if self.state.exists() else (0, None)
        grid, out = None if raw is None else np.frombuffer(raw, np.uint8).reshape(-1, 3), []
        for at, kind, commands in pd.concat(list(rows)).sort_values("place")[["place", "kind", "commands"]].itertuples(index=False, name=None):
            if at != place:
                raise ValueError(f"rows of stream {key[0]} are out of place")
            grid = advance(grid, int(kind), bytes(commands), *self.grid)
            out.append((key[0], place, grid.tobytes()))
            place += 1
        self.state.update((place, out[-1][2]))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def decoded(frames: DataFrame, cells: int, columns: int, depth: int) -> DataFrame:
    """Streaming (stream, place, state) of a streaming (stream, place, kind, commands).

    Needs the RocksDB state store.
    """
    return frames.groupBy("stream").transformWithStateInPandas(statefulProcessor=DecoderProcessor(cells, columns, depth), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
