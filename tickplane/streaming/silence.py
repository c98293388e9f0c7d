"""Pauses in live level streams, with keyed state.

Rows of a stream come in micro-batches in order of ``place``; the state is five
numbers, however long the stream is, and a pause is given out when it ends.  The
result is the same for any cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickplane.schema import struct

OUTPUT = struct("stream string, start long, end long")
_STATE = struct("place long, low_run long, high_run long, start long, due long")
NOWHERE = -1


def advance(state: tuple[int, int, int, int, int], levels: list[float], enter: float, enter_rows: int, leave: float, leave_rows: int) -> tuple[tuple[int, int, int, int, int], list[tuple[int, int]]]:
    """The state after some levels, and the pauses that ended among them."""
    place, low, high, start, due = state
    ended = []
    for level in levels:
        if start == NOWHERE:
            low = low + 1 if level <= enter else 0
            if low >= enter_rows:
                start, low, high = place - low + 1, 0, 0
        else:
            high = high + 1 if level >= leave else 0
            if high >= leave_rows:
                ended.append((start, place - high + 1))
                start, low, high = NOWHERE, 0, 0
        place += 1
    return (place, low, high, start, due), ended


class PauseProcessor(StatefulProcessor):
    """Rows (stream, place, level, last) to pauses; a row with ``last`` closes its stream.

    Rows out of place fail the batch before any state is written, so the state
    stays what the last sound batch left.
    """

    def __init__(self, enter: float, enter_rows: int, leave: float, leave_rows: int):
        self.rule = (enter, enter_rows, leave, leave_rows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pause", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, NOWHERE, 0)
        found, closed = [], False
        for frame in [pd.concat(list(rows)).sort_values("place")]:
            if frame["place"].tolist() != list(range(state[0], state[0] + len(frame))) or closed:
                raise ValueError(f"rows of stream {key[0]} are out of place")
            state, ended = advance(state, frame["level"].tolist(), *self.rule)
            found += ended
            closed = bool(frame["last"].any())
        if closed:
            if state[3] != NOWHERE:
                found.append((state[3], state[0]))
            self.state.clear()
        else:
            self.state.update(state)
        yield pd.DataFrame({"stream": key[0], "start": [a for a, _ in found], "end": [b for _, b in found]})

    def close(self) -> None:
        pass


def pauses(levels: DataFrame, enter: float, enter_rows: int, leave: float, leave_rows: int) -> DataFrame:
    """Streaming (stream, start, end) of a streaming (stream, place, level, last).

    Needs the RocksDB state store.
    """
    return levels.groupBy("stream").transformWithStateInPandas(
        statefulProcessor=PauseProcessor(enter, enter_rows, leave, leave_rows), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def group_sizes(levels: DataFrame, width: str, delay: str) -> DataFrame:
    """Rows and mean level by stream and tumbling window of event time, late rows up to ``delay`` let in."""
    from pyspark.sql import functions as F

    return levels.withWatermark("ts", delay).groupBy("stream", F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("level").alias("level"))
