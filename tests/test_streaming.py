"""Live decoding with keyed state, and late rows against a watermark."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tickplane.functions import grid_codec as gc
from tickplane.functions.bits import FormatError
from tickplane.schema import struct
from tickplane.streaming import decoder, silence

CELLS, COLUMNS, DEPTH = 6, 3, 4


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def _streams():
    rng = random.Random(4)
    states, rows = {}, []
    for name in "ab":
        grid = None
        for place in range(20):
            after = grid.copy() if grid is not None else np.zeros((CELLS, 3), np.uint8)
            if grid is None or rng.random() < 0.6:
                after[rng.randrange(CELLS)] = (rng.randrange(64), rng.randrange(DEPTH), rng.randrange(DEPTH))
            if grid is not None and (after == grid).all():
                rows.append((name, place, decoder.AGAIN, b""))
            else:
                whole = grid is None or place % 7 == 0
                rows.append((name, place, decoder.KEY if whole else decoder.DELTA, gc.plain_encode(after, None if whole else grid, COLUMNS, DEPTH)))
            grid = after
            states[name, place] = grid.tobytes()
    return states, rows


def _run(spark, tmp_path, batches, schema, build, name):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
    return spark.table(name).collect()


def test_live_grids_over_batches(spark, tmp_path, rocks):
    states, rows = _streams()
    batches = [[r for r in rows if r[1] // 6 == k] for k in range(4)]
    got = _run(spark, tmp_path, batches, struct("stream string, place long, kind int, commands binary"), lambda s: decoder.decoded(s, CELLS, COLUMNS, DEPTH), "grids")
    assert {(r["stream"], r["place"]): bytes(r["state"]) for r in got} == states


def test_a_failed_frame_leaves_the_grid(spark):
    grid = decoder.advance(None, decoder.KEY, gc.plain_encode(np.ones((CELLS, 3), np.uint8), None, COLUMNS, DEPTH), CELLS, COLUMNS, DEPTH)
    before = grid.tobytes()
    for kind, commands in ((decoder.DELTA, b"\xff"), (decoder.AGAIN, b"x")):
        with pytest.raises(FormatError):
            decoder.advance(grid, kind, commands, CELLS, COLUMNS, DEPTH)
    with pytest.raises(FormatError):
        decoder.advance(None, decoder.DELTA, b"\0", CELLS, COLUMNS, DEPTH)
    assert grid.tobytes() == before


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [[("s", at(1), 1.0), ("s", at(2), 3.0)], [("s", at(30), 5.0)], [("s", at(31), 7.0)], [("s", at(3), 100.0)], [("s", at(90), 0.0)], [("s", at(91), 0.0)]]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("stream", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("level", T.DoubleType())])
    got = _run(spark, tmp_path, batches, schema, lambda s: silence.group_sizes(s, "10 minutes", "5 minutes"), "groups")
    rows = {r["window"]["start"]: (r["n"], r["level"]) for r in got}
    assert rows[at(0)] == (2, 2.0) and rows[at(30)] == (2, 6.0)  # the row of minute 3 came two batches after minute 30
