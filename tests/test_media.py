"""Audio, raster and plane operators on small exact cases, and the live pause detector."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickplane.functions import audio as au
from tickplane.functions import raster as ra
from tickplane.functions.bits import FormatError
from tickplane.operators import audio, planes
from tickplane.schema import struct
from tickplane.streaming import silence as live


def test_wav_round_trip_and_faults():
    samples = np.arange(-300, 300, dtype=np.int16)
    raw = au.write_wav(samples, 8000, 2)
    rate, channels, back = au.read_wav(raw)
    assert (rate, channels) == (8000, 2) and np.array_equal(back, samples)
    for bad in (raw[:40], b"JUNK" + raw[4:], raw[:-5]):
        with pytest.raises(FormatError):
            au.read_wav(bad)


def test_packet_lengths():
    assert [au.packet_samples(bytes([c << 3])) for c in (0, 3, 12, 13, 16, 19, 31)] == [480, 2880, 480, 960, 120, 960, 960]
    assert au.packet_samples(bytes([1])) == 960 and au.packet_samples(bytes([3, 3])) == 1440
    for bad in (b"", b"\x03", bytes([3, 0]), bytes([3 << 3 | 3, 3])):
        with pytest.raises(FormatError):
            au.packet_samples(bad)


def test_run_round_trip_and_accounting(spark):
    run = au.Run([bytes([31 << 3, i]) for i in range(10)], 312, 288)
    raw = au.write_run(run)
    assert au.read_run(raw) == run and run.kept == 9000
    for bad in (raw[:-1], raw + b"\0", raw[:8] + b"\1" + raw[9:]):
        with pytest.raises(FormatError):
            au.read_run(bad)
    rows = [("f", 0, "AURN", 11250, raw, None), ("f", 1, "AURN", 11251, raw, None), ("f", 2, "AURN", 5, b"x", None)]
    found = audio.run_accounts(spark.createDataFrame(rows, "path string, seq long, type string, duration long, payload binary, error string")).collect()
    assert [(r["kept"], r["error"] is None) for r in sorted(found, key=lambda r: r["seq"])] == [(9000, True), (9000, True), (None, False)]


def test_pauses_of_the_synthetic_audio(spark):
    raw = au.write_wav(au.synthetic_speech(), au.RATE)
    files = spark.createDataFrame([("a", raw), ("bad", b"x")], "path string, content binary")
    for block in (480 * 7, 480 * 400):
        blocks = audio.wav_blocks(files, block)
        assert blocks.where("error is not null").count() == 1
        got = sorted(map(tuple, audio.silence(blocks, au.RATE).select("start", "end").collect()))
        assert got == [(12000, 31200), (69600, 96000)]


def test_padding_and_segments(spark):
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, -4, 0, 5, 1])], "k string, i long, v double")
    assert [r["v"] for r in audio.padded(samples, "k", "i", "v", 7).orderBy("i").collect()] == [3, -4, 0, 5, 1, 0, 0]
    assert audio.padded(samples, "k", "i", "v", 2).count() == 2
    segments = spark.createDataFrame([("a", 0, 2), ("a", 2, 4)], "k string, start long, end long")
    got = {r["start"]: (round(r["rms"], 6), r["peak"]) for r in audio.segment_levels(samples, segments, ["k"], "i", "v").collect()}
    assert got == {0: (round(12.5**0.5, 6), 4), 2: (round(12.5**0.5, 6), 5)}


def test_raster_frames_hold_whole_vectors(spark, sf_dir):
    from tickplane.plans import media_queries as mq

    vectors = mq.load(spark, sf_dir, "embeddings")
    expected = sorted([min(255, int(abs(x) * 512)) for x in r["embedding"]] for r in vectors.collect())
    got = sorted(list(bytes(r["rgba"])[::4]) for r in mq.raster_frames(spark, sf_dir).collect())
    assert all(len(g) == mq.FRAME_SIDE**2 for g in got) and got == expected


def test_scene_scores():
    black, white = np.zeros((6, 8, 4), np.uint8), np.full((6, 8, 4), 255, np.uint8)
    assert ra.scene_score(black, black) == 0 and ra.scene_score(black, white) == 1


GLYPHS = np.random.default_rng(1).integers(0, 256, (64, 16), dtype=np.uint8)
GLYPHS[7] = 255
PALETTE = np.array([[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 0, 255]], np.uint8)


def test_rendering_and_analysis_agree_on_flat_cells():
    cells = np.array([[7, c, c] for c in (0, 1, 2, 3, 1, 0)], np.uint8)
    frame = ra.render(cells, 3, GLYPHS, PALETTE)
    assert frame.shape == (32, 24, 4) and np.array_equal(ra.analyse(frame, 3, 2, GLYPHS, PALETTE), cells)


def test_a_rendered_glyph_is_its_own_best_match():
    blocks = np.zeros((64, 16), np.uint8)
    rng = np.random.default_rng(4)
    for g in range(64):  # glyphs of whole samples, all different
        bits = np.unpackbits(np.frombuffer(rng.bytes(4), np.uint8)).reshape(8, 4)
        blocks[g] = np.packbits(np.kron(bits, np.ones((2, 2), np.uint8)), axis=1)[:, 0]
    blocks[7] = 255
    cells = np.array([[g, 1, 0] for g in range(64) if g != 7], np.uint8)[:60]
    got = ra.analyse(ra.render(cells, 10, blocks, PALETTE), 10, 6, blocks, PALETTE)
    assert (got[:, 0] == cells[:, 0]).mean() > 0.95


def test_stability_holds_the_state_before():
    rng = np.random.default_rng(2)
    frame = rng.integers(0, 256, (32, 32, 4), dtype=np.uint8)
    first = ra.analyse(frame, 4, 2, GLYPHS, PALETTE)
    noisy = np.clip(frame.astype(int) + rng.integers(-2, 3, frame.shape), 0, 255).astype(np.uint8)
    free, held = ra.analyse(noisy, 4, 2, GLYPHS, PALETTE), ra.analyse(noisy, 4, 2, GLYPHS, PALETTE, first, 1.0)
    assert (held != first).sum() <= (free != first).sum()


def test_overlay_scanlines_and_ppm():
    frame = ra.render(np.array([[7, 1, 1]], np.uint8), 1, GLYPHS, PALETTE)
    drawn = ra.overlay(frame, 1, [(0, 2, 3, b"\xf0" * 16)], PALETTE)
    assert (drawn[:, :4, :3] == [255, 0, 0]).all() and (drawn[:, 4:, :3] == [0, 0, 255]).all()
    assert ra.scanlines(frame, 0)[1, 0, 0] == 209 and ra.scanlines(frame, 0)[0, 0, 0] == 255
    assert ra.ppm(frame).startswith(b"P6\n8 16\n255\n") and len(ra.ppm(frame)) == 12 + 8 * 16 * 3


entry = st.tuples(st.integers(0, 3), st.integers(0, 3), st.binary(min_size=16, max_size=16))
plane = st.dictionaries(st.integers(0, 19), entry, max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(plane, min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=10))
def test_plane_codecs_round_trip(pool, picks):
    frames = [pool[0], *(pool[i % len(pool)] for i in picks)]
    assert planes.read_plane(planes.write_plane(frames[0], 20, 4)) == frames[0]
    raw = planes.write_sequence(frames, 20, 4)
    assert planes.read_sequence(raw) == frames
    for bad in (raw[:-1], raw + b"\0"):
        with pytest.raises(FormatError):
            planes.read_sequence(bad)


def test_sequences_in_runs(spark):
    rng = random.Random(1)
    rows = [("s", f, c, rng.randrange(4), rng.randrange(4), bytes([f // 3] * 16)) for f in range(25) for c in sorted(rng.sample(range(20), 4))]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fore int, back int, mask binary")
    got = [p for r in planes.encode_sequences(df, 25, 20, 4, 10).orderBy("run_no").collect() for p in planes.read_sequence(bytes(r["payload"]))]
    assert got == [{c: (a, b, m) for _, g, c, a, b, m in rows if g == f} for f in range(25)]


def test_sequences_of_each_streams_own_length(spark):
    rows = [(s, f, 3, 1, 2, bytes(16)) for s, frames in (("a", (0, 34)), ("b", (2,)), (None, (9,))) for f in frames]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fore int, back int, mask binary")
    found = {}
    for r in planes.encode_sequences(df, None, 20, 4, 10).orderBy("stream", "run_no").collect():
        found.setdefault(r["stream"], []).extend(planes.read_sequence(bytes(r["payload"])))
    assert {s: len(p) for s, p in found.items()} == {"a": 35, "b": 3, None: 10}
    assert [f for f, p in enumerate(found["a"]) if p] == [0, 34]


def test_stabilised_plane_matches_plain_python(spark):
    rng = random.Random(2)
    rows = [("s", f, c, rng.randrange(2), rng.randrange(2), bytes(rng.choice((0, 3, 255)) for _ in range(16))) for f in range(12) for c in range(8) if rng.random() < (c + 1) / 9]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fore int, back int, mask binary")
    got = {r["cell"]: (r["fore"], r["back"], bytes(r["mask"])) for r in planes.stabilised(df, ["stream"], F.lit(12)).collect()}
    expected = {}
    for c in range(8):
        own = [r for r in rows if r[2] == c]
        if len(own) < 3:
            continue
        pairs = [(r[3], r[4]) for r in own]
        best = min(set(pairs), key=lambda p: (-pairs.count(p), f"{p[0]},{p[1]}"))
        mask = bytes(sum(1 << b for b in range(8) if sum(r[5][i] >> b & 1 for r in own) / len(own) >= 0.35) for i in range(16))
        if 3 <= sum(x.bit_count() for x in mask) <= 112:
            expected[c] = (*best, mask)
    assert got == expected


@given(st.lists(st.sampled_from([10.0, 50.0, 90.0]), max_size=60), st.lists(st.integers(1, 9), max_size=12))
def test_live_state_does_not_depend_on_the_batches(levels, cuts):
    start = (0, 0, 0, live.NOWHERE, 0)
    whole = live.advance(start, levels, 40, 3, 60, 2)
    state, ended, at = start, [], 0
    for n in [*cuts, len(levels)]:
        state, more = live.advance(state, levels[at : at + n], 40, 3, 60, 2)
        ended += more
        at += n
    assert (state, ended) == whole


def test_live_pauses_match_the_batch_operator(spark, tmp_path):
    from tickplane.operators.timeline import hysteresis_spans

    rng = random.Random(3)
    streams = {f"s{k}": [float(rng.choice((10, 50, 90))) for _ in range(40)] for k in range(5)}
    rows = [(k, i, v, i == 39) for k, x in streams.items() for i, v in enumerate(x)]
    schema = struct("stream string, place long, level double, last boolean")
    for batch in range(4):
        part = [r for r in rows if r[1] // 10 == batch]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = live.pauses(source, 40, 3, 60, 2).writeStream.format("memory").queryName("pauses").outputMode("append")
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
        got = sorted(map(tuple, spark.table("pauses").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    expected = hysteresis_spans(spark.createDataFrame(rows, schema), ["stream"], "place", "level", 40, 3, 60, 2)
    assert got == sorted(map(tuple, expected.select("stream", "start", "end").collect()))
