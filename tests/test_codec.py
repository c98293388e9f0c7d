"""Codecs by round trips, malformed bytes and small exact cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickplane.functions import bits
from tickplane.functions import grid_codec as gc
from tickplane.operators import codec
from tickplane.plans import codec_queries as cq
from tickplane.sources import container


@given(st.integers(0, 2**32 - 1))
def test_varuint_round_trip(n):
    raw = bits.put_varuint(n)
    assert bits.get_varuint(raw + b"\xff", 0) == (n, len(raw))


@pytest.mark.parametrize("raw", [b"", b"\x80", b"\x80\x00", b"\xff\xff\xff\xff\x10", b"\x80\x80\x80\x80\x80\x01"])
def test_bad_varuint(raw):
    with pytest.raises(bits.FormatError):
        bits.get_varuint(raw, 0)


@given(st.binary(max_size=400))
def test_huffman_round_trip(raw):
    assert bits.huffman_decode(bits.huffman_encode(raw)) == raw


def test_huffman_rejects_cut_and_padded_input():
    raw = bits.huffman_encode(b"abracadabra")
    for bad in (raw[:-1], raw + b"\0", b"XUF1" + raw[4:]):
        with pytest.raises(bits.FormatError):
            bits.huffman_decode(bad)


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 511)), max_size=40))
def test_packing_round_trip(fields):
    widths = np.array([w for w, _ in fields], np.int64)
    values = np.array([v % (1 << w) for w, v in fields], np.int64)
    assert bits.unpack_low_first(bits.pack_low_first(values, widths), widths).tolist() == values.tolist()


cell = st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2))


@settings(max_examples=80, deadline=None)
@given(st.lists(cell, min_size=12, max_size=12), st.lists(cell, min_size=12, max_size=12), st.booleans())
def test_commands_round_trip(now, then, key):
    now, before = np.array(now, np.uint8), None if key else np.array(then, np.uint8)
    raw = gc.plain_encode(now, before, 4, 3)
    assert np.array_equal(gc.plain_apply(raw, before, 12, 4, 3), now)
    plan = gc.packed_plan(now, before, 3)
    packed = gc.packed_encode(plan, 3)
    assert np.array_equal(gc.packed_apply(packed, before, 12, 3), now)
    flat = gc.packed_encode(gc.packed_plan(now, before, 3, byte_costs=np.full(256, 8.0)), 3)
    assert len(flat) == len(packed)


def _cheapest(now, before, depth, n):
    """The least size over all ways to cut a small grid into packed commands."""
    b = gc.index_bits(depth)
    base = np.zeros_like(now) if before is None else before
    best = [None] * n + [1]
    for at in range(n - 1, -1, -1):
        sizes = []
        for count in range(1, n - at + 1):
            part, old = now[at : at + count], base[at : at + count]
            sizes.append(2 + -(-count * (6 + 2 * b) // 8) + best[at + count])
            if np.array_equal(part, old):
                sizes.append(2 + best[at + count])
            if (part == part[0]).all():
                sizes.append(2 + -(-(6 + 2 * b) // 8) + best[at + count])
            if before is not None:
                for parts in ((0,), (1,), (2,), (1, 2)):
                    others = [p for p in range(3) if p not in parts]
                    if np.array_equal(part[:, others], old[:, others]) and (part[:, parts] == part[0, parts]).all() and (part[:, parts] != old[:, parts]).all():
                        sizes.append((1 if count == 1 else 2) + -(-sum(6 if p == 0 else b for p in parts) // 8) + best[at + count])
        best[at] = min(sizes)
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(cell, min_size=7, max_size=7), st.lists(cell, min_size=7, max_size=7), st.booleans())
def test_packed_plan_is_the_cheapest(now, then, key):
    now, before = np.array(now, np.uint8), None if key else np.array(then, np.uint8)
    assert len(gc.packed_encode(gc.packed_plan(now, before, 3), 3)) == _cheapest(now, before, 3, 7)


def test_uniform_keyframe_is_one_rectangle():
    raw = gc.plain_encode(np.tile(np.array([[5, 1, 0]], np.uint8), (12, 1)), None, 4, 3)
    assert raw == bytes([gc.FILL, 0, 0, 4, 3, 5, 1, 0, gc.END])


@given(st.binary(max_size=60))
def test_any_bytes_decode_or_fail_cleanly(raw):
    before = np.zeros((12, 3), np.uint8)
    for apply in (lambda: gc.plain_apply(raw, before, 12, 4, 3), lambda: gc.packed_apply(raw, before, 12, 3)):
        try:
            assert apply().shape == (12, 3)
        except bits.FormatError:
            pass
        assert not before.any()


def test_containers_hold_their_frames(spark, sf_dir):
    frames = cq.grid_frames(spark, sf_dir).where("cast(path as int) < 8").cache()
    files = container.mux(codec.encode_timelines(frames, cq.COLUMNS, cq.DEPTH, cq.CADENCE, cq.INTERVAL), cq.COLUMNS, cq.ROWS, cq.CADENCE, cq.DEPTH).cache()
    found = container.chunks(files).cache()
    heads = container.headers(files)
    assert heads.where("error is not null").count() == 0 and found.where("error is not null or not crc_ok").count() == 0
    assert container.timeline_faults(found, heads).count() == 0 and container.index_faults(found).count() == 0
    assert container.index_entries(found).count() == found.where("type = 'VFRM' and hex(substring(payload, 1, 1)) = '00'").count()
    states = codec.decode_timelines(found, cq.CELLS, cq.COLUMNS, cq.DEPTH)
    assert states.where("error is not null").count() == 0
    each = states.select("path", "state", F.explode(F.sequence(F.col("timestamp"), F.col("timestamp") + F.col("duration") - 1, F.lit(2500).cast("long"))).alias("t"))
    met = each.join(frames.withColumn("t", F.col("place") * 2500).withColumnRenamed("state", "s"), ["path", "t"], "full_outer")
    assert met.where("not state <=> s").count() == 0


def test_bad_files_say_why(spark):
    good = container.mux_bytes(4, 3, 7, 16, [("VFRM", 0, 2500, b"\0" + gc.plain_encode(np.zeros((12, 3), np.uint8), None, 4, 16)), ("RPTF", 2500, 2500, b"")])
    at = container.HEADER.size + container.PREFIX.size
    files = {"good": good, "cut": good[:-3], "magic": b"x" + good[1:], "crc": good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :], "long": good + b"\0", "empty": b"", "null": None}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    errors = {r["path"] for r in container.chunks(df).where("error is not null").collect()}
    assert errors == set(files) - {"good"}
    assert {r["path"] for r in container.headers(df).where("error is null").collect()} == {"good", "crc", "long"}
    gap = container.mux_bytes(4, 3, 7, 16, [("VFRM", 0, 2500, b"\0"), ("RPTF", 5000, 2400, b"x")])
    one = spark.createDataFrame([("gap", gap)], "path string, content binary")
    rules = {r["rule"] for r in container.timeline_faults(container.chunks(one), container.headers(one)).collect()}
    assert rules == {"video gap", "frame span", "repeat payload"}


def test_deflate_is_capped():
    import zlib

    engine = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = engine.compress(bytes(100_000)) + engine.flush()
    assert len(container.inflate(raw)) == 100_000
    with pytest.raises(bits.FormatError):
        container.inflate(raw, 1000)


def test_entropy_refinement_selects_one(spark, sf_dir):
    frames = cq.grid_frames(spark, sf_dir).where("cast(path as int) < 3")
    found = codec.entropy_refined(frames, cq.COLUMNS, cq.DEPTH, cq.INTERVAL).collect()
    for key in {(r["path"], r["group_no"]) for r in found}:
        own = [r for r in found if (r["path"], r["group_no"]) == key]
        best = [r for r in own if r["selected"]]
        assert len(own) == 3 and len(best) == 1 and best[0]["deflate_bytes"] == min(r["deflate_bytes"] for r in own)


def test_streams_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(5)
    for trial in range(60):
        size, cells, depth, run = int(rng.integers(1, 9)), 6 * int(rng.integers(1, 7)) if trial % 20 else 138, int(rng.choice([1, 2, 5, 16, 256])), int(rng.choice([1, 3, 64]))
        some = lambda: np.stack([rng.integers(0, 4, (size, cells)), *(rng.integers(0, min(depth, 3), (size, cells)) for _ in "fb")], 2).astype(np.uint8)  # noqa: B023, E731
        states = some()
        before, keyed = np.where(rng.random((size, cells, 3)) < rng.choice([0.5, 0.9, 1]), states, some()), rng.random(size) < 0.3
        weights, owner = -np.log2((rng.integers(0, 50, (2, 256)) + 0.5) / 7000), rng.integers(0, 2, size)
        each = [(s, None if k else b) for s, b, k in zip(states, before, keyed, strict=True)]
        assert gc.cut(*gc.plain_streams(states, before, keyed, 6, depth)) == [gc.plain_encode(s, b, 6, depth) for s, b in each]
        assert gc.cut(*gc.packed_streams(states, before, keyed, depth, run)) == [gc.packed_encode(gc.packed_plan(s, b, depth, run), depth) for s, b in each]
        weighted = [gc.packed_encode(gc.packed_plan(s, b, depth, run, weights[o]), depth) for (s, b), o in zip(each, owner, strict=True)]
        assert gc.cut(*gc.packed_streams(states, before, keyed, depth, run, weights, owner)) == weighted


def test_entropy_refinement_of_many_groups_and_sizes(spark):
    import zlib

    rng = np.random.default_rng(6)
    streams = {path: [rng.integers(0, 3, (cells, 3)).astype(np.uint8) for _ in range(n)] for path, cells, n in (("a", 6, 11), ("b", 9, 4), ("c", 6, 5))}
    rows = [(path, i, bytes(s.tobytes())) for path, states in streams.items() for i, s in enumerate(states)] + [(None, 0, bytes(6))]
    streams[None] = [np.zeros((2, 3), np.uint8)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = codec.entropy_refined(spark.createDataFrame(rows, "path string, place long, state binary"), 3, 4, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = []
    for path, states in streams.items():
        for group in range(-(-len(states) // 5)):
            own, costs, tried = states[group * 5 : group * 5 + 5], None, []
            for _ in range(3):
                raw = b"".join(gc.packed_encode(gc.packed_plan(s, b, 4, 32, costs), 4) for s, b in zip(own, [None, *own[:-1]], strict=True))
                engine = zlib.compressobj(9, zlib.DEFLATED, -15)
                tried.append((len(engine.compress(raw) + engine.flush()), len(raw)))
                counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                costs = -np.log2((counts + 0.5) / (counts.sum() + 128))
            best = min(range(3), key=lambda i: (*tried[i], i))
            expected += [(path, group, i, size, packed, i == best) for i, (packed, size) in enumerate(tried)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
