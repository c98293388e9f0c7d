"""Regions, spans, Ogg streams and rate-distortion analysis."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickplane.functions import audio as au
from tickplane.functions import ogg
from tickplane.functions import raster as ra
from tickplane.functions.bits import FormatError
from tickplane.operators import rate_distortion as rd
from tickplane.operators import regions as rg


def test_components_match_a_flood_fill():
    rng = random.Random(1)
    for _ in range(60):
        columns, gap = rng.randrange(4, 12), rng.randrange(0, 3)
        cells = rng.sample(range(columns * 8), rng.randrange(0, 30))
        left, expected = set(cells), {}
        while left:
            todo, own = [min(left)], []
            left -= {todo[0]}
            while todo:
                c = todo.pop()
                own.append(c)
                near = {o for o in left if abs(o // columns - c // columns) <= 1 and abs(o % columns - c % columns) <= gap + 1}
                left -= near
                todo += near
            expected |= dict.fromkeys(own, min(own))
        got = rg.components(np.array(cells, np.int64), columns, gap) if cells else []
        assert dict(zip(cells, map(int, got), strict=True)) == expected


def test_frame_selection_keeps_wide_low_regions():
    columns, rows = 40, 20
    line = [18 * columns + x for x in range(10, 22)]
    cells = np.array([*line, 3 * columns + 5, 18 * columns + 38, *[y * columns + 30 for y in range(13, 20)]])
    keep = rg.frame_selection(cells, np.ones(len(cells), bool), columns, rows)
    assert cells[keep].tolist() == line


def test_boxes_leave_overlaps_out():
    columns, rows = 40, 20
    support = {17 * columns + x: 5 for x in range(8, 30)} | {18 * columns + x: 5 for x in range(8, 30)}
    boxes = rg.ranked_boxes(support, columns, rows, 3)
    assert 1 <= len(boxes) <= 2 and boxes[0][0] == 7 and boxes[0][1] == 30
    assert rg.ranked_boxes({}, columns, rows, 1) == []


def test_caption_spans():
    a, b = set(range(10)), set(range(50, 60))
    assert rg.caption_spans([a] * 4 + [b] * 4) == [(0, 4), (4, 8)]
    assert rg.caption_spans([a] * 4 + [set()] + [a] * 3) == [(0, 8)]
    assert rg.caption_spans([a] * 4 + [b]) == [(0, 5)]
    assert rg.caption_spans([set()]) == [(0, 1)]


def test_span_and_selection_tables(spark):
    rows = [("s", f, 18 * 40 + x + (0 if f < 6 else 15), True) for f in range(12) for x in range(8, 20)]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fit boolean")
    got = [(r["start"], r["end"]) for r in rg.span_table(df, 12).collect()]
    assert got == [(0, 6), (6, 12)]
    assert rg.temporal_selection(df, 40, 20).count() == len(rows)
    assert rg.temporal_selection(df.withColumn("fit", F.lit(False)), 40, 20).count() == len(rows)


def test_spans_cross_any_run(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for stream in range(12):
        length = rng.choice([1, 3, 250, 481, 700])
        sets, own = [], set()
        for _ in range(length):
            if rng.random() < 0.05:
                own = set(rng.sample(range(60), rng.choice([0, 1, 4, 9])))
            sets.append(own | set(rng.sample(range(60), rng.randrange(3))) if rng.random() < 0.9 else set())
        sets[-1] = sets[-1] or {1}
        expected |= {(stream, a, b) for a, b in rg.caption_spans(sets)}
        rows += [(stream, f, c, True) for f, s in enumerate(sets) for c in s]
    rows += [(None, f, c, True) for f in range(238, 242) for c in range(5)]
    df = spark.createDataFrame(rows, "stream long, frame long, cell long, fit boolean")
    got = [tuple(r) for r in rg.span_table(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected | {(None, 0, 242)}


def test_selection_does_not_depend_on_runs(spark):
    # Lasting cells of the whole stream fill frames of a run in which they are rare.
    rows = [(s, f, 18 * 40 + x, False) for s in ("s", None) for f in [*range(200), 400, 479] for x in range(8, 20)]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fit boolean")
    whole = sorted(map(str, rg.temporal_selection(df, 40, 20, run=10**6).collect()))
    assert len(whole) == len(rows)
    assert all(sorted(map(str, rg.temporal_selection(df, 40, 20, run=run).collect())) == whole for run in (240, 7))


def test_ogg_round_trip_and_faults():
    run = au.Run([bytes([31 << 3]) + bytes(n) for n in (3, 254, 255, 600)], 100, 50)
    raw = ogg.write_opus(run)
    assert ogg.read_opus(raw) == run
    for bad in (raw[:-1], raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], raw[60:], b""):
        with pytest.raises(FormatError):
            ogg.read_opus(bad)


GLYPHS = np.random.default_rng(1).integers(0, 256, (64, 16), dtype=np.uint8)
PALETTE = np.array([[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 0, 255]], np.uint8)


def test_rate_distortion_choices(spark):
    rng = np.random.default_rng(3)
    scenes = [rng.integers(0, 256, (32, 32, 4), dtype=np.uint8), np.zeros((32, 32, 4), np.uint8)]
    rows = [("s", i, np.ascontiguousarray(scenes[i // 4]).tobytes()) for i in range(8)]
    frames = spark.createDataFrame(rows, "stream string, place long, rgba binary")
    found = rd.analysed(frames, 32, 32, 4, 2, GLYPHS, PALETTE, "quality", 12).orderBy("place").collect()
    assert [r["keyframe"] for r in found] == [True, False, False, False] * 2
    assert {r["group_no"] for r in found} == {0, 1} and all(r["glyph_count"] in (32, 64) for r in found)
    for r in found:
        drawn = ra.render(np.frombuffer(r["state"], np.uint8).reshape(-1, 3), 4, GLYPHS, PALETTE)
        assert abs(rd.distortion(scenes[r["place"] // 4], drawn)[0] - r["distortion"]) < 1e-12
    assert found[4]["distortion"] == 0 and found[4]["psnr"] is None
    total = rd.summary(spark.createDataFrame(found)).first()
    assert total["groups"] == 2 and total["rate_bytes"] == sum(r["rate_bytes"] for r in found)


def test_subset_map_keeps_its_own():
    to = rd.subset_map(GLYPHS, 32)
    assert to[:32].tolist() == list(range(32)) and to.max() < 32


def _plain_spans(sets, least=0.42, shortest=2, sparse=2):
    """The rule by its words: every frame is compared with what its span showed up to the last full frame."""
    starts = [0]
    for i in range(1, len(sets)):
        full = [j for j in range(starts[-1], i) if j == starts[-1] or len(sets[j]) > sparse]
        known = set().union(*sets[starts[-1] : full[-1] + 1])
        both, either = known & sets[i], known | sets[i]
        if min(len(known), len(sets[i])) > sparse and i - starts[-1] >= shortest and len(both) < least * len(either):
            starts.append(i)
    if len(starts) > 1 and len(sets) - starts[-1] < shortest:
        starts.pop()
    return list(zip(starts, [*starts[1:], len(sets)], strict=True))


def test_caption_spans_follow_the_rule():
    rng = random.Random(7)
    for _ in range(300):
        sets, base = [], 0
        for _ in range(rng.randrange(1, 25)):
            base += rng.choice((0, 0, 0, 4, 9))
            sets.append(set(rng.sample(range(base, base + 8), rng.choice((0, 1, 2, 3, 5, 6)))))
        assert rg.caption_spans(sets) == _plain_spans(sets)


def test_short_spans_join_the_more_alike_neighbour():
    a, b, c = {1, 2, 3}, {1, 2, 9}, {7, 8, 9}
    assert rg.without_short([(0, 2), (2, 3), (3, 5)], [a, a, b, c, c], 2) == [(0, 3), (3, 5)]
    assert rg.without_short([(0, 2), (2, 3), (3, 5)], [c, c, b, a, a], 2) == [(0, 2), (2, 5)]
    assert rg.without_short([(0, 1), (1, 2), (2, 3)], [a, b, c], 3) == [(0, 3)]
    assert rg.without_short([(0, 2), (2, 3), (3, 5)], [a, a, {5}, c, c], 2) == [(0, 3), (3, 5)]  # the left one among equals
    assert rg.without_short([(0, 1)], [a], 2) == [(0, 1)]
