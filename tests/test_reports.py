"""Reports, validation and generators that have no SQL form, against plain Python."""

import random
import zlib

import numpy as np
import pytest

from tickplane.functions import grid_codec as gc
from tickplane.functions import palette as pal
from tickplane.functions import raster as ra
from tickplane.operators import cells as ce
from tickplane.operators import command_reports as cr
from tickplane.operators import codec, corpus, planes, reports
from tickplane.operators import measures as ms

COLUMNS, DEPTH, INTERVAL = 6, 16, 5


def _frames(seed=1, n=17, cells=24):
    rng = random.Random(seed)
    state = np.zeros((cells, 3), np.uint8)
    out = []
    for _ in range(n):
        if rng.random() < 0.7:
            at = rng.randrange(cells - 3)
            state = state.copy()
            state[at : at + rng.randrange(1, 4)] = (rng.randrange(64), rng.randrange(16), rng.randrange(16))
        out.append(state)
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(path, i, bytes(s.tobytes())) for path, seed in (("a", 1), ("b", 2)) for i, s in enumerate(_frames(seed))]
    return spark.createDataFrame(rows, "path string, place long, state binary").cache()


def _coded(seed, interval=INTERVAL):
    """(group, kind, plain, packed) of each frame, made one by one."""
    out = []
    for i, s in enumerate(states := _frames(seed)):
        before = None if i % interval == 0 else states[i - 1]
        if before is not None and (before == s).all():
            out.append((i // interval, 2, b"", b""))
        else:
            out.append((i // interval, int(before is not None), gc.plain_encode(s, before, COLUMNS, DEPTH), gc.packed_encode(gc.packed_plan(s, before, DEPTH), DEPTH)))
    return out


def test_histogram_counts_commands_and_cells(frames):
    got = {(r["path"], r["grammar"], r["command"]): (r["commands"], r["cells"]) for r in cr.command_histogram(frames, COLUMNS, DEPTH, INTERVAL).collect()}
    for path, seed in (("a", 1), ("b", 2)):
        coded = [c for c in _coded(seed) if c[1] != 2]
        assert got[path, "plain", "end"] == got[path, "packed", "end"] == (len(coded), 0)
        assert sum(n for (p, g, _), (_, n) in got.items() if (p, g) == (path, "packed")) == 24 * len(coded)
        fills = [op for c in coded for op, *_ in gc.plain_commands(c[2], 24, COLUMNS, DEPTH)]
        assert {c: n for (p, g, c), (n, _) in got.items() if (p, g) == (path, "plain")} == {cr.PLAIN[o]: fills.count(o) for o in set(fills)}


def test_accounts_make_the_whole(frames):
    for r in cr.command_accounts(frames, COLUMNS, DEPTH, INTERVAL).collect():
        coded = [c for c in _coded(1 if r["path"] == "a" else 2) if c[1] != 2]
        assert r["balanced"] and r["total_bytes"] == sum(len(c[3]) for c in coded) == r["opcode_bytes"] + r["count_bytes"] + r["payload_bytes"]


def test_backends_by_frame_and_group(frames):
    deflate = lambda raw: (lambda e: len(e.compress(raw) + e.flush()))(zlib.compressobj(9, zlib.DEFLATED, -15))
    rows = cr.backend_matrix(frames, COLUMNS, DEPTH, INTERVAL).collect()
    assert all(r["exact"] for r in rows) and {r["backend"] for r in rows} >= {"deflate", "selective", "huffman"}
    got = {(r["path"], r["grammar"], r["scope"], r["backend"]): (r["units"], r["input_bytes"], r["bytes"]) for r in rows}
    for which, grammar in ((2, "plain"), (3, "packed")):
        coded = [c for c in _coded(1) if c[1] != 2]
        parts = [bytes([c[1]]) + c[which] for c in coded]
        assert got["a", grammar, "frame", "deflate"] == (len(parts), sum(map(len, parts)), sum(map(deflate, parts)))
        assert got["a", grammar, "frame", "selective"][2] == sum(deflate(p) if deflate(p) + 8 < len(p) else len(p) for p in parts)
        groups = {}
        for c in coded:
            groups[c[0]] = groups.get(c[0], b"") + bytes([c[1]]) + len(c[which]).to_bytes(4, "little") + c[which]
        assert got["a", grammar, "group", "deflate"] == (len(groups), sum(map(len, groups.values())), sum(map(deflate, groups.values())))


def test_group_sweep_cuts_by_time(frames):
    got = {(r["path"], r["seconds"]): r for r in cr.group_sweep(frames, COLUMNS, DEPTH, 3, [1, 2.1]).collect()}  # three frames a second
    for seconds, size in ((1.0, 3), (2.1, 7)):
        coded, r = _coded(1, size), got["a", seconds]
        assert (r["groups"], r["frames"], r["repeat_frames"]) == (-(-17 // size), 17, sum(c[1] == 2 for c in coded))
        assert r["command_bytes"] == sum(len(c[3]) for c in coded)


def test_group_sweep_parses_once_for_lengths_that_divide_each_other(spark, frames, monkeypatch):
    from tickplane.functions.bits import huffman_encode

    def alone(*_):
        raise AssertionError("a state was parsed by itself")

    deflate = lambda raw: (lambda e: len(e.compress(raw) + e.flush()))(zlib.compressobj(9, zlib.DEFLATED, -15))
    expected = {}
    for path, seed in (("a", 1), ("b", 2)):
        for seconds, size in ((1.0, 3), (2.0, 6), (2.1, 7)):
            groups = {}
            for group, kind, _, packed in _coded(seed, size):
                groups[group] = groups.get(group, b"") + bytes([kind]) + len(packed).to_bytes(4, "little") + packed
            sizes = [(len(g), deflate(g), len(huffman_encode(g))) for g in groups.values()]
            expected[path, seconds] = (len(groups), *map(sum, zip(*sizes, strict=True)))
    found = cr.group_sweep(frames, COLUMNS, DEPTH, 3, [1, 2, 2.1]).collect()
    assert {(r["path"], r["seconds"]): (r["groups"], r["group_bytes"], r["deflate_bytes"], r["huffman_bytes"]) for r in found} == expected
    # The work is done on many states at once.
    kept = {}
    monkeypatch.setattr(cr, "in_groups", lambda rows, keys, run, schema: kept.setdefault("rows", (rows, run)) and spark.createDataFrame([], schema))
    monkeypatch.setattr(gc, "packed_plan", alone)
    cr.group_sweep(frames, COLUMNS, DEPTH, 3, [1, 2])
    rows, run = kept["rows"]
    table = rows.orderBy("path", "block", "group_no", "place").toArrow()
    assert run(table, codec.state_array(table["state"])).num_rows == 2 * (6 + 3) and table.num_rows == 34


def test_backends_agree_with_units_one_by_one(frames):
    from tickplane.functions.bits import huffman_encode

    got = {(r["path"], r["grammar"], r["scope"], r["backend"]): (r["units"], r["input_bytes"], r["bytes"]) for r in cr.backend_matrix(frames, COLUMNS, DEPTH, INTERVAL).collect()}
    for path, seed in (("a", 1), ("b", 2)):
        for which, grammar in ((2, "plain"), (3, "packed")):
            groups, units = {}, []
            for c in (c for c in _coded(seed) if c[1] != 2):
                units.append(bytes([c[1]]) + c[which])
                groups[c[0]] = groups.get(c[0], b"") + bytes([c[1]]) + len(c[which]).to_bytes(4, "little") + c[which]
            for scope, parts in (("frame", units), ("group", list(groups.values()))):
                assert got[path, grammar, scope, "huffman"] == (len(parts), sum(map(len, parts)), sum(len(huffman_encode(p)) for p in parts))


def test_farthest_palette():
    colors = pal.farthest_palette(24)
    assert [tuple(c) for c in colors[:16].tolist()] == list(pal.SEEDS) and len({tuple(c) for c in colors.tolist()}) == 24
    scale = np.array([pal.LIGHTNESS, 1, 1])
    axis = range(0, 256, 17)
    grid = [(r, g, b) for r in axis for g in axis for b in axis]
    lab = pal.oklab(np.array(grid)) * scale
    for i in range(16, 24):
        near = ((lab[:, None] - pal.oklab(colors[:i].astype(int)) * scale) ** 2).sum(2).min(1)
        near[[c in {tuple(x) for x in colors[:i].tolist()} for c in grid]] = -1
        best = sorted((c for c, d in zip(grid, near, strict=True) if d >= near.max() - 1e-15), key=lambda c: ",".join(map(str, c)))
        assert tuple(colors[i].tolist()) == best[0]


def test_masks_are_taken_out_again():
    rng = np.random.default_rng(2)
    columns, rows = 5, 4
    palette = np.array([[0, 0, 0], [255, 255, 255], [200, 30, 30], [20, 40, 90]], np.uint8)
    frame = np.zeros((rows * 16, columns * 8, 4), np.uint8)
    frame[..., 3], frame[..., :3] = 255, palette[3]
    entries = []
    for cell in (2, 11, 13, 19):
        bits = np.zeros((16, 8), np.uint8)
        bits[4:9, 2:6] = rng.random((5, 4)) < 0.7
        entries.append((cell, 1, 3, np.packbits(bits, axis=1).tobytes()))
    drawn = ra.overlay(frame, columns, entries, palette)
    assert ra.extract_masks(drawn, columns, rows, palette) == [e for e in entries if e[0] >= int(rows * 0.58) * columns]
    assert ra.extract_masks(frame, columns, rows, palette) == [] and len(ra.extract_masks(drawn, columns, rows, palette, band=0)) == 4
    with pytest.raises(ValueError):
        ra.extract_masks(drawn, columns, rows + 1, palette)


def test_atlas_and_side_by_side():
    glyphs = np.random.default_rng(1).integers(0, 256, (64, 16), dtype=np.uint8)
    palette = np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    sheet = ra.atlas(glyphs, palette, scale=3)
    assert sheet.shape == (8 * 16 * 3, 8 * 8 * 3, 4)
    bits = ra.mask_bits(glyphs)
    for g, y, x in ((0, 0, 0), (9, 5, 7), (63, 15, 3)):
        assert sheet[(g // 8 * 16 + y) * 3 + 2, (g % 8 * 8 + x) * 3 + 1, 0] == 255 * bits[g, y, x]
    both = ra.beside(sheet, sheet[:, :10], 4)
    assert both.shape[1] == sheet.shape[1] + 14 and (both[:, sheet.shape[1] : sheet.shape[1] + 4] == [0, 0, 0, 255]).all()


def test_output_names_do_not_collide(spark):
    rows = [(0, "d/a.mp4"), (1, "d/a.mkv"), (2, "d/a.x.avi"), (3, "e/a.mp4"), (4, "d/b.out"), (5, "d/a.2.mp4"), (6, "plain"), (7, "d/a")]
    wanted = spark.createDataFrame(rows, "n int, path string").select("n", reports.suggested_name(__import__("pyspark.sql.functions", fromlist=["col"]).col("path"), ".out").alias("path"))
    taken = spark.createDataFrame([("e/a.out",)], "path string")
    got = {r["n"]: r["output"] for r in reports.distinct_names(wanted, ["n"], "path", taken).collect()}
    assert got == {0: "d/a.out", 1: "d/a.2.out", 2: "d/a.x.out", 3: "e/a.2.out", 4: "d/b.encoded.out", 5: "d/a.2.2.out", 6: "plain.out", 7: "d/a.3.out"}


def test_a_name_that_is_only_an_extension_is_numbered_before_it(spark):
    wanted = spark.createDataFrame([(i, "h/.out") for i in range(3)] + [(3, "h/a.out"), (4, "h/a.out")], "n int, path string")
    got = {r["n"]: r["output"] for r in reports.distinct_names(wanted, ["n"], "path", extension=".out").collect()}
    assert got == {0: "h/.out", 1: "h/.2.out", 2: "h/.3.out", 3: "h/a.out", 4: "h/a.2.out"}


def test_ranks_are_exact_on_ties_and_odd_groups(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    values = {"hot": [rng.choice((1.0, 2.0, 2.5, 9.0)) if rng.random() < 0.8 else rng.random() * 50 for _ in range(3000)], "one": [4.0], "two": [3.0, 8.0], "none": [None, None]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = {"a": F.lit(1), "b": F.ceil(F.lit(0.37) * F.col("n")), "c": F.col("n"), "d": F.col("n") + 1}
    for r in ms.at_ranks(df, ["k"], "v", ranks, 8).collect():
        known = sorted(v for v in values[r["k"]] if v is not None)
        at = lambda i: known[i - 1] if 0 < i <= len(known) else None  # noqa: E731, B023
        assert (r["a"], r["b"], r["c"], r["d"]) == (at(1), at(int(np.ceil(0.37 * len(known)))), at(len(known)), None)
    got = {r["k"]: r["median"] for r in ms.classic_median(df, ["k"], "v").collect()}
    assert got["one"] == 4 and got["two"] == 6 and got["none"] is None


def test_components_by_frame_agree_with_those_of_a_graph(spark):
    rng = random.Random(3)
    cells = [(f, rng.randrange(12), rng.randrange(30)) for f in range(4) for _ in range(60)]
    df = spark.createDataFrame(cells, "f int, y long, x long")
    got = sorted(map(tuple, ce.grid_components(df, ["f"], "y", "x", 1).collect()))
    one = sorted(tuple(r) for r in ce.graph_components(df.where("f = 2"), "y", "x", 1).select("y", "x", "component").collect())
    assert [g[1:] for g in got if g[0] == 2] == one


def test_components_cross_column_zero(spark):
    cells = [(0, 7, -1), (0, 7, 0), (0, 8, 1), (0, 14, -1), (0, 15, 0), (0, 3, None), (1, -2, -9), (1, -2, -7), (1, -3, -8), (1, 4, 2)]
    df = spark.createDataFrame(cells, "f int, y long, x long")
    got = {(f, y, x): c for f, y, x, c in map(tuple, ce.grid_components(df, ["f"], "y", "x").collect())}
    at = lambda y, x: y * ce.WIDE + x
    one, two, low = at(7, -1), at(14, -1), at(-3, -8)
    assert got == {(0, 7, -1): one, (0, 7, 0): one, (0, 8, 1): one, (0, 14, -1): two, (0, 15, 0): two, (1, -2, -9): low, (1, -2, -7): low, (1, -3, -8): low, (1, 4, 2): at(4, 2)}


def test_boxes_reach_over_column_zero(spark):
    df = spark.createDataFrame([(0, 7, -1), (0, 7, 0), (0, 7, 1), (0, 8, 0)], "f int, y long, x long")
    (box,) = ce.boxes(ce.grid_components(df, ["f"], "y", "x"), ["component"], "y", "x").collect()
    assert tuple(box) == (7 * ce.WIDE - 1, 7, 8, -1, 1, 4, 2, 3, round(4 / 6, 6))


def test_corpus_face_and_grain(spark):
    entries = [("g", "monochrome-film", 7, 20, 9, 16, 3), ("f", "static-lecture", 7, 20, 9, 16, 2)]
    df = spark.createDataFrame(entries, "id string, generator string, seed long, columns int, rows int, depth int, frames int")
    got = {(r["id"], r["frame"], r["cell"]): (r["glyph"], r["fore"], r["back"]) for r in corpus.corpus_cells(df).collect()}
    for frame in range(3):
        state, seen = (7 + frame * corpus.FRAME_STEP) & corpus.WORD, []
        for _ in range(24):
            state ^= state << 13 & corpus.WORD
            state ^= state >> 17
            state ^= state << 5 & corpus.WORD
            seen.append(state / 2**32)
        want, centre = {}, int(np.floor(10 + np.sin(frame / 3) * 5))
        want |= {y * 20 + x: (63, 1, 0) for y in range(1, 9) for x in range(centre - 2, centre + 3)}
        for i in range(0, 24, 3):
            want[int(seen[i + 1] * 9) * 20 + int(seen[i] * 20)] = (int(seen[i + 2] > 0.5), 1, 0)
        assert {c: got["g", frame, c] for c in range(180)} == {c: want.get(c, (0, 0, 0)) for c in range(180)}
    assert got["f", 1, 2 * 20 + 8] == (33, 1, 6) and got["f", 1, 4 * 20 + 9] == (19, 1, 6) and got["f", 0, 8 * 20 + 2] == (4, 3, 1) and got["f", 0, 1 * 20 + 7] == (12, 6, 1)


def test_span_planes_are_those_of_the_span(spark):
    mask = bytes(range(16))
    rows = [("s", f, 5, 1, 2, mask) for f in range(4)] + [("s", f, 9, 3, 4, mask) for f in range(4, 8)] + [("s", 4, 5, 7, 7, mask)]
    df = spark.createDataFrame(rows, "stream string, frame long, cell long, fore int, back int, mask binary")
    spans = spark.createDataFrame([("s", 0, 4), ("s", 4, 8)], "stream string, start long, end long")
    got = sorted((r["start"], r["cell"], r["fore"], r["back"], bytes(r["mask"])) for r in planes.span_consensus(df, spans, frame_share=0.5).collect())
    assert got == [(0, 5, 1, 2, mask), (4, 9, 3, 4, mask)]


def test_manifests_are_read_with_their_schema(spark, tmp_path):
    import json

    from tickplane.sources import manifest

    entry = {"id": "a-1", "structuralClass": "x", "generator": "rapid-motion", "seed": 7, "grid": {"columns": 20, "rows": 9}, "paletteDepth": 16, "cadence": "24", "frames": 3, "provenance": {"license": "CC0-1.0"}}
    (tmp_path / "good.json").write_text(json.dumps({"format": "m-1", "title": "more", "entries": [entry, {"id": "b"}]}, indent=1))
    (tmp_path / "bad.json").write_text("no json")
    read = manifest.read_manifests(spark, str(tmp_path))
    assert read.where("m.entries is null").count() == 1
    got = {r["id"]: r for r in manifest.manifest_entries(read).collect()}
    assert (got["a-1"]["columns"], got["a-1"]["depth"], got["a-1"]["license"]) == (20, 16, "CC0-1.0") and got["b"]["seed"] is None


def test_cells_are_remapped_to_a_subset():
    from tickplane.operators import rate_distortion as rd

    masks = np.random.default_rng(4).integers(0, 256, (64, 16), dtype=np.uint8)
    to = rd.subset_map(masks, 16)
    state = np.array([[3, 1, 2], [40, 0, 1], [63, 2, 0]], np.uint8)
    got = rd.remapped(state, to)
    bits = ra.mask_bits(masks).reshape(64, -1)
    for before, after in zip(state, got, strict=True):
        far = [(int((bits[before[0]] != bits[c]).sum()), c) for c in range(16)]
        assert after[0] == min(far)[1] and (after[1:] == before[1:]).all()
    with pytest.raises(ValueError):
        rd.remapped(state, to[:40])
