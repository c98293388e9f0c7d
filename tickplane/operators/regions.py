"""Caption regions in sparse planes: by frame, over time, and by span."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.schema import struct

BAND = 0.62
OVERLAP = 0.7


def components(cells: np.ndarray, columns: int, gap: int) -> np.ndarray:
    """A label for each distinct cell: the least cell of its component.

    Neighbours are at most one row and gap + 1 columns apart.  Labels spread by
    minima until nothing changes.
    """
    cells = np.asarray(cells, np.int64)
    order = np.argsort(cells)
    known = cells[order]
    y, x = known // columns, known % columns
    labels = known.copy()
    links = []
    for dy in (0, 1):
        for dx in range(-(gap + 1), gap + 2):
            ok = (x + dx >= 0) & (x + dx < columns)
            other = known + dy * columns + dx
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            hit = np.flatnonzero(ok & (known[at] == other)) if len(known) else at
            links.append((hit, at[hit]))
    a, b = np.concatenate([p for p, _ in links]), np.concatenate([q for _, q in links])
    while True:
        low = np.minimum(labels[a], labels[b])
        after = labels.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[np.searchsorted(known, after)]
        if np.array_equal(after, labels):
            break
        labels = after
    out = np.empty_like(labels)
    out[order] = labels
    return out


def least_width(columns: int) -> int:
    return max(6, math.ceil(columns * 0.12))


def most_height(rows: int) -> int:
    return max(3, math.ceil(rows * 0.18))


def frame_selection(cells: np.ndarray, fit: np.ndarray, columns: int, rows: int, gap: int = 2) -> np.ndarray:
    """Which cells of a frame lie in a wide, low component of fit cells of the lower band."""
    keep = np.zeros(len(cells), bool)
    at = np.flatnonzero(fit & (cells // columns >= math.floor(rows * BAND)))
    if not len(at):
        return keep
    labels = components(cells[at], columns, gap)
    for label in np.unique(labels):
        own = at[labels == label]
        x, y = cells[own] % columns, cells[own] // columns
        if len(own) >= 3 and np.ptp(x) + 1 >= least_width(columns) and np.ptp(y) + 1 <= most_height(rows):
            keep[own] = True
    return keep


#: Fixed values of a region's score: what fill and centring are counted from.
FILL_BASE, CENTRE_BASE = 0.5, 0.75


def measured(group: np.ndarray, cells: np.ndarray, weight: np.ndarray, columns: int, rows: int) -> pd.DataFrame:
    """Box, size and score of each group of cells, by group number.

    The score is the weight that the group's cells have in all, times its width
    over its height, and more for groups that are low, fill their columns and
    stand in the middle.
    """
    table = pd.DataFrame({"group": group, "cell": cells, "weight": weight, "x": cells % columns, "y": cells // columns})
    out = table.groupby("group").agg(
        left=("x", "min"), right=("x", "max"), top=("y", "min"), bottom=("y", "max"), n=("cell", "size"), first=("cell", "min"), used=("x", "nunique"), weight=("weight", "sum")
    )
    out["width"], out["height"] = out.right - out.left + 1, out.bottom - out.top + 1
    low = 1 + out.bottom / max(1, rows - 1)
    fill = FILL_BASE + out.used / out.width
    centre = CENTRE_BASE + 1 - ((out.left + out.right) / 2 - (columns - 1) / 2).abs() / columns
    return out.assign(score=out.weight * out.width * low * fill * centre / out.height)


def ranked_boxes(support: dict[int, int], columns: int, rows: int, persistence: int, gap: int = 3, most: int = 2, grow: int = 1) -> list[tuple[int, int, int, int]]:
    """At most ``most`` boxes (left, right, top, bottom) of cells that last, the best first.

    Candidates are components of lasting cells and bands of rows; a box that
    overlaps a better one by OVERLAP of the smaller is left out.
    """
    first = math.floor(rows * BAND)
    lasting = np.array(sorted(c for c, n in support.items() if n >= persistence and c // columns >= first), np.int64)
    if not len(lasting):
        return []
    weight = np.array([support[int(c)] for c in lasting])
    parts = measured(components(lasting, columns, gap), lasting, weight, columns, rows)
    parts = parts[(parts.n >= 3) & (parts.width >= least_width(columns)) & (parts.height <= most_height(rows))]
    # A cell is in every band that holds its row; a band's number is its top and height.
    tall = most_height(rows)
    top, height = (x.ravel() for x in np.meshgrid(np.arange(first, rows), np.arange(1, tall + 1), indexing="ij"))
    inside = (top + height <= rows) & (lasting[:, None] // columns >= top) & (lasting[:, None] // columns < top + height)
    cell, band = np.nonzero(inside)
    bands = measured(band, lasting[cell], weight[cell], columns, rows)
    bands = bands[(bands.n >= 3) & (bands.width >= least_width(columns)) & (bands.used >= max(4, math.ceil(least_width(columns) * 0.65)))]
    ranked = pd.concat([parts, bands]).sort_values(["score", "width", "first"], ascending=[False, False, True], kind="stable")
    return _apart([(max(0, r.left - grow), min(columns - 1, r.right + grow), r.top, r.bottom) for r in ranked.itertuples()], most)


def _apart(boxes: list[tuple[int, int, int, int]], most: int) -> list[tuple[int, int, int, int]]:
    """The first ``most`` boxes of which none lies on an earlier one by OVERLAP of the smaller area or more."""
    kept = np.zeros((0, 4), np.int64)
    for box in boxes:
        both = np.stack([np.maximum(kept[:, 0], box[0]), np.minimum(kept[:, 1], box[1]), np.maximum(kept[:, 2], box[2]), np.minimum(kept[:, 3], box[3])], 1)
        area = lambda b: np.clip(b[:, 1] - b[:, 0] + 1, 0, None) * np.clip(b[:, 3] - b[:, 2] + 1, 0, None)
        if not (area(both) >= OVERLAP * np.minimum(area(kept), area(np.array([box])))).any():
            kept = np.concatenate((kept, [box]))
        if len(kept) == most:
            break
    return [tuple(int(x) for x in b) for b in kept]


def temporal_selection(planes: DataFrame, columns: int, rows: int, fit: str = "fit", run: int = 240, frames: Column | int | None = None) -> DataFrame:
    """(stream, frame, cell) that captions cover.

    A frame's own selection stands if it is not sparse; otherwise its stream's
    boxes fill it with their lasting cells, the best supported first.  Support,
    persistence and boxes are those of the whole stream of ``frames`` frames (by
    default up to its last one with a cell); ``run`` frames are a task's work at
    once, which no result depends on.
    """
    stream = planes.schema["stream"]
    length = F.max("frame") + 1 if frames is None else F.max(frames if isinstance(frames, Column) else F.lit(frames))
    counts = planes.groupBy("stream", "cell").agg(F.countDistinct("frame").alias("support"), length.cast("long").alias("length"))

    def boxed(group: pd.DataFrame) -> pd.DataFrame:
        length = int(group["length"].max())
        support = {int(c): int(n) for c, n in zip(group["cell"], group["support"], strict=True)}
        boxes = ranked_boxes(support, columns, rows, min(length, max(2, math.ceil(length * 0.125))))
        flat = [x for box in boxes for x in box]
        return group[["stream", "cell", "support"]].assign(boxes=[flat] * len(group))

    # A stream has at most a row for each cell of the grid here.
    of = counts.groupBy("stream").applyInPandas(boxed, T.StructType([stream, *struct("cell long, support long"), T.StructField("boxes", T.ArrayType(T.LongType()))]))
    of = of.select(F.col("stream").alias("__stream"), F.col("cell").alias("__cell"), "support", "boxes")

    def select(group: pd.DataFrame) -> pd.DataFrame:
        boxes = np.reshape(np.asarray(group["boxes"].iloc[0], np.int64), (-1, 4))
        floor, most = max(8, math.ceil(columns * 0.14)), columns * 2
        out = []
        for frame, g in group.groupby("frame"):
            cells, support = g["cell"].to_numpy(np.int64), g["support"].to_numpy(np.int64)
            keep = frame_selection(cells, g[fit].to_numpy(bool), columns, rows)
            if len(boxes) and keep.sum() < floor:
                x, y = cells % columns, cells // columns
                inside = np.any([(x >= a) & (x <= b) & (y >= c) & (y <= d) for a, b, c, d in boxes], 0)
                for i in sorted(np.flatnonzero(inside & ~keep), key=lambda i: (-support[i], cells[i])):  # noqa: B023
                    if keep.sum() >= most:
                        break
                    keep[i] = True
            out.append(pd.DataFrame({"frame": frame, "cell": cells[keep]}))
        return pd.concat(out).assign(stream=group["stream"].iloc[0])[["stream", "frame", "cell"]]

    cut = planes.select("stream", "frame", "cell", fit).withColumn("run_no", F.floor(F.col("frame") / run).cast("long"))
    met = cut.join(of, F.col("stream").eqNullSafe(F.col("__stream")) & (F.col("cell") == F.col("__cell"))).drop("__stream", "__cell")
    return met.groupBy("stream", "run_no").applyInPandas(select, T.StructType([stream, *struct("frame long, cell long")]))


def likeness(a: set, b: set) -> float:
    """Shared cells over all cells; 1 for two empty sets."""
    shared = len(a & b)
    joint = len(a) + len(b) - shared
    return shared / joint if joint else 1.0


class Spans:
    """Cuts a stream of frames into spans whose cells belong together, frame by frame.

    A frame opens a span if it is unlike the cells of the span so far, neither
    of them is sparse, and the span has the least length.  So all spans but the
    last are long enough; a short last one joins the one before it, which is why
    one span is held back.  Sparse frames add nothing to what the next frame is
    compared with until a fuller one comes.  Frames without cells change nothing
    and need not be given.
    """

    def __init__(self, least: float, shortest: int, sparse: int):
        self.least, self.shortest, self.sparse = least, shortest, sparse
        self.opened, self.known, self.seen = [0], set(), set()

    def add(self, frame: int, cells: set) -> list[tuple[int, int]]:
        """The spans that are certain after the frame."""
        if frame == 0:
            self.known = self.seen = cells
            return []
        full = min(len(cells), len(self.known)) > self.sparse
        if full and frame - self.opened[-1] >= self.shortest and likeness(self.known, cells) < self.least:
            self.opened.append(frame)
            self.known = self.seen = cells
            if len(self.opened) > 2:
                return [(self.opened.pop(0), self.opened[0])]
            return []
        self.seen = self.seen | cells
        if len(cells) > self.sparse:
            self.known = self.seen
        return []

    def end(self, frames: int) -> list[tuple[int, int]]:
        """The spans still open when the stream has ``frames`` frames."""
        starts = self.opened
        if len(starts) == 2 and frames - starts[1] < self.shortest:
            starts = starts[:1]
        return list(zip(starts, [*starts[1:], frames], strict=True))


def caption_spans(sets: list[set], least: float = 0.42, shortest: int = 2, sparse: int = 2) -> list[tuple[int, int]]:
    """Spans (start, end) of a whole stream, by ``Spans``."""
    state = Spans(least, shortest, sparse)
    return [s for i, cells in enumerate(sets) for s in state.add(i, cells)] + state.end(len(sets))


def without_short(spans: list[tuple[int, int]], sets: list[set], shortest: int) -> list[tuple[int, int]]:
    """Neighbouring spans with the short ones, leftmost first, joined to the neighbour that is more like them.

    The left neighbour wins among equals.  What stands to the left is always long
    enough, so one walk does it.
    """
    done: list[tuple[int, int, set]] = []
    todo = [(start, end, set().union(*sets[start:end])) for start, end in reversed(spans)]
    while todo:
        start, end, cells = todo.pop()
        if end - start >= shortest or not (done or todo):
            done.append((start, end, cells))
        elif todo and (not done or likeness(cells, todo[-1][2]) > likeness(cells, done[-1][2])):
            _, end, more = todo.pop()
            todo.append((start, end, cells | more))
        else:
            start, _, more = done.pop()
            done.append((start, end, cells | more))
    return [(start, end) for start, end, _ in done]


def span_table(planes: DataFrame, frames: Column | int | None = None, least: float = 0.42, shortest: int = 2, sparse: int = 2) -> DataFrame:
    """(stream, start, end) of the caption spans of whole streams.

    A stream has ``frames`` frames, by default up to its last one with a cell.
    Its frames are folded in order, batch by batch; what is kept between them is
    a span's union of cells.
    """
    schema = T.StructType([planes.schema["stream"], *struct("start long, end long")])
    length = F.max("frame") + 1 if frames is None else F.max(frames if isinstance(frames, Column) else F.lit(frames))
    sets = planes.groupBy("stream", "frame").agg(F.collect_set("cell").alias("cells"), length.cast("long").alias("length"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, current, state, length = pa.null(), None, None, 0
        made = lambda found: pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in found], kind), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))], schema.names)
        for batch in batches:
            kind, found = batch.schema.field("stream").type, []
            for row in batch.to_pylist():
                if state is None or row["stream"] != current:
                    found += [(current, *s) for s in state.end(length)] if state else []
                    current, state, length = row["stream"], Spans(least, shortest, sparse), 0
                length = max(length, row["length"])
                found += [(current, *s) for s in state.add(row["frame"], set(row["cells"]))]
            yield made(found)
        if state:
            yield made([(current, *s) for s in state.end(length)])

    return sets.repartition("stream").sortWithinPartitions("stream", "frame").mapInArrow(spans, schema)
