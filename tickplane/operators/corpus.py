"""Synthetic streams of grid cells: named patterns as layers of painted rectangles.

A pattern is a list of layers; a layer says, in column expressions of x, y and
the frame number, where it paints and which glyph and colors.  The last layer
that paints a cell wins.  So a corpus is one projection over (entry, frame,
cell) rows and is made wherever they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GLYPHS = 64
WORD = (1 << 32) - 1
#: Fixed value: how far the seeds of two neighbouring frames are apart.
FRAME_STEP = 0x9E3779B9
#: Specks of grain, and draws that each takes.
SPECKS, DRAWS = 8, 3

Cell = tuple[Column, Column, Column]


def xorshift32(state: Column) -> Column:
    """The next state of a 32-bit xorshift generator (13, 17, 5) held in a long."""
    word = F.lit(WORD)
    state = state.bitwiseXOR(F.shiftleft(state, 13)).bitwiseAND(word)
    state = state.bitwiseXOR(F.shiftrightunsigned(state, 17))
    return state.bitwiseXOR(F.shiftleft(state, 5)).bitwiseAND(word)


def draws(seed: Column, n: int) -> Column:
    """The generator's next n states after ``seed``, as an array of longs."""
    start = F.struct(seed.cast("long").alias("state"), F.array().cast("array<bigint>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        after = xorshift32(acc["state"])
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(after)).alias("seen"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["seen"])


@dataclass
class Place:
    """What layers are made from: cell, frame, grid and palette depth, and the frame's random states."""

    x: Column
    y: Column
    frame: Column
    columns: Column
    rows: Column
    depth: Column
    random: Column

    def color(self, n: Column | int) -> Column:
        return F.pmod(F.lit(n) if isinstance(n, int) else n, self.depth)

    def box(self, left, top, width, height) -> Column:
        return (self.x >= left) & (self.x < left + width) & (self.y >= top) & (self.y < top + height)

    def at(self, x, y) -> Column:
        return (self.x == x) & (self.y == y)

    def fraction(self, i: int) -> Column:
        return self.random[i] / float(1 << 32)


Layer = tuple[Column, Cell]
#: The patterns' layers.  Glyphs, colors and places are the format's own numbers.
Pattern = Callable[[Place], list[Layer]]


def _half(n: Column) -> Column:
    return F.floor(n / 2)


def _face(p: Place, shift: Column, caption: bool) -> list[Layer]:
    left, c = _half(p.columns) - 3 + shift, p.color
    layers = [(p.box(left, 1, 6, 5), (F.lit(12), c(6), c(1)))]
    layers += [(p.at(left + i, 2), (F.lit(33), c(1), c(6))) for i in (1, 4)]
    layers += [(p.at(left + i, 4), (18 + p.frame % 4, c(1), c(6))) for i in (2, 3)]
    if caption:
        layers.append((p.box(2, p.rows - 2, p.columns - 4, 2), (F.lit(4), c(3), c(1))))
    return layers


def _dark(p: Place) -> list[Layer]:
    left = F.floor(p.frame / 3) % (p.columns + 6) - 3
    return [(p.box(left, 2, 4, p.rows - 2), (F.lit(8), F.lit(1), F.lit(0))), (p.x == p.columns - 1 - p.y, (F.lit(2), p.color(2), F.lit(0)))]


def _rapid(p: Place) -> list[Layer]:
    left = p.frame * 3 % (p.columns + 8) - 4
    return [(p.box(left, 1, 7, p.rows - 2), (48 + p.frame % 4, p.color(12), p.color(2))), (p.box(p.columns - left - 3, 3, 3, 3), (F.lit(7), p.color(5), p.color(1)))]


def _flat(p: Place) -> list[Layer]:
    left = 3 + F.floor((p.columns - 8) * (1 + F.sin(p.frame / 4)) / 2)
    return [(p.box(1, 1, _half(p.columns), p.rows - 2), (F.lit(1), p.color(3), p.color(2))), (p.box(left, 2, 4, 4), (F.lit(32), p.color(7), p.color(4)))]


def _depth(p: Place) -> list[Layer]:
    band = F.floor((p.x + p.y * 2 + p.frame) / 3)
    return [(F.lit(True), (band * 7 % GLYPHS, p.color(band), p.color(band + 3)))]


def _grain(p: Place) -> list[Layer]:
    centre = F.floor(_exact(p.columns / 2) + F.sin(p.frame / 3) * p.columns / 4)
    layers = [(p.box(centre - 2, 1, 5, p.rows - 1), (F.lit(63), F.lit(1), F.lit(0)))]
    for i in range(0, SPECKS * DRAWS, DRAWS):
        place = p.at(F.floor(p.fraction(i) * p.columns), F.floor(p.fraction(i + 1) * p.rows))
        layers.append((place, (F.when(p.fraction(i + 2) > 0.5, 1).otherwise(0), F.lit(1), F.lit(0))))
    return layers


def _exact(n: Column) -> Column:
    return n.cast("double")


def _pulse(p: Place) -> list[Layer]:
    scene, pulse = F.floor(p.frame / 6), (p.x + p.y + p.frame * 2) % 6
    return [(F.lit(True), ((scene * 13 + pulse * 7) % GLYPHS, p.color(scene * 3 + pulse + 1), p.color(scene * 5 + p.x)))]


def _screen(p: Place) -> list[Layer]:
    lines = (p.y >= 2) & (p.y < p.rows - 1) & (p.y % 2 == 0) & (p.x >= 7) & (p.x < p.columns - 2)
    return [
        (p.box(0, 0, p.columns, 1), (F.lit(4), p.color(7), p.color(1))), (p.box(0, 1, 5, p.rows - 1), (F.lit(1), p.color(3), p.color(2))),
        (lines, (10 + (p.x + p.y) % 20, p.color(6), F.lit(0))), (p.at(7 + p.frame % (p.columns - 9), 3), (F.lit(63), p.color(7), F.lit(0))),
    ]


def _captioned(p: Place) -> list[Layer]:
    caption, last = F.floor(p.frame / 8), p.rows - 2
    words = (p.y == last) & (p.x >= 4) & (p.x < p.columns - 4)
    return [
        (p.box(2 + p.frame % 6, 1, 7, 4), (F.lit(14), p.color(4), p.color(1))), (p.box(2, last, p.columns - 4, 1), (F.lit(0), p.color(7), F.lit(0))),
        (words, (10 + (p.x + caption * 7) % 40, p.color(7), F.lit(0))),
    ]


def _saturated(p: Place) -> list[Layer]:
    color = p.color(p.x * 3 + p.y * 5 + p.frame)
    return [(F.lit(True), ((p.x * 5 + p.y * 11 + p.frame) % GLYPHS, color, p.color(color + 7)))]


#: The patterns' names.
PATTERNS: dict[str, Pattern] = {
    "dialogue-face": lambda p: _face(p, F.when(p.frame % 12 >= 8, 1).otherwise(0), False),
    "static-lecture": lambda p: _face(p, F.lit(0), True),
    "dark-cinematography": _dark,
    "rapid-motion": _rapid,
    "flat-animation": _flat,
    "depth-animation": _depth,
    "monochrome-film": _grain,
    "music-video": _pulse,
    "screen-capture": _screen,
    "subtitles": _captioned,
    "saturated-material": _saturated,
}


def manifest_faults(entries: DataFrame, classes: list[str], cadences: list[str], depths: tuple[int, ...], most: tuple[int, int, int]) -> DataFrame:
    """(id, rule) of entries (id, structural_class, generator, seed, columns, rows, depth, cadence, frames) that break a rule.

    Classes that no entry has come as rows of rule ``class missing``, without an id.
    """
    most_columns, most_rows, most_cells = most
    c = F.col
    rules = {
        "id": ~c("id").rlike("^[a-z0-9][a-z0-9-]{2,63}$"), "duplicate": c("__same") > 1, "class": ~c("structural_class").isin(*classes),
        "generator": ~c("generator").isin(*PATTERNS), "seed": ~c("seed").between(1, WORD),
        "grid": ~(c("columns").between(1, most_columns) & c("rows").between(1, most_rows) & (c("columns") * c("rows") <= most_cells)), "depth": ~c("depth").isin(*depths),
        "cadence": ~c("cadence").isin(*cadences), "frames": ~c("frames").between(2, 3600),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    found = entries.withColumn("__same", F.count("*").over(Window.partitionBy("id"))).select("id", F.explode(broken).alias("rule"))
    have = entries.select(F.col("structural_class").alias("k")).distinct()
    wanted = entries.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("k"))
    return found.unionByName(wanted.join(have, "k", "left_anti").select(F.col("k").alias("id"), F.lit("class missing").alias("rule")))


def corpus_cells(entries: DataFrame) -> DataFrame:
    """(id, frame, cell, glyph, fore, back) of entries (id, generator, seed, columns, rows, depth, frames).

    A frame's random states are made once for the frame, before its cells are.
    """
    frames = entries.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1)))
    seed = (F.col("seed") + F.col("frame") * FRAME_STEP).bitwiseAND(F.lit(WORD))
    frames = frames.withColumn("random", F.when(F.col("generator") == "monochrome-film", draws(seed, SPECKS * DRAWS)))
    cells = frames.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("columns") * F.col("rows")).cast("long") - 1)))
    wide = F.col("columns").cast("long")
    place = Place(F.col("cell") % wide, F.floor(F.col("cell") / wide), F.col("frame"), wide, F.col("rows").cast("long"), F.col("depth").cast("long"), F.col("random"))
    parts = [F.lit(0).cast("long")] * 3
    for name, pattern in PATTERNS.items():
        own = [F.lit(0).cast("long")] * 3
        for where, cell in pattern(place):
            own = [F.when(where, new.cast("long")).otherwise(old) for new, old in zip(cell, own, strict=True)]
        parts = [F.when(F.col("generator") == name, new).otherwise(old) for new, old in zip(own, parts, strict=True)]
    return cells.select("id", "frame", "cell", *(p.alias(n) for p, n in zip(parts, ("glyph", "fore", "back"), strict=True)))


def corpus_states(cells: DataFrame) -> DataFrame:
    """(path, place, state) of such cells: each frame's bytes in the order of its cells."""
    byte = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    listed = F.array_sort(F.collect_list(F.struct("cell", F.concat(byte("glyph"), byte("fore"), byte("back")).alias("h"))))
    whole = cells.groupBy("id", "frame").agg(listed.alias("l"))
    return whole.select(F.col("id").alias("path"), F.col("frame").alias("place"), F.unhex(F.array_join(F.transform("l", lambda x: x["h"]), "")).alias("state"))
