"""Grid cells, sparse planes and small codebooks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.operators.components import connected_components
from tickplane.operators.regions import components

#: A codebook (palette, glyph table) is held by every task; it may have this many rows at most.
CODEBOOK_ROWS = 4096


def _bounded(codes: DataFrame) -> DataFrame:
    """The codebook, checked to be as small as a broadcast side must be."""
    if codes.limit(CODEBOOK_ROWS + 1).count() > CODEBOOK_ROWS:
        raise ValueError(f"a codebook has at most {CODEBOOK_ROWS} rows")
    return F.broadcast(codes)


def nearest_code(rows: DataFrame, vector: str, codes: DataFrame, code: str, code_vector: str, digits: int = 6) -> DataFrame:
    """Adds ``code`` and ``distance``: the nearest code by squared distance, the least among equals.

    The codebook is gathered into one array, so a row meets all codes inside an
    expression and never becomes many rows.  Distances are rounded before they
    are compared.
    """
    book = _bounded(codes).agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), F.col(code_vector).alias("v")))).alias("__book"))

    def squared(c: Column) -> Column:
        return F.aggregate(F.zip_with(F.col(vector), c["v"], lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x)

    met = rows.join(F.broadcast(book))
    best = F.array_min(F.transform("__book", lambda c: F.struct(F.round(squared(c), digits).alias("d"), c["c"].alias("c"))))
    return met.withColumn("__best", best).withColumn(code, F.col("__best.c")).withColumn("distance", F.col("__best.d")).drop("__book", "__best")


def nearest_mask(masks: DataFrame, mask: str, subset: DataFrame, subset_id: str, subset_mask: str) -> DataFrame:
    """Adds the subset member of least Hamming distance, the least id among equals."""
    book = _bounded(subset).agg(F.array_sort(F.collect_list(F.struct(F.col(subset_id).alias("c"), F.col(subset_mask).alias("m")))).alias("__book"))
    far = lambda c: F.bit_count(F.col(mask).bitwiseXOR(c["m"]))
    best = F.array_min(F.transform("__book", lambda c: F.struct(far(c).alias("d"), c["c"].alias("c"))))
    return masks.join(F.broadcast(book)).withColumn("__best", best).select(*masks.columns, F.col("__best.c").alias("nearest"), F.col("__best.d").cast("long").alias("hamming"))


def overlay(base: DataFrame, upper: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Base cells with the upper plane's values where it has the cell."""
    top = upper.select(*key, F.lit(True).alias("__there"), *(F.col(v).alias(f"__{v}") for v in values))
    met = base.join(top, key, "left")
    return met.select(*key, *(F.when(F.col("__there"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values), F.coalesce("__there", F.lit(False)).alias("covered"))


def plane_delta(planes: DataFrame, key: list[str], frame: str, cell: str, values: list[str]) -> DataFrame:
    """(key, frame, cell, change): upserts and removals against the frame before.

    ``frame`` counts from 0 within a key; frame f is met with frame f - 1 moved
    on, in one full outer join on the cell.
    """
    columns = [*key, frame, cell]
    now = planes.select(*columns, F.lit(True).alias("__now"), *values)
    last = planes.groupBy(*key).agg(F.max(frame).alias("__last"))
    before = planes.select(*key, (F.col(frame) + 1).alias(frame), cell, F.lit(True).alias("__old"), *(F.col(v).alias(f"__{v}") for v in values))
    before = before.join(last, key).where(F.col(frame) <= F.col("__last")).drop("__last")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    change = F.when(F.col("__now").isNull(), "remove").when(F.col("__old").isNull() | ~same, "upsert")
    return now.join(before, columns, "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select(*columns, "change")


def component_change(df: DataFrame, key: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """Adds ``change``: which of a cell's parts differ from the row before (``all`` on the first)."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    names = [F.when(~F.col(p).eqNullSafe(F.lag(p).over(w)), F.lit(p)) for p in parts]
    changed = F.concat_ws("+", *names)
    return df.withColumn("change", F.when(first, "all").when(changed == "", "none").otherwise(changed))


#: Cells of a frame are told apart by row-major codes of rows this wide.
WIDE = 1 << 31


def _wide_components(rows: np.ndarray, columns: np.ndarray, gap: int) -> np.ndarray:
    """The least code of each cell's component in a frame that is wider than its codes.

    Empty columns count only as far as they part two cells, so rows don't run into each other.
    """
    known, at = np.unique(columns, return_inverse=True)
    places = np.minimum(np.diff(known, prepend=known[0]), gap + 2).cumsum()
    _, member = np.unique(components(rows * WIDE + places[at], WIDE, gap), return_inverse=True)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, member, rows * WIDE + columns)
    return least[member]


def grid_components(cells: DataFrame, key: list[str], y: str, x: str, gap: int = 0) -> DataFrame:
    """(key, y, x, component) of each frame's distinct cells, by key; neighbours are at most 1 row and gap + 1 columns apart.

    A frame's cells are bounded by its grid, so a frame is one task's work and
    frames are as many tasks as there are.  A component's number is the least of
    its cells' row-major codes; places may be negative, and cells without one are
    left out.
    """
    schema = T.StructType([*(cells.schema[k] for k in key), *(T.StructField(c, T.LongType()) for c in ("y", "x", "component"))])
    nodes = cells.select(*key, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x")).where("y is not null and x is not null").distinct()

    def run(group: pa.Table) -> pa.Table:
        rows, columns = group["y"].to_numpy(), group["x"].to_numpy()
        left = columns.min()  # codes are of columns from 0, or a row's first cells would belong to the row before
        if columns.max() - left < WIDE:
            found = components(rows * WIDE + (columns - left), WIDE, gap) + left
        else:
            found = _wide_components(rows, columns, gap)
        return pa.Table.from_arrays([*(group[k] for k in key), group["y"], group["x"], pa.array(found)], schema.names)

    return nodes.groupBy(*key).applyInArrow(run, schema)


def graph_components(cells: DataFrame, y: str, x: str, gap: int = 0) -> DataFrame:
    """(y, x, component) of one grid of any size.

    Each cell looks its neighbours up by their places, an equi-join of bounded
    fan-out, and the links are contracted by stars.
    """
    code = F.col(y).cast("long") * WIDE + F.col(x).cast("long")
    nodes = cells.select(F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"), code.alias("node")).distinct()
    steps = [(dy, dx) for dy in (0, 1) for dx in range(-(gap + 1), gap + 2) if (dy, dx) > (0, 0)]
    moves = F.array(*[F.lit(dy * WIDE + dx) for dy, dx in steps])
    ahead = nodes.select("node", F.explode(F.transform(moves, lambda m: F.col("node") + m)).alias("other"))
    links = ahead.join(nodes.select(F.col("node").alias("other")), "other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    found = connected_components(links).withColumnRenamed("node", "n")
    return nodes.join(found, nodes["node"] == F.col("n"), "left").select("y", "x", F.coalesce("component", "node").alias("component"))


def boxes(components: DataFrame, key: list[str], y: str, x: str) -> DataFrame:
    """The bounding box, cells, distinct rows and columns, and fill of each component.

    The fill is rounded to 6 digits as SQL rounds a double, scaled first: 41 cells of
    640 are 0.064062, while F.round would take the decimal 0.0640625 up.
    """
    area = (F.max(y) - F.min(y) + 1) * (F.max(x) - F.min(x) + 1)
    return components.groupBy(*key).agg(
        F.min(y).alias("top"), F.max(y).alias("bottom"), F.min(x).alias("left"), F.max(x).alias("right"), F.count("*").alias("cells"),
        F.countDistinct(y).alias("used_rows"), F.countDistinct(x).alias("used_columns"), (F.round(F.count("*") / area * 1e6) / 1e6).alias("fill"),
    )


def support(planes: DataFrame, key: list[str], frame: str, cell: str, least: int) -> DataFrame:
    """Cells that are in at least ``least`` distinct frames of a key."""
    return planes.groupBy(*key, cell).agg(F.countDistinct(frame).alias("support")).where(F.col("support") >= least)


def union_of_cells(planes: DataFrame, key: list[str], cell: str) -> DataFrame:
    """(key, members): the sorted distinct cells of each key, at most a grid's."""
    return planes.groupBy(*key).agg(F.array_sort(F.collect_set(cell)).alias("members"))


def filled(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def jaccard(a: Column, b: Column) -> Column:
    """The similarity of two arrays as sets; 1 for two empty ones."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / joint)
