"""Ordered-stream operators: change, repeat, flicker, continuity, seeking, intervals.

``key`` names the stream, ``order`` the columns that order it (their values must
not tie within a stream), ``value`` the token compared.  All are window plans
with one shuffle by the stream's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def _stream(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def with_change(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``place`` (0-based), ``previous`` and ``changed`` (false on the first row)."""
    w = _stream(key, order)
    out = df.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("previous", F.lag(value).over(w))
    return out.withColumn("changed", (F.col("place") > 0) & ~F.col(value).eqNullSafe(F.col("previous")))


def frame_kind(df: DataFrame, key: list[str], order: list[str], value: str, interval: int) -> DataFrame:
    """KEY each ``interval`` rows, else REPEAT if equal to the row before, else DELTA."""
    kind = F.when(F.col("place") % interval == 0, "KEY").when(F.col("changed"), "DELTA").otherwise("REPEAT")
    return with_change(df, key, order, value).withColumn("kind", kind)


def repeat_spans(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, span, value, first, last, rows): maximal runs of equal tokens."""
    w = _stream(key, order)
    marked = with_change(df, key, order, value).withColumn("span", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(*RUNNING)))
    return marked.groupBy(*key, "span", value).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("rows"))


def stability(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, rows, changes, changed_percent, spans, flickers) of each stream.

    A flicker is a change back to the token of two rows before.
    """
    w = _stream(key, order)
    marked = with_change(df, key, order, value).withColumn("back", F.lag(value, 2).over(w))
    flicker = F.col("changed") & (F.col("place") > 1) & F.col(value).eqNullSafe(F.col("back"))
    changes = F.sum(F.col("changed").cast("long"))
    return marked.groupBy(*key).agg(
        F.count("*").alias("rows"),
        changes.alias("changes"),
        F.round(100 * changes / F.greatest(F.count("*") - 1, F.lit(1)), 6).alias("changed_percent"),
        (changes + 1).alias("spans"),
        F.sum(flicker.cast("long")).alias("flickers"),
    )


def run_lengths(df: DataFrame, key: list[str], place: str, value: str) -> DataFrame:
    """(key, value, start, count): runs of equal values at consecutive places."""
    w = Window.partitionBy(*key, value).orderBy(place)
    island = df.withColumn("island", F.col(place) - F.row_number().over(w))
    return island.groupBy(*key, value, "island").agg(F.min(place).alias("start"), F.count("*").alias("count")).drop("island")


def continuity(df: DataFrame, key: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows with ``expected`` (the row before's end) where it isn't their start."""
    w = _stream(key, order)
    return df.withColumn("expected", F.lag(end).over(w)).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(start)))


def overlapping(df: DataFrame, key: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows that begin before an earlier row of their stream has ended."""
    w = _stream(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reached", F.max(end).over(w)).where(F.col("reached") > F.col(start))


def running_offset(df: DataFrame, key: list[str], order: list[str], size: Column, origin: int) -> DataFrame:
    """Adds ``offset``: ``origin`` plus the sizes of the rows before."""
    w = _stream(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.lit(origin) + F.coalesce(F.sum(size).over(w), F.lit(0)))


def seek(points: DataFrame, targets: DataFrame, key: list[str], time: str, carried: list[str]) -> DataFrame:
    """Each target with the last point at or before its time (nulls if there is none).

    Both sides go through one shuffle: points and targets are one stream, and a
    running last value carries the point on.  At equal times points come first.
    """
    packed = F.struct(F.col(time).alias("at"), *carried)
    left = points.select(*key, F.col(time).alias("__t"), F.lit(0).alias("__side"), packed.alias("__point"), F.lit(None).alias("__row"))
    row = F.struct(*targets.columns)
    right = targets.select(*key, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["__point"].dataType).alias("__point"), row.alias("__row"))
    both = left.withColumn("__row", F.lit(None).cast(right.schema["__row"].dataType)).unionByName(right)
    w = Window.partitionBy(*key).orderBy("__t", "__side").rowsBetween(*RUNNING)
    found = both.withColumn("__found", F.last("__point", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__row.*", *(F.col("__found")[c].alias(f"seek_{c}") for c in ("at", *carried)))


def contained(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, bucket: int | None = None) -> DataFrame:
    """Points left-joined to the spans of their key with start <= at < end.

    ``bucket`` is a width of time (in the columns' own unit, microseconds for
    timestamps): a span is then met by its key and the buckets that it reaches,
    so a hot key's points and spans meet bucket by bucket.  Choose it near the
    usual length of a span; a span is dealt once for each bucket it reaches.
    """
    p, s, on = points, spans, list(key)
    if bucket is not None:
        number = lambda df, c: F.unix_micros(c) if df.schema[c].dataType.typeName() == "timestamp" else F.col(c).cast("long") if df.schema[c].dataType.typeName() != "timestamp_ntz" else F.unix_micros(F.col(c).cast("timestamp"))
        last = number(spans, end) - 1
        p = points.withColumn("__bucket", F.floor(number(points, at) / bucket))
        reached = F.sequence(F.floor(number(spans, start) / bucket), F.floor(last / bucket))
        s = spans.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(reached))
        on.append("__bucket")
    p, s = p.alias("p"), s.alias("s")
    cond = (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"p.{at}") < F.col(f"s.{end}"))
    for k in on:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return p.join(s, cond, "left").drop("__bucket")


def clipped(spans: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Spans that overlap [low, high), cut to it."""
    inside = spans.where((F.col(start) < high) & (F.col(end) > low))
    return inside.withColumn("clip_start", F.greatest(F.col(start), low)).withColumn("clip_end", F.least(F.col(end), high))


def complement(spans: DataFrame, lengths: DataFrame, key: list[str], start: str, end: str, length: str) -> DataFrame:
    """(key, start, end): what the disjoint spans of a stream leave of [0, length)."""
    w = Window.partitionBy(*key).orderBy("__end", "__start")
    tail = lengths.select(*key, F.col(length).cast("long").alias("__start"), F.col(length).cast("long").alias("__end"))
    edges = spans.select(*key, F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end")).unionByName(tail)
    gaps = edges.withColumn("start", F.coalesce(F.lag("__end").over(w), F.lit(0))).withColumn("end", F.col("__start"))
    return gaps.where("start < end").select(*key, "start", "end")


def split(spans: DataFrame, key: list[str], start: str, end: str, longest: int) -> DataFrame:
    """Spans cut into pieces of at most ``longest``."""
    pieces = spans.where(F.col(start) < F.col(end)).withColumn("piece", F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(longest).cast("long"))))
    return pieces.select(*key, F.col("piece").alias("start"), F.least(F.col("piece") + longest, F.col(end)).alias("end"))


def hysteresis_spans(df: DataFrame, key: list[str], place: str, value: str, enter: float, enter_rows: int, leave: float, leave_rows: int, size: str | None = None) -> DataFrame:
    """(key, start, end): quiet spans of a level with hysteresis.

    A span starts where at least ``enter_rows`` rows in a row are at or below
    ``enter``, and ends where at least ``leave_rows`` in a row are at or above
    ``leave``; places count from 0 and ``end`` is exclusive.  A span that does not
    end reaches to the stream's end.  Null levels break runs.  With ``size``, a
    row counts as so many.
    """
    w = Window.partitionBy(*key).orderBy(place)
    side = F.when(F.col(value) <= enter, 1).when(F.col(value) >= leave, 2).otherwise(0)
    weight = F.lit(1) if size is None else F.col(size)
    marked = df.select(*key, place, side.alias("side"), weight.alias("__size")).withColumn("fresh", (F.col("side") != F.coalesce(F.lag("side").over(w), F.lit(-1))).cast("long"))
    runs = marked.withColumn("run", F.sum("fresh").over(w.rowsBetween(*RUNNING)))
    runs = runs.groupBy(*key, "run", "side").agg(F.min(place).alias("start"), F.sum("__size").alias("n"))
    good = runs.where(((F.col("side") == 1) & (F.col("n") >= enter_rows)) | ((F.col("side") == 2) & (F.col("n") >= leave_rows)))
    by_start = Window.partitionBy(*key).orderBy("start")
    turns = good.where(~F.col("side").eqNullSafe(F.lit(None))).withColumn("before", F.lag("side").over(by_start)).where(F.coalesce(F.col("before"), F.lit(2)) != F.col("side"))
    ends = turns.withColumn("end", F.lead("start").over(by_start)).where("side = 1")
    length = df.groupBy(*key).agg((F.max(place) + 1).alias("length"))
    return ends.join(length, key).select(*key, "start", F.coalesce("end", "length").alias("end"))


def sessions(df: DataFrame, key: list[str], time: str, gap: str) -> DataFrame:
    """(key, start, end, rows) of a stream's sessions: rows less than ``gap`` apart.

    ``end`` is ``gap`` after the last row.  Works on live streams as on tables;
    a live one needs a watermark on ``time``.
    """
    found = df.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("rows"))
    return found.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")
