"""Report tables: rankings, roll-ups, selections, settings, names, clocks, estimates."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.functions.scalars import MOST_COLUMNS, PALETTE_DEPTHS, TICK_RATE


def rankings(rows: DataFrame, name: str, bytes_: str, error: str) -> DataFrame:
    """(name, by_bytes, by_error): places of a report's configurations, by size and then error and the other way round.

    A report has a row for each configuration; ties go by name.
    """
    place = lambda *order: F.row_number().over(Window.orderBy(*order, name)).cast("long")
    return rows.select(name, place(bytes_, error).alias("by_bytes"), place(error, bytes_).alias("by_error"))


def cheapest(totals: DataFrame, name: str, bytes_: str) -> DataFrame:
    """The name of the least total, the first by name among equals; null totals don't take part."""
    best = F.min(F.struct(F.col(bytes_).alias("bytes"), F.col(name).alias("name")))
    return totals.where(F.col(bytes_).isNotNull()).agg(best.alias("b")).select(F.col("b.name").alias("winner"), F.col("b.bytes").alias("bytes"))


def decoder_rollup(rows: DataFrame, key: list[str], summed: list[str], median: str, p95: str, peaks: list[str]) -> DataFrame:
    """Files, sums, mean and total of the median times, the worst p95 and peaks by key."""
    return rows.groupBy(*key).agg(
        F.count("*").alias("files"), *(F.sum(c).alias(c) for c in summed), F.round(F.sum(median) / F.count("*"), 3).alias("median_per_file"), F.round(F.max(p95), 3).alias("worst_p95"),
        F.round(F.sum(median), 3).alias("total_median"), *(F.max(c).alias(f"peak_{c}") for c in peaks),
    )


def selected(entries: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """All wanted keys with their entries; ``missing`` marks those that have none."""
    asked = wanted.select(F.col(wanted_key).alias("__asked")).distinct()
    met = asked.join(entries.withColumn("__there", F.lit(True)), F.col("__asked") == F.col(key), "left")
    return met.withColumn("missing", F.col("__there").isNull()).withColumn(key, F.col("__asked")).drop("__there", "__asked")


#: What settings are where none is given.
DEFAULTS = {"fps": "24", "columns": 80, "palette": 32, "glyphs": 32, "profile": "balanced"}
PROFILES, GLYPHS = ("smallest", "balanced", "clearest"), (32, 64)


def settled(rows: DataFrame, cadences: list[str], defaults: dict | None = None) -> DataFrame:
    """Rows with their settings filled in and ``fault``: the first setting that isn't legal.

    Settings are fps (a cadence's label), columns, palette (a depth), glyphs and
    profile (in any case of letters).
    """
    own = {**DEFAULTS, **(defaults or {})}
    out = rows
    for name in ("fps", "columns", "palette", "glyphs"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(own[name])))
    out = out.withColumn("profile", F.lower(F.coalesce(F.col("profile"), F.lit(own["profile"]))))
    legal = {
        "fps": F.col("fps").isin(*cadences), "columns": F.col("columns").between(1, MOST_COLUMNS), "palette": F.col("palette").isin(*PALETTE_DEPTHS), "glyphs": F.col("glyphs").isin(*GLYPHS),
        "profile": F.col("profile").isin(*PROFILES),
    }
    fault = F.lit(None).cast("string")
    for name in reversed(legal):
        fault = F.when(~legal[name], F.lit(name)).otherwise(fault)
    return out.withColumn("fault", fault)


def suggested_name(path: Column, extension: str) -> Column:
    """A file's name with another extension; a file that has it already is marked as encoded."""
    folder, name = F.regexp_extract(path, "^(.*/)?[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    again = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)) == extension
    return F.concat(folder, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.when(again, F.lit(".encoded")).otherwise(F.lit("")), F.lit(extension))


def distinct_names(rows: DataFrame, order: list[str], path: str, taken: DataFrame | None = None, extension: str | None = None) -> DataFrame:
    """Adds ``output``: the path, or with ``.2``, ``.3``, ... before its extension where it is taken.

    Rows come in order; a folder is one task's work, as what a name becomes
    depends on all names before it.  ``taken`` has paths that are in use.  Without
    ``extension`` a name that only begins with a dot has none; with it, a name may
    be the extension alone.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("output", T.StringType())])
    folder = lambda c: F.regexp_extract(c, "^(.*/)?[^/]*$", 1)
    used = (taken.select(F.col(path).alias("p")) if taken is not None else rows.where("false").select(F.col(path).alias("p"))).distinct()
    used = used.groupBy(folder(F.col("p")).alias("__folder")).agg(F.collect_list("p").alias("__used"))
    met = rows.withColumn("__folder", folder(F.col(path))).join(used, "__folder", "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        first = group["__used"].iloc[0]
        used, out = set(first if first is not None else ()), []
        for wanted in group[path]:
            stem, end = (wanted[: -len(extension)], extension) if extension and wanted.endswith(extension) else posixpath.splitext(wanted)
            name, n = wanted, 2
            while name in used:
                name, n = f"{stem}.{n}{end}", n + 1
            used.add(name)
            out.append(name)
        return group.drop(columns=["__folder", "__used"]).assign(output=out)[schema.names]

    return met.groupBy("__folder").applyInPandas(run, schema)


def playback_clock(steps: DataFrame, key: list[str], order: list[str], nanoseconds: str, total: Column, numerator: int = 1, denominator: int = 1) -> DataFrame:
    """Adds ``position``, in ticks after each step of wall time, and ``remainder``.

    What is left of a step's ticks is carried on, so the position is the whole
    part of the running sum; a clock stands still at the end, ``total``.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = F.sum(F.col(nanoseconds).cast("decimal(20,0)")).over(w).cast("decimal(28,0)") * F.lit(TICK_RATE * numerator).cast("decimal(9,0)")
    whole = F.lit(10**9 * denominator).cast("decimal(18,0)")
    ticks = F.floor(passed / whole).cast("long")
    return steps.withColumn("position", F.least(ticks, total.cast("long"))).withColumn("remainder", F.pmod(passed, whole).cast("long"))


#: Fixed values of a size estimate: fixed bytes of a file, and margins of its upper bound for pictures and sound.
ESTIMATE_OVERHEAD, PICTURE_MARGIN, SOUND_MARGIN = 1024, 1.25, 1.5


def estimated_size(rates: DataFrame, key: list[str], rate: str, seconds: Column, sound_rate: Column) -> DataFrame:
    """(key, samples, low_rate, middle_rate, high_rate, estimated, lower, upper) in bits a second and bytes.

    The middle is the classic median of the positive sampled rates with the sound's,
    the lower bound the least rate without it, the upper the highest with margins;
    bounds are moved out to hold the estimate.
    """
    whole = lambda c: F.floor(c + 0.5).cast("long")
    size = lambda c: whole(c * F.col("__seconds") / 8) + ESTIMATE_OVERHEAD
    found = rates.where(F.col(rate) > 0).groupBy(*key).agg(
        F.count("*").alias("samples"), F.min(rate).alias("low_rate"), whole(F.percentile(rate, 0.5)).alias("middle_rate"), F.max(rate).alias("high_rate"), F.max(seconds).alias("__seconds"), F.max(sound_rate).alias("__sound")
    )
    high = whole(F.col("high_rate") * PICTURE_MARGIN + F.col("__sound") * SOUND_MARGIN)
    found = found.withColumn("estimated", size(F.col("middle_rate") + F.col("__sound")))
    return found.select(
        *key, "samples", "low_rate", "middle_rate", "high_rate", "estimated", F.least("estimated", size(F.col("low_rate"))).alias("lower"), F.greatest("estimated", size(high)).alias("upper")
    )


def sample_offsets(length: Column, sample: Column | int, count: int) -> Column:
    """Distinct evenly spaced starts of at most ``count`` samples in ``length`` places, as an array."""
    reach = F.greatest(F.lit(0), length - F.least(length, sample if isinstance(sample, Column) else F.lit(sample)))
    starts = [F.floor(reach / 2)] if count == 1 else [F.floor(reach * i / (count - 1)) for i in range(count)]
    return F.array_distinct(F.array(*[s.cast("long") for s in starts]))


#: Empty columns of a review sheet.
SCORES = ("recognizability_1_to_5", "color_or_grayscale_1_to_5", "temporal_stability_1_to_5", "subtitle_transcription", "notes")


def worksheet(rows: DataFrame, public: list[str], code: Column) -> tuple[DataFrame, DataFrame]:
    """(public sheet, key) of a blind review: the sheet has codes for names, the key has both.

    The sheet ends with empty columns for the scores; write it with
    ``sheet.write.option("header", True).csv(path)`` and keep the key apart.
    """
    coded = rows.withColumn("code", code)
    return coded.select("code", *public, *(F.lit("").alias(c) for c in SCORES)), coded
