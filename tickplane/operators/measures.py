"""Aggregates: distributions, order statistics, entropy, signal measures, choices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def distribution(df: DataFrame, key: list[str], size: str) -> DataFrame:
    """Rows, sum and largest of a size by key."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total"), F.max(size).alias("largest"))


def at_ranks(df: DataFrame, key: list[str], value: str, ranks: dict[str, Column], bins: int = 64) -> DataFrame:
    """(key, names...): the values at some ranks (from 1) of each key, in columns; nulls don't count.

    ``ranks`` are expressions of ``n``, a key's number of values; a rank outside
    1 to n gives null.  Sketched quantiles cut a key's values into bins, the bins
    are counted, and only the bin that holds a rank is counted by value.  So the
    work on a hot key is dealt over its bins, and the result is exact whatever
    the sketch says.
    """
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("__v"))
    edges = rows.groupBy(*key).agg(F.percentile_approx("__v", [i / bins for i in range(1, bins)], 1000).alias("__edges"), F.count("*").alias("n"))
    number = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    binned = rows.join(edges, key).select(*key, "__v", number.alias("__bin"))
    counts = binned.groupBy(*key, "__bin").agg(F.count("*").alias("__count"))
    below = F.coalesce(F.sum("__count").over(Window.partitionBy(*key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    wanted = edges.select(*key, asked.alias("a")).select(*key, "a.name", "a.rank")
    placed = counts.withColumn("__below", below).join(wanted, key).where((F.col("rank") > F.col("__below")) & (F.col("rank") <= F.col("__below") + F.col("__count")))
    inside = binned.join(placed.select(*key, "__bin", "__below", "name", "rank"), [*key, "__bin"])
    values = inside.groupBy(*key, "name", "rank", "__below", "__v").agg(F.count("*").alias("__count"))
    until = F.col("__below") + F.sum("__count").over(Window.partitionBy(*key, "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = values.withColumn("__until", until).where(F.col("__until") >= F.col("rank"))
    columns = [F.min(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks]
    return df.select(*key).distinct().join(found.groupBy(*key).agg(*columns), key, "left")


def nearest_rank(df: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles by key; 0 where a group has no value."""
    found = at_ranks(df, key, value, {name: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) for name, p in shares.items()})
    return found.select(*key, *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in shares))


def classic_median(df: DataFrame, key: list[str], value: str, name: str = "median") -> DataFrame:
    """(key, name): the median with the middle two averaged, rounded half up."""
    found = at_ranks(df, key, value, {"__low": F.floor((F.col("n") + 1) / 2), "__high": F.floor(F.col("n") / 2) + 1})
    return found.select(*key, F.floor((F.col("__low") + F.col("__high")) / 2 + 0.5).cast("long").alias(name))


def byte_counts(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """(key, byte, n) of a BINARY column: bytes are counted by batch and key before anything moves."""
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, np.ndarray] = {}
            for *own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = sums.setdefault(tuple(own), np.zeros(256, np.int64))
                counts += np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
            rows = [(*own, byte, int(counts[byte])) for own, counts in sums.items() for byte in np.flatnonzero(counts).tolist()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema))

    found = df.select(*key, F.col(raw).alias("__raw")).mapInArrow(run, schema)
    return found.groupBy(*key, "byte").agg(F.sum("n").alias("n"))


def ordered_digest(df: DataFrame, key: list[str], order: str, digest: Column, lot: int = 1024) -> DataFrame:
    """(key, digest): a hash of rows' hashes in order, in two levels.

    Hashes are joined and hashed by ranges of ``lot`` of the whole number
    ``order``, and these hashes again, so what is gathered for a key shrinks by
    the rows of a range.
    """
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda x: x["h"]), ","), 256)
    lots = df.groupBy(*key, F.floor(F.col(order) / lot).alias("o")).agg(joined(F.collect_list(F.struct(F.col(order).alias("o"), digest.alias("h")))).alias("h"))
    return lots.groupBy(*key).agg(joined(F.collect_list(F.struct("o", "h"))).alias("digest"))


def top_tokens(df: DataFrame, token: list[str], least: int, most: int) -> DataFrame:
    """Tokens that occur ``least`` times or more: the ``most`` commonest, ties by token, ranked.

    The limit is a sort-and-limit plan, so no task holds more than ``most`` rows
    of each partition.
    """
    counts = df.groupBy(*token).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.col("n").desc(), *token).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), *token)).cast("long"))


def modal(df: DataFrame, key: list[str], token: str) -> DataFrame:
    """The commonest token of each key, the least among equals."""
    counts = df.groupBy(*key, token).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(token).alias("token")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.token").alias(token), (-F.col("b.m")).alias("n"))


def smoothed_cost(counts: DataFrame, key: list[str], symbol: str, n: str, alpha: float, symbols: int) -> DataFrame:
    """Bits of each symbol and in all by key under additive smoothing over ``symbols`` symbols."""
    totals = counts.groupBy(*key).agg((F.sum(n) + alpha * symbols).alias("total"))
    cost = -F.log2((F.col(n) + alpha) / F.col("total"))
    return counts.join(totals, key).groupBy(*key).agg(F.sum(n).cast("long").alias("symbols"), F.sum(F.col(n) * cost).alias("bits"))


def majority_bits(df: DataFrame, key: list[str], bits: str, width: int, share: float) -> DataFrame:
    """A mask of the bits that are set in at least ``share`` of the rows of a key."""
    mask = F.lit(0).cast("long")
    for i in range(width):
        bit = F.shiftright(bits, i).bitwiseAND(F.lit(1))
        mask = mask + F.when(F.avg(bit) >= share, F.lit(1 << i)).otherwise(F.lit(0))
    return df.groupBy(*key).agg(mask.cast("long").alias("mask"), F.count("*").alias("n"))


def signal_measures(a: Column, b: Column, peak: float) -> list[Column]:
    """Squared and absolute error, and ratios in dB, of two signals; null where there is no error."""
    mse = F.avg((a - b) * (a - b))
    power = F.avg(a * a)
    return [
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(a - b)).alias("mae"),
        F.max(F.abs(a - b)).alias("worst"),
        F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)).alias("psnr"),
        F.when((mse > 0) & (power > 0), 10 * F.log10(power / mse)).alias("snr"),
    ]


def window_rms(df: DataFrame, key: list[str], place: str, value: str, width: int) -> DataFrame:
    """Root mean square and peak by windows of ``width`` places."""
    cut = df.withColumn("window_no", F.floor(F.col(place) / width).cast("long"))
    return cut.groupBy(*key, "window_no").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"))


def least_by(df: DataFrame, key: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The row of least ``order`` of each key: one pre-aggregated pass, no sort."""
    best = F.min(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"k{i}") for i, c in enumerate(kept))))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, *(F.col(f"b.k{i}").alias(c) for i, c in enumerate(kept)))


def strict_total(value: str) -> Column:
    """The sum, or null if any member is null."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def percent_saving(before: Column, after: Column) -> Column:
    """What ``after`` saves of ``before`` in percent; 0 of nothing."""
    return F.when(before != 0, 100 * (before - after) / before).otherwise(F.lit(0.0))


def bits_per_second(size: Column, ticks: Column, rate: int = 60_000) -> Column:
    """Rounded half up; null without a size or a duration."""
    return F.when((size >= 0) & (ticks > 0), F.floor(size * 8 * rate / ticks + 0.5).cast("long"))
