"""Analysis of raster streams under a rate-distortion choice, group by group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickplane.functions import grid_codec as gc
from tickplane.functions import raster as ra
from tickplane.operators import sequential as sq
from tickplane.schema import struct


@dataclass(frozen=True)
class Mode:
    """Glyph subsets that compete, stability, weight of distortion, scene threshold."""

    glyph_counts: tuple[int, ...]
    stability: float
    weight: float
    scene: float


#: Fixed values of the three modes.
MODES = {"compact": Mode((32,), 0.82, 0.75, 0.58), "balanced": Mode((32,), 0.48, 4.0, 0.44), "quality": Mode((32, 64), 0.18, 16.0, 0.34)}


def subset_map(masks: np.ndarray, count: int) -> np.ndarray:
    """For each glyph the nearest of the first ``count`` by Hamming distance, the least among equals."""
    bits = ra.mask_bits(masks).reshape(len(masks), -1)
    return (bits[:, None] != bits[None, :count]).sum(2).argmin(1)


def remapped(state: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cells with each glyph replaced by what ``to`` has for it."""
    if len(state) and state[:, 0].max() >= len(to):
        raise ValueError("a cell's glyph is not in the map")
    out = state.copy()
    out[:, 0] = to[state[:, 0]]
    return out


def distortion(frame: np.ndarray, drawn: np.ndarray) -> tuple[float, float | None]:
    """(normalised squared error, PSNR) against a drawing of any size, sampled at its cells' pixels.

    The PSNR is null where there is no error.
    """
    y = ((np.arange(len(frame)) + 0.5) * len(drawn) / len(frame)).astype(int)
    x = ((np.arange(frame.shape[1]) + 0.5) * drawn.shape[1] / frame.shape[1]).astype(int)
    gap = frame[..., :3].astype(float) - drawn[y][:, x, :3].astype(float)
    mse = float((gap * gap).mean())
    return mse / 65025, 10 * np.log10(65025 / mse) if mse else None


def scene_scores(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames (stream, place, rgba) with ``score`` against the frame before, null on the first.

    One pass over sorted streams; the state is the last frame.
    """
    from pyspark.sql import types as T

    def fold(before, pictures):
        out = []
        for raw in pictures:
            now = np.frombuffer(raw, np.uint8).reshape(height, width, 4)
            out.append(None if before is None else ra.scene_score(before, now))
            before = now
        return before, (out,)

    return sq.fold_sorted(frames, ["stream"], ["place"], ["rgba"], lambda: None, fold, [T.StructField("score", T.DoubleType())])


def analysed(frames: DataFrame, width: int, height: int, columns: int, rows: int, glyphs: np.ndarray, palette: np.ndarray, mode: str, most: int, least: int = 2) -> DataFrame:
    """(stream, group_no, place, keyframe, glyph_count, rate_bytes, distortion, psnr, objective, state).

    Groups start at scene cuts or at ``most`` frames; each is analysed alone.  Of
    the mode's glyph subsets, the least of rate a cell plus weighted distortion
    is taken, then the least distortion, rate and subset.
    """
    rule, n, depth = MODES[mode], columns * rows, len(palette)
    cut = sq.bounded_groups(scene_scores(frames, width, height), ["stream"], ["place"], "score", least, most, rule.scene)
    schema = struct("stream string, group_no long, place long, keyframe boolean, glyph_count int, rate_bytes long, distortion double, psnr double, objective double, state binary")
    maps = {count: subset_map(glyphs, count) for count in rule.glyph_counts}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for stream, number, place, rgba in group.sort_values("place")[["stream", "group_no", "place", "rgba"]].itertuples(index=False, name=None):
            frame = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
            base = ra.analyse(frame, columns, rows, glyphs, palette, before, rule.stability)
            tries = []
            for count, to in maps.items():
                state = remapped(base, to)
                size = 1 + len(gc.plain_encode(state, before, columns, depth))
                error, psnr = distortion(frame, ra.render(state, columns, glyphs, palette))
                tries.append((size / n + error * rule.weight, error, size, count, psnr, state))
            objective, error, size, count, psnr, state = min(tries, key=lambda t: t[:4])
            out.append((stream, number, place, before is None, count, size, error, psnr, round(objective, 9), state.tobytes()))
            before = state
        return pd.DataFrame(out, columns=schema.names)

    return cut.select("stream", "group_no", "place", "rgba").groupBy("stream", "group_no").applyInPandas(run, schema)


def summary(selections: DataFrame) -> DataFrame:
    """Rate, mean distortion, mean PSNR (99 where there is no error) and choices by stream."""
    return selections.groupBy("stream").agg(
        F.sum("rate_bytes").alias("rate_bytes"), F.round(F.avg("distortion"), 9).alias("distortion"), F.round(F.avg(F.coalesce("psnr", F.lit(99.0))), 6).alias("psnr"),
        F.countDistinct("group_no").alias("groups"), *(F.sum((F.col("glyph_count") == c).cast("long")).alias(f"glyphs_{c}") for c in (16, 32, 64)),
    )
