"""Raster frames and grid cells in numpy, all cells of a frame at once."""

from __future__ import annotations

import numpy as np

#: Pixels of a cell, and samples that are taken of it.
CELL_WIDTH, CELL_HEIGHT = 8, 16
SAMPLES_X, SAMPLES_Y = 4, 8
#: A cell whose luma range is below this is flat; glyphs of flat cells and of textures.
FLAT_RANGE = 7
FLAT_GLYPH, TEXTURE_GLYPH = 7, 60
#: Luma weights.
LUMA = np.array([0.2126, 0.7152, 0.0722])
#: Weights of the glyph score: shape, area, occupancy, centroid, orientation.
WEIGHTS = (3.2, 1.4, 0.30, 0.70, 0.55)
#: Weights of the scene score: color difference, changed pixels, luma shift.
SCENE_WEIGHTS = (0.55, 0.30, 0.15)


def mask_bits(masks: np.ndarray) -> np.ndarray:
    """(n, 16) mask rows, highest bit left, as (n, 16, 8) of 0 and 1."""
    return np.unpackbits(np.asarray(masks, np.uint8)[..., None], axis=-1)


def _features(values: np.ndarray, shape: np.ndarray) -> dict[str, np.ndarray]:
    """Features of (n, 8, 4) amounts of ink; ``shape`` is their (n, 8, 4) outline."""
    n = len(values)
    v = values.astype(np.float64)
    ink = v.sum((1, 2))
    safe = np.maximum(ink, 1e-300)
    cx = np.where(ink > 0, (v * np.arange(SAMPLES_X)).sum((1, 2)) / safe / 3, 0.5)
    cy = np.where(ink > 0, (v * np.arange(SAMPLES_Y)[:, None]).sum((1, 2)) / safe / 7, 0.5)
    occupancy = v.reshape(n, 4, 2, 2, 2).sum((2, 4)).reshape(n, 8) * 0.25
    framed = np.pad(v, ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy = framed[:, 1:-1, 2:] - framed[:, 1:-1, :-2], framed[:, 2:, 1:-1] - framed[:, :-2, 1:-1]
    size = np.hypot(gx, gy)
    size[size < 0.01] = 0
    angle = np.arctan2(gy, gx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    angle = np.where(angle >= np.pi, angle - np.pi, angle)
    sector = np.floor(angle / (np.pi / 4) + 0.5).astype(int) & 3
    orientation = np.stack([(size * (sector == s)).sum((1, 2)) for s in range(4)], 1)
    total = orientation.sum(1, keepdims=True)
    orientation = np.divide(orientation, total, out=np.zeros_like(orientation), where=total > 0)
    f32 = lambda x: x.astype(np.float32).astype(np.float64)
    return {"shape": shape.reshape(n, 32).astype(bool), "area": ink / 32, "cx": cx, "cy": cy, "occupancy": f32(occupancy), "orientation": f32(orientation)}


def glyph_features(masks: np.ndarray) -> dict[str, np.ndarray]:
    """Features of 8 x 16 glyph masks, each 2 x 2 of whose pixels are one sample."""
    ink = mask_bits(masks).reshape(-1, SAMPLES_Y, 2, SAMPLES_X, 2).sum((2, 4))
    return _features(ink / 4, ink > 0)


def target_features(outline: np.ndarray) -> dict[str, np.ndarray]:
    return _features(outline.astype(float), outline)


def glyph_scores(target: dict[str, np.ndarray], glyphs: dict[str, np.ndarray]) -> np.ndarray:
    """(targets, glyphs) scores; 0 is a perfect match."""
    apart = lambda f: np.abs(target[f][:, None] - glyphs[f][None])
    shape = (target["shape"][:, None] != glyphs["shape"][None]).sum(2) / 32
    terms = (shape, apart("area"), apart("occupancy").sum(2), apart("cx") + apart("cy"), apart("orientation").sum(2))
    return sum(w * t for w, t in zip(WEIGHTS, terms, strict=True))


def nearest_color(colors: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The nearest palette entry of each color, the first among equals."""
    gaps = colors[:, None].astype(float) - palette[None].astype(float)
    return (gaps * gaps * LUMA).sum(2).argmin(1)


#: How much worse a held glyph may score, plainly and among textures, each with its growth by
#: stability; how far off a held color may be, with its growth.
HOLD_GLYPH, HOLD_TEXTURE, HOLD_COLOR = (0.06, 0.34), (0.22, 0.36), (7, 17)


def analyse(frame: np.ndarray, columns: int, rows: int, glyphs: np.ndarray, palette: np.ndarray, before: np.ndarray | None = None, stability: float = 0.48) -> np.ndarray:
    """Cells (n, 3) of an (h, w, 4) frame.

    A cell is sampled 4 x 8; its samples above the mean luma are bright.  The
    glyph that best fits either side is taken, the bright side among equals of
    one glyph; flat cells get the full one.  With a state before, its glyph and
    colors are held while they are nearly as good.
    """
    height, width = frame.shape[:2]
    stable = min(max(float(stability), 0.0), 1.0)
    place = lambda count, size: np.clip(np.floor((np.arange(count) + 0.5) * size / count).astype(int), 0, size - 1)
    picked = frame[place(rows * SAMPLES_Y, height)][:, place(columns * SAMPLES_X, width), :3].astype(float)
    cells = picked.reshape(rows, SAMPLES_Y, columns, SAMPLES_X, 3).transpose(0, 2, 1, 3, 4).reshape(-1, SAMPLES_Y, SAMPLES_X, 3)
    luma = (cells[..., 0] * LUMA[0] + cells[..., 1] * LUMA[1]) + cells[..., 2] * LUMA[2]
    kept = luma.astype(np.float32).astype(float)
    bright = kept >= (luma.sum((1, 2)) / 32)[:, None, None]
    flat = luma.max((1, 2)) - luma.min((1, 2)) < FLAT_RANGE
    known = glyph_features(glyphs)
    both = np.stack([glyph_scores(target_features(bright), known), glyph_scores(target_features(~bright), known)], 2)
    best = both.reshape(len(cells), -1).argmin(1)
    glyph, dark_side = best // 2, best % 2 == 1
    lowest = both.reshape(len(cells), -1)[np.arange(len(cells)), best]
    mean = lambda side: (cells * side[..., None]).sum((1, 2)) / np.maximum(side.sum((1, 2)), 1)[:, None]
    high, low, whole = mean(bright), mean(~bright), cells.mean((1, 2))
    fore, back = np.where(dark_side[:, None], low, high), np.where(dark_side[:, None], high, low)
    if before is not None:
        old = before[:, 0].astype(int)
        held = both[np.arange(len(cells)), old].min(1)
        hold = (held <= lowest + HOLD_GLYPH[0] + stable * HOLD_GLYPH[1]) | ((glyph >= TEXTURE_GLYPH) & (old != glyph) & (held <= lowest + HOLD_TEXTURE[0] + stable * HOLD_TEXTURE[1]))
        glyph = np.where(hold, old, glyph)
    glyph = np.where(flat, FLAT_GLYPH, glyph)
    fore, back = np.where(flat[:, None], whole, fore), np.where(flat[:, None], whole, back)
    out = [glyph]
    for i, color in enumerate((fore, back), 1):
        index = nearest_color(color, palette)
        if before is not None:
            old = before[:, i].astype(int)
            gap = palette[index].astype(float) - palette[old].astype(float)
            index = np.where((gap * gap).sum(1) <= (HOLD_COLOR[0] + stable * HOLD_COLOR[1]) ** 2, old, index)
        out.append(index)
    return np.stack(out, 1).astype(np.uint8)


def render(cells: np.ndarray, columns: int, glyphs: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The (16 rows, 8 columns, 4) frame of cells."""
    ink = mask_bits(glyphs)[cells[:, 0]].astype(bool)
    color = np.where(ink[..., None], palette[cells[:, 1]][:, None, None], palette[cells[:, 2]][:, None, None]).astype(np.uint8)
    grid = color.reshape(-1, columns, CELL_HEIGHT, CELL_WIDTH, 3).transpose(0, 2, 1, 3, 4)
    rgb = grid.reshape(grid.shape[0] * CELL_HEIGHT, columns * CELL_WIDTH, 3)
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], 2)


def overlay(frame: np.ndarray, columns: int, plane: list[tuple[int, int, int, bytes]], palette: np.ndarray) -> np.ndarray:
    """A frame with (cell, fore, back, mask) entries drawn over it."""
    out = frame.copy()
    for cell, fore, back, mask in plane:
        y, x = cell // columns * CELL_HEIGHT, cell % columns * CELL_WIDTH
        ink = mask_bits(np.frombuffer(mask, np.uint8)).astype(bool)
        out[y : y + CELL_HEIGHT, x : x + CELL_WIDTH, :3] = np.where(ink[..., None], palette[fore], palette[back])
    return out


def scene_score(before: np.ndarray, now: np.ndarray, stride: int = 1, changed: float = 32.0) -> float:
    """How much two frames differ, from 0 to 1, to 6 digits."""
    a, b = (f.reshape(-1, 4)[::stride, :3].astype(float) for f in (before, now))
    ya, yb = a @ LUMA, b @ LUMA
    terms = ((np.abs(a - b) @ LUMA).sum() / (len(a) * 255), (np.abs(ya - yb) >= changed).mean(), abs(ya.sum() - yb.sum()) / (len(a) * 255))
    return round(float(min(max(sum(w * t for w, t in zip(SCENE_WEIGHTS, terms, strict=True)), 0.0), 1.0)), 6)


def ppm(frame: np.ndarray) -> bytes:
    return f"P6\n{frame.shape[1]} {frame.shape[0]}\n255\n".encode() + np.ascontiguousarray(frame[..., :3]).tobytes()


def scanlines(frame: np.ndarray, offset: int, period: int = 2, phase: int = 1, gain: float = 0.82) -> np.ndarray:
    out = frame.copy()
    dark = (np.arange(len(frame)) + offset) % period == phase
    out[dark, :, :3] = np.floor(out[dark, :, :3] * gain + 0.5)
    return out


def atlas(glyphs: np.ndarray, palette: np.ndarray, columns: int = 8, scale: int = 2) -> np.ndarray:
    """All glyphs in rows of ``columns``, color 1 on color 0, each pixel ``scale`` times as large."""
    cells = np.stack([np.arange(len(glyphs)), np.ones(len(glyphs)), np.zeros(len(glyphs))], 1).astype(np.uint8)
    return render(cells, columns, glyphs, palette).repeat(scale, 0).repeat(scale, 1)


def beside(left: np.ndarray, right: np.ndarray, gap: int = 8) -> np.ndarray:
    """Two frames of one height side by side, an opaque black gap between them."""
    between = np.zeros((len(left), gap, 4), np.uint8)
    between[..., 3] = 255
    return np.concatenate([left, between, right], 1)


#: Pixels that the thinner side of a caption cell has at least and at most.
LEAST_INK, MOST_INK = 4, 64


def extract_masks(frame: np.ndarray, columns: int, rows: int, palette: np.ndarray, band: float = 0.58, contrast: float = 36) -> list[tuple[int, int, int, bytes]]:
    """(cell, fore, back, mask) of cells in the lower band that split into two clear shades.

    Pixels as bright as the cell's mean or more are one side; the side with fewer
    pixels is the ink, the bright one among equals.  Each side has the palette
    color nearest to its mean.
    """
    if frame.shape != (rows * CELL_HEIGHT, columns * CELL_WIDTH, 4):
        raise ValueError("the frame is not of whole cells")
    first = int(rows * band)
    cells = frame[first * CELL_HEIGHT :].reshape(rows - first, CELL_HEIGHT, columns, CELL_WIDTH, 4).transpose(0, 2, 1, 3, 4).reshape(-1, CELL_HEIGHT * CELL_WIDTH, 4)
    rgb = cells[..., :3].astype(float)
    luma = rgb @ LUMA
    bright = luma.astype(np.float32) >= (luma.mean(1))[:, None]
    n = bright.sum(1)
    ink = np.where((2 * n <= bright.shape[1])[:, None], bright, ~bright)
    size = ink.sum(1)
    fit = np.flatnonzero((np.ptp(luma, 1) >= contrast) & (size >= LEAST_INK) & (size <= MOST_INK))
    mean = lambda side: (rgb[fit] * side[fit][..., None]).sum(1) / np.maximum(side[fit].sum(1), 1)[:, None]
    fore, back = nearest_color(mean(ink), palette), nearest_color(mean(~ink), palette)
    masks = np.packbits(ink[fit].reshape(-1, CELL_HEIGHT, CELL_WIDTH), axis=2)[..., 0]
    return [(first * columns + int(c), int(f), int(b), m.tobytes()) for c, f, b, m in zip(fit, fore, back, masks, strict=True)]
