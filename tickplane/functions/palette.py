"""A master palette by farthest points in OKLab."""

from __future__ import annotations

import numpy as np

#: The colors that come first.
SEEDS = (
    (0, 0, 0), (255, 255, 255), (128, 128, 128), (220, 40, 48), (36, 176, 82), (48, 92, 220), (246, 214, 52), (48, 202, 212),
    (210, 56, 190), (48, 48, 52), (208, 208, 212), (238, 174, 132), (240, 118, 36), (116, 70, 44), (116, 70, 190), (28, 132, 126),
)
#: Steps of the candidates' grid, weight of lightness, and what counts as equal.
GRID_STEP, LIGHTNESS, EQUAL = 17, 1.25, 1e-15
#: The published matrices of OKLab.
TO_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
TO_LAB = np.array([[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]])


def oklab(rgb: np.ndarray) -> np.ndarray:
    u = np.asarray(rgb, float) / 255
    linear = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ TO_LMS.T) @ TO_LAB.T


def farthest_palette(size: int = 256, seeds: tuple = SEEDS) -> np.ndarray:
    """``size`` colors: the seeds, then each time the grid color farthest from all chosen ones.

    Of colors equally far the one that comes first as text is taken.
    """
    axis = np.arange(0, 256, GRID_STEP)
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    grid = grid[np.argsort([",".join(map(str, c)) for c in grid.tolist()])]
    scale = np.array([LIGHTNESS, 1, 1])
    lab = oklab(grid) * scale
    chosen = [tuple(s) for s in seeds][:size]
    near = np.full(len(grid), np.inf)
    free = ~(grid[:, None] == np.array(chosen)[None]).all(2).any(1)
    for color in chosen:
        near = np.minimum(near, ((lab - oklab(np.array(color)) * scale) ** 2).sum(1))
    while len(chosen) < size:
        reach = np.where(free, near, -np.inf)
        best = int(np.flatnonzero(reach >= reach.max() - EQUAL)[0])
        chosen.append(tuple(grid[best].tolist()))
        free[best] = False
        near = np.minimum(near, ((lab - lab[best]) ** 2).sum(1))
    return np.array(chosen, np.uint8)
