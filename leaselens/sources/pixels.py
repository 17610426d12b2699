"""Image preprocessing on pixel arrays, in numpy: stamps, skew, contrast, table lines.

Decoders are providers: these functions take height x width x 3 (or height x width) arrays.
"""

from __future__ import annotations

import numpy as np


def without_red_stamp(rgb: np.ndarray, saturation: float = 0.27, least: int = 50) -> np.ndarray:
    """Red, saturated pixels as white."""
    x = rgb.astype(np.float64)
    top, low = x.max(2), x.min(2)
    spread = np.where(top > 0, (top - low) / np.maximum(top, 1), 0)
    red = (x[..., 0] == top) & (np.abs(x[..., 1] - x[..., 2]) < 0.35 * np.maximum(top - low, 1))
    out = rgb.copy()
    out[red & (spread > saturation) & (top > least)] = 255
    return out


def skew_angle(grey: np.ndarray, most: float = 15.0, step: float = 0.5) -> float:
    """The turn, in degrees, at which dark pixels fall into the sharpest rows."""
    y, x = np.nonzero(grey < 128)
    if len(y) < 10:
        return 0.0

    def sharpness(angle: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(np.int64)
        count = np.bincount(rows - rows.min())
        return float((count.astype(np.float64) ** 2).sum())

    angles = np.arange(-most, most + step / 2, step)
    best = [sharpness(a) for a in angles]
    return float(max(zip(best, -np.abs(angles), angles))[2])


def deskewed(grey: np.ndarray, limit: float = 10.0) -> np.ndarray:
    """The page turned back by shearing its columns; pages that seem turned by more than limit stay."""
    angle = skew_angle(grey)
    if angle == 0 or abs(angle) > limit:
        return grey
    rows = np.arange(grey.shape[0])[:, None] + np.round(np.arange(grey.shape[1]) * np.tan(np.radians(angle))).astype(np.int64)
    inside = (rows >= 0) & (rows < grey.shape[0])
    return np.where(inside, np.take_along_axis(grey, np.clip(rows, 0, grey.shape[0] - 1), 0), 255).astype(grey.dtype)


def equalised(grey: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation: clipped histograms of tiles, blended between tile centres."""
    h, w = grey.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = grey[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            top = max(clip * part.size / 256, 1)
            over = np.maximum(hist - top, 0).sum()
            hist = np.minimum(hist, top) + over / 256
            maps[i, j] = np.cumsum(hist) / max(hist.sum(), 1) * 255
    fy = np.clip((np.arange(h) + 0.5) / h * tiles - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) / w * tiles - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], grey]
    out = (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy
    return np.round(out).astype(np.uint8)


def _lines(dark: np.ndarray, least: int) -> list[int]:
    """Middles of the runs of rows that hold an unbroken dark stretch of that length."""
    edge = np.diff(np.pad(dark, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows = np.zeros(len(dark), bool)
    for i in range(len(dark)):
        a, b = np.flatnonzero(edge[i] == 1), np.flatnonzero(edge[i] == -1)
        rows[i] = len(a) > 0 and (b - a).max() >= least
    start = np.flatnonzero(np.diff(np.concatenate([[0], rows.astype(np.int8)])) == 1)
    end = np.flatnonzero(np.diff(np.concatenate([rows.astype(np.int8), [0]])) == -1)
    return [int((s + e) // 2) for s, e in zip(start, end)]


def table_cells(grey: np.ndarray, least: int = 40) -> list[tuple[int, int, int, int]]:
    """x, y, w, h between neighbouring long lines; cells too small or as large as the page are left out."""
    dark = grey < 128
    ys, xs = _lines(dark, least), _lines(dark.T, least)
    h, w = grey.shape
    cells = [(x0, y0, x1 - x0, y1 - y0) for y0, y1 in zip(ys, ys[1:]) for x0, x1 in zip(xs, xs[1:])]
    return [c for c in cells if c[2] >= 20 and c[3] >= 15 and c[2] < 0.95 * w and c[3] < 0.95 * h]
