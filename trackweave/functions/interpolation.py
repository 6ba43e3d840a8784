"""Sampling of feature grids at sub-pixel positions, vectorised over many grids and points with NumPy.

A batch of grids has shape (n, h, w, c), one grid per point, or (1, h, w, c), one grid for all; points are rows of (r, c) =
(row, column). Every sampler returns value, d/dr, d/dc and, where it has one, d2/drdc, each (n, channels). Reads outside a grid
meet its border.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MODES = ("BICUBIC", "CERES_BICUBIC", "BILINEAR", "NEARESTNEIGHBOR", "POLYGRADIENTFIELD", "BICUBICGRADIENTFIELD", "BICUBICCHAIN")


@dataclass(frozen=True)
class Sampling:
    """How a patch is sampled: mode, normalisation of each node's descriptor (l2) or of each channel over the nodes (ncc), and node offsets (x, y) in feature pixels."""

    mode: str = "BICUBIC"
    l2_normalize: bool = True
    ncc_normalize: bool = False
    nodes: tuple[tuple[float, float], ...] = ((0.0, 0.0),)
    check_bounds: bool = False


def read(grids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Clamped reads; rows and cols (n,) or (n, k...)."""
    h, w = grids.shape[1:3]
    which = np.zeros(1, int) if len(grids) == 1 else np.arange(len(grids))
    which = which.reshape(-1, *[1] * (rows.ndim - 1))
    return grids[which, np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)].astype(np.float64)


def _spline(p0, p1, p2, p3, x):
    """Cubic through p1 at 0 and p2 at 1 with the central differences as slopes: value and derivative at x."""
    a = (3 * (p1 - p2) + p3 - p0) / 2
    b = (2 * p0 - 5 * p1 + 4 * p2 - p3) / 2
    slope = (p2 - p0) / 2
    return p1 + x * (slope + x * (b + x * a)), slope + x * (2 * b + 3 * a * x)


def _cell(points: np.ndarray):
    base = np.floor(points).astype(int)
    return base[:, 0], base[:, 1], *(points - base).T[:, :, None]


def bicubic(grids: np.ndarray, points: np.ndarray):
    r, c, fr, fc = _cell(points)
    block = read(grids, r[:, None, None] + np.arange(-1, 3)[:, None], c[:, None, None] + np.arange(-1, 3))  # n, 4 rows, 4 columns, channels
    along, by_c = _spline(*np.moveaxis(block, 2, 0), fc[:, None])
    value, by_r = _spline(*np.moveaxis(along, 1, 0), fr)
    dc, cross = _spline(*np.moveaxis(by_c, 1, 0), fr)
    return value, by_r, dc, cross


def bilinear(grids: np.ndarray, points: np.ndarray):
    r, c, fr, fc = _cell(points)
    v00, v01, v10, v11 = (read(grids, r + i, c + j) for i in (0, 1) for j in (0, 1))
    top, low = v00 + (v01 - v00) * fc, v10 + (v11 - v10) * fc
    return top + (low - top) * fr, low - top, (v01 - v00) * (1 - fr) + (v11 - v10) * fr, v11 - v10 - v01 + v00


def nearest(grids: np.ndarray, points: np.ndarray):
    r, c = (np.sign(points) * np.floor(np.abs(points) + 0.5)).astype(int).T
    value = read(grids, r, c)
    return value, read(grids, r + 1, c) - value, read(grids, r, c + 1) - value, np.zeros_like(value)


def chain(grids: np.ndarray, points: np.ndarray):
    """Three channels (value, its d/dr, its d/dc), each interpolated: the derivatives are the stored ones."""
    value, *_ = bicubic(grids, points)
    return value[:, :1], value[:, 1:2], value[:, 2:3], np.zeros_like(value[:, :1])


def _hermite(x: np.ndarray):
    """Weights of (value at 0, value at 1, slope at 0, slope at 1) on the unit interval, and their derivatives."""
    h = np.stack([2 * x**3 - 3 * x**2 + 1, 3 * x**2 - 2 * x**3, x**3 - 2 * x**2 + x, x**3 - x**2])
    d = np.stack([6 * x**2 - 6 * x, 6 * x - 6 * x**2, 3 * x**2 - 4 * x + 1, 3 * x**2 - 2 * x])
    return h, d


def gradient_field(grids: np.ndarray, points: np.ndarray):
    """Four channels (value, d/dr, d/dc, d2/drdc) at the corners of the cell determine the bicubic surface of the cell."""
    r, c, fr, fc = _cell(points)
    v = read(grids, r[:, None, None] + np.arange(2)[:, None], c[:, None, None] + np.arange(2))  # n, 2, 2, 4
    (hr, dr), (hc, dc) = _hermite(fr[:, 0]), _hermite(fc[:, 0])
    table = np.empty((len(v), 4, 4))  # by (value rows 0, 1; slope rows 0, 1) x the same of columns
    table[:, :2, :2], table[:, 2:, :2], table[:, :2, 2:], table[:, 2:, 2:] = (v[..., k] for k in range(4))
    mix = lambda a, b: np.einsum("in,nij,jn->n", a, table, b)[:, None]
    return mix(hr, hc), mix(dr, hc), mix(hr, dc), mix(dr, dc)


def poly_gradient_field(grids: np.ndarray, points: np.ndarray):
    """Three or four channels: cubic Hermite along the columns of two rows from values and d/dc, then along the rows with d/dr interpolated linearly. d/dc is the linear blend of the two rows' slopes."""
    r, c, fr, fc = _cell(points)
    v = read(grids, r[:, None, None] + np.arange(2)[:, None], c[:, None, None] + np.arange(2))
    (hr, dr), (hc, dc) = _hermite(fr[:, 0]), _hermite(fc[:, 0])
    x = fc[:, 0]
    values, slopes = v[..., 0], v[..., 2]
    row = np.einsum("kn,nik->ni", hc[:2], values) + np.einsum("kn,nik->ni", hc[2:], slopes)
    row_c = np.einsum("kn,nik->ni", dc[:2], values) + np.einsum("kn,nik->ni", dc[2:], slopes)
    tilt = v[:, :, 0, 1] * (1 - x)[:, None] + v[:, :, 1, 1] * x[:, None]
    mix = lambda w: (np.einsum("kn,nk->n", w[:2], row) + np.einsum("kn,nk->n", w[2:], tilt))[:, None]
    by_c = row_c[:, :1] * (1 - fr) + row_c[:, 1:] * fr
    return mix(hr), mix(dr), by_c, row_c[:, 1:] - row_c[:, :1]


SAMPLERS = {
    "BICUBIC": bicubic,
    "CERES_BICUBIC": bicubic,
    "BILINEAR": bilinear,
    "NEARESTNEIGHBOR": nearest,
    "BICUBICCHAIN": chain,
    "BICUBICGRADIENTFIELD": gradient_field,
    "POLYGRADIENTFIELD": poly_gradient_field,
}


def l2_normalise(value: np.ndarray, *slopes: np.ndarray):
    """Unit length, and the derivatives of the unit vector. A vector without length stays as it is."""
    size = np.linalg.norm(value, axis=-1, keepdims=True)
    size = np.where(size > 0, size, 1.0)
    unit = value / size
    return unit, *(s / size - unit * (unit * s / size).sum(axis=-1, keepdims=True) for s in slopes)


def ncc_normalise(value: np.ndarray, *slopes: np.ndarray):
    """(n, nodes, channels): each channel minus its mean over the nodes, over its population deviation (0 counts as 1); with derivatives."""
    centred = value - value.mean(axis=1, keepdims=True)
    spread = np.sqrt((centred**2).mean(axis=1, keepdims=True))
    spread = np.where(spread > 0, spread, 1.0)
    unit = centred / spread
    out = []
    for s in slopes:
        s = s - s.mean(axis=1, keepdims=True)
        out.append(s / spread - unit * (unit * s / spread).mean(axis=1, keepdims=True))
    return unit, *out


def sample(grids: np.ndarray, points: np.ndarray, how: Sampling):
    """Descriptors (n, nodes * channels) at the points, with d/dr and d/dc. Nodes are offset by (x, y): columns by x, rows by y."""
    parts = []
    for x, y in how.nodes:
        value, by_r, by_c, _ = SAMPLERS[how.mode](grids, points + [y, x])
        parts.append((value, by_r, by_c))
    value, by_r, by_c = (np.stack(p, axis=1) for p in zip(*parts))
    if how.ncc_normalize:
        value, by_r, by_c = ncc_normalise(value, by_r, by_c)
    if how.l2_normalize:
        value, by_r, by_c = l2_normalise(value, by_r, by_c)
    return tuple(a.reshape(len(points), -1) for a in (value, by_r, by_c))


def inside(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Strictly inside the grid in both directions."""
    return ((points > 0) & (points < [h, w])).all(axis=1)


def crop(grid: np.ndarray, row: int, col: int, patch: int) -> np.ndarray:
    """The patch x patch window whose first pixel is (row, col), cut at the borders of the grid."""
    return grid[max(row, 0) : row + patch, max(col, 0) : col + patch]
