"""Cost maps: per patch pixel the robust distance of its descriptor to a reference, with gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import arrays, losses
from trackweave.functions.interpolation import Sampling, sample
from trackweave.operators.sampling import PATCH

#: A smaller cost has no gradient.
LEAST_COST = 1e-8


def cost_map(grid: np.ndarray, reference: np.ndarray, loss_name: str = "cauchy", scale: float = 0.25, upsampling: int = 1, gradients: bool = True, cross: bool = False, apply_sqrt: bool = False, how: Sampling = Sampling(l2_normalize=False)) -> np.ndarray:
    """(h * upsampling, w * upsampling, 1 | 3 | 4): cost, and d/dr, d/dc, d2/drdc of it if asked for.

    On the grid of the patch itself, without cross derivative, stored values and central differences serve; else the patch is
    sampled at (x / upsampling, y / upsampling).
    """
    h, w, _ = grid.shape
    rho = losses.loss(loss_name, scale)
    rows, cols = np.meshgrid(np.arange(h * upsampling), np.arange(w * upsampling), indexing="ij")
    at = np.stack([rows.ravel(), cols.ravel()], axis=1) / upsampling
    crossed = 0.0
    if upsampling == 1 and not cross and not (how.l2_normalize or how.ncc_normalize):
        value = grid.reshape(h * w, -1).astype(float)
        slope = lambda axis, n: ((np.take(grid, np.minimum(np.arange(n) + 1, n - 1), axis) - np.take(grid, np.maximum(np.arange(n) - 1, 0), axis)) / 2).reshape(h * w, -1)
        by_r, by_c = slope(0, h), slope(1, w)
    else:
        value, by_r, by_c = sample(grid[None], at, how)
        if cross:
            from trackweave.functions.interpolation import SAMPLERS

            crossed = SAMPLERS[how.mode](grid[None], at)[3]
    residual = value - reference
    cost, first, second = rho((residual**2).sum(axis=1))
    cost = cost / 2
    channels = [cost]
    if gradients:
        rr, rc = (residual * by_r).sum(axis=1), (residual * by_c).sum(axis=1)
        dr, dc = first * rr, first * rc
        channels += [dr, dc]
        if cross:
            channels.append(2 * second * rr * rc + first * (by_r * by_c + crossed * residual).sum(axis=1))
        channels[1:] = [np.where(cost > LEAST_COST, c, 0.0) for c in channels[1:]]
    if apply_sqrt:
        root = np.sqrt(cost)
        channels = [root] + [np.where(root > 0, c * 0.5 / np.maximum(root, 1e-300), 0.0) if i < 2 else c for i, c in enumerate(channels[1:])]
    return np.stack(channels, axis=1).reshape(h * upsampling, w * upsampling, -1)


def extract_costmaps(patches: DataFrame, loss_name: str = "cauchy", scale: float = 0.25, upsampling: int = 1, gradients: bool = True, cross: bool = False, apply_sqrt: bool = False) -> DataFrame:
    """PATCH rows of cost maps from PATCH rows that carry their `reference` ARRAY<DOUBLE> (one node). Rows that do not fit their shape or reference are left out."""
    order = [f.strip().split(" ")[0] for f in PATCH.split(",")]
    fit = patches.where((F.size("reference") == F.col("c")) & (F.size("data") == F.col("h") * F.col("w") * F.col("c")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            maps = [cost_map(np.asarray(d, np.float64).reshape(h, w, c), np.asarray(r, float), loss_name, scale, upsampling, gradients, cross, apply_sqrt) for d, h, w, c, r in zip(part["data"], part["h"], part["w"], part["c"], part["reference"])]
            part = part.assign(h=[m.shape[0] for m in maps], w=[m.shape[1] for m in maps], c=[m.shape[2] for m in maps], upsampling=part["upsampling"] * upsampling, data=[m.ravel().astype(np.float32) for m in maps])
            yield part[order]

    return fit.select(*order, "reference").mapInPandas(run, PATCH)


def costmap_shapes(patches: DataFrame, gradients: bool = True, cross: bool = False) -> DataFrame:
    """The patches' metadata as their cost maps will have it, without any data."""
    return patches.withColumn("c", F.lit(1 if not gradients else 4 if cross else 3)).drop("data")


def pixel_costs(data: Column, reference: Column, h: Column, w: Column, c: int, loss_name: str = "cauchy", scale: float = 0.25) -> Column:
    """ARRAY<DOUBLE> of the costs of all pixels, in generated code."""
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda k: losses.rho(loss_name, arrays.squared_distance(F.slice(data, (k * c + 1).cast("int"), c), reference), scale) * 0.5)
