"""Levenberg-Marquardt with robust losses, bounds and fixed parameters: one problem, or many small ones in step (NumPy)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.losses import Loss, loss

Residuals = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Options:
    """When to stop, and the loss. Residual blocks have `block` rows each: the loss is applied to the squared norm of a block."""

    max_iterations: int = 100
    parameter_tolerance: float = 1e-5
    function_tolerance: float = 0.0
    gradient_tolerance: float = 0.0
    loss_name: str = "cauchy"
    loss_scale: float = 0.25


@dataclass
class Summary:
    initial_cost: float
    final_cost: float
    num_residuals: int
    iterations: int
    termination: str
    history: list[float] = field(default_factory=list)


def robust_cost(residuals: np.ndarray, weights: np.ndarray, rho: Loss) -> float:
    return float(0.5 * (weights * rho((residuals**2).sum(axis=1))[0]).sum())


def minimise(
    start: np.ndarray,
    residuals: Residuals,
    options: Options = Options(),
    weights: np.ndarray | None = None,
    low: np.ndarray | None = None,
    high: np.ndarray | None = None,
    fixed: np.ndarray | None = None,
    plus: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, Summary]:
    """Minimises sum_i w_i rho(|r_i|^2) / 2.

    residuals(x) gives r (blocks, k) and its Jacobian (blocks, k, steps). Steps are added by `plus` (default: x + step), clipped to
    the bounds; `fixed` marks steps that stay zero. A step is accepted only if the cost falls, so it never rises.
    """
    rho = loss(options.loss_name, options.loss_scale)
    x = np.array(start, float)
    r, jac = residuals(x)
    weights = np.ones(len(r)) if weights is None else np.asarray(weights, float)
    free = np.ones(jac.shape[2], bool) if fixed is None else ~np.asarray(fixed, bool)
    cost = robust_cost(r, weights, rho)
    summary = Summary(cost, cost, r.size, 0, "no free parameters", [cost])
    if not free.any() or not r.size:
        return x, summary
    damping, grow = 1e-4, 2.0
    summary.termination = "iterations"
    for summary.iterations in range(1, options.max_iterations + 1):
        first = weights * rho((r**2).sum(axis=1))[1]
        jac_free = jac[:, :, free]
        hessian = np.einsum("n,nki,nkj->ij", first, jac_free, jac_free)
        gradient = np.einsum("n,nki,nk->i", first, jac_free, r)
        if np.abs(gradient).max() <= options.gradient_tolerance:
            summary.termination = "gradient"
            break
        scale = np.clip(np.diag(hessian), 1e-6, 1e32)
        try:
            move = -np.linalg.solve(hessian + damping * np.diag(scale), gradient)
        except np.linalg.LinAlgError:
            damping, grow = damping * grow, grow * 2
            continue
        step = np.zeros(len(free))
        step[free] = move
        candidate = x + step if plus is None else plus(x, step)
        if low is not None:
            candidate = np.clip(candidate, low, high)
        new_r, new_jac = residuals(candidate)
        new_cost = robust_cost(new_r, weights, rho)
        if np.isfinite(new_cost) and new_cost < cost:
            change, fall = np.linalg.norm(candidate - x), (cost - new_cost) / max(cost, 1e-300)
            size = np.linalg.norm(x)
            x, r, jac, cost = candidate, new_r, new_jac, new_cost
            summary.history.append(cost)
            damping, grow = max(damping / 3, 1e-16), 2.0
            if change <= options.parameter_tolerance * (size + options.parameter_tolerance):
                summary.termination = "parameters"
                break
            if fall <= options.function_tolerance:
                summary.termination = "function"
                break
        else:
            damping, grow = damping * grow, grow * 2
            if damping > 1e16 or np.linalg.norm(step) <= 1e-14 * (np.linalg.norm(x) + 1e-14):
                summary.termination = "no better step"
                break
    summary.final_cost = cost
    return x, summary


# Many problems of one size at once ------------------------------------------------------------------------------------------------

#: Cost, Gauss-Newton matrix and gradient of the problems `which` at x: evaluate(x (n, d), which (n,)) -> (n,), (n, d, d), (n, d).
Normal = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

SUMMARY = "initial_cost double, final_cost double, num_residuals bigint, iterations int, termination string, history array<double>"
SUMMARY_NAMES = [f.split()[0] for f in SUMMARY.split(", ")]


@dataclass
class Summaries:
    initial_cost: np.ndarray
    final_cost: np.ndarray
    num_residuals: np.ndarray
    iterations: np.ndarray
    termination: np.ndarray
    history: list[list[float]]

    def rows(self) -> dict[str, object]:
        return {name: getattr(self, name) for name in SUMMARY_NAMES}


def minimise_many(
    start: np.ndarray,
    evaluate: Normal,
    options: Options = Options(),
    num_residuals: np.ndarray | int = 0,
    low: np.ndarray | None = None,
    high: np.ndarray | None = None,
    fixed: np.ndarray | None = None,
    plus: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, Summaries]:
    """`minimise` for many independent problems in step, each with its own damping and end; the rules and results are those of one problem at a time.

    start: (n, values); steps have the width of the gradient. `fixed` (n, steps) marks steps that stay zero.
    """
    x, n = np.array(start, float), len(start)
    cost, hessian, gradient = evaluate(x, np.arange(n))
    width = gradient.shape[1]
    held = np.zeros((n, width), bool) if fixed is None else np.asarray(fixed, bool)
    counts = np.broadcast_to(num_residuals, n)
    summary = Summaries(cost.copy(), cost, counts, np.zeros(n, int), np.full(n, "iterations", object), [[c] for c in cost.tolist()])
    none = held.all(axis=1) | (counts == 0)
    summary.termination[none] = "no free parameters"
    active, damping, grow = ~none, np.full(n, 1e-4), np.full(n, 2.0)
    eye = np.eye(width)

    def end(which: np.ndarray, why: str) -> None:
        summary.termination[which], active[which] = why, False

    for iteration in range(1, options.max_iterations + 1):
        at = np.nonzero(active)[0]
        if not len(at):
            break
        summary.iterations[at] = iteration
        flat = np.abs(np.where(held[at], 0, gradient[at])).max(axis=1) <= options.gradient_tolerance
        end(at[flat], "gradient")
        at = at[~flat]
        scale = np.clip(np.diagonal(hessian[at], axis1=1, axis2=2), 1e-6, 1e32)
        system = hessian[at] + (damping[at, None] * scale)[:, :, None] * eye
        stay = held[at]
        system[stay[:, :, None] | stay[:, None, :]] = 0
        system[np.broadcast_to(eye.astype(bool), system.shape) & stay[:, :, None]] = 1
        step = -_solved(system, np.where(stay, 0, gradient[at]))
        good = np.isfinite(step).all(axis=1)
        step[~good] = 0
        candidate = x[at] + step if plus is None else plus(x[at], step)
        if low is not None:
            candidate = np.clip(candidate, low[at], high[at])
        new_cost, new_hessian, new_gradient = evaluate(candidate, at)
        better = good & np.isfinite(new_cost) & (new_cost < cost[at])
        win, lose = at[better], at[~better]
        change, size = np.linalg.norm(candidate[better] - x[win], axis=1), np.linalg.norm(x[win], axis=1)
        fall = (cost[win] - new_cost[better]) / np.maximum(cost[win], 1e-300)
        x[win], cost[win], hessian[win], gradient[win] = candidate[better], new_cost[better], new_hessian[better], new_gradient[better]
        for i, c in zip(win.tolist(), new_cost[better].tolist()):
            summary.history[i].append(c)
        damping[win], grow[win] = np.maximum(damping[win] / 3, 1e-16), 2.0
        small = change <= options.parameter_tolerance * (size + options.parameter_tolerance)
        end(win[fall <= options.function_tolerance], "function")
        end(win[small], "parameters")
        damping[lose], grow[lose] = damping[lose] * grow[lose], grow[lose] * 2
        still = np.linalg.norm(step[~better], axis=1) <= 1e-14 * (np.linalg.norm(x[lose], axis=1) + 1e-14)
        end(lose[(damping[lose] > 1e16) | (still & good[~better])], "no better step")
    return x, summary


def _solved(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many systems; NaN where one is singular."""
    try:
        return np.linalg.solve(system, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full_like(right, np.nan)
        for i, (a, b) in enumerate(zip(system, right)):
            try:
                out[i] = np.linalg.solve(a, b)
            except np.linalg.LinAlgError:
                pass
        return out


#: Numbers of patches and descriptors that one call of a batch solver takes, about (64 MB); a larger problem is solved alone.
AT_ONCE = 2**23


def by_problem(frame: DataFrame, key: str, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`solve` on runs of whole problems (rows of equal `key`), as many at a time as AT_ONCE allows. Rows with a NULL key are left out.

    Problems are co-partitioned by key and sorted within the partitions, which may spill; a task holds one run at a time.
    """

    def weight(rows: pd.DataFrame) -> int:
        return sum(int(rows[c].map(lambda v: len(v) if v is not None else 0).sum()) for c in rows.columns if len(rows) and isinstance(rows[c].iloc[0], np.ndarray)) + rows.size

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, load = [], 0
        for part in parts:
            for start in range(0, len(part), 256):
                piece = part.iloc[start : start + 256]
                waiting.append(piece)
                load += weight(piece)
                if load < AT_ONCE:
                    continue
                rows = pd.concat(waiting)
                last = (rows[key] == rows[key].iloc[-1]).to_numpy()
                if not last.all():
                    yield solve(rows[~last])
                waiting = [rows[last]]
                load = weight(waiting[0])
        if waiting:
            yield solve(pd.concat(waiting))

    return frame.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
