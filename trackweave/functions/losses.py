"""Robust losses rho(s) of squared residuals s, with first and second derivative, for NumPy and for Spark columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
NAMES = ("trivial", "cauchy", "huber", "soft_l1")


def loss(name: str, scale: float = 0.25) -> Loss:
    """rho, rho' and rho'' by name; `scale` is where outliers begin, in residual units."""
    a, b = float(scale), float(scale) ** 2
    if name == "trivial":
        return lambda s: (s, np.ones_like(s), np.zeros_like(s))
    if name == "cauchy":

        def cauchy(s):
            first = 1 / (1 + s / b)
            return b * np.log1p(s / b), first, -(first**2) / b

        return cauchy
    if name == "huber":

        def huber(s):
            r = np.sqrt(np.maximum(s, b))
            out = s > b
            return np.where(out, 2 * a * r - b, s), np.where(out, a / r, 1.0), np.where(out, -a / (2 * r**3), 0.0)

        return huber
    if name == "soft_l1":

        def soft(s):
            root = np.sqrt(1 + s / b)
            return 2 * b * (root - 1), 1 / root, -1 / (2 * b * root**3)

        return soft
    raise ValueError(f"unknown loss {name!r}; one of {', '.join(NAMES)}")


def rho(name: str, s: Column, scale: float = 0.25) -> Column:
    """The loss value as a column."""
    a, b = float(scale), float(scale) ** 2
    if name == "trivial":
        return s
    if name == "cauchy":
        return F.lit(b) * F.log1p(s / b)
    if name == "huber":
        return F.when(s > b, 2 * a * F.sqrt(s) - b).otherwise(s)
    if name == "soft_l1":
        return 2 * b * (F.sqrt(1 + s / b) - 1)
    raise ValueError(f"unknown loss {name!r}; one of {', '.join(NAMES)}")
