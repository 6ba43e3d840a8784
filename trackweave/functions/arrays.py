"""Array arithmetic as Spark columns. Arrays are cast to DOUBLE first; a NULL array gives NULL, arrays of different length NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.transform(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y), lambda d: d * d))


def l2_normalised(a: Column) -> Column:
    """Unit length; a vector without length has no direction and gives NULL entries."""
    size = norm(a)
    return F.transform(doubles(a), lambda v: F.when(size > 0, v / size))


def row(a: Column, number: Column | int, width: int) -> Column:
    """Row `number` (from 0) of a row-major matrix of `width` columns."""
    return F.slice(a, (F.lit(number) if isinstance(number, int) else number) * F.lit(width) + F.lit(1), width)


def ncc_normalised(a: Column, channels: int) -> Column:
    """Per channel over the nodes of a row-major nodes x channels matrix: minus the mean, over the population deviation (0 counts as 1)."""
    values = doubles(a)
    nodes = (F.size(values) / F.lit(channels)).cast("int")
    places = F.sequence(F.lit(0), F.lit(channels - 1))
    column = lambda c: F.filter(values, lambda _, i: i % F.lit(channels) == c)
    # Sums of a channel bound to a struct, so that each is formed once.
    first = F.transform(places, lambda c: F.struct(column(c).alias("v"), (total(column(c)) / nodes).alias("m")))
    spread = F.transform(first, lambda x: F.struct(x["m"].alias("m"), F.sqrt(total(F.transform(x["v"], lambda y: (y - x["m"]) * (y - x["m"]))) / nodes).alias("s")))
    return F.transform(F.arrays_zip(values.alias("v"), F.flatten(F.array_repeat(spread, nodes)).alias("k")), lambda z: (z["v"] - z["k"]["m"]) / F.when(z["k"]["s"] > 0, z["k"]["s"]).otherwise(F.lit(1.0)))


def clamped_value(data: Column, h: Column, w: Column, c: Column, row_: Column, col_: Column, channel: int) -> Column:
    """Value of a row-major, channel-last grid; reads outside meet the border."""
    r = F.least(F.greatest(row_, F.lit(0)), h - 1)
    k = F.least(F.greatest(col_, F.lit(0)), w - 1)
    return F.element_at(data, ((r * w + k) * c + F.lit(channel) + 1).cast("int")).cast("double")


def bilinear(data: Column, h: Column, w: Column, c: Column, u: Column, v: Column, channel: int) -> Column:
    """Value at column u, row v."""
    k, r = F.floor(u).cast("int"), F.floor(v).cast("int")
    fu, fv = u - k, v - r
    at = lambda dr, dk: clamped_value(data, h, w, c, r + dr, k + dk, channel)
    return (at(0, 0) * (1 - fu) + at(0, 1) * fu) * (1 - fv) + (at(1, 0) * (1 - fu) + at(1, 1) * fu) * fv


def nearest(data: Column, h: Column, w: Column, c: Column, u: Column, v: Column, channel: int) -> Column:
    """Value at the nearest grid point; halves go away from zero."""
    return clamped_value(data, h, w, c, F.round(v).cast("int"), F.round(u).cast("int"), channel)
