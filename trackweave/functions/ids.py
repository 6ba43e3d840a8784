"""Identifier and coordinate arithmetic as Spark columns: pair ids, coordinate conventions, patch pixels, corners and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pair_id = smaller image id * PAIR_BASE + larger image id.
PAIR_BASE = 2**31 - 1
#: Fixed value: key of the one dense patch of an image in imported caches; a NULL kp_id here.
DENSE_KEY = 1_000_000
HALF_PIXEL = 0.5


def to_corner_origin(x: Column) -> Column:
    """From pixel-centre coordinates (first pixel at 0) to corner coordinates (first pixel at 0.5)."""
    return x + F.lit(HALF_PIXEL)


def to_centre_origin(x: Column) -> Column:
    return x - F.lit(HALF_PIXEL)


def pair_id(a: Column, b: Column) -> Column:
    """One id for two images in either order; NULL if one is NULL."""
    small, large = F.least(a, b).cast("bigint"), F.greatest(a, b).cast("bigint")
    return F.when(a.isNotNull() & b.isNotNull(), small * F.lit(PAIR_BASE) + large)


def pair_images(pair: Column) -> tuple[Column, Column]:
    second = pair % F.lit(PAIR_BASE)
    return F.floor((pair - second) / F.lit(PAIR_BASE)).cast("bigint"), second


def to_pixel(x: Column, scale: Column, corner: Column, upsampling: Column) -> Column:
    """Image coordinate to coordinate on the patch grid."""
    return (x * scale - F.lit(0.5) - corner) * upsampling


def to_image(u: Column, scale: Column, corner: Column, upsampling: Column) -> Column:
    return (u / upsampling + corner + F.lit(0.5)) / scale


def clamped_corner(u: Column, patch: int, size: Column) -> Column:
    """Corner of a patch around a grid coordinate: truncated toward zero, within [0, size - patch]."""
    return F.least(F.greatest((u - F.lit(patch / 2.0)).cast("int"), F.lit(0)), size - F.lit(patch)).cast("int")


def extraction_corner(x: Column, scale: Column, patch: int, size: Column) -> Column:
    """Corner used when patches are cut from a feature map: no half-pixel shift, at most size - patch - 1."""
    return F.least(F.greatest((x * scale - F.lit(patch / 2.0)).cast("int"), F.lit(0)), size - F.lit(patch) - F.lit(1)).cast("int")


def keypoint_bounds(x: Column, corner: Column, size: Column, scale: Column, bound: float) -> tuple[Column, Column]:
    """Interval in which a keypoint may move: the extent of its patch, and at most `bound` feature pixels from where it is (bound <= 0: the patch only)."""
    low = (corner + F.lit(0.5)) / scale
    high = low + size / scale
    if bound > 0:
        low, high = F.greatest(low, x - F.lit(float(bound)) / scale), F.least(high, x + F.lit(float(bound)) / scale)
    return low, high


def scaled_size(w: Column, h: Column, max_edge: int, pyramid_scale: float = 1.0) -> tuple[Column, Column]:
    """Image size after the longer edge is cut down to max_edge and the pyramid scale applied; halves go to the even number."""
    factor = F.least(F.lit(float(max_edge)) / F.greatest(w, h), F.lit(1.0)) * F.lit(float(pyramid_scale))
    return F.bround(w * factor).cast("int"), F.bround(h * factor).cast("int")


def node_coordinates(x: Column, offset: Column, scale: Column) -> Column:
    """A keypoint plus a node offset given in feature pixels."""
    return x + offset / scale


def strictly_inside(v: Column, limit: Column | int) -> Column:
    return (v > 0) & (v < limit)


def level_order(levels: int, chosen: list[int] | None = None) -> list[int]:
    """Levels from coarse to fine, unless chosen."""
    return list(range(levels - 1, -1, -1)) if chosen is None else list(chosen)


def patch_bytes(h: Column, w: Column, c: Column, width: int = 4) -> Column:
    return h.cast("bigint") * w * c * F.lit(width)
