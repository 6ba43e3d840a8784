"""Cameras and poses. Column versions keep projections inside generated code; NumPy versions serve the solvers, vectorised over rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions of (fx, fy, cx, cy) in a model's parameters, and its distortion parameters after them.
MODELS = {
    "SIMPLE_PINHOLE": ((0, 0, 1, 2), ()),
    "PINHOLE": ((0, 1, 2, 3), ()),
    "SIMPLE_RADIAL": ((0, 0, 1, 2), (3,)),
    "RADIAL": ((0, 0, 1, 2), (3, 4)),
    "OPENCV": ((0, 1, 2, 3), (4, 5, 6, 7)),
}
#: Models that the fronto-parallel patch warp accepts.
WARP_MODELS = ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL")


# Columns -----------------------------------------------------------------------------------------------------------------------


def _param(params: Column, number: int) -> Column:
    return F.get(params, F.lit(number))


def _by_model(model: Column, value) -> Column:
    """CASE over the camera models; NULL for a model that is not known."""
    out = None
    for name, (places, extra) in MODELS.items():
        out = F.when(model == name, value(places, extra)) if out is None else out.when(model == name, value(places, extra))
    return out


def unit_quaternion(q: list[Column]) -> list[Column]:
    size = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return [c / size for c in q]


def rotate(q: list[Column], p: list[Column]) -> list[Column]:
    """Rotation of p by the quaternion w, x, y, z, which is brought to unit length."""
    w, x, y, z = unit_quaternion(q)
    a, b, c = p
    return [
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c,
        2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    ]


def to_camera(q: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    return [r + s for r, s in zip(rotate(q, p), t)]


def depth(q: list[Column], t: list[Column], p: list[Column]) -> Column:
    """Depth of a point along the viewing axis."""
    return to_camera(q, t, p)[2]


def distorted(model: Column, params: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The model's coefficients are chosen first, so that u and v, which may be long expressions, stand in one formula only."""
    coefficient = lambda n: _by_model(model, lambda _, extra: _param(params, extra[n]) if n < len(extra) else F.lit(0.0))
    k1, k2, p1, p2 = (coefficient(n) for n in range(4))
    r2 = u * u + v * v
    radial = 1 + r2 * (k1 + k2 * r2)
    return u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + 2 * p2 * u * v + p1 * (r2 + 2 * v * v)


def camera_to_pixel(model: Column, params: Column, u: Column, v: Column) -> tuple[Column, Column]:
    fx, fy, cx, cy = (_by_model(model, lambda at, _, n=n: _param(params, at[n])) for n in range(4))
    du, dv = distorted(model, params, u, v)
    return fx * du + cx, fy * dv + cy


def world_to_pixel(model: Column, params: Column, q: list[Column], t: list[Column], p: list[Column]) -> tuple[Column, Column]:
    """Pixel of a world point; NULL behind the camera and for unknown models."""
    x, y, z = to_camera(q, t, p)
    front = F.when(z > 0, z)
    return camera_to_pixel(model, params, x / front, y / front)


def reprojection_error(model: Column, params: Column, q: list[Column], t: list[Column], p: list[Column], x: Column, y: Column) -> Column:
    u, v = world_to_pixel(model, params, q, t, p)
    return F.hypot(u - x, v - y)


def pose_error(q1: list[Column], t1: list[Column], q2: list[Column], t2: list[Column]) -> tuple[Column, Column]:
    """Distance of the camera centres, and angle between the rotations in degrees."""
    back = lambda q, t: rotate([q[0], -q[1], -q[2], -q[3]], t)
    gap = [a - b for a, b in zip(back(q1, t1), back(q2, t2))]
    a, b = unit_quaternion(q1), unit_quaternion(q2)
    inner = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    cosine = F.least(F.greatest(2 * inner * inner - 1, F.lit(-1.0)), F.lit(1.0))  # (trace(R1 R2') - 1) / 2
    return F.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2), F.degrees(F.acos(cosine))


def epipolar_line(f: list[Column], x: Column, y: Column) -> list[Column]:
    """Line F (x, y, 1) of a row-major 3 x 3 matrix."""
    return [f[3 * r] * x + f[3 * r + 1] * y + f[3 * r + 2] for r in range(3)]


def line_at_borders(line: list[Column], width: Column) -> tuple[Column, Column]:
    """y of the line at the left and the right border; NULL for a vertical line."""
    a, b, c = line
    slope = F.when(b != 0, b)
    return -c / slope, -(c + a * width) / slope


# NumPy, rows first -------------------------------------------------------------------------------------------------------------


def rotation_matrix(q: np.ndarray) -> np.ndarray:
    """(n, 4) quaternions w, x, y, z to (n, 3, 3)."""
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    w, x, y, z = np.moveaxis(q, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def quaternion(r: np.ndarray) -> np.ndarray:
    """(3, 3) rotation to w, x, y, z with w >= 0."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0],
        [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ]) / 3
    x, y, z, w = np.linalg.eigh(k)[1][:, -1]
    return np.array([w, x, y, z]) * (1 if w >= 0 else -1)


def turned(q: np.ndarray, step: np.ndarray) -> np.ndarray:
    """q (..., 4) after a small rotation by the vector step (..., 3), applied on the camera's side."""
    angle = np.linalg.norm(step, axis=-1, keepdims=True)
    axis = step / np.where(angle > 0, angle, 1)
    w, v, a, u = np.cos(angle / 2), np.sin(angle / 2) * axis, q[..., :1], q[..., 1:]
    return np.concatenate([w * a - (v * u).sum(axis=-1, keepdims=True), w * u + a * v + np.cross(v, u)], axis=-1)


def distort(model: str, params: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distorted coordinates (n, 2) and their Jacobian (n, 2, 2)."""
    k = [params[i] for i in MODELS[model][1]]
    u, v = uv[:, 0], uv[:, 1]
    r2 = u * u + v * v
    k1, k2 = (k[0] if k else 0.0), (k[1] if len(k) > 1 else 0.0)
    radial, slope = k1 * r2 + k2 * r2 * r2, k1 + 2 * k2 * r2  # slope: d radial / d r2
    jac = np.empty((len(uv), 2, 2))
    jac[:, 0, 0], jac[:, 1, 1] = 1 + radial + 2 * slope * u * u, 1 + radial + 2 * slope * v * v
    jac[:, 0, 1] = jac[:, 1, 0] = 2 * slope * u * v
    out = uv * (1 + radial)[:, None]
    if len(k) == 4:
        p1, p2 = k[2:]
        out = out + np.stack([2 * p1 * u * v + p2 * (r2 + 2 * u * u), 2 * p2 * u * v + p1 * (r2 + 2 * v * v)], axis=1)
        jac[:, 0, 0] += 2 * p1 * v + 6 * p2 * u
        jac[:, 0, 1] += 2 * p1 * u + 2 * p2 * v
        jac[:, 1, 0] += 2 * p2 * v + 2 * p1 * u
        jac[:, 1, 1] += 2 * p2 * u + 6 * p1 * v
    return out, jac


def n_params(model: str) -> int:
    places, extra = MODELS[model]
    return max(*places, *extra) + 1


def to_pixels(model: str, params: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of normalised coordinates, and the Jacobian by them. params: one camera (k,), or one per row (k, n)."""
    fx, fy, cx, cy = (params[i] for i in MODELS[model][0])
    out, jac = distort(model, params, uv)
    focal, centre = np.stack(np.broadcast_arrays(fx, fy), axis=-1), np.stack(np.broadcast_arrays(cx, cy), axis=-1)
    return out * focal + centre, jac * focal[..., :, None]


def undistort(model: str, params: np.ndarray, xy: np.ndarray, iterations: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Normalised coordinates of pixels, by Newton's method from the distorted ones; it stops when all squared steps are below the tolerance."""
    fx, fy, cx, cy = (params[i] for i in MODELS[model][0])
    pair = lambda a, b: np.stack(np.broadcast_arrays(a, b), axis=-1)
    target = (xy - pair(cx, cy)) / pair(fx, fy)
    uv = target.copy()
    if not MODELS[model][1]:
        return uv
    for _ in range(iterations):
        out, jac = distort(model, params, uv)
        step = np.linalg.solve(jac, (out - target)[:, :, None])[:, :, 0]
        uv -= step
        if len(step) == 0 or (step**2).sum(axis=1).max() < tolerance:
            break
    return uv


def project(model: str, params: np.ndarray, r: np.ndarray, t: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels (n, 2), Jacobian by the point in the camera (n, 2, 3), and that point (n, 3). r is (3, 3) or (n, 3, 3)."""
    p = (np.broadcast_to(r, (len(points), 3, 3)) @ points[:, :, None])[:, :, 0] + t
    z = p[:, 2]
    uv = p[:, :2] / z[:, None]
    pixels, by_uv = to_pixels(model, params, uv)
    by_p = np.zeros((len(p), 2, 3))
    by_p[:, 0, 0] = by_p[:, 1, 1] = 1 / z
    by_p[:, :, 2] = -uv / z[:, None]
    return pixels, by_uv @ by_p, p


def back_project(model: str, params: np.ndarray, r: np.ndarray, t: np.ndarray, xy: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """World points of pixels at given depths."""
    uv = undistort(model, params, xy)
    p = np.concatenate([uv, np.ones((len(uv), 1))], axis=1) * np.asarray(depths)[:, None]
    return (p - t) @ r


def by_params(model: str, params: np.ndarray, uv: np.ndarray) -> np.ndarray:
    """Jacobian (n, 2, k) of pixels by the camera's parameters."""
    places, extra = MODELS[model]
    out, _ = distort(model, params, uv)
    jac = np.zeros((len(uv), 2, len(params)))  # params: one camera (k,), or one per row (k, n)
    jac[:, 0, places[0]] += out[:, 0]
    jac[:, 1, places[1]] += out[:, 1]
    jac[:, 0, places[2]] = jac[:, 1, places[3]] = 1
    u, v, r2 = uv[:, 0], uv[:, 1], (uv**2).sum(axis=1)
    focal = np.stack(np.broadcast_arrays(params[places[0]], params[places[1]]), axis=-1)
    for number, place in enumerate(extra):
        if number < 2:
            jac[:, :, place] = uv * (r2 ** (number + 1))[:, None] * focal
        elif number == 2:
            jac[:, :, place] = np.stack([2 * u * v, r2 + 2 * v * v], axis=1) * focal
        else:
            jac[:, :, place] = np.stack([r2 + 2 * u * u, 2 * u * v], axis=1) * focal
    return jac
