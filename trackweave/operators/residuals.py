"""Residuals with analytic Jacobians (NumPy). They serve the solvers and can be evaluated on their own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from trackweave.functions import geometry, interpolation
from trackweave.functions.interpolation import Sampling


@dataclass
class Patch:
    """Feature grid (h, w, c) with its corner (x, y) on the feature map, scale (x, y) to the image, and upsampling."""

    data: np.ndarray
    corner: np.ndarray
    scale: np.ndarray
    upsampling: float = 1.0

    def sample(self, xy: np.ndarray, how: Sampling) -> tuple[np.ndarray, np.ndarray]:
        """Descriptors (n, k) at image coordinates (n, 2), and their Jacobian (n, k, 2) by x and y."""
        uv = (xy * self.scale - 0.5 - self.corner) * self.upsampling
        value, by_r, by_c = interpolation.sample(self.data[None], uv[:, ::-1], how)
        return value, np.stack([by_c, by_r], axis=2) * (self.scale * self.upsampling)


@dataclass
class Camera:
    model: str
    params: np.ndarray


def pair_2d(patch_a: Patch, a: np.ndarray, patch_b: Patch, b: np.ndarray, how: Sampling) -> tuple[np.ndarray, np.ndarray]:
    """Descriptor difference of two keypoints: residual (k,), Jacobian (k, 4) by both keypoints."""
    (da, ja), (db, jb) = patch_a.sample(a[None], how), patch_b.sample(b[None], how)
    return da[0] - db[0], np.concatenate([ja[0], -jb[0]], axis=1)


def reference_2d(patch: Patch, xy: np.ndarray, reference: np.ndarray, how: Sampling) -> tuple[np.ndarray, np.ndarray]:
    """Descriptor at a keypoint minus a fixed one: residual (k,), Jacobian (k, 2)."""
    d, j = patch.sample(xy[None], how)
    return d[0] - reference, j[0]


def pose_columns(by_p: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Jacobian by a small turn on the camera's side and by the translation, from that by the point in the camera; p is the rotated point before the translation."""
    turn = np.zeros((len(p), 3, 3))
    turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 0], turn[:, 1, 2], turn[:, 2, 0], turn[:, 2, 1] = p[:, 2], -p[:, 1], -p[:, 2], p[:, 0], p[:, 1], -p[:, 0]
    return np.concatenate([by_p @ turn, by_p], axis=2)


def geometric(camera: Camera, r: np.ndarray, t: np.ndarray, points: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Reprojection residuals (n, 2) and Jacobians by turn, translation, point and camera parameters."""
    pixels, by_p, p = geometry.project(camera.model, camera.params, r, t, points)
    rotated = p - t
    pose = pose_columns(by_p, rotated)
    return pixels - xy, {"turn": pose[:, :, :3], "t": by_p, "point": by_p @ r, "params": geometry.by_params(camera.model, camera.params, p[:, :2] / p[:, 2:])}


def feature_reference(patch: Patch, camera: Camera, r: np.ndarray, t: np.ndarray, point: np.ndarray, reference: np.ndarray | None, how: Sampling, offsets: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Descriptor at the projected point minus the reference; without reference (cost maps) the sampled value itself.

    offsets (nodes, 3): each node is projected on its own instead of being laid out in the patch.
    """
    points = point[None] if offsets is None else point + offsets
    pixels, by = geometric(camera, r, t, points, np.zeros((len(points), 2)))
    nodes = how if offsets is None else Sampling(how.mode, how.l2_normalize, how.ncc_normalize, ((0.0, 0.0),))
    value, jac = patch.sample(pixels, nodes)
    residual = value.ravel() if reference is None else value.ravel() - reference
    return residual, {name: np.einsum("nki,nij->nkj", jac, b).reshape(residual.size, -1) for name, b in by.items()}


def patch_warp(source: Patch, source_camera: Camera, source_r: np.ndarray, source_t: np.ndarray, target: Patch, camera: Camera, r: np.ndarray, t: np.ndarray, point: np.ndarray, how: Sampling) -> np.ndarray:
    """Difference of the target's and the source's descriptors, the source's nodes carried over by the plane through the point that faces the source."""
    if camera.model not in geometry.WARP_MODELS or source_camera.model not in geometry.WARP_MODELS:
        raise ValueError("the patch warp takes " + ", ".join(geometry.WARP_MODELS))
    pixel, _, p = geometry.project(source_camera.model, source_camera.params, source_r, source_t, point[None])
    places = pixel + np.array(how.nodes) / source.scale / source.upsampling
    single = Sampling(how.mode, False, False, ((0.0, 0.0),))
    world = geometry.back_project(source_camera.model, source_camera.params, source_r, source_t, places, np.full(len(places), p[0, 2]))
    there, _, _ = geometry.project(camera.model, camera.params, r, t, world)

    def normal(value: np.ndarray) -> np.ndarray:
        value = value[None]
        if how.ncc_normalize:
            (value,) = interpolation.ncc_normalise(value)
        if how.l2_normalize:
            (value,) = interpolation.l2_normalise(value)
        return value.ravel()

    return normal(target.sample(there, single)[0]) - normal(source.sample(places, single)[0])
