"""NumPy kernels: interpolation, normalisation, cameras, losses, solver, cost maps."""

import numpy as np
import pytest

from trackweave import conf
from trackweave.functions import geometry, interpolation, losses
from trackweave.functions.interpolation import SAMPLERS, Sampling, sample
from trackweave.operators import residuals
from trackweave.operators.costmaps import cost_map
from trackweave.operators.graph import pack_by_size
from trackweave.operators.localize import absolute_pose
from trackweave.operators.references import robust_mean
from trackweave.operators.residuals import Camera, Patch
from trackweave.operators.solver import Options, minimise

RNG = np.random.default_rng(0)


def quadratic(coefficients, channels):
    """A surface x' C x with x = (r, c, 1), scaled per channel, on a 10 x 10 grid, and its exact values and slopes."""
    scale = np.arange(channels) ** 2 + 1.0

    def at(rc):
        x = np.concatenate([rc, np.ones((len(rc), 1))], axis=1)
        value = np.einsum("ni,ij,nj->n", x, coefficients, x)
        slope = x @ (coefficients + coefficients.T)
        return value[:, None] * scale, slope[:, :1] * scale, slope[:, 1:2] * scale

    rows, cols = np.meshgrid(np.arange(10.0), np.arange(10.0), indexing="ij")
    return at(np.stack([rows.ravel(), cols.ravel()], axis=1))[0].reshape(1, 10, 10, channels), at


def matrix(**entries):
    c = np.zeros((3, 3))
    for key, v in entries.items():
        c[int(key[1]), int(key[2])] = v
    return c


SURFACES = [matrix(), matrix(c22=1), matrix(c22=1, c02=0.1, c20=0.1), matrix(c22=1, c01=0.1, c10=0.1), matrix(c01=0.1, c10=0.1, c02=0.2, c20=0.2)]


@pytest.mark.parametrize("channels", [1, 2, 3])
@pytest.mark.parametrize("mode", ["BICUBIC", "CERES_BICUBIC", "BILINEAR"])
@pytest.mark.parametrize("surface", range(len(SURFACES)))
def test_surfaces_are_reproduced(mode, surface, channels):
    grid, exact = quadratic(SURFACES[surface], channels)
    g = np.linspace(1, 8, 100)
    points = np.stack([a.ravel() for a in np.meshgrid(g, g, indexing="ij")], axis=1)
    value, by_r, by_c, _ = SAMPLERS[mode](grid, points)
    for got, want in zip((value, by_r, by_c), exact(points)):
        assert np.abs(got - want).max() < 1e-8


@pytest.mark.parametrize("mode", ["BICUBIC", "BILINEAR", "BICUBICGRADIENTFIELD"])
def test_slopes_are_derivatives(mode):
    grid, points, e = RNG.normal(size=(1, 10, 10, 4)), RNG.uniform(2, 7, (80, 2)), 1e-6
    f = SAMPLERS[mode]
    _, by_r, by_c, cross = f(grid, points)
    assert np.abs((f(grid, points + [e, 0])[0] - f(grid, points - [e, 0])[0]) / (2 * e) - by_r).max() < 1e-6
    assert np.abs((f(grid, points + [0, e])[0] - f(grid, points - [0, e])[0]) / (2 * e) - by_c).max() < 1e-6
    assert np.abs((f(grid, points + [0, e])[1] - f(grid, points - [0, e])[1]) / (2 * e) - cross).max() < 1e-6


def test_nodes_of_gradient_fields_keep_their_values():
    grid = RNG.normal(size=(1, 6, 7, 4))
    rows, cols = np.meshgrid(np.arange(5.0), np.arange(6.0), indexing="ij")
    points = np.stack([rows.ravel(), cols.ravel()], axis=1)
    for mode in ("BICUBICGRADIENTFIELD", "POLYGRADIENTFIELD"):
        value, by_r, by_c, _ = SAMPLERS[mode](grid, points)
        at = interpolation.read(grid, *points.astype(int).T)
        assert np.allclose(value[:, 0], at[:, 0]) and np.allclose(by_r[:, 0], at[:, 1]) and np.allclose(by_c[:, 0], at[:, 2])
    value, by_r, by_c, _ = SAMPLERS["BICUBICCHAIN"](grid[..., :3], points)
    assert np.allclose(value[:, 0], grid[0, :5, :6, 0].ravel()) and np.allclose(by_r[:, 0], grid[0, :5, :6, 1].ravel())


def test_nearest_and_borders():
    grid = np.arange(8.0).reshape(1, 2, 4, 1)
    value = SAMPLERS["NEARESTNEIGHBOR"](grid, np.array([[0.5, 0.4], [-3, 9], [1.4, 2.5]]))[0]
    assert value[:, 0].tolist() == [4, 3, 7]


def test_normalisation():
    grid = np.array([1, 5, 2, 10, 2, 6, 3, 5, 1, 2, 2, 2, 2, 2, 3, 1], float).reshape(1, 2, 4, 2)
    points = np.array([[0.5, 2.5], [1.5, 1.5], [0.0, 3.0]])
    assert np.abs(np.linalg.norm(sample(grid, points, Sampling())[0], axis=1) - 1).max() < 1e-10
    nodes = Sampling(l2_normalize=False, ncc_normalize=True, nodes=((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5)))
    unit = sample(grid, points[:1], nodes)[0].reshape(4, 2)
    assert np.abs(unit.mean(axis=0)).max() < 1e-8 and np.abs(unit.std(axis=0) - 1).max() < 1e-8
    assert np.isfinite(sample(np.zeros((1, 3, 3, 2)), points[:1], Sampling())[0]).all()


@pytest.mark.parametrize("model", list(geometry.MODELS))
def test_cameras_round_trip(model):
    size = len(set(geometry.MODELS[model][0])) + len(geometry.MODELS[model][1])
    params = np.concatenate([[655.1, 651.1, 386.1, 511.1][4 - (size - len(geometry.MODELS[model][1])) :], [0.05, 0.03, 0.01, -0.01][: len(geometry.MODELS[model][1])]])
    uv = np.stack([a.ravel() for a in np.meshgrid(np.linspace(-0.5, 0.5, 11), np.linspace(-0.5, 0.5, 11))], axis=1)
    pixels, _ = geometry.to_pixels(model, params, uv)
    assert np.abs(geometry.undistort(model, params, pixels) - uv).max() < 1e-6
    r, t = geometry.rotation_matrix(np.array([[0.9, 0.1, -0.2, 0.1]]))[0], np.array([0.1, 0.2, 5.0])
    points = RNG.uniform(-1, 1, (30, 3))
    xy, _, p = geometry.project(model, params, r, t, points)
    assert np.abs(geometry.back_project(model, params, r, t, xy, p[:, 2]) - points).max() < 1e-6


def test_jacobians_of_projection():
    camera, e = Camera("OPENCV", np.array([600, 610, 300, 310, 0.1, 0.03, 0.01, -0.02])), 1e-6
    q, t, points = np.array([0.9, 0.1, -0.2, 0.1]), np.array([0.1, 0.2, 5.0]), RNG.uniform(-1, 1, (6, 3))
    q = q / np.linalg.norm(q)
    value = lambda q, t, x, k: residuals.geometric(Camera("OPENCV", k), geometry.rotation_matrix(q[None])[0], t, x, np.zeros((6, 2)))[0]
    by = residuals.geometric(camera, geometry.rotation_matrix(q[None])[0], t, points, np.zeros((6, 2)))[1]
    for i, d in enumerate(np.eye(3) * e):
        assert np.abs((value(geometry.turned(q, d), t, points, camera.params) - value(geometry.turned(q, -d), t, points, camera.params)) / (2 * e) - by["turn"][:, :, i]).max() < 1e-4
        assert np.abs((value(q, t + d, points, camera.params) - value(q, t - d, points, camera.params)) / (2 * e) - by["t"][:, :, i]).max() < 1e-4
        assert np.abs((value(q, t, points + d, camera.params) - value(q, t, points - d, camera.params)) / (2 * e) - by["point"][:, :, i]).max() < 1e-4
    for i, d in enumerate(np.eye(8) * e):
        assert np.abs((value(q, t, points, camera.params + d) - value(q, t, points, camera.params - d)) / (2 * e) - by["params"][:, :, i]).max() < 1e-4


@pytest.mark.parametrize("name", losses.NAMES)
def test_loss_derivatives(name):
    rho, s, e = losses.loss(name, 0.5), np.array([0.01, 0.2, 0.24, 0.3, 4.0]), 1e-6
    value, first, second = rho(s)
    assert np.abs((rho(s + e)[0] - rho(s - e)[0]) / (2 * e) - first).max() < 1e-6
    assert np.abs((rho(s + e)[1] - rho(s - e)[1]) / (2 * e) - second).max() < 1e-6
    assert np.abs(rho(s * 1e-6)[0] / (s * 1e-6) - 1).max() < 1e-4
    with pytest.raises(ValueError):
        losses.loss("none")


def test_solver_finds_the_minimum_within_bounds():
    def rosenbrock(x):
        return np.array([[1 - x[0]], [10 * (x[1] - x[0] ** 2)]]), np.array([[[-1.0, 0.0]], [[-20 * x[0], 10.0]]])

    options = Options(loss_name="trivial", parameter_tolerance=1e-12)
    x, summary = minimise(np.array([-1.2, 1.0]), rosenbrock, options)
    assert np.abs(x - 1).max() < 1e-6 and summary.final_cost < 1e-12 and np.all(np.diff(summary.history) < 0)
    x, _ = minimise(np.array([-1.2, 1.0]), rosenbrock, options, low=np.array([-2, -2.0]), high=np.array([0.5, 2.0]))
    assert x[0] <= 0.5 and abs(x[0] - 0.5) < 1e-3
    x, _ = minimise(np.array([-1.2, 1.0]), rosenbrock, options, fixed=np.array([True, False]))
    assert x[0] == -1.2 and abs(x[1] - 1.44) < 1e-6
    assert minimise(np.array([3.0, 4.0]), rosenbrock, options, fixed=np.ones(2, bool))[0].tolist() == [3.0, 4.0]


def test_robust_mean():
    same = np.tile([0.6, 0.8], (5, 1))
    assert np.abs(robust_mean(same) - [0.6, 0.8]).max() < 1e-12
    points = np.concatenate([RNG.normal(0, 0.01, (9, 3)), [[5.0, 5.0, 5.0]]])
    assert np.linalg.norm(robust_mean(points)) < 0.1 < np.linalg.norm(points.mean(axis=0))


def test_cost_maps():
    grid = RNG.normal(size=(5, 6, 4))
    out = cost_map(grid, grid[2, 3])
    assert out.shape == (5, 6, 3) and np.abs(out[2, 3]).max() == 0
    brute = losses.loss("cauchy", 0.25)(((grid - grid[2, 3]) ** 2).sum(axis=2))[0] / 2
    assert np.allclose(out[:, :, 0], brute)
    assert cost_map(grid, grid[0, 0], gradients=False).shape == (5, 6, 1) and cost_map(grid, grid[0, 0], cross=True, upsampling=2).shape == (10, 12, 4)
    assert np.allclose(cost_map(grid, grid[2, 3], apply_sqrt=True)[:, :, 0] ** 2, brute)


def test_patch_warp_is_zero_for_one_view_and_reference_is_met():
    grid = RNG.normal(size=(16, 16, 3))
    patch, camera = Patch(grid, np.zeros(2), np.ones(2)), Camera("SIMPLE_RADIAL", np.array([20.0, 8.0, 8.0, 0.01]))
    r, t, point = np.eye(3), np.array([0.0, 0, 2.0]), np.array([0.1, -0.1, 0.5])
    how = Sampling(ncc_normalize=True, l2_normalize=False, nodes=((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5)))
    assert np.abs(residuals.patch_warp(patch, camera, r, t, patch, camera, r, t, point, how)).max() < 1e-9
    value, _ = residuals.feature_reference(patch, camera, r, t, point, None, Sampling())
    residual, by = residuals.feature_reference(patch, camera, r, t, point, value, Sampling())
    assert np.abs(residual).max() == 0
    e = 1e-6
    numeric = np.stack([(residuals.feature_reference(patch, camera, r, t, point + d, value, Sampling())[0] - residuals.feature_reference(patch, camera, r, t, point - d, value, Sampling())[0]) / (2 * e) for d in np.eye(3) * e], axis=1)
    assert np.abs(numeric - by["point"]).max() < 1e-5
    with pytest.raises(ValueError):
        residuals.patch_warp(patch, Camera("OPENCV", np.zeros(8)), r, t, patch, camera, r, t, point, how)


def test_pose_from_outliers():
    camera = Camera("SIMPLE_RADIAL", np.array([1000.0, 500, 500, 0.01]))
    r, t, points = geometry.rotation_matrix(np.array([[0.95, 0.1, -0.2, 0.1]]))[0], np.array([0.3, -0.2, 6.0]), RNG.uniform(-1, 1, (120, 3))
    xy, _, _ = geometry.project(camera.model, camera.params, r, t, points)
    xy[:40] += RNG.uniform(-300, 300, (40, 2))
    found = absolute_pose(camera, points, xy)
    assert found is not None and np.abs(found[0] - r).max() < 1e-3 and np.abs(found[1] - t).max() < 1e-2 and found[2][40:].all()
    assert absolute_pose(camera, points[:5], xy[:5]) is None


def test_pose_of_noise_where_one_of_thousands_is_an_inlier():
    camera, noise = Camera("SIMPLE_RADIAL", np.array([1000.0, 500, 500, 0.01])), np.random.default_rng(0)
    assert absolute_pose(camera, noise.uniform(-1, 1, (2000, 3)) + [0, 0, 10], noise.uniform(0, 1000, (2000, 2))) is None


def first_fit(sizes, most):
    bins, out = [], []
    for s in sizes:
        at = next((i for i, b in enumerate(bins) if s < most and b + s <= most), None)
        if at is None:
            bins.append(0)
            at = len(bins) - 1
        bins[at] += s
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_by_size_is_first_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 14, 200).tolist(), reverse=True)
    histogram = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    out = []
    for size, first, to, per_bin, bin_ in pack_by_size(histogram, 12):
        out += [bin_ + k // per_bin for k in range(to - first)]
    assert out == first_fit(sizes, 12)


def test_settings():
    assert conf.load()["keypoint_adjustment"]["optimizer"]["bound"] == 4.0
    changed = conf.load("low_memory", {"dense_features": {"patch_size": 8}}, ["keypoint_adjustment.optimizer.loss.name=huber"])
    assert changed["dense_features"]["patch_size"] == 8 and changed["bundle_adjustment"]["strategy"] == "costmaps" and changed["keypoint_adjustment"]["optimizer"]["loss"]["name"] == "huber"
    for bad, error in (({"nothing": 1}, KeyError), ({"interpolation": 3}, TypeError), ({"dense_features": {"patch_size": "x"}}, TypeError), (["optimizer"], ValueError)):
        with pytest.raises(error):
            conf.load(bad)
    for preset in conf.PRESETS:
        conf.load(preset)
