"""Keypoint adjustment and bundle adjustment: many robust least-squares problems, one Spark group each."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geometry, interpolation
from trackweave.functions.interpolation import Sampling
from trackweave.functions.losses import loss
from trackweave.operators import residuals as res
from trackweave.operators.graph import intra_track, root_edges
from trackweave.operators.solver import SUMMARY, SUMMARY_NAMES, Options, by_problem, minimise_many
from trackweave.runtime import Scratch


@dataclass(frozen=True)
class KeypointOptions:
    """bound: feature pixels that a keypoint may move; root_regularize: compare with the track's root only."""

    solver: Options = Options()
    sampling: Sampling = Sampling()
    bound: float = 4.0
    root_fixed: bool = True
    weight_by_sim: bool = True
    root_edges_only: bool = False


def keypoint_rows(nodes: DataFrame, edges: DataFrame, keypoints: DataFrame, patches: DataFrame, images: DataFrame) -> DataFrame:
    """Input of `adjust_keypoints`: a row per node (problem, node_idx, x, y, is_constant, patch) and per edge (src, dst, sim).

    nodes: node_idx, image_id, feature_idx, problem, is_constant. Nodes without patch are left out, and edges that lose an end.
    """
    named = nodes.where("problem <> -1").join(images.select("image_id", F.col("name").alias("image_name")), "image_id")
    placed = named.join(keypoints.select("image_id", F.col("kp_id").alias("feature_idx"), "x", "y"), ["image_id", "feature_idx"])
    with_patch = placed.join(patches.withColumnRenamed("kp_id", "feature_idx"), ["image_name", "feature_idx"])
    none = lambda kind: F.lit(None).cast(kind)
    head = with_patch.select("problem", F.lit(0).alias("kind"), F.col("node_idx").alias("src"), none("bigint").alias("dst"), none("double").alias("sim"), "x", "y", "is_constant", "h", "w", "c", "x0", "y0", "sx", "sy", "upsampling", "data")
    tail = edges.join(nodes.select(F.col("node_idx").alias("src"), "problem"), "src").where("problem <> -1").select("problem", F.lit(1).alias("kind"), "src", "dst", "sim")
    return head.unionByName(tail, allowMissingColumns=True)


def adjust_keypoints(rows: DataFrame, options: KeypointOptions = KeypointOptions()) -> DataFrame:
    """problem, node_idx, x, y and the problem's summary: keypoints moved so that descriptors along the edges agree.

    Constant nodes stay; others keep within their patch and options.bound. Problems are solved many at a time, those with equally
    many nodes in step; within a problem, all edges together. `history` stands in the first row of a problem.
    """
    schema = "problem bigint, node_idx bigint, x double, y double, " + SUMMARY
    return by_problem(rows, "problem", lambda part: _keypoints(part, options), schema)


def _keypoints(part: pd.DataFrame, options: KeypointOptions) -> pd.DataFrame:
    heads = part[part["kind"] == 0].sort_values(["problem", "src"])
    patches, start = Patches(heads), heads[["x", "y"]].to_numpy(float)
    held = heads["is_constant"].to_numpy(object) == True  # noqa: E712  NULL: not held
    low, high = _bounds(patches, start, options.bound)
    low[held], high[held] = start[held], start[held]
    owner, begin, size = np.unique(heads["problem"].to_numpy(np.int64), return_index=True, return_counts=True)

    tail = part[part["kind"] == 1]
    place = pd.Series(np.arange(len(heads)), pd.MultiIndex.from_frame(heads[["problem", "src"]]))
    one, two = (place.reindex(pd.MultiIndex.from_frame(tail[["problem", end]])).to_numpy(float) for end in ("src", "dst"))
    known = ~np.isnan(one) & ~np.isnan(two) & (one != two)
    one, two, weight = one[known].astype(int), two[known].astype(int), tail["sim"].to_numpy(float)[known] if options.weight_by_sim else np.ones(int(known.sum()))
    problem = np.searchsorted(begin, one, side="right") - 1
    edges, width = np.bincount(problem, minlength=len(owner)), patches.channels * len(options.sampling.nodes)
    rho, out = loss(options.solver.loss_name, options.solver.loss_scale), []

    for n in np.unique(size):
        own = np.nonzero(size == n)[0]
        nodes = begin[own][:, None] + np.arange(n)
        inside = np.nonzero(np.isin(problem, own))[0]
        number = np.searchsorted(own, problem[inside])
        i, j = one[inside] - begin[own][number], two[inside] - begin[own][number]

        def evaluate(x: np.ndarray, which: np.ndarray, n=n, nodes=nodes, inside=inside, number=number, i=i, j=j):
            value, jac = patches.sample(nodes[which].ravel(), x.reshape(-1, 2), options.sampling)
            position = np.full(len(nodes), -1)
            position[which] = np.arange(len(which))
            at = position[number]
            used = at >= 0
            at, a, b, w = at[used], i[used], j[used], weight[inside[used]]
            r = value[at * n + a] - value[at * n + b]
            cost, first, _ = rho((r**2).sum(axis=1))
            ja, jb, w1 = jac[at * n + a], jac[at * n + b], w * first
            hessian, gradient = np.zeros((len(which), n, 2, n, 2)), np.zeros((len(which), n, 2))
            every = slice(None)
            for p, q, jp, jq, sign in ((a, a, ja, ja, 1), (b, b, jb, jb, 1), (a, b, ja, jb, -1), (b, a, jb, ja, -1)):
                np.add.at(hessian, (at, p, every, q, every), sign * w1[:, None, None] * (jp.transpose(0, 2, 1) @ jq))
            for p, jp, sign in ((a, ja, 1), (b, jb, -1)):
                np.add.at(gradient, (at, p), sign * w1[:, None] * (jp.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0])
            return np.bincount(at, 0.5 * w * cost, len(which)), hessian.reshape(len(which), 2 * n, 2 * n), gradient.reshape(len(which), 2 * n)

        flat = lambda v, nodes=nodes: v[nodes].reshape(len(nodes), -1)
        fixed = np.repeat(held[nodes], 2, axis=1)
        xy, summary = minimise_many(flat(start), evaluate, options.solver, edges[own] * width, flat(low), flat(high), fixed)
        summary.termination[edges[own] == 0] = "no residuals"
        rows = {"problem": np.repeat(owner[own], n), "node_idx": heads["src"].to_numpy(np.int64)[nodes.ravel()], "x": xy.reshape(-1, 2)[:, 0], "y": xy.reshape(-1, 2)[:, 1]}
        first = np.arange(len(nodes) * n) % n == 0
        for name, values in summary.rows().items():
            rows[name] = [values[k // n] if first[k] or name != "history" else None for k in range(len(first))] if name == "history" else np.repeat(np.asarray(values), n)
        out.append(pd.DataFrame(rows))
    return pd.concat(out) if out else pd.DataFrame({"problem": [], "node_idx": [], "x": [], "y": []} | {name: [] for name in SUMMARY_NAMES})


class Patches:
    """The patches of many rows, stacked by shape."""

    def __init__(self, rows: pd.DataFrame, prefix: str = "") -> None:
        get = lambda name: rows[prefix + name].to_numpy()
        self.shape = np.stack([get(n).astype(int) for n in ("h", "w", "c")], axis=1).reshape(-1, 3)
        self.corner, self.scale = (np.stack([get(a).astype(float), get(b).astype(float)], axis=1).reshape(-1, 2) for a, b in (("x0", "y0"), ("sx", "sy")))
        self.upsampling = get("upsampling").astype(float)
        self.channels = int(self.shape[0, 2]) if len(rows) else 0
        shapes, self.kind = np.unique(self.shape, axis=0, return_inverse=True)
        self.kind, self.number, self.grids, data = self.kind.ravel(), np.zeros(len(rows), int), [], get("data")
        for k, shape in enumerate(shapes):
            own = np.nonzero(self.kind == k)[0]
            self.number[own] = np.arange(len(own))
            self.grids.append(np.stack([np.asarray(data[i], np.float64) for i in own]).reshape(-1, *shape))

    def sample(self, rows: np.ndarray, xy: np.ndarray, how: Sampling) -> tuple[np.ndarray, np.ndarray]:
        """Descriptors of the patches `rows` at image coordinates xy (n, 2), and their Jacobian (n, k, 2) by x and y."""
        scale = self.scale[rows]
        uv = (xy * scale - 0.5 - self.corner[rows]) * self.upsampling[rows, None]
        value = jac = None
        for k, grids in enumerate(self.grids):
            own = np.nonzero(self.kind[rows] == k)[0]
            if not len(own):
                continue
            v, by_r, by_c = interpolation.sample(grids[self.number[rows[own]]], uv[own][:, ::-1], how)
            if value is None:
                value, jac = np.zeros((len(rows), v.shape[1])), np.zeros((len(rows), v.shape[1], 2))
            value[own], jac[own] = v, np.stack([by_c, by_r], axis=2) * (scale[own] * self.upsampling[rows[own], None])[:, None, :]
        return (value, jac) if value is not None else (np.zeros((0, 0)), np.zeros((0, 0, 2)))


def _bounds(patches: Patches, start: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    low = (patches.corner + 0.5) / patches.scale
    high = low + patches.shape[:, 1::-1] / patches.upsampling[:, None] / patches.scale
    if bound > 0:
        low, high = np.maximum(low, start - bound / patches.scale), np.minimum(high, start + bound / patches.scale)
    return np.minimum(low, start), np.maximum(high, start)


def refine_keypoints(nodes: DataFrame, edges: DataFrame, keypoints: DataFrame, patches: DataFrame, images: DataFrame, scratch: Scratch, strategy: str = "featuremetric", options: KeypointOptions = KeypointOptions(), levels: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Refined keypoints (image_id, kp_id, x, y) and the summary rows, over all levels from coarse to fine.

    nodes: node_idx, image_id, feature_idx, track, is_root, problem [, is_constant]. `featuremetric` compares along all edges of a
    track, weighted by similarity; `topological_reference` along the star of its root, with weight 1. Keypoints outside the graph
    are returned as they are. The keypoints of each level are written before the next level reads them.
    """
    labels, roots = nodes.select("node_idx", "track"), nodes.select("node_idx", "is_root")
    if strategy == "featuremetric":
        used = intra_track(edges, labels)
        if options.root_edges_only:
            root = roots.where("is_root").select("node_idx")
            used = used.join(root.withColumnsRenamed({"node_idx": "src"}).withColumn("_one", F.lit(True)), "src", "left").join(root.withColumnsRenamed({"node_idx": "dst"}).withColumn("_two", F.lit(True)), "dst", "left")
            used = used.where("_one OR _two").select("src", "dst", "sim")
    elif strategy == "topological_reference":
        used, options = root_edges(edges, labels, roots), replace(options, weight_by_sim=False)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    held = F.coalesce(F.col("is_constant"), F.lit(False)) if "is_constant" in nodes.columns else F.lit(False)
    nodes = nodes.withColumn("is_constant", held | (F.col("is_root") if options.root_fixed else F.lit(False)))
    if levels is None:
        levels = sorted((r.level for r in patches.select("level").distinct().collect()), reverse=True)
    summaries = None
    for level in levels:
        rows = keypoint_rows(nodes, used.select("src", "dst", "sim"), keypoints, patches.where(F.col("level") == level), images)
        moved = scratch.save(adjust_keypoints(rows, options))
        new = moved.join(nodes.select("node_idx", "image_id", F.col("feature_idx").alias("kp_id")), "node_idx").select("image_id", "kp_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
        keypoints = scratch.save(keypoints.join(new, ["image_id", "kp_id"], "left").select("image_id", "kp_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")))
        one = moved.groupBy("problem").agg(*[F.first(c, ignorenulls=True).alias(c) for c in SUMMARY_NAMES]).withColumn("level", F.lit(level))
        summaries = one if summaries is None else summaries.unionByName(one)
    return keypoints, summaries


# Bundle adjustment -------------------------------------------------------------------------------------------------------------


@dataclass
class BundleSetup:
    """What stays as it is: ids of images, points and cameras, and images whose first translation component stays."""

    constant_poses: set[int] = field(default_factory=set)
    constant_tx: set[int] = field(default_factory=set)
    constant_points: set[int] = field(default_factory=set)
    constant_cameras: set[int] = field(default_factory=set)
    refine_focal: bool = True
    refine_principal: bool = False
    refine_extra: bool = True
    refine_poses: bool = True
    refine_points: bool = True

    @classmethod
    def gauge(cls, image_ids: list[int], **more) -> BundleSetup:
        """The pose of the first registered image stays, and of the second one component of the translation."""
        ordered = sorted(image_ids)
        return cls(constant_poses=set(ordered[:1]), constant_tx=set(ordered[1:2]), **more)

    def fixed_params(self, camera_id: int, model: str) -> np.ndarray:
        places, extra = geometry.MODELS[model]
        free = (set(places[:2]) if self.refine_focal else set()) | (set(places[2:]) if self.refine_principal else set()) | (set(extra) if self.refine_extra else set())
        if camera_id in self.constant_cameras:
            free = set()
        return np.array([i not in free for i in range(len(set(places)) + len(extra))])


def adjust_points(observations: DataFrame, options: Options = Options(parameter_tolerance=0.0), kind: str = "geometric", sampling: Sampling = Sampling()) -> DataFrame:
    """point3d_id, px, py, pz and summary: each point moved on its own, with poses and cameras held; points are solved many at a time, in step.

    observations: point3d_id, px, py, pz (the point), model, params, qw..qz, tx..tz and, by kind: `geometric` x, y; `feature_reference`
    and `costmaps` a patch (h, w, c, x0, y0, sx, sy, upsampling, data), the first also `reference`; `patch_warp` a patch and
    src_-prefixed camera, pose and patch of the source observation.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids, first, owner = np.unique(part["point3d_id"].to_numpy(np.int64), return_index=True, return_inverse=True)
        owner = owner.ravel()
        start, observed = part[["px", "py", "pz"]].to_numpy(float)[first], Observed(part, kind, sampling)
        rho = loss(options.loss_name, options.loss_scale)

        def evaluate(x: np.ndarray, which: np.ndarray):
            position = np.full(len(ids), -1)
            position[which] = np.arange(len(which))
            rows = np.nonzero(position[owner] >= 0)[0]
            at = position[owner[rows]]
            r, by = observed.residuals(rows, x[at])
            cost, slope, _ = rho((r**2).sum(axis=1))
            hessian, gradient = np.zeros((len(which), 3, 3)), np.zeros((len(which), 3))
            np.add.at(hessian, at, slope[:, None, None] * (by["point"].transpose(0, 2, 1) @ by["point"]))
            np.add.at(gradient, at, slope[:, None] * (by["point"].transpose(0, 2, 1) @ r[:, :, None])[:, :, 0])
            return np.bincount(at, 0.5 * cost, len(which)), hessian, gradient

        width = observed.residuals(np.arange(min(1, len(part))), start[:1])[0].shape[1] if len(part) else 0
        x, summary = minimise_many(start, evaluate, options, np.bincount(owner, minlength=len(ids)) * width)
        return pd.DataFrame({"point3d_id": ids, "px": x[:, 0], "py": x[:, 1], "pz": x[:, 2], **summary.rows()})

    return by_problem(observations, "point3d_id", solve, "point3d_id bigint, px double, py double, pz double, " + SUMMARY)


def residual_rows(observations: DataFrame, kind: str, sampling: Sampling = Sampling(), keys: tuple[str, ...] = ("point3d_id", "image_id"), options: Options = Options()) -> DataFrame:
    """keys, residual ARRAY<DOUBLE>, cost: the residual of every observation where it stands (see adjust_points for the columns), and its robust cost."""
    rho = loss(options.loss_name, options.loss_scale)

    def run(parts):
        for part in parts:
            r, _ = Observed(part, kind, sampling).residuals(np.arange(len(part)), part[["px", "py", "pz"]].to_numpy(float))
            yield part[list(keys)].assign(residual=list(r), cost=0.5 * rho((r**2).sum(axis=1))[0])

    types = {f.name: f.dataType.simpleString() for f in observations.schema}
    return observations.mapInPandas(run, ", ".join([f"{k} {types[k]}" for k in keys] + ["residual array<double>", "cost double"]))


class Observed:
    """Observations of points, whose residuals (n, k) and Jacobians are evaluated for many rows at once, by kind (see adjust_points)."""

    def __init__(self, part: pd.DataFrame, kind: str, sampling: Sampling) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        self.kind, self.sampling = kind, sampling
        self.model, self.params, self.turn, self.shift = _poses(part)
        if kind == "geometric":
            self.xy = part[["x", "y"]].to_numpy(float)
            return
        self.patches = Patches(part)
        if kind == "feature_reference":
            self.reference = np.stack([np.asarray(v, float) for v in part["reference"]]) if len(part) else np.zeros((0, 0))
        if kind == "costmaps":
            self.sampling = replace(sampling, mode="BICUBICCHAIN" if self.patches.channels == 3 else "BICUBIC", l2_normalize=False, ncc_normalize=False)
        if kind == "patch_warp":
            self.source, self.source_patches = _poses(part, "src_"), Patches(part, "src_")
            if not {*self.model, *self.source[0]} <= set(geometry.WARP_MODELS):
                raise ValueError("the patch warp takes " + ", ".join(geometry.WARP_MODELS))

    def residuals(self, rows: np.ndarray, points: np.ndarray, turn: np.ndarray | None = None, shift: np.ndarray | None = None, params: np.ndarray | None = None, source: tuple | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Residuals of the rows, and their Jacobians by point, turn, t and params (and source_turn, source_t, source_params of a patch warp).

        Poses and parameters are those of the rows unless given: turn (n, 3, 3), shift (n, 3), params (n, 8).
        """
        turn, shift, params = (own[rows] if given is None else given for own, given in ((self.turn, turn), (self.shift, shift), (self.params, params)))
        if self.kind == "patch_warp":
            return self._warped(rows, points, turn, shift, params, source)
        pixels, by = _projected(self.model[rows], params, turn, shift, points)
        if self.kind == "geometric":
            return pixels - self.xy[rows], by
        value, jac = self.patches.sample(rows, pixels, self.sampling)
        return value - self.reference[rows] if self.kind == "feature_reference" else value, {name: jac @ b for name, b in by.items()}

    def _warped(self, rows, points, turn, shift, params, source):
        """Difference of the target's and the source's descriptors under the plane through the point that faces the source; central differences."""
        s_turn, s_shift, s_params = source or (self.source[2][rows], self.source[3][rows], self.source[1][rows])
        single = Sampling(self.sampling.mode, False, False, ((0.0, 0.0),))
        normal = lambda v: self._normal(v.reshape(len(rows), len(self.sampling.nodes), -1))

        def value(points, turn, shift, params, s_turn, s_shift, s_params):
            pixels, _ = _projected(self.source[0][rows], s_params, s_turn, s_shift, points)
            depth = (s_turn @ points[:, :, None])[:, 2, 0] + s_shift[:, 2]
            target, origin = [], []
            step = 1 / self.source_patches.scale[rows] / self.source_patches.upsampling[rows, None]
            for node in self.sampling.nodes:
                places = pixels + np.array(node) * step
                world = _back_projected(self.source[0][rows], s_params, s_turn, s_shift, places, depth)
                target.append(self.patches.sample(rows, _projected(self.model[rows], params, turn, shift, world)[0], single)[0])
                origin.append(self.source_patches.sample(rows, places, single)[0])
            return normal(np.stack(target, axis=1)) - normal(np.stack(origin, axis=1))

        given = [points, turn, shift, params, s_turn, s_shift, s_params]
        base, by = value(*given), {}
        for place, (name, size) in enumerate((("point", 3), ("turn", 3), ("t", 3), ("params", params.shape[1]), ("source_turn", 3), ("source_t", 3), ("source_params", s_params.shape[1]))):
            columns = []
            for i in range(size):
                move = np.zeros(size)
                move[i] = 1e-6 * (max(1.0, np.abs(given[place]).max()) if not name.endswith("turn") and given[place].size else 1.0)
                shifted = [_turned(given[place], sign * move) if name.endswith("turn") else given[place] + sign * move for sign in (1, -1)]
                columns.append(np.subtract(*(value(*given[:place], v, *given[place + 1 :]) for v in shifted)) / (2 * move[i]))
            by[name] = np.stack(columns, axis=2)
        return base, by

    def _normal(self, value: np.ndarray) -> np.ndarray:
        if self.sampling.ncc_normalize:
            (value,) = interpolation.ncc_normalise(value)
        if self.sampling.l2_normalize:
            (value,) = interpolation.l2_normalise(value)
        return value.reshape(len(value), -1)


KINDS = ("geometric", "feature_reference", "costmaps", "patch_warp")
#: Parameters of the largest camera model; shorter ones are padded.
MOST_PARAMS = 8


def _poses(rows: pd.DataFrame, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model, parameters (n, MOST_PARAMS), rotation (n, 3, 3) and translation (n, 3) per row."""
    names = [prefix + n for n in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]
    pose, params = rows[names].to_numpy(float), np.zeros((len(rows), MOST_PARAMS))
    for i, p in enumerate(rows[prefix + "params"]):
        params[i, : len(p)] = p
    return rows[prefix + "model"].to_numpy(str) if len(rows) else np.zeros(0, str), params, geometry.rotation_matrix(pose[:, :4]), pose[:, 4:]


def _turned(turn: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Rotations after a small one by the vector, on the camera's side."""
    return geometry.rotation_matrix(geometry.turned(np.array([1.0, 0, 0, 0]), step)[None]) @ turn


def _projected(model: np.ndarray, params: np.ndarray, turn: np.ndarray, shift: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Pixels (n, 2) of points under poses and cameras of their own, with Jacobians by point, turn, t and params (n, 2, MOST_PARAMS)."""
    pixels = np.zeros((len(points), 2))
    by = {"point": np.zeros((len(points), 2, 3)), "turn": np.zeros((len(points), 2, 3)), "t": np.zeros((len(points), 2, 3)), "params": np.zeros((len(points), 2, MOST_PARAMS))}
    for name in np.unique(model):
        own = np.nonzero(model == name)[0]
        k = geometry.n_params(name)
        own_params = params[own, :k].T
        pixels[own], by_p, p = geometry.project(name, own_params, turn[own], shift[own], points[own])
        pose = res.pose_columns(by_p, p - shift[own])
        by["point"][own], by["turn"][own], by["t"][own] = by_p @ turn[own], pose[:, :, :3], by_p
        by["params"][own, :, :k] = geometry.by_params(name, own_params, p[:, :2] / p[:, 2:])
    return pixels, by


def _back_projected(model, params, turn, shift, xy, depth) -> np.ndarray:
    """World points of pixels at depths, each under its own pose and camera."""
    world = np.zeros((len(xy), 3))
    for name in np.unique(model):
        own = np.nonzero(model == name)[0]
        uv = geometry.undistort(name, params[own, : geometry.n_params(name)].T, xy[own])
        p = np.concatenate([uv, np.ones((len(own), 1))], axis=1) * depth[own][:, None]
        world[own] = ((p - shift[own])[:, None, :] @ turn[own])[:, 0]
    return world


@dataclass
class BundleState:
    """Poses and cameras as arrays by ascending id. Their size is that of images and cameras: some 150 bytes each go to every task."""

    image_ids: np.ndarray
    quaternions: np.ndarray
    shifts: np.ndarray
    camera_ids: np.ndarray
    models: np.ndarray
    params: np.ndarray

    def moved(self, step: np.ndarray) -> BundleState:
        n = len(self.image_ids)
        pose, inner = step[: 6 * n].reshape(n, 6), step[6 * n :].reshape(-1, MOST_PARAMS)
        return replace(self, quaternions=geometry.turned(self.quaternions, pose[:, :3]), shifts=self.shifts + pose[:, 3:], params=self.params + inner)

    def poses(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {int(i): (q, t) for i, q, t in zip(self.image_ids, self.quaternions, self.shifts)}

    def cameras(self) -> dict[int, np.ndarray]:
        return {int(c): p[: geometry.n_params(m)] for c, m, p in zip(self.camera_ids, self.models, self.params)}


#: Unknowns of poses and cameras up to which the reduced system is formed and solved as a matrix on the driver (128 MB); beyond, by conjugate gradients.
DENSE_UNKNOWNS = 4_000
_SOURCE = ("src_image_id", "src_camera_id")


def bundle_adjust(
    observations: DataFrame, setup: BundleSetup, options: Options = Options(parameter_tolerance=0.0, max_iterations=20), scratch: Scratch | None = None, kind: str = "geometric", sampling: Sampling = Sampling(), dense_unknowns: int = DENSE_UNKNOWNS
) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], DataFrame, list[float]]:
    """Bundle adjustment of poses, cameras and points: {image_id: q, t}, {camera_id: params}, points (point3d_id, px, py, pz), costs per iteration.

    observations: image_id, camera_id, point3d_id, px, py, pz, model, params, qw..qz, tx..tz and what the kind needs (see adjust_points);
    a patch warp also src_image_id and src_camera_id. Levenberg-Marquardt with the points eliminated: tasks hold the observations
    of whole points and add up Schur complements. Up to dense_unknowns unknowns of poses and cameras, the reduced system is summed
    and solved as a matrix on the driver; beyond, it is solved by conjugate gradients, each product one pass over the observations,
    which moves vectors of the unknowns only. A step is taken only if the summed cost falls.
    """
    spark, own = observations.sparkSession, scratch or Scratch(observations.sparkSession, "bundle")
    state = _bundle_state(observations)
    n_images, size = len(state.image_ids), 6 * len(state.image_ids) + MOST_PARAMS * len(state.camera_ids)
    fixed = np.zeros(size, bool)
    for i, image in enumerate(state.image_ids.tolist()):
        fixed[6 * i : 6 * i + 6] = image in setup.constant_poses or not setup.refine_poses
        fixed[6 * i + 3] |= image in setup.constant_tx
    for c, (camera, model) in enumerate(zip(state.camera_ids.tolist(), state.models)):
        known = setup.fixed_params(camera, model)
        fixed[6 * n_images + MOST_PARAMS * c :][:MOST_PARAMS] = np.concatenate([known, np.ones(MOST_PARAMS - len(known), bool)])
    free, rho, held = ~fixed, loss(options.loss_name, options.loss_scale), np.array(sorted(setup.constant_points), np.int64)
    points = own.save(observations.groupBy("point3d_id").agg(*[F.first(c).alias(c) for c in ("px", "py", "pz")]))
    seen = own.save(observations.drop("px", "py", "pz"))

    def systems(part: pd.DataFrame, state: BundleState, damping: float) -> dict:
        """Residuals, Jacobians and damped point systems of the points of a run of rows."""
        rows = np.arange(len(part))
        ids, owner = np.unique(part["point3d_id"].to_numpy(np.int64), return_inverse=True)
        image, camera = (np.searchsorted(known, part[name].to_numpy(np.int64)) for name, known in (("image_id", state.image_ids), ("camera_id", state.camera_ids)))
        turns = geometry.rotation_matrix(state.quaternions)
        source, columns = None, [6 * image[:, None] + np.arange(6), 6 * n_images + MOST_PARAMS * camera[:, None] + np.arange(MOST_PARAMS)]
        if kind == "patch_warp":
            s_image, s_camera = (np.searchsorted(known, part[name].to_numpy(np.int64)) for name, known in zip(_SOURCE, (state.image_ids, state.camera_ids)))
            source = turns[s_image], state.shifts[s_image], state.params[s_camera]
            columns += [6 * s_image[:, None] + np.arange(6), 6 * n_images + MOST_PARAMS * s_camera[:, None] + np.arange(MOST_PARAMS)]
        r, by = Observed(part, kind, sampling).residuals(rows, part[["px", "py", "pz"]].to_numpy(float), turns[image], state.shifts[image], state.params[camera], source)
        wide = [np.concatenate([by["turn"], by["t"], by["params"]], axis=2)]
        if source is not None:
            wide.append(np.concatenate([by["source_turn"], by["source_t"], by["source_params"]], axis=2))
        column = np.concatenate(columns, axis=1)
        wide = np.concatenate(wide, axis=2) * free[column][:, None, :]
        cost, slope, _ = rho((r**2).sum(axis=1))
        owner, n = owner.ravel(), len(ids)
        v, g = np.zeros((n, 3, 3)), np.zeros((n, 3))
        weighted = slope[:, None, None] * by["point"]
        np.add.at(v, owner, weighted.transpose(0, 2, 1) @ by["point"])
        np.add.at(g, owner, (weighted.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0])
        inverse = np.zeros_like(v)
        moves = np.full(n, setup.refine_points) & ~np.isin(ids, held)
        damped = v + damping * np.eye(3) * np.maximum(np.diagonal(v, axis1=1, axis2=2), 1e-9)[:, :, None]
        inverse[moves] = np.linalg.pinv(damped[moves], rcond=1e-13, hermitian=True)  # a point seen once is not determined along its ray
        return {"ids": ids, "owner": owner, "column": column, "wide": wide, "r": r, "slope": slope, "cost": 0.5 * cost, "point": by["point"], "inverse": inverse, "g": g}

    def entries(values: np.ndarray, at: np.ndarray, what: str) -> pd.DataFrame:
        """Sums by place of one run."""
        places, which = np.unique(at.ravel(), return_inverse=True)
        return pd.DataFrame({"what": what, "at": places.astype(np.int64), "value": np.bincount(which.ravel(), values.ravel(), len(places))})

    def back(s: dict, vector: np.ndarray) -> np.ndarray:
        """V^-1 E^T vector of each point."""
        t = np.zeros_like(s["g"])
        along = (s["wide"] @ vector[s["column"]][:, :, None])[:, :, 0]
        np.add.at(t, s["owner"], s["slope"][:, None] * (s["point"].transpose(0, 2, 1) @ along[:, :, None])[:, :, 0])
        return (s["inverse"] @ t[:, :, None])[:, :, 0]

    def gradients(state: BundleState, damping: float, matrix: bool):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            s = systems(part, state, damping)
            pull = (s["inverse"] @ s["g"][:, :, None])[:, :, 0]
            turned = s["slope"][:, None, None] * s["wide"].transpose(0, 2, 1)
            out = [entries((turned @ (s["r"] - (s["point"] @ pull[s["owner"]][:, :, None])[:, :, 0])[:, :, None])[:, :, 0], s["column"], "g")]
            out.append(entries(np.einsum("nmk,nkm->nm", turned, s["wide"]), s["column"], "d"))
            if matrix:
                m = s["column"].shape[1]
                moves = free[s["column"]]
                place = s["column"][:, :, None] * size + s["column"][:, None, :]
                inner = moves[:, :, None] & moves[:, None, :]
                out.append(entries((turned @ s["wide"])[inner], place[inner], "h"))
                cross = turned @ s["point"]
                order = np.argsort(s["owner"], kind="stable")
                bounds = np.searchsorted(s["owner"][order], np.arange(len(s["ids"]) + 1))
                values, at, load = [], [], 0
                loose = np.nonzero(s["inverse"].any(axis=(1, 2)))[0]
                for p in loose:
                    own_rows = order[bounds[p] : bounds[p + 1]]
                    c = s["column"][own_rows].ravel()
                    e, c = cross[own_rows].reshape(-1, 3)[free[c]], c[free[c]]
                    values.append((-e @ s["inverse"][p] @ e.T).ravel())
                    at.append((c[:, None] * size + c[None, :]).ravel())
                    load += len(e) ** 2
                    if load > 4_000_000 or p == loose[-1]:
                        out.append(entries(np.concatenate(values), np.concatenate(at), "h"))
                        values, at, load = [], [], 0
            return pd.concat(out)

        return run

    def product(state: BundleState, damping: float, vector: np.ndarray):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            s = systems(part, state, damping)
            along = (s["wide"] @ vector[s["column"]][:, :, None])[:, :, 0] - (s["point"] @ back(s, vector)[s["owner"]][:, :, None])[:, :, 0]
            return entries(s["slope"][:, None] * (s["wide"].transpose(0, 2, 1) @ along[:, :, None])[:, :, 0], s["column"], "y")

        return run

    def moved(state: BundleState, step: np.ndarray, damping: float):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            s = systems(part, state, damping)
            first = np.unique(part["point3d_id"].to_numpy(np.int64), return_index=True)[1]
            at = part[["px", "py", "pz"]].to_numpy(float)[first] - (s["inverse"] @ s["g"][:, :, None])[:, :, 0] - back(s, step)
            return pd.DataFrame({"point3d_id": s["ids"], "px": at[:, 0], "py": at[:, 1], "pz": at[:, 2]})

        return run

    def over(points: DataFrame, run, schema: str) -> DataFrame:
        return by_problem(seen.join(points, "point3d_id"), "point3d_id", run, schema)

    def sums(points: DataFrame, run) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Vectors of the unknowns, and of the pairs of unknowns only where the matrix is wanted."""
        rows = over(points, run, "what string, at bigint, value double").groupBy("what", "at").agg(F.sum("value").alias("value")).toArrow()
        what, at, value = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("what", "at", "value"))
        return {w: (at[what == w], value[what == w]) for w in np.unique(what.astype(str))}

    def dense(pairs: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
        out = np.zeros(length)
        out[pairs[0]] = pairs[1]
        return out

    def cost_of(state: BundleState, points: DataFrame) -> float:
        run = lambda part: pd.DataFrame({"cost": [systems(part, state, 0.0)["cost"].sum()]})
        return over(points, run, "cost double").agg(F.sum("cost")).first()[0] or 0.0

    damping, costs, unknowns = 1e-4, [cost_of(state, points)], int(free.sum())
    for _ in range(options.max_iterations):
        found = sums(points, gradients(state, damping, 0 < unknowns <= dense_unknowns))
        if not found:
            break
        gradient, scale = dense(found["g"], size), np.maximum(dense(found["d"], size), 1e-9)
        step = np.zeros(size)
        if 0 < unknowns <= dense_unknowns:
            h = np.zeros((unknowns, unknowns))
            number = np.cumsum(free) - 1
            i, j = np.divmod(found["h"][0], size)
            inner = free[i] & free[j]
            h[number[i[inner]], number[j[inner]]] = found["h"][1][inner]
            step[free] = -np.linalg.lstsq(h + damping * np.diag(scale[free]), gradient[free], rcond=None)[0]
        elif unknowns:
            apply = lambda x: np.where(free, dense(sums(points, product(state, damping, x))["y"], size) + damping * scale * x, 0)
            step = -_conjugate_gradients(apply, np.where(free, gradient, 0), scale * (1 + damping))
        trial = state.moved(step)
        candidate = own.save(over(points, moved(state, step, damping), "point3d_id bigint, px double, py double, pz double"))
        cost = cost_of(trial, candidate)
        if np.isfinite(cost) and cost < costs[-1]:
            fall = (costs[-1] - cost) / max(costs[-1], 1e-300)
            state, damping = trial, max(damping / 5, 1e-12)
            own.drop(points)
            points = candidate
            costs.append(cost)
            if fall <= max(options.function_tolerance, 1e-9) or cost <= 1e-18 * costs[0]:
                break
        else:
            own.drop(candidate)
            damping *= 10
            if damping > 1e8:
                break
    return state.poses(), state.cameras(), points, costs


def _bundle_state(observations: DataFrame) -> BundleState:
    """Poses and cameras of the observations and of their sources, each once."""
    pose, camera = ("qw", "qx", "qy", "qz", "tx", "ty", "tz"), ("model", "params")
    images, cameras = observations.select("image_id", *pose), observations.select("camera_id", *camera)
    if "src_image_id" in observations.columns:
        images = images.unionByName(observations.select(F.col("src_image_id").alias("image_id"), *[F.col(f"src_{c}").alias(c) for c in pose]))
        cameras = cameras.unionByName(observations.select(F.col("src_camera_id").alias("camera_id"), *[F.col(f"src_{c}").alias(c) for c in camera]))
    images = images.groupBy("image_id").agg(*[F.first(c).alias(c) for c in pose]).orderBy("image_id").toPandas()
    cameras = cameras.groupBy("camera_id").agg(*[F.first(c).alias(c) for c in camera]).orderBy("camera_id").toPandas()
    params = np.zeros((len(cameras), MOST_PARAMS))
    for i, p in enumerate(cameras["params"]):
        params[i, : len(p)] = p
    table = images[list(pose)].to_numpy(float)
    unit = table[:, :4] / np.linalg.norm(table[:, :4], axis=1, keepdims=True)
    return BundleState(images["image_id"].to_numpy(np.int64), unit, table[:, 4:], cameras["camera_id"].to_numpy(np.int64), cameras["model"].to_numpy(object), params)


def _conjugate_gradients(apply, right: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-8, most: int = 200) -> np.ndarray:
    """Solution of apply(x) = right, preconditioned by the diagonal, to a relative residual."""
    x, r = np.zeros_like(right), right.copy()
    z = r / diagonal
    p, rz, target = z.copy(), r @ z, tolerance * np.linalg.norm(right)
    for _ in range(most):
        if np.linalg.norm(r) <= target:
            break
        q = apply(p)
        along = p @ q
        if along <= 0:
            break
        alpha = rz / along
        x, r = x + alpha * p, r - alpha * q
        z = r / diagonal
        following = r @ z
        p, rz = z + following / rz * p, following
    return x


def bundle_over_levels(rows_of_level, levels: list[int], setup: BundleSetup, options: Options = Options(parameter_tolerance=0.0, max_iterations=20), scratch: Scratch | None = None, kind: str = "feature_reference", sampling: Sampling = Sampling()) -> list[list[float]]:
    """Bundle adjustment from the first level to the last: the costs of each.

    rows_of_level(level, poses, cameras, points) gives the observations of a level; the last three are None at first, then what the
    level before found (as bundle_adjust returns them).
    """
    poses = cameras = points = None
    history = []
    for level in levels:
        poses, cameras, points, costs = bundle_adjust(rows_of_level(level, poses, cameras, points), setup, options, scratch, kind, sampling)
        history.append(costs)
    return history


def summary_totals(summaries: DataFrame) -> DataFrame:
    """One row over all problems: problems, residuals, summed costs, most and least iterations, root of the summed squares of the final costs, and the RMS cost."""
    return summaries.agg(
        F.count(F.lit(1)).alias("problems"), F.sum("num_residuals").alias("num_residuals"), F.sum("initial_cost").alias("initial_cost"), F.sum("final_cost").alias("final_cost"),
        F.max("iterations").alias("most_iterations"), F.min("iterations").alias("least_iterations"), F.sqrt(F.sum(F.col("final_cost") * F.col("final_cost"))).alias("root_square_cost"),
        F.sqrt(F.sum("final_cost") / F.when(F.sum("num_residuals") > 0, F.sum("num_residuals"))).alias("rms_cost"),
    )


def merge_histories(histories: DataFrame) -> DataFrame:
    """iteration, cost: the summed cost of all problems per iteration; a problem that ended keeps its last cost. histories: problem, history ARRAY<DOUBLE>."""
    longest = F.max(F.size("history")).alias("longest")
    table = histories.where(F.size("history") > 0)
    spread = table.crossJoin(F.broadcast(table.agg(longest))).select("history", F.explode(F.sequence(F.lit(0), F.col("longest") - 1)).alias("iteration"))  # one row of one number is broadcast
    return spread.groupBy("iteration").agg(F.sum(F.element_at("history", F.least(F.col("iteration") + 1, F.size("history")))).alias("cost"))
