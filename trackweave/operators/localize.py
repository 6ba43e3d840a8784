"""Localisation of query images: unique inliers, keypoint and pose refinement, PnP with RANSAC, and the pipeline over all queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import arrays, geometry
from trackweave.functions.interpolation import Sampling
from trackweave.operators import residuals as res
from trackweave.functions.losses import loss
from trackweave.operators.graph import components, ranked
from trackweave.operators.adjust import Observed, Patches, _bounds
from trackweave.operators.residuals import Camera
from trackweave.operators.solver import Options, by_problem, minimise, minimise_many
from trackweave.runtime import Scratch


def unique_inliers(rows: DataFrame, key: str = "id", inlier: str = "inlier") -> DataFrame:
    """Of the inliers of each (query, key), the first by pos."""
    rank = F.row_number().over(Window.partitionBy("query", key).orderBy("pos"))
    return rows.where(F.col(inlier)).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unique_min_error(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of each (query, key), the row of the smallest error; the first pos of equals. NULL and NaN errors count as largest."""
    error = F.when(F.col("error").isNotNull() & ~F.isnan("error"), F.col("error")).otherwise(F.lit(float("inf")))
    rank = F.row_number().over(Window.partitionBy("query", key).orderBy(error, "pos"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unique_min_error_two_keys(rows: DataFrame, first: str = "point3d_id", second: str = "kp_id") -> DataFrame:
    """The smallest error per 3-D point, then, of those left, per keypoint."""
    return unique_min_error(unique_min_error(rows, first), second)


def feature_inliers(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows whose descriptor is within the threshold of their reference; a negative threshold, or a NULL reference, admits."""
    if threshold < 0:
        return rows
    return rows.where(F.col("reference").isNull() | (F.sqrt(arrays.squared_distance(F.col("descriptor"), F.col("reference"))) <= threshold))


def stack_correspondences(rows: DataFrame) -> DataFrame:
    """Per (query, kp_id): the references of all its correspondences in order of pos, and the last one's position."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "reference", "x", "y")))
    return rows.groupBy("query", "kp_id").agg(ordered.alias("s")).select("query", "kp_id", F.transform("s", lambda s: s["reference"]).alias("references"), F.element_at("s", -1)["x"].alias("x"), F.element_at("s", -1)["y"].alias("y"))


def refine_query_keypoints(rows: DataFrame, bound: float = 4.0, options: Options = Options(loss_name="trivial"), sampling: Sampling = Sampling(), inlier: str | None = None) -> DataFrame:
    """query, kp_id, x, y, initial_cost, final_cost: each keypoint moved to where its descriptor meets its references best.

    rows: query, kp_id, x, y, references ARRAY<ARRAY<DOUBLE>>, and a patch. Two parameters a problem; rows are independent, so they
    are solved batch by batch, all of a batch in step, without a shuffle. inlier: a boolean column; rows where it is not true stay
    where they are. Rows without references or with a patch of another size than h x w x c give no row.
    """

    def solve(parts):
        for part in parts:
            for start in range(0, len(part), 512):
                yield moved(part.iloc[start : start + 512])

    def moved(part: pd.DataFrame) -> pd.DataFrame:
        patches, start = Patches(part), part[["x", "y"]].to_numpy(float)
        low, high = _bounds(patches, start, bound)
        counts = part["references"].map(len).to_numpy(int)
        owner, references = np.repeat(np.arange(len(part)), counts), np.array([v for r in part["references"] for v in r], float)
        fixed = np.zeros((len(part), 2), bool) if inlier is None else np.repeat(~(part[inlier].to_numpy(object) == True)[:, None], 2, axis=1)  # noqa: E712
        rho = loss(options.loss_name, options.loss_scale)

        def evaluate(x: np.ndarray, which: np.ndarray):
            value, jac = patches.sample(which, x, sampling)
            position = np.full(len(part), -1)
            position[which] = np.arange(len(which))
            used = np.nonzero(position[owner] >= 0)[0]
            at = position[owner[used]]
            r = value[at] - references[used]
            cost, slope, _ = rho((r**2).sum(axis=1))
            total, pull = np.bincount(at, slope, len(which)), np.zeros((len(which), r.shape[1]))
            np.add.at(pull, at, slope[:, None] * r)
            turned = jac.transpose(0, 2, 1)
            return np.bincount(at, 0.5 * cost, len(which)), total[:, None, None] * (turned @ jac), (turned @ pull[:, :, None])[:, :, 0]

        x, s = minimise_many(start, evaluate, options, counts * references.shape[-1], low, high, fixed)
        return pd.DataFrame({"query": part["query"].to_numpy(), "kp_id": part["kp_id"].to_numpy(), "x": x[:, 0], "y": x[:, 1], "initial_cost": s.initial_cost, "final_cost": s.final_cost})

    fit = rows.where((F.size("references") > 0) & (F.size("data") == F.col("h") * F.col("w") * F.col("c")))
    return fit.mapInPandas(solve, "query string, kp_id int, x double, y double, initial_cost double, final_cost double")


def refine_over_levels(stacked: DataFrame, patches: DataFrame, scratch: Scratch, levels: list[int] | None = None, **how) -> DataFrame:
    """query, kp_id, x, y after refining with the patches of each level in turn, from the highest; a keypoint without patch at a level keeps its place.

    stacked: level, query, kp_id, x, y, references (and the column `inlier` names); patches: level, query, kp_id and a patch.
    """
    if levels is None:
        levels = sorted((r.level for r in patches.select("level").distinct().collect()), reverse=True)
    places = stacked.groupBy("query", "kp_id").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    for level in levels:
        known = stacked.where(F.col("level") == level).drop("x", "y", "level").join(places, ["query", "kp_id"])
        moved = refine_query_keypoints(known.join(patches.where(F.col("level") == level).drop("level"), ["query", "kp_id"]), **how).select("query", "kp_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
        places = scratch.save(places.join(moved, ["query", "kp_id"], "left").select("query", "kp_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")))
    return places


# Absolute pose -----------------------------------------------------------------------------------------------------------------


def pose_from_points(rays: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pose (rotation, translation) of at least six points seen at normalised coordinates, by the direct linear transform."""
    centre, spread = points.mean(axis=0), np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1).mean())
    if spread == 0:
        return None
    x = np.concatenate([(points - centre) / spread, np.ones((len(points), 1))], axis=1)
    zero = np.zeros_like(x)
    rows = np.concatenate([np.concatenate([x, zero, -rays[:, :1] * x], axis=1), np.concatenate([zero, x, -rays[:, 1:] * x], axis=1)])
    p = np.linalg.svd(rows)[2][-1].reshape(3, 4)
    if np.linalg.det(p[:, :3]) < 0:
        p = -p
    u, s, v = np.linalg.svd(p[:, :3])
    if s[2] < 1e-12:
        return None
    r = u @ v
    scale = s.mean()
    return r, p[:, 3] / scale * spread - r @ centre


def _refine_pose(camera: Camera, r: np.ndarray, t: np.ndarray, points: np.ndarray, xy: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Six-parameter refinement of the reprojection error."""
    start = np.concatenate([geometry.quaternion(r), t])
    plus = lambda x, step: np.concatenate([geometry.turned(x[:4], step[:3]), x[4:] + step[3:]])

    def evaluate(x):
        value, by = res.geometric(camera, geometry.rotation_matrix(x[None, :4])[0], x[4:], points, xy)
        return value, np.concatenate([by["turn"], by["t"]], axis=2)

    x, _ = minimise(start, evaluate, options, plus=plus)
    return geometry.rotation_matrix(x[None, :4])[0], x[4:]


def absolute_pose(camera: Camera, points: np.ndarray, xy: np.ndarray, max_error: float = 12.0, trials: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rotation, translation and inlier mask by RANSAC over samples of six, then refinement on the inliers; None without six inliers."""
    if len(points) < 6:
        return None
    rays, rng, best = geometry.undistort(camera.model, camera.params, xy), np.random.default_rng(seed), None
    options = Options(loss_name="cauchy", loss_scale=max(1.0, max_error / 4), max_iterations=30)

    def errors(r, t):
        with np.errstate(all="ignore"):
            pixels, _, p = geometry.project(camera.model, camera.params, r, t, points)
        return np.where(p[:, 2] > 0, np.linalg.norm(pixels - xy, axis=1), np.inf)

    needed = trials
    for trial in range(trials):
        if trial >= needed:
            break
        chosen = rng.choice(len(points), 6, replace=False)
        pose = pose_from_points(rays[chosen], points[chosen])
        if pose is None:
            continue
        inliers = errors(*pose) < max_error
        if best is None or inliers.sum() > best[2].sum():
            best = (*pose, inliers)
            share = inliers.mean() ** 6
            # log1p: 1 - share is 1 for an inlier among many, but the logarithm must not be 0
            needed = int(min(trials, np.ceil(np.log(1e-4) / np.log1p(-min(share, 1 - 1e-12))) + 1)) if share > 0 else trials
    if best is None or best[2].sum() < 6:
        return None
    r, t, inliers = best
    for _ in range(2):
        r, t = _refine_pose(camera, r, t, points[inliers], xy[inliers], options)
        new = errors(r, t) < max_error
        if new.sum() < 6:
            return None
        inliers = new
    return r, t, inliers


POSE = "query string, success boolean, qw double, qx double, qy double, qz double, tx double, ty double, tz double, num_inliers int, inliers array<boolean>"
_POSE_NAMES = [f.strip().split(" ")[0] for f in POSE.split(",")]


@dataclass(frozen=True)
class PoseOptions:
    max_error: float = 12.0
    trials: int = 200
    seed: int = 0


def localize(correspondences: DataFrame, options: PoseOptions = PoseOptions()) -> DataFrame:
    """POSE row per query from correspondences (query, pos, kp_id, point3d_id, x, y, px, py, pz, model, params).

    PnP with RANSAC, the same seed for every query; inliers by pos. A query without a pose has success false and NULLs. Queries are
    groups; one query's correspondences are bounded by its keypoints.
    """

    def solve(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        camera = Camera(rows["model"].iloc[0], np.asarray(rows["params"].iloc[0], float))
        points, xy = rows[["px", "py", "pz"]].to_numpy(float), rows[["x", "y"]].to_numpy(float)
        found = absolute_pose(camera, points, xy, options.max_error, options.trials, options.seed)
        if found is None:
            return pd.DataFrame([[key[0], False, *[None] * 7, 0, [False] * len(rows)]], columns=_POSE_NAMES)
        r, t, inliers = found
        return pd.DataFrame([[key[0], True, *geometry.quaternion(r), *t, int(inliers.sum()), inliers.tolist()]], columns=_POSE_NAMES)

    return correspondences.groupBy("query").applyInPandas(solve, POSE)


def refine_query_poses(rows: DataFrame, options: Options = Options(parameter_tolerance=0.0), sampling: Sampling = Sampling()) -> DataFrame:
    """query, qw..tz, initial_cost, final_cost: poses moved so that descriptors at the projected points meet their references; points and cameras held.

    rows: query, model, params, qw..tz, px, py, pz, reference, and a patch.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names, first, owner = np.unique(part["query"].to_numpy(str), return_index=True, return_inverse=True)
        owner, points, observed = owner.ravel(), part[["px", "py", "pz"]].to_numpy(float), Observed(part, "feature_reference", sampling)
        start = part[["qw", "qx", "qy", "qz", "tx", "ty", "tz"]].to_numpy(float)[first]
        start[:, :4] /= np.linalg.norm(start[:, :4], axis=1, keepdims=True)
        plus = lambda x, step: np.concatenate([geometry.turned(x[:, :4], step[:, :3]), x[:, 4:] + step[:, 3:]], axis=1)
        rho = loss(options.loss_name, options.loss_scale)

        def evaluate(x: np.ndarray, which: np.ndarray):
            position = np.full(len(names), -1)
            position[which] = np.arange(len(which))
            rows = np.nonzero(position[owner] >= 0)[0]
            at = position[owner[rows]]
            r, by = observed.residuals(rows, points[rows], geometry.rotation_matrix(x[:, :4])[at], x[at, 4:])
            jac = np.concatenate([by["turn"], by["t"]], axis=2)
            cost, slope, _ = rho((r**2).sum(axis=1))
            hessian, gradient = np.zeros((len(which), 6, 6)), np.zeros((len(which), 6))
            np.add.at(hessian, at, slope[:, None, None] * (jac.transpose(0, 2, 1) @ jac))
            np.add.at(gradient, at, slope[:, None] * (jac.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0])
            return np.bincount(at, 0.5 * cost, len(which)), hessian, gradient

        x, s = minimise_many(start, evaluate, options, np.bincount(owner, minlength=len(names)), plus=plus)
        return pd.DataFrame({"query": names, **dict(zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), x.T)), "initial_cost": s.initial_cost, "final_cost": s.final_cost})

    return by_problem(rows, "query", solve, "query string, qw double, qx double, qy double, qz double, tx double, ty double, tz double, initial_cost double, final_cost double")


def recount_inliers(correspondences: DataFrame, poses: DataFrame, max_error: float = 12.0) -> DataFrame:
    """query, num_inliers: correspondences whose reprojection error under the pose is below max_error."""
    joined = correspondences.join(poses.select("query", "qw", "qx", "qy", "qz", "tx", "ty", "tz"), "query")
    error = geometry.reprojection_error(F.col("model"), F.col("params"), [F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("tx", "ty", "tz")], [F.col(c) for c in ("px", "py", "pz")], F.col("x"), F.col("y"))
    return joined.groupBy("query").agg(F.count_if(error < max_error).cast("int").alias("num_inliers"))


def localize_all(queries: DataFrame, correspondences: DataFrame, patches: DataFrame | None = None, retrieval: DataFrame | None = None, images: DataFrame | None = None, options: PoseOptions = PoseOptions(), qka: bool = True, qba: bool = True, feature_threshold: float = -1.0) -> DataFrame:
    """POSE of every query: refined keypoints, PnP, unique inliers, refined pose, recounted inliers, in one job over all queries.

    correspondences as for `localize`, with `reference`; patches: query, kp_id and a patch. Without patches no refinement is made. A
    query without pose takes the pose of its first retrieved image (retrieval: query, rank, name), with success false. With a
    feature_threshold of 0 or more, keypoints whose descriptor is farther from their reference are left out (column `descriptor`).
    """
    rows = correspondences if feature_threshold < 0 else feature_inliers(correspondences, feature_threshold)
    if patches is not None and qka:
        stacked = stack_correspondences(rows).join(patches, ["query", "kp_id"])
        moved = refine_query_keypoints(stacked).select("query", "kp_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
        rows = rows.join(moved, ["query", "kp_id"], "left").withColumns({"x": F.coalesce("nx", "x"), "y": F.coalesce("ny", "y")}).drop("nx", "ny")
    poses = localize(rows, options)
    if patches is not None and qba:
        usable = rows.join(poses.where("success").select("query", "qw", "qx", "qy", "qz", "tx", "ty", "tz"), "query")
        quaternion, translation, point = [F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("tx", "ty", "tz")], [F.col(c) for c in ("px", "py", "pz")]
        usable = usable.withColumn("error", geometry.reprojection_error(F.col("model"), F.col("params"), quaternion, translation, point, F.col("x"), F.col("y")))
        inliers = unique_min_error_two_keys(usable.where(F.col("error") < options.max_error))
        better = refine_query_poses(inliers.join(patches, ["query", "kp_id"]))
        counts = recount_inliers(rows, better, options.max_error).select("query", F.col("num_inliers").alias("better_inliers"))
        columns = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
        new = better.select("query", *[F.col(c).alias(f"better_{c}") for c in columns]).join(counts, "query")
        poses = poses.join(new, "query", "left").select("query", "success", *[F.coalesce(f"better_{c}", c).alias(c) for c in columns], F.coalesce("better_inliers", "num_inliers").alias("num_inliers"), "inliers")
    everyone = queries.select("query").join(poses, "query", "left").withColumn("success", F.coalesce("success", F.lit(False)))
    if retrieval is None or images is None:
        return everyone
    columns = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    first = retrieval.groupBy("query").agg(F.min_by("name", "rank").alias("name")).join(images.select("name", *[F.col(c).alias(f"near_{c}") for c in columns]), "name").drop("name")
    return everyone.join(first, "query", "left").select("query", "success", *[F.coalesce(c, f"near_{c}").alias(c) for c in columns], F.coalesce("num_inliers", F.lit(0)).alias("num_inliers"), "inliers")


def best_cluster(candidates: DataFrame) -> DataFrame:
    """Of each query's cluster results (query, cluster, num_inliers, ...), the one with most inliers; the first cluster of equals."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("num_inliers"), "cluster"))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def covisibility_clusters(retrieved: DataFrame, tracks: DataFrame, scratch: Scratch) -> DataFrame:
    """query, image_id, cluster: retrieved images (query, image_id) of a query that observe common points, directly or over others, form a cluster, named by its smallest image.

    tracks: point3d_id, image_id. Each query's images meet through the points they observe, so no pairs of images are made.
    """
    seen = retrieved.join(tracks.select("point3d_id", "image_id").distinct(), "image_id").select("query", "image_id", "point3d_id")
    names = ranked(retrieved.select("query", "image_id").distinct(), ["query", "image_id"], "node")
    points = ranked(seen.select("query", "point3d_id").distinct(), ["query", "point3d_id"], "place")
    links = seen.join(names, ["query", "image_id"]).join(points, ["query", "point3d_id"]).select(F.col("node").alias("src"), (-F.col("place") - 1).alias("dst"))
    nodes = links.select(F.col("src").alias("node_idx")).unionByName(links.select(F.col("dst").alias("node_idx"))).distinct()
    found = components(nodes, links, scratch).where("node_idx >= 0").withColumnsRenamed({"node_idx": "node"})
    grouped = names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("query", "component").agg(F.min("image_id").alias("cluster"))
    return grouped.join(first, ["query", "component"]).select("query", "image_id", "cluster")
