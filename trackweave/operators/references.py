"""Robust reference descriptors of tracks, their selection, and the nearest reference of a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import arrays, geometry
from trackweave.functions.interpolation import Sampling, l2_normalise, ncc_normalise
from trackweave.functions.losses import loss
from trackweave.operators.sampling import sample_patches


def robust_mean(descriptors: np.ndarray, loss_name: str = "cauchy", scale: float = 0.25, iterations: int = 100, nodes: int = 1, l2: bool = False, ncc: bool = False) -> np.ndarray:
    """Iteratively reweighted mean of descriptors (n, nodes * channels) with weights 1 / rho(squared distance); a descriptor at distance 0 is the mean."""
    rho = loss(loss_name, scale)
    weights = np.ones(len(descriptors))
    mean = descriptors[0]
    for _ in range(iterations):
        weights = weights / weights.sum()
        mean = (weights @ descriptors).reshape(1, nodes, -1)
        if ncc:
            (mean,) = ncc_normalise(mean)
        if l2:
            (mean,) = l2_normalise(mean)
        mean = mean.ravel()
        cost = rho(((descriptors - mean) ** 2).sum(axis=1))[0]
        exact = np.nonzero(cost <= 0)[0]
        if len(exact):
            return descriptors[exact[0]]
        weights = 1 / cost
    return mean


REFERENCES = (
    "level int, point3d_id bigint, src_image_id int, src_kp_id int, n_nodes int, channels int, descriptor array<double>, mean array<double>, "
    "observations array<struct<track_pos:int,image_id:int,kp_id:int,descriptor:array<double>,cost:double>>"
)


def extract_references(observed: DataFrame, loss_name: str = "cauchy", scale: float = 0.25, iterations: int = 100, n_nodes: int = 1, l2: bool = True, ncc: bool = False, closest: bool = True, keep_observations: bool = True) -> DataFrame:
    """One reference per (level, point3d_id) from observations (level, point3d_id, track_pos, image_id, kp_id, descriptor).

    `mean` is the robust mean; `descriptor` is the observation closest to it (the first of equals by track_pos), or the mean itself
    if closest is off. NULL descriptors, and those with NULL or NaN entries, are no observations; a point without any has no
    reference. Points are independent groups; a track is as long as its images are many, which bounds a group.
    """
    good = observed.where(F.col("descriptor").isNotNull() & ~F.exists("descriptor", lambda v: v.isNull() | F.isnan(v)) & (F.size("descriptor") > 0))

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("track_pos", kind="stable")
        matrix = np.stack(rows["descriptor"].to_numpy()).astype(float)
        mean = robust_mean(matrix, loss_name, scale, iterations, n_nodes, l2, ncc)
        distance = ((matrix - mean) ** 2).sum(axis=1)
        best = int(distance.argmin())
        chosen = matrix[best] if closest else mean
        cost = 0.5 * loss(loss_name, scale)(((matrix - chosen) ** 2).sum(axis=1))[0]
        kept = []
        if keep_observations:
            kept = [{"track_pos": int(p), "image_id": int(i), "kp_id": int(k), "descriptor": d, "cost": float(c)} for p, i, k, d, c in zip(rows["track_pos"], rows["image_id"], rows["kp_id"], matrix, cost)]
        source = rows.iloc[best]
        return pd.DataFrame([[key[0], key[1], int(source["image_id"]), int(source["kp_id"]), n_nodes, matrix.shape[1] // n_nodes, chosen, mean, kept]], columns=[c.strip().split(" ")[0] for c in "level x, point3d_id x, src_image_id x, src_kp_id x, n_nodes x, channels x, descriptor x, mean x, observations x".split(",")])

    columns = ["level", "point3d_id", "track_pos", "image_id", "kp_id", "descriptor"]
    return good.select(*columns).groupBy("level", "point3d_id").applyInPandas(one, REFERENCES)


def observe(tracks: DataFrame, projected: DataFrame, patches: DataFrame, images: DataFrame, how: Sampling = Sampling()) -> DataFrame:
    """Descriptors of observations: tracks (point3d_id, track_pos, image_id, kp_id), positions (image_id, kp_id, x, y) and patches joined and sampled.

    Observations without patch are dropped; `missing_patches` counts them.
    """
    places = tracks.join(projected.select("image_id", "kp_id", "x", "y"), ["image_id", "kp_id"]).join(images.select("image_id", F.col("name").alias("image_name")), "image_id")
    sampled = sample_patches(places.join(patches, ["image_name", "kp_id"]), how)
    return sampled.select("level", "point3d_id", "track_pos", "image_id", "kp_id", "descriptor").where(F.col("descriptor").isNotNull())


def missing_patches(required: DataFrame, patches: DataFrame) -> DataFrame:
    """image_name, missing: required keypoints (image_name, kp_id) without patch."""
    return required.join(patches.select("image_name", "kp_id").distinct(), ["image_name", "kp_id"], "left_anti").groupBy("image_name").agg(F.count(F.lit(1)).alias("missing"))


def closest_to(observed: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, the observation with the smallest squared distance to the group's mean; the first track_pos of equals."""
    distance = arrays.squared_distance(F.col("descriptor"), F.col("mean"))
    best = F.min_by(F.struct("image_id", "kp_id", "track_pos", "distance"), F.struct("distance", "track_pos")).alias("best")
    return observed.join(means, keys).withColumn("distance", distance).groupBy(*keys).agg(best).select(*keys, "best.*")


def nearest_references(queries: DataFrame, references: DataFrame) -> DataFrame:
    """query, pos, point3d_id, reference: of the observations of the matched point, the one nearest to the query's descriptor; the first of equals.

    A correspondence whose point has no reference, or none with observations, gives no row; `unmatched_correspondences` lists them.
    """
    joined = queries.join(references.select("point3d_id", F.explode("observations").alias("o")), "point3d_id")
    distance = arrays.squared_distance(F.col("descriptor"), F.col("o.descriptor"))
    rank = F.row_number().over(Window.partitionBy("query", "pos", "point3d_id").orderBy(distance, F.col("o.track_pos")))
    return joined.withColumn("_rank", rank).where("_rank = 1").select("query", "pos", "point3d_id", F.col("o.descriptor").alias("reference"), F.col("o.image_id").alias("src_image_id"), F.col("o.kp_id").alias("src_kp_id"))


def unmatched_correspondences(queries: DataFrame, references: DataFrame) -> DataFrame:
    return queries.join(references.where(F.size("observations") > 0).select("point3d_id"), "point3d_id", "left_anti")


def select_references(references: DataFrame, kind: str = "nearest") -> DataFrame:
    """What a localiser compares with: `robust_mean` (the chosen descriptor), `all_observations` (their descriptors in track order) or `full` (everything)."""
    if kind == "robust_mean":
        return references.select("level", "point3d_id", F.array("descriptor").alias("references"))
    if kind in ("all_observations", "nearest"):
        return references.select("level", "point3d_id", F.transform(F.array_sort("observations"), lambda o: o["descriptor"]).alias("references"))
    if kind == "full":
        return references
    raise ValueError(f"unknown reference kind {kind!r}")


def references_of_model(tracks: DataFrame, points3d: DataFrame, images: DataFrame, cameras: DataFrame, patches: DataFrame, how: Sampling = Sampling(), **options) -> DataFrame:
    """One reference per point and level from a model and patches: each point is projected into the images of its track, the patches are sampled there, and the descriptors reduced.

    tracks: point3d_id, track_pos, image_id, kp_id; points3d: point3d_id, px, py, pz; images: image_id, name, camera_id, qw..tz;
    cameras: camera_id, model, params. Further options are those of extract_references.
    """
    rows = tracks.join(points3d, "point3d_id").join(images, "image_id").join(cameras, "camera_id")
    pose, shift, point = ([F.col(c) for c in names] for names in (("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"), ("px", "py", "pz")))
    u, v = geometry.world_to_pixel(F.col("model"), F.col("params"), pose, shift, point)
    placed = rows.select("point3d_id", "track_pos", "image_id", "kp_id", F.col("name").alias("image_name"), u.alias("x"), v.alias("y")).where(F.col("x").isNotNull())
    sampled = sample_patches(placed.join(patches, ["image_name", "kp_id"]), how)
    observed = sampled.select("level", "point3d_id", "track_pos", "image_id", "kp_id", "descriptor").where(F.col("descriptor").isNotNull())
    return extract_references(observed, n_nodes=len(how.nodes), l2=how.l2_normalize, ncc=how.ncc_normalize, **options)


def node_offsets(rows: DataFrame, how: Sampling) -> DataFrame:
    """point3d_id, offsets ARRAY<ARRAY<DOUBLE>>: where each node of the source observation lies around the point, at the point's depth, facing the source.

    rows: point3d_id, px, py, pz and pose and camera of the source (model, params, qw..tz). Nodes are offsets in image pixels.
    """

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples():
                turn = geometry.rotation_matrix(np.array([[r.qw, r.qx, r.qy, r.qz]], float))[0]
                shift, point, params = np.array([r.tx, r.ty, r.tz], float), np.array([r.px, r.py, r.pz], float), np.asarray(r.params, float)
                pixel, _, p = geometry.project(r.model, params, turn, shift, point[None])
                world = geometry.back_project(r.model, params, turn, shift, pixel + np.array(how.nodes), np.full(len(how.nodes), p[0, 2]))
                out.append((r.point3d_id, (world - point).tolist()))
            yield pd.DataFrame(out, columns=["point3d_id", "offsets"])

    return rows.mapInPandas(run, "point3d_id bigint, offsets array<array<double>>")
