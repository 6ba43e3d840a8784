"""Selections and joins of the feature tables: required patches, tracks, observations, image pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_view(patches: DataFrame, required: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The patches that are required, by image and keypoint unless other keys are given."""
    keys = keys or ["image_name", "kp_id"]
    return patches.join(required.select(*keys).distinct(), keys, "left_semi")


def visible_observations(points2d: DataFrame) -> DataFrame:
    """Observations with a 3-D point."""
    return points2d.where(F.col("point3d_id").isNotNull())


def track_lengths(points2d: DataFrame) -> DataFrame:
    return visible_observations(points2d).groupBy("point3d_id").agg(F.count(F.lit(1)).alias("track_length"))


def long_tracks(points2d: DataFrame, least: int) -> DataFrame:
    """Observations of points with at least so many."""
    return visible_observations(points2d).join(track_lengths(points2d).where(F.col("track_length") >= least).select("point3d_id"), "point3d_id", "left_semi")


def images_with_points(images: DataFrame, points2d: DataFrame) -> DataFrame:
    return images.join(visible_observations(points2d).select("image_id"), "image_id", "left_semi")


def observation_rows(points2d: DataFrame, points3d: DataFrame, images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations with their point, pose and camera; any that lacks one is dropped."""
    return points2d.join(points3d, "point3d_id").join(images, "image_id").join(cameras, "camera_id")


def residual_counts(rows: DataFrame, key: str) -> DataFrame:
    """Residuals per image, point or camera."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("residuals"))


def contained_tracks(points2d: DataFrame, image_ids: DataFrame) -> DataFrame:
    """point3d_id, contained: whether all observations of the point lie in the given images; only then is the point free to move."""
    inside = points2d.join(image_ids.select("image_id").distinct().withColumn("_in", F.lit(True)), "image_id", "left")
    return visible_observations(inside).groupBy("point3d_id").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("contained"))


def exhaustive_pairs(images: DataFrame) -> DataFrame:
    """name1, name2 for every two images, in name order: as many rows as pairs, which is the feature; meant for one scene's images."""
    names = images.select("name").distinct()
    return names.select(F.col("name").alias("name1")).join(names.select(F.col("name").alias("name2")), F.col("name1") < F.col("name2"))


def without_images(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs of which neither image is excluded."""
    for side in ("name1", "name2"):
        pairs = pairs.join(excluded.select(F.col("name").alias(side)), side, "left_anti")
    return pairs.select("name1", "name2")


def holdout_pairs(images: DataFrame, excluded: DataFrame) -> DataFrame:
    """All pairs of the images that are not excluded; the names are filtered before they are paired."""
    return exhaustive_pairs(images.select("name").join(excluded.select("name"), "name", "left_anti"))


def query_pairs(pairs: DataFrame, queries: DataFrame, excluded: DataFrame) -> DataFrame:
    """query, other: pairs that hold a query, with an other image that is not excluded for it (excluded: query, name)."""
    ways = pairs.select(F.explode(F.array(F.struct(F.col("name1").alias("query"), F.col("name2").alias("other")), F.struct(F.col("name2").alias("query"), F.col("name1").alias("other")))).alias("w")).select("w.*")
    return ways.join(queries.select("query"), "query", "left_semi").join(excluded.select("query", F.col("name").alias("other")), ["query", "other"], "left_anti")


def pairs_of_queries(images: DataFrame, queries: DataFrame, excluded: DataFrame) -> DataFrame:
    """query, other: every query with every other image that is excluded for none (excluded: name); a stated query set against all images."""
    others = images.select(F.col("name").alias("other")).distinct().join(excluded.select(F.col("name").alias("other")), "other", "left_anti")
    return queries.select("query").distinct().join(others, F.col("query") != F.col("other"))


def query_points(matches: DataFrame, points2d: DataFrame) -> DataFrame:
    """query, kp_id, point3d_id: distinct 3-D points that a query's keypoints reach over their matches in the model's images (matches: query, kp_id, image_id, db_kp_id)."""
    return matches.join(visible_observations(points2d).select("image_id", F.col("kp_id").alias("db_kp_id"), "point3d_id"), ["image_id", "db_kp_id"]).select("query", "kp_id", "point3d_id").distinct()


def assign_nearest_keypoints(places: DataFrame, keypoints: DataFrame, radius: float = 1.0) -> DataFrame:
    """The keypoint of the same image nearest to each place (image_id, pos, x, y), within the radius; the smaller kp_id of equals. Places meet keypoints by grid cells."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    near = places.select("image_id", "pos", "x", "y", around("x").alias("cx")).select("*", around("y").alias("cy"))
    table = keypoints.select("image_id", "kp_id", F.col("x").alias("kx"), F.col("y").alias("ky"), cell("x").alias("cx"), cell("y").alias("cy"))
    joined = near.join(table, ["image_id", "cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky"))).where(F.col("distance") <= radius)
    rank = F.row_number().over(Window.partitionBy("image_id", "pos").orderBy("distance", "kp_id"))
    return joined.withColumn("_rank", rank).where("_rank = 1").select("image_id", "pos", "kp_id", "distance")


def patch_warp_rows(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Each observation beside the source observation of its point's reference, whose columns get the prefix src_; the source itself is left out."""
    source = references.select("point3d_id", F.col("src_image_id").alias("src_image_id"), F.col("src_kp_id").alias("src_kp_id"))
    columns = [c for c in rows.columns if c not in ("point3d_id", "image_id", "kp_id")]
    renamed = rows.select("point3d_id", F.col("image_id").alias("src_image_id"), F.col("kp_id").alias("src_kp_id"), *[F.col(c).alias(f"src_{c}") for c in columns])
    joined = rows.join(source, "point3d_id").join(renamed, ["point3d_id", "src_image_id", "src_kp_id"])
    return joined.where((F.col("image_id") != F.col("src_image_id")) | (F.col("kp_id") != F.col("src_kp_id")))


def without_points(images: DataFrame, points2d: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model without 3-D points and without the excluded images."""
    kept = images.join(excluded.select("image_id"), "image_id", "left_anti")
    return kept, points2d.join(kept.select("image_id"), "image_id", "left_semi").withColumn("point3d_id", F.lit(None).cast("bigint"))


def missing_names(required: DataFrame, images: DataFrame) -> DataFrame:
    """name, rows: required names that no image has, with how many rows ask for them; they are left out of the joins."""
    return required.join(images.select("name"), "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def retrieval_ids(retrieval: DataFrame, images: DataFrame) -> DataFrame:
    """query, image_id of the retrieved images that the model has."""
    return retrieval.join(images.select("name", "image_id"), "name").select("query", "image_id")


def jacobian_entries(observations: Column, active_params: Column, residuals: int) -> Column:
    """Non-zero entries of the Jacobian."""
    return observations.cast("bigint") * active_params * F.lit(residuals)
