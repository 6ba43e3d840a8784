"""Sinks: caches, keypoints, pairs, poses, models and results. A table is written to a new place, never to where it is read from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import ids


def write_patches(patches: DataFrame, path: str) -> None:
    """A folder per level, rows sorted by image and keypoint, so that readers of some images skip most row groups."""
    patches.repartition("level", "image_name").sortWithinPartitions("level", "image_name", "kp_id").write.mode("error").partitionBy("level").parquet(path)


def write_references(references: DataFrame, path: str) -> None:
    references.write.mode("error").partitionBy("level").parquet(path)


def write_keypoints(keypoints: DataFrame, path: str) -> None:
    keypoints.write.mode("error").parquet(path)


def encode_keypoints(keypoints: DataFrame) -> DataFrame:
    """image_id, rows, cols, data: blobs of 32-bit floats in the order of kp_id. An image's keypoints are a group."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.sort_values("kp_id")[["x", "y"]].to_numpy(np.float32)
        return pd.DataFrame([[key[0], len(matrix), 2, matrix.astype("<f4").tobytes()]], columns=["image_id", "rows", "cols", "data"])

    return keypoints.select("image_id", "kp_id", "x", "y").groupBy("image_id").applyInPandas(run, "image_id int, rows int, cols int, data binary")


def encode_matches(matches: DataFrame) -> DataFrame:
    """pair_id, rows, cols, data of matches (image1, image2, match_ord, kp1, kp2); columns swapped where image1 > image2."""
    swap = F.col("image1") > F.col("image2")
    rows = matches.select(ids.pair_id(F.col("image1"), F.col("image2")).alias("pair_id"), "match_ord", F.when(swap, F.col("kp2")).otherwise(F.col("kp1")).alias("a"), F.when(swap, F.col("kp1")).otherwise(F.col("kp2")).alias("b"))

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        matrix = part.sort_values("match_ord")[["a", "b"]].to_numpy("<u4")
        return pd.DataFrame([[key[0], len(matrix), 2, matrix.tobytes()]], columns=["pair_id", "rows", "cols", "data"])

    return rows.groupBy("pair_id").applyInPandas(run, "pair_id bigint, rows int, cols int, data binary")


def encode_descriptors(descriptors: DataFrame) -> DataFrame:
    """image_id, rows, cols, data of byte descriptors (image_id, kp_id, descriptor ARRAY<INT>)."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(part.sort_values("kp_id")["descriptor"].to_numpy()).astype(np.uint8)
        return pd.DataFrame([[key[0], *matrix.shape, matrix.tobytes()]], columns=["image_id", "rows", "cols", "data"])

    return descriptors.groupBy("image_id").applyInPandas(run, "image_id int, rows int, cols int, data binary")


def duplicate_names(images: DataFrame) -> DataFrame:
    """Names that several images have: what a unique index would refuse."""
    return images.groupBy("name").agg(F.countDistinct("image_id").alias("images")).where("images > 1")


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" ", "name1", "name2").alias("value")).write.mode("error").text(path)


def pose_line(parent: bool = False) -> Column:
    """name qw qx qy qz tx ty tz; the name without folders, or with the last one."""
    parts = F.split("name", "/")
    name = F.element_at(parts, -1)
    if parent:
        name = F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))
    return F.concat_ws(" ", name, *[F.col(c).cast("string") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])


def write_poses(poses: DataFrame, path: str, parent: bool = False) -> None:
    """One line per localised query; queries without pose have none."""
    poses.where(F.col("qw").isNotNull()).select(pose_line(parent).alias("value")).write.mode("error").text(path)


def write_model(tables: dict[str, DataFrame], folder: str) -> None:
    for name, frame in tables.items():
        frame.write.mode("error").parquet(f"{folder}/{name}")


def write_ply(points: DataFrame, path: str) -> None:
    """A text point cloud: the header, then x y z lines. It is one file by its format, so it is streamed through one task."""
    count = points.count()
    header = "\n".join(["ply", "format ascii 1.0", f"element vertex {count}", "property float x", "property float y", "property float z", "end_header"])

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        for part in parts:
            yield pd.DataFrame({"value": part["x"].astype(str) + " " + part["y"].astype(str) + " " + part["z"].astype(str)})

    points.select("x", "y", "z").coalesce(1).mapInPandas(lines, "value string").write.mode("error").text(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("error").json(path)


# The tables of a feature database.
DATABASE = {
    "cameras": "camera_id int, model int, width int, height int, params binary, prior_focal_length int",
    "images": "image_id int, name string, camera_id int, prior_qw double, prior_qx double, prior_qy double, prior_qz double, prior_tx double, prior_ty double, prior_tz double",
    "keypoints": "image_id int, rows int, cols int, data binary",
    "descriptors": "image_id int, rows int, cols int, data binary",
    "matches": "pair_id bigint, rows int, cols int, data binary",
    "two_view_geometries": "pair_id bigint, rows int, cols int, data binary, config int, F binary, E binary, H binary",
}
# Numbers of the camera models in a feature database.
MODEL_NUMBERS = {"SIMPLE_PINHOLE": 0, "PINHOLE": 1, "SIMPLE_RADIAL": 2, "RADIAL": 3, "OPENCV": 4}


def encode_cameras(cameras: DataFrame) -> DataFrame:
    """Rows of the table `cameras` from camera_id, model, width, height, params ARRAY<DOUBLE>, prior_focal_length; an unknown model has a NULL number."""
    number = F.create_map(*[F.lit(v) for pair in MODEL_NUMBERS.items() for v in pair])[F.col("model")]
    numbered = cameras.select("camera_id", number.alias("model"), "width", "height", "params", F.coalesce(F.col("prior_focal_length"), F.lit(False)).cast("int").alias("prior_focal_length"))
    return _blobs(numbered, ["params"], DATABASE["cameras"])


def encode_images(images: DataFrame) -> DataFrame:
    """Rows of the table `images`; poses that are missing are NULL."""
    return images.select("image_id", "name", "camera_id", *[(F.col(c) if c in images.columns else F.lit(None)).cast("double").alias(f"prior_{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])


def encode_two_views(matches: DataFrame, geometries: DataFrame) -> DataFrame:
    """Rows of the table `two_view_geometries`: the inlier matches of a pair (see encode_matches) with config and the matrices F, E, H (ARRAY<DOUBLE> of nine, row by row).

    geometries: pair_id, config, F, E, H. A pair without inlier matches has 0 rows; a missing matrix is the identity.
    """
    pairs = geometries.join(encode_matches(matches), "pair_id", "left")
    filled = pairs.select("pair_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(2).alias("cols"), F.coalesce("data", F.lit(b"")).alias("data"), "config", *[F.coalesce(F.col(m), F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])).alias(m) for m in "FEH"])
    return _blobs(filled, ["F", "E", "H"], DATABASE["two_view_geometries"])


def _blobs(frame: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """Arrays of doubles as blobs of 64-bit floats."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{c: [None if v is None else np.asarray(v, "<f8").tobytes() for v in part[c]] for c in columns})

    return frame.select(*[f.split()[0] for f in schema.split(", ")]).mapInPandas(run, schema)


def pairs_of_matches(matches: DataFrame, images: DataFrame, least: int = 1) -> DataFrame:
    """name1, name2 of the image pairs with at least so many matches in the database's blobs (pair_id, rows), for write_pairs."""
    first, second = ids.pair_images(F.col("pair_id"))
    known = matches.where(F.col("rows") >= least).select(first.alias("id1"), second.alias("id2"))
    side = lambda n: images.select(F.col("image_id").cast("bigint").alias(f"id{n}"), F.col("name").alias(f"name{n}")).distinct()
    return known.join(side(1), "id1").join(side(2), "id2").select("name1", "name2")
