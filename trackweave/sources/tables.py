"""Sources: blobs of a feature database, match arrays, lists in text files, patch and reference caches, models, image folders, results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions import ids
from trackweave.operators.sampling import PATCH

#: File name endings that count as images (the upper-case PNG does not).
IMAGE_ENDINGS = (".png", ".jpeg", ".jpg", ".JPEG", ".JPG")


def image_names(images: DataFrame) -> DataFrame:
    return images.select("image_id", "name").distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair_ord, name1, name2 of a text file with two names a line; shorter and empty lines are skipped. pair_ord follows file and line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pair_ord"), F.split(F.trim("value"), r"\s+").alias("names"))
    return lines.where(F.size("names") >= 2).select("pair_ord", F.col("names")[0].alias("name1"), F.col("names")[1].alias("name2"))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """query, names: the retrieved images of each query in file order."""
    pairs = read_pairs(spark, path)
    return pairs.groupBy(F.col("name1").alias("query")).agg(F.sort_array(F.collect_list(F.struct("pair_ord", "name2"))).alias("p")).select("query", F.transform("p", lambda p: p["name2"]).alias("names"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query, model, width, height, params of a text file: name, camera model, width, height, parameters."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") >= 5)
    return words.select(F.col("w")[0].alias("query"), F.col("w")[1].alias("model"), F.col("w")[2].cast("int").alias("width"), F.col("w")[3].cast("int").alias("height"), F.slice("w", F.lit(5), F.size("w") - 4).cast("array<double>").alias("params"))


def decode_keypoints(blobs: DataFrame) -> DataFrame:
    """image_id, kp_id, x, y from blobs (image_id, rows, cols, data) of 32-bit floats, cols 2, 4 or 6; a NULL blob, or one of another size, has none."""
    return _decode(blobs, "<f4", "image_id int, kp_id int, x double, y double", lambda m: (m[:, 0].astype(float), m[:, 1].astype(float)), "image_id")


def decode_matches(blobs: DataFrame) -> DataFrame:
    """pair_id, match_ord, kp1, kp2 from blobs (pair_id, rows, cols, data) of 32-bit unsigned integers; NULL blobs are skipped. kp1 belongs to the smaller image id."""
    return _decode(blobs, "<u4", "pair_id bigint, match_ord int, kp1 int, kp2 int", lambda m: (m[:, 0].astype(np.int32), m[:, 1].astype(np.int32)), "pair_id")


def _decode(blobs: DataFrame, kind: str, schema: str, pick, key: str) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    width = np.dtype(kind).itemsize
    fit = blobs.where((F.col("rows") > 0) & (F.col("cols") >= 2) & (F.length("data") == F.col("rows").cast("bigint") * F.col("cols") * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows, cols, data in zip(*(c.to_pylist() for c in batch.columns)):
                first, second = pick(np.frombuffer(data, kind).reshape(rows, cols))
                owner = pa.array([own] * rows, pa.int32() if key == "image_id" else pa.int64())
                yield pa.RecordBatch.from_arrays([owner, pa.array(np.arange(rows, dtype=np.int32)), pa.array(first), pa.array(second)], names=names)

    return fit.select(key, "rows", "cols", "data").mapInArrow(run, schema)


def score_matches(matches: DataFrame, descriptors: DataFrame, width: int = 128) -> DataFrame:
    """Matches (pair_id, match_ord, kp1, kp2) with image1, image2 and the cosine of their descriptors as score; 1.0 where one is missing.

    Only the two rows of a match leave the blobs; their cosine is taken batch by batch.
    """
    first, second = ids.pair_images(F.col("pair_id"))
    blobs = descriptors.where((F.col("cols") == width) & (F.length("data") == F.col("rows").cast("bigint") * width)).dropDuplicates(["image_id"])
    joined = matches.withColumns({"image1": first, "image2": second})
    for n in (1, 2):
        side = blobs.select(F.col("image_id").cast("bigint").alias(f"image{n}"), F.col("data").alias("data"), "rows")
        cut = F.when(F.col(f"kp{n}") < F.col("rows"), F.substring("data", F.col(f"kp{n}") * width + 1, F.lit(width)))
        joined = joined.join(side, f"image{n}", "left").withColumn(f"row{n}", cut).drop("data", "rows")
    names = ["pair_id", "match_ord", "image1", "kp1", "image2", "kp2"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            both = np.array([a is not None and b is not None for a, b in zip(one, two)], bool)
            a, b = (np.frombuffer(b"".join(r for r, ok in zip(rows, both) if ok), np.uint8).reshape(-1, width).astype(float) for rows in (one, two))
            size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            out = np.ones(len(batch))
            out[both] = np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out)], names=[*names, "score"])

    return joined.select(*names, "row1", "row2").mapInArrow(score, "pair_id bigint, match_ord int, image1 bigint, kp1 int, image2 bigint, kp2 int, score double")


def decode_pair_matches(pairs: DataFrame) -> DataFrame:
    """pair_ord, match_ord, image1, kp1, image2, kp2, score: a row per match of arrays matches0 (-1 or NULL: none) with matching_scores0; ends are swapped back where the pair is stored reversed. Without scores, or where they are fewer, the score is NULL."""
    small, large = ids.pair_images(F.col("pair_id"))
    back = F.coalesce("stored_reversed", F.lit(False))
    rows = pairs.select("pair_ord", small.alias("small"), large.alias("large"), back.alias("back"), F.posexplode(F.arrays_zip("matches0", F.coalesce("matching_scores0", F.array().cast("array<float>")).alias("matching_scores0"))).alias("i", "m")).where(F.col("m.matches0") >= 0)
    return rows.select(
        "pair_ord", F.col("i").alias("match_ord"), F.col("small").alias("image1"), F.when(F.col("back"), F.col("m.matches0")).otherwise(F.col("i")).alias("kp1"),
        F.col("large").alias("image2"), F.when(F.col("back"), F.col("i")).otherwise(F.col("m.matches0")).alias("kp2"), F.col("m.matching_scores0").cast("double").alias("score"),
    )


def read_patches(spark: SparkSession, path: str, level: int | None = None, names: DataFrame | None = None, metadata_only: bool = False) -> DataFrame:
    """PATCH rows of a cache; a level prunes folders, names (image_name[, kp_id]) are a semi-join, and metadata alone leaves the data unread."""
    patches = spark.read.schema(PATCH).parquet(path)
    if level is not None:
        patches = patches.where(F.col("level") == level)
    if metadata_only:
        patches = patches.drop("data")
    if names is not None:
        keys = [c for c in ("image_name", "kp_id") if c in names.columns]
        patches = patches.join(names.select(*keys).distinct(), keys, "left_semi")
    return patches


def cached_names(patches: DataFrame) -> DataFrame:
    return patches.select("image_name").where(F.col("image_name").isNotNull()).distinct()


def from_arrays(spark: SparkSession, level: int, image_name: str, grids: dict[int | None, np.ndarray], corners: dict[int | None, tuple[int, int]], scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """PATCH rows of arrays in memory: {kp_id or None for the dense map: (h, w, c)}."""
    rows = [(level, image_name, k, *g.shape, *corners.get(k, (0, 0)), *scale, 1.0, np.asarray(g, np.float32).ravel().tolist()) for k, g in grids.items()]
    return spark.createDataFrame(rows, PATCH)


def list_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and bytes of the image files below a folder, by file name ending; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.where(ends_like_image(F.col("path")))


def ends_like_image(name: Column) -> Column:
    out = F.lit(False)
    for ending in IMAGE_ENDINGS:
        out = out | name.endswith(ending)
    return out


def read_model_text(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cameras, images, points2d, points3d and tracks of a reconstruction in text form (cameras.txt, images.txt, points3D.txt; # begins a comment).

    images.txt has two lines an image; they are told apart by the line number within the file, which is read as one split.
    """
    words = lambda name: spark.read.text(f"{folder}/{name}").where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    w = F.col("w")
    cameras = words("cameras.txt").select(w[0].try_cast("int").alias("camera_id"), w[1].alias("model"), w[2].try_cast("int").alias("width"), w[3].try_cast("int").alias("height"), F.slice(w, F.lit(5), F.size(w) - 4).cast("array<double>").alias("params"))
    numbers = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    lines = spark.read.text(f"{folder}/images.txt", wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda v: ~v.startswith("#"))).alias("n", "line"))
    head = lines.where("n % 2 = 0").where(F.trim("line") != "").select("n", F.split(F.trim("line"), r"\s+").alias("w"))
    images = head.select(w[0].try_cast("int").alias("image_id"), *[w[k + 1].try_cast("double").alias(c) for k, c in enumerate(numbers)], w[8].try_cast("int").alias("camera_id"), w[9].alias("name"))
    body = lines.where("n % 2 = 1").select((F.col("n") - 1).alias("n"), F.split(F.trim("line"), r"\s+").alias("p"))
    triples = head.select("n", w[0].try_cast("int").alias("image_id")).join(body, "n").select("image_id", "p", F.explode(F.when(F.size("p") >= 3, F.sequence(F.lit(0), F.floor(F.size("p") / 3).try_cast("int") - 1))).alias("kp_id"))
    at = lambda k: F.get(F.col("p"), F.col("kp_id") * 3 + k)
    points2d = triples.select("image_id", "kp_id", at(0).try_cast("double").alias("x"), at(1).try_cast("double").alias("y"), F.nullif(at(2).try_cast("bigint"), F.lit(-1)).alias("point3d_id"))
    raw = words("points3D.txt")
    points3d = raw.select(w[0].try_cast("bigint").alias("point3d_id"), *[w[k + 1].try_cast("double").alias(c) for k, c in enumerate("xyz")])
    tracks = raw.select(w[0].try_cast("bigint").alias("point3d_id"), w, F.explode(F.when(F.size(w) > 9, F.sequence(F.lit(0), F.floor((F.size(w) - 8) / 2).try_cast("int") - 1))).alias("track_pos"))
    tracks = tracks.select("point3d_id", "track_pos", F.get(w, F.col("track_pos") * 2 + 8).try_cast("int").alias("image_id"), F.get(w, F.col("track_pos") * 2 + 9).try_cast("int").alias("kp_id"))
    return {"cameras": cameras, "images": images, "points2d": points2d, "points3d": points3d, "tracks": tracks}


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of a reconstruction in Parquet."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("cameras", "images", "points2d", "points3d", "tracks")}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def match_keypoints_by_name(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Keypoints (image_name, kp_id, x, y) of a cache, of the given images."""
    keypoints = spark.read.parquet(path)
    return keypoints if names is None else keypoints.where(F.col("image_name").isin(names))


def latest_life(images: DataFrame) -> DataFrame:
    """One row per image: the latest life of its key."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("added_at").desc_nulls_last()))
    return images.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_references(spark: SparkSession, path: str, level: int | None = None, observations: bool = True) -> DataFrame:
    """References of a cache; a level prunes folders, and without observations their arrays stay unread."""
    references = spark.read.parquet(path)
    if level is not None:
        references = references.where(F.col("level") == level)
    return references if observations else references.drop("observations")
