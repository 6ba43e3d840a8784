"""Feature patches: sampling at keypoints, cropping, cutting patches from feature maps, storage choice and memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import ids
from trackweave.functions.interpolation import Sampling, crop, inside, sample

#: Columns of a patch; data is row-major with the channel fastest and has h * w * c entries. kp_id NULL: the dense patch of the image.
PATCH = "level int, image_name string, kp_id int, h int, w int, c int, x0 int, y0 int, sx double, sy double, upsampling double, data array<float>"
GRID = ["h", "w", "c", "x0", "y0", "sx", "sy", "upsampling", "data"]


def valid_patches(patches: DataFrame) -> DataFrame:
    """Patches whose data has as many entries as their shape says."""
    return patches.where((F.col("h") > 0) & (F.col("w") > 0) & (F.col("c") > 0) & (F.size("data") == F.col("h") * F.col("w") * F.col("c")))


def sample_patches(rows: DataFrame, how: Sampling = Sampling(), gradients: bool = False) -> DataFrame:
    """The rows (patch columns and x, y in image coordinates) without data, with descriptor ARRAY<DOUBLE>, and by_x, by_y if gradients are asked for.

    Descriptors are sampled per Arrow batch, at once for all patches of one shape. Rows whose data does not fit the shape, with a
    NULL, or outside the patch when how.check_bounds is set, get NULL.
    """
    kept = [c for c in rows.columns if c != "data"]
    outputs = ["descriptor", "by_x", "by_y"] if gradients else ["descriptor"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"{o} array<double>" for o in outputs])
    needed = ["h", "w", "c", "x0", "y0", "sx", "sy", "upsampling", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in needed}
            data = batch.column("data")
            lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(data).to_pylist()])
            shape = np.stack([columns[n] for n in ("h", "w", "c")], axis=1)
            good = np.isfinite(np.stack(list(columns.values()), axis=1)).all(axis=1) & (lengths == shape.prod(axis=1)) & (lengths > 0)
            out: list[list] = [[None] * len(batch) for _ in outputs]
            for h, w, c in np.unique(shape[good], axis=0).astype(int) if good.any() else []:
                at = np.nonzero(good & (shape == [h, w, c]).all(axis=1))[0]
                grids = data.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w, c)
                scale, corner = (np.stack([columns[a][at], columns[b][at]], axis=1) for a, b in (("sx", "sy"), ("x0", "y0")))
                up = columns["upsampling"][at][:, None]
                uv = (np.stack([columns["x"][at], columns["y"][at]], axis=1) * scale - 0.5 - corner) * up
                value, by_r, by_c = sample(grids, uv[:, ::-1], how)
                seen = inside(uv[:, ::-1], h, w) if how.check_bounds else np.ones(len(at), bool)
                results = [value, by_c * (scale * up)[:, :1], by_r * (scale * up)[:, 1:]]
                for slot, result in zip(out, results):
                    for k, v, ok in zip(at, result, seen):
                        slot[k] = v if ok else None
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(o, pa.list_(pa.float64())) for o in out)], names=[*kept, *outputs])

    return rows.select(*kept, "data").mapInArrow(run, schema)


def slice_patches(rows: DataFrame, patch: int) -> DataFrame:
    """Each row's patch cut to patch x patch around (x, y); the corner counts from the feature map, so a patch with a corner can be cut again.

    Built from array slices: one row of pixels after the other.
    """
    u, v = (ids.to_pixel(F.col(a), F.col(s), F.col(o), F.col("upsampling")) for a, s, o in (("x", "sx", "x0"), ("y", "sy", "y0")))
    col, row = ids.clamped_corner(u, patch, F.col("w")), ids.clamped_corner(v, patch, F.col("h"))
    fits = (F.col("w") >= patch) & (F.col("h") >= patch)
    cut = rows.where(fits).withColumn("_col", col).withColumn("_row", row)
    start = lambda k: (F.col("_row") + k) * F.col("w") * F.col("c") + F.col("_col") * F.col("c") + 1
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda k: F.slice("data", start(k).cast("int"), F.lit(patch) * F.col("c"))))
    cut = cut.withColumn("data", data)
    return cut.withColumns({"x0": F.col("x0") + F.col("_col"), "y0": F.col("y0") + F.col("_row"), "h": F.lit(patch), "w": F.lit(patch)}).drop("_col", "_row")


def extract_patches(maps: DataFrame, keypoints: DataFrame, patch: int = 16) -> DataFrame:
    """Patches around keypoints (image_name, kp_id, x, y), cut out of dense feature maps (PATCH rows with NULL kp_id, corner 0).

    The keypoints of an image meet its map in one task, so that the map is moved once; images without map give no rows.
    """
    order = [f.strip().split(" ")[0] for f in PATCH.split(",")]

    def cut(key, left, right):
        import pandas as pd

        rows = []
        for m in left.itertuples():
            grid = np.asarray(m.data, np.float32).reshape(m.h, m.w, m.c)
            scale, size = np.array([m.sx, m.sy]), np.array([m.w, m.h])
            for k in right.itertuples():
                x, y = np.clip(np.trunc(np.array([k.x, k.y]) * scale - patch / 2), 0, np.maximum(size - patch - 1, 0)).astype(int)
                piece = crop(grid, y, x, patch)
                rows.append((m.level, m.image_name, k.kp_id, *piece.shape, int(x), int(y), m.sx, m.sy, m.upsampling, piece.ravel()))
        return pd.DataFrame(rows, columns=order)

    dense = valid_patches(maps.where(F.col("kp_id").isNull())).select(*order)
    wanted = keypoints.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("image_name", "kp_id", "x", "y")
    return dense.groupBy("image_name").cogroup(wanted.groupBy("image_name")).applyInPandas(cut, PATCH)


def storage_choice(image_size: DataFrame, patch: int = 16) -> DataFrame:
    """image_name, is_sparse: store patches (n_keypoints * patch^2) or the whole map (h * w), whichever has fewer entries."""
    return image_size.select("image_name", (F.col("n_keypoints").cast("bigint") * patch * patch < F.col("h").cast("bigint") * F.col("w")).alias("is_sparse"))


def memory_by_level(patches: DataFrame, width: int = 4) -> DataFrame:
    """level, patches, images, bytes of their data; read from the shapes, without the data."""
    return patches.groupBy("level").agg(F.count(F.lit(1)).alias("patches"), F.countDistinct("image_name").alias("images"), F.coalesce(F.sum(ids.patch_bytes(F.col("h"), F.col("w"), F.col("c"), width)), F.lit(0)).alias("bytes"))


def memory_estimate(n_keypoints: Column, channels: list[int], patch: int, width: int = 2) -> Column:
    """Bytes that sparse patches of all levels will take."""
    return n_keypoints.cast("bigint") * F.lit(patch * patch * sum(channels) * width)
