"""Items that appear together: a blocked Gram matrix of baskets and items, normalised by expected marginals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import Scratch, join_nulls

#: Items of one block of the matrix; a dense product of two blocks is BLOCK x BLOCK counts of 4 bytes (4 MB).
BLOCK = 1024
#: Observations that one record block aims at.
RECORD_BLOCK = 200_000


def basket_items(tracks: DataFrame) -> DataFrame:
    """scene, basket, item: the images of the observations of each point (both list entries not NULL and >= 0), over all its rows; one may come several times, which `together` counts once."""
    return (
        tracks.where(F.col("point3d_id").isNotNull())
        .select("scene", F.col("point3d_id").alias("basket"), F.explode(F.arrays_zip("track_list_image_id", "track_list_point2d_idx")).alias("o"))
        .where((F.col("o.track_list_image_id") >= 0) & (F.col("o.track_list_point2d_idx") >= 0))
        .select("scene", "basket", F.col("o.track_list_image_id").alias("item"))
    )


def together(items: DataFrame, least_count: int = 4, least_lift: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """Pairs of items of a scene: scene, item1 < item2, n baskets, c1, c2, c together, lift = c*n / (c1*c2); c >= least_count, lift >= least_lift.

    Gram matrix by blocks: items are numbered densely within their scene and cut into blocks of BLOCK; record blocks hold about
    RECORD_BLOCK observations. An observation goes to the products of its item block with the item blocks of its own basket, never
    to pairs of items. Each (scene, record block, block pair) computes one transpose-product X1' X2 of binary sparse blocks, and
    the products are summed by item pair with map-side combine.

    Exact pruning first: c <= min(c1, c2), so an item of fewer than least_count baskets, or of more than n / least_lift, is in no
    result (n, c1, c2 are counted before). One scene may hold most rows: its record and item blocks are separate groups.
    NULL scenes form one scene of their own; empty input gives no rows; repeated rows count once.
    """
    own = scratch or Scratch(items.sparkSession, "together")
    items = own.save(items.select(F.col("scene").alias("scene"), "basket", "item").where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct())
    baskets = items.select("scene", "basket").distinct().groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    margins = items.groupBy("scene", "item").agg(F.count(F.lit(1)).alias("c1"))
    fit = join_nulls(margins, baskets, ["scene"]).where((F.col("c1") >= least_count) & (F.col("c1") * F.lit(float(least_lift)) <= F.col("n")))
    sizes = fit.groupBy("scene").agg(F.count(F.lit(1)).alias("kept_items"), F.sum("c1").alias("kept_rows"))
    # The numbering restarts in slices of the items by hash, so a scene with very many items is not numbered by one task.
    number = F.row_number().over(Window.partitionBy("scene", "slice").orderBy("item")) - 1
    fit = (
        join_nulls(fit, sizes, ["scene"])
        .withColumn("slice", F.pmod(F.xxhash64("item"), F.ceil(F.col("kept_items") / F.lit(64 * BLOCK))))
        .withColumn("tile", F.col("slice") * F.lit(2**31) + F.floor(number / BLOCK))
        .select("scene", "item", "c1", "n", "kept_rows", "tile")
    )
    fit = own.save(fit)
    record_block = F.pmod(F.xxhash64("basket"), F.ceil(F.col("kept_rows") / F.lit(RECORD_BLOCK))).cast("int")
    rows = join_nulls(items, fit, ["scene", "item"]).select("scene", "basket", "item", "tile", record_block.alias("record_block"))
    rows = own.save(rows)
    tiles = rows.select("scene", "basket", F.col("tile").alias("other")).distinct()
    grams = (
        join_nulls(rows, tiles, ["scene", "basket"])
        .select("scene", "record_block", F.least("tile", "other").alias("tile1"), F.greatest("tile", "other").alias("tile2"), (F.col("tile") <= F.col("other")).alias("left"), (F.col("tile") >= F.col("other")).alias("right"), "basket", "item")
        .groupBy("scene", "record_block", "tile1", "tile2")
        .applyInPandas(_gram, "scene string, item1 bigint, item2 bigint, c bigint")
        .groupBy("scene", "item1", "item2")
        .agg(F.sum("c").alias("c"))
        .where(F.col("c") >= least_count)
    )
    first = fit.select("scene", F.col("item").alias("item1"), "c1", "n")
    second = fit.select("scene", F.col("item").alias("item2"), F.col("c1").alias("c2"))
    joined = join_nulls(join_nulls(grams, first, ["scene", "item1"]), second, ["scene", "item2"])
    return joined.where(F.col("c") * F.col("n") >= F.lit(float(least_lift)) * F.col("c1") * F.col("c2")).select(
        "scene", "item1", "item2", "n", "c1", "c2", "c", (F.col("c") * F.col("n") / (F.col("c1") * F.col("c2"))).alias("lift")
    )


def _gram(rows: pd.DataFrame) -> pd.DataFrame:
    """The product of one record block and block pair: counts of item1 < item2."""
    left, right = rows[rows["left"]], rows[rows["right"]]
    diagonal = len(left) == len(right) == len(rows)
    baskets = np.unique(rows["basket"].to_numpy())
    items1, records1, columns1 = _binary(left, baskets)
    items2, records2, columns2 = _binary(right, baskets)
    total = np.zeros((len(items1), len(items2)), np.int64)
    step = min(len(baskets), max(1, 2**22 // max(len(items1), len(items2), 1)))  # records of a dense slice: at most 16 MB a side
    for start in range(0, len(baskets), step):
        x1 = _dense(records1, columns1, start, step, len(items1))
        x2 = _dense(records2, columns2, start, step, len(items2))
        total += (x1.T @ x2).astype(np.int64)  # exact: fewer than 2^24 ones are summed
    i, j = np.nonzero(total)
    one, two, counts = items1[i], items2[j], total[i, j]
    keep = one < two if diagonal else np.ones(len(one), bool)  # a diagonal block holds every pair twice
    return pd.DataFrame({"scene": rows["scene"].iloc[0], "item1": np.minimum(one, two)[keep], "item2": np.maximum(one, two)[keep], "c": counts[keep]})


def _binary(rows: pd.DataFrame, baskets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ones of a sparse binary block: the items of its columns, and record and column of each one, by record."""
    items, columns = np.unique(rows["item"].to_numpy(), return_inverse=True)
    records = np.searchsorted(baskets, rows["basket"].to_numpy())
    order = np.argsort(records, kind="stable")
    return items, records[order], columns[order]


def _dense(records: np.ndarray, columns: np.ndarray, start: int, step: int, width: int) -> np.ndarray:
    ones = slice(*np.searchsorted(records, [start, start + step]))
    block = np.zeros((step, width), np.float32)
    block[records[ones] - start, columns[ones]] = 1
    return block
