"""Evaluation of poses and reconstructions: recall curves, area under them, distributions, scene means, covisibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import join_nulls, running


def _error(name: str = "error") -> Column:
    """NULL and NaN stand for no result: infinitely wrong."""
    return F.when(F.col(name).isNull() | F.isnan(name), F.lit(float("inf"))).otherwise(F.col(name).cast("double"))


def recall_curve(errors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, error, recall: the share of results with at most this error, a row per distinct finite error.

    Errors are counted by value first, so the running sum is over distinct values.
    """
    counted = errors.select(*keys, _error().alias("error")).groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("all"))
    curve = join_nulls(running(counted, keys, "error", "n"), totals, keys)
    return curve.where(F.col("error") < F.lit(float("inf"))).select(*keys, "error", (F.col("up_to") / F.col("all")).alias("recall"))


def auc_at(errors: DataFrame, keys: list[str], thresholds: list[float], min_error: float | None = None) -> DataFrame:
    """keys, threshold, auc: area under the recall curve up to each threshold, in percent of the threshold.

    With min_error, errors up to it count as met from 0 on. Between errors the curve is linear; from the last error below the
    threshold it is flat.
    """
    counted = errors.select(*keys, _error().alias("error")).groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("error") <= (min_error or -1.0), F.col("n"))), F.lit(0)).alias("met"))
    floor = F.lit(float(min_error or 0.0))
    run = running(counted.where(F.col("error") < F.lit(float("inf"))), keys, "error", "n")
    if min_error is not None:
        run = run.where(F.col("error") > floor)
    # Repeated errors rise vertically: the trapezoid into an error ends at the rank of its first result.
    steps = run.select(*keys, "error", "n", "up_to", "previous").join(totals, keys) if keys else run.crossJoin(totals)  # without keys, totals are one row
    steps = steps.withColumn("prev_error", F.greatest(F.coalesce("previous", floor), floor)).withColumn("prev_n", F.col("up_to") - F.col("n"))
    first_rank = F.col("up_to") - F.col("n") + 1
    steps = steps.withColumn("area", (F.col("error") - F.col("prev_error")) * (F.col("prev_n") + first_rank) / 2 / F.col("all"))
    at = totals.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    inner = at.join(steps.select(*keys, "error", "up_to", "area"), keys, "left") if keys else at.join(steps.select("error", "up_to", "area"), F.lit(True), "left")
    below = F.col("error") <= F.col("threshold")
    sums = inner.groupBy(*keys, "threshold", "all", "met").agg(
        F.coalesce(F.sum(F.when(below, F.col("area"))), F.lit(0.0)).alias("area"), F.max(F.when(below, F.col("error"))).alias("last"), F.max(F.when(below, F.col("up_to"))).alias("reached")
    )
    start = F.least(floor, F.col("threshold"))
    level = F.coalesce(F.col("reached"), F.col("met")) / F.col("all")
    flat = (F.col("threshold") - F.coalesce(F.col("last"), start)) * level
    head = F.col("met") / F.col("all") * start if min_error is not None else F.lit(0.0)
    return sums.select(*keys, "threshold", (100 * (head + F.col("area") + flat) / F.col("threshold")).alias("auc"))


def ecdf(errors: DataFrame, keys: list[str], top: float, steps: int = 100) -> DataFrame:
    """keys, threshold, share: share of errors at most each of `steps` evenly spaced thresholds from 0 to top.

    Errors are put into their step first and the counts summed over steps, so no error meets every threshold.
    """
    width = float(top) / (steps - 1)
    binned = errors.select(*keys, _error().alias("error")).select(*keys, F.greatest(F.least(F.ceil(F.when(F.col("error") < float("inf"), F.col("error")).otherwise(F.lit(2.0 * top)) / width), F.lit(steps)), F.lit(0)).cast("int").alias("step"))
    counts = binned.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy(*keys).agg(F.sum("n").alias("all")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    joined = grid.join(counts, [*keys, "step"], "left")
    up_to = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*keys).orderBy("step"))
    return joined.select(*keys, (F.col("step") * width).alias("threshold"), (up_to / F.col("all")).alias("share"))


def scene_means(results: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean of the measures over the scenes of each group; NULLs do not count."""
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.countDistinct("scene").alias("scenes"))


def result_table(results: DataFrame, rows: list[str], column: str, values: list, measure: str, digits: int = 2) -> DataFrame:
    """A fixed-width table: one text column per value of `column`, the mean of the measure with so many digits."""
    wide = results.groupBy(*rows).pivot(column, values).agg(F.avg(measure))
    return wide.select(*rows, *[F.lpad(F.coalesce(F.format_number(F.col(f"`{v}`"), digits), F.lit("-")), 10, " ").alias(str(v)) for v in values])


def pooled_auc(errors: DataFrame, thresholds: list[float], min_error: float = 0.001) -> DataFrame:
    """method, threshold, auc over the errors of all scenes of a method."""
    return auc_at(errors, ["method"], thresholds, min_error)


#: Images of one point whose pairs covisible_pairs will list (2 million rows a point).
LONGEST_TRACK = 2_000


def covisible_pairs(tracks: DataFrame) -> DataFrame:
    """image1 < image2, shared: 3-D points that both images observe. tracks: point3d_id, image_id."""
    seen = tracks.select("point3d_id", "image_id").distinct()
    longest = seen.groupBy("point3d_id").count().agg(F.max("count")).first()[0] or 0
    if longest > LONGEST_TRACK:
        raise ValueError(f"a point is observed by {longest} images; covisible_pairs pairs all images of a point and takes {LONGEST_TRACK} at most")
    return seen.select("point3d_id", F.col("image_id").alias("image1")).join(seen.select("point3d_id", F.col("image_id").alias("image2")), "point3d_id").where("image1 < image2").groupBy("image1", "image2").agg(F.count(F.lit(1)).alias("shared"))


def covisibility_holdout(tracks: DataFrame, exclude: int) -> DataFrame:
    """image_id, excluded: the `exclude` images that share most points with each image; smaller ids first among equals."""
    pairs = covisible_pairs(tracks)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("image1").alias("image_id"), F.col("image2").alias("excluded")), F.struct(F.col("image2").alias("image_id"), F.col("image1").alias("excluded")))).alias("w"), "shared").select("w.*", "shared")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("shared"), "excluded"))
    return ways.withColumn("rank", rank).where(F.col("rank") <= exclude).select("image_id", "excluded", "shared")


def nearest_point_distance(points: DataFrame, cloud: DataFrame, cell: float) -> DataFrame:
    """id, distance to the nearest cloud point, if one lies within `cell`; others have NULL. points: id, x, y, z; cloud: x, y, z.

    Both sides are put into cubes of edge `cell`; a point meets the 27 cubes around it.
    """
    cube = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = points.select("id", "x", "y", "z", F.explode(around).alias("dx"))
    spread = spread.select("*", F.explode(around).alias("dy"))
    spread = spread.select("id", "x", "y", "z", (cube("x") + F.col("dx")).alias("cx"), (cube("y") + F.col("dy")).alias("cy"), F.explode(F.transform(around, lambda d: cube("z") + d)).alias("cz"))
    filled = cloud.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), cube("x").alias("cx"), cube("y").alias("cy"), cube("z").alias("cz"))
    gap = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    least = spread.join(filled, ["cx", "cy", "cz"]).groupBy("id").agg(F.min(gap).alias("distance")).where(F.col("distance") <= cell)
    return points.select("id").join(least, "id", "left")


def error_by_track_length(points: DataFrame, tolerances: list[float], longest: int = 8, floor: float = 0.002) -> DataFrame:
    """track_length (at most `longest`), points, median error, and the share of errors below each tolerance; errors below `floor` count as floor, NULL errors (ignored points) are dropped."""
    kept = points.where(F.col("error").isNotNull()).select(F.least("track_length", F.lit(longest)).alias("track_length"), F.greatest("error", F.lit(floor)).alias("error"))
    shares = [F.avg((F.col("error") < t).cast("double")).alias(f"below_{t:g}".replace(".", "_")) for t in tolerances]
    return kept.groupBy("track_length").agg(F.count(F.lit(1)).alias("points"), F.percentile("error", F.lit(0.5)).alias("median_error"), *shares)
