"""Exact percentiles per group by bisection of value intervals; the counts add up over partitions and days."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.runtime import Scratch, join_nulls

#: Percent ranks asked for by default.
PERCENTS = (1, 5, 50, 95, 99)
#: A pass halves every interval this often: it counts the rows below 2^HALVINGS - 1 midpoints at once.
HALVINGS = 6
#: The interval table is broadcast only up to this many rows of a few numbers (under 10 MB).
BROADCAST_INTERVALS = 100_000


@F.pandas_udf(T.LongType())
def order_code(values: pd.Series) -> pd.Series:
    """Integers that sort as the doubles do: halving an interval of codes first halves the exponent, so heavy tails cost no extra pass."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(T.DoubleType())
def code_value(codes: pd.Series) -> pd.Series:
    bits = codes.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def coded(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group keys and the code of every finite value; NULL, NaN and infinite values are left out."""
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return values.where(finite).select(*keys, order_code(number).alias("code"))


def count_below(part: DataFrame, keys: list[str], done_bits: int, open_intervals: DataFrame | None) -> DataFrame:
    """Of one part: rows, smallest and largest code in each piece of every open interval. Pieces are named by their leading bits.

    Results of several parts combine by `add_counts`; a part never needs to be seen twice for one pass, nor together with another.
    """
    bits = min(64, done_bits + HALVINGS)
    rows = part.withColumn("piece", F.shiftright("code", 64 - bits))
    if open_intervals is not None:
        rows = join_nulls(rows.withColumn("interval", F.shiftright("code", 64 - done_bits)), open_intervals, [*keys, "interval"], "left_semi")
    return rows.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("rows"), F.min("code").alias("least"), F.max("code").alias("most"))


def add_counts(counts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The counts of all parts together."""
    if len(counts) == 1:
        return counts[0]
    return reduce(DataFrame.unionByName, counts).groupBy(*keys, "piece").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))


def exact_percentiles(parts: list[DataFrame], keys: list[str], value: str, scratch: Scratch, percents: tuple[int, ...] = PERCENTS, passes: int = 11) -> DataFrame:
    """Percentiles of all parts together: keys, n, percent, value, error.

    The percentile p of n values is the smallest value with at least p % of the values at or below it (nearest rank, so the median
    of an even number is the lower one). Per group and percentile an interval of values is kept; each pass counts rows below its
    midpoints and keeps the piece with the target rank. Pieces of one distinct value are done; 11 passes of 6 halvings resolve any
    double, then `error` is 0. With fewer passes `value` is the smallest value of the last piece and `error` the width of that
    piece, which bounds the error.

    Only codes and keys are written, once, to the shared folder. A pass reads them, keeps rows in open intervals and combines
    counts map-side, so one heavy group needs no task of its own. The interval table is broadcast while its counted rows stay below
    BROADCAST_INTERVALS, else joined by a shuffle that splits skewed keys. NULL keys make groups of their own; groups without a
    finite value, and empty parts, give no rows.
    """
    saved = [scratch.save(coded(part, keys, value)) for part in parts]
    targets = intervals = None
    results: list[DataFrame] = []
    for number in range(passes):
        counts = add_counts([count_below(part, keys, number * HALVINGS, intervals) for part in saved], keys)
        final = number == passes - 1
        ranked, still_open = _advance(counts, targets, keys, number * HALVINGS, percents, final, scratch)
        results.append(ranked.where("done").select(*keys, "n", "percent", "least", "most"))
        if not still_open:
            break
        targets = ranked.where("NOT done").select(*keys, "n", "percent", F.col("piece").alias("interval"), F.col("left").alias("rank"))
        intervals = targets.select(*keys, "interval").distinct()
        if still_open <= BROADCAST_INTERVALS:
            intervals = F.broadcast(intervals)
    value_of = code_value(F.col("least"))
    return reduce(DataFrame.unionByName, results).select(*keys, "n", "percent", value_of.alias("value"), (code_value(F.col("most")) - value_of).alias("error"))


def _advance(counts: DataFrame, targets: DataFrame | None, keys: list[str], done_bits: int, percents: tuple[int, ...], final: bool, scratch: Scratch) -> tuple[DataFrame, int]:
    """Each target's piece after a pass, with the rank that is left within it; and how many targets stay open."""
    counts = counts.withColumn("interval", F.shiftright("piece", min(HALVINGS, 64 - done_bits)) if done_bits else F.lit(0).cast("bigint"))
    within = Window.partitionBy(*keys, "interval")
    counts = counts.withColumn("up_to", F.sum("rows").over(within.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)))
    if targets is None:
        ranked = counts.withColumn("n", F.sum("rows").over(within)).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
        ranked = ranked.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("percent") / 100).cast("bigint")))
    else:
        ranked = join_nulls(counts, targets, [*keys, "interval"])
    ranked = ranked.where((F.col("rank") <= F.col("up_to")) & (F.col("rank") > F.col("up_to") - F.col("rows")))
    done = (F.col("least") == F.col("most")) | F.lit(final or done_bits + HALVINGS >= 64)
    seen = Observation()
    ranked = ranked.select(*keys, "n", "percent", "piece", (F.col("rank") - F.col("up_to") + F.col("rows")).alias("left"), "least", "most", done.alias("done"))
    saved = scratch.save(ranked.observe(seen, F.count_if(~F.col("done")).alias("open")))
    return saved, seen.get["open"] or 0


def kept_scores(pair_matches: DataFrame) -> DataFrame:
    """matcher, day, score of the matches kept in matches0 (element not NULL and >= 0); rows repeated with one pair_ord count once.

    A score array that is NULL or shorter than matches0 has no score there. The scores are cut down to the kept ones before the
    shuffle that finds repeated rows.
    """
    kept = F.filter(F.arrays_zip("matches0", "matching_scores0"), lambda m: m["matches0"] >= 0)
    compact = pair_matches.select("pair_ord", "matcher", F.to_date("matched_at").alias("day"), F.transform(kept, lambda m: m["matching_scores0"]).alias("scores"))
    once = compact.where(F.size("scores") > 0).dropDuplicates(["pair_ord"])
    return once.select("matcher", "day", F.explode("scores").alias("score"))


def point_costs(tracks: DataFrame) -> DataFrame:
    """level, scene, cost of every entry of costs; rows repeated with one (level, point3d_id) count once."""
    return tracks.select("level", "point3d_id", "scene", "costs").dropDuplicates(["level", "point3d_id"]).select("level", "scene", F.explode("costs").alias("cost"))


def labelled(field: str, result: DataFrame, first: Column, second: Column) -> DataFrame:
    return result.select(F.lit(field).alias("field"), first.cast("string").alias("group1"), second.cast("string").alias("group2"), "n", "percent", "value", "error")
