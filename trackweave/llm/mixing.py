"""Mixing sources to target weights: hash-random order, distributed prefix sums of sizes, exact budgets, capped repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import Scratch, join_nulls

#: Records that one range of hash keys aims at.
RANGE_RECORDS = 100_000
SEED = 7


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source with a target: source, target_share, max_repeats, documents, available (tokens of one epoch), budget (tokens wanted).

    Without `total` the mixture is as large as it can be with all shares exact: the total at which the first source with documents
    reaches available * max_repeats. With `total`, sources that cannot fill their share give all they may, and what they miss is
    spread over the others in proportion to their shares until every budget is met or every source is used up (water filling).
    Shares of targets without documents are spread in the same way. A NULL or negative share counts as 0, a NULL or negative
    max_repeats as 0; a source named by several target rows gets their summed share and the largest max_repeats.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).cast("bigint").alias("max_repeats")
    )
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available"))
    rows = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available")).orderBy("source").collect()
    # One row per target row of a configuration table: its size does not follow the corpus.
    caps = {r.source: r.available * r.max_repeats for r in rows}
    shares = {r.source: r.target_share for r in rows if caps[r.source] and r.target_share > 0}
    whole = sum(shares.values())
    if total is None:
        total = int(min((caps[s] * whole / share for s, share in shares.items()), default=0))
    wants = dict.fromkeys(caps, 0.0)
    left, rest = dict(shares), float(min(total, sum(caps[s] for s in shares)))
    while left:
        weight = sum(left.values())
        full = [s for s, share in left.items() if rest * share / weight >= caps[s]]
        if not full:
            wants |= {s: rest * share / weight for s, share in left.items()}
            break
        for s in full:
            wants[s] = caps[s]
            rest -= caps[s]
            del left[s]
    data = [(*r, int(round(wants[r.source]))) for r in rows]
    return sizes.sparkSession.createDataFrame(data, "source string, target_share double, max_repeats bigint, documents bigint, available bigint, budget bigint")


def mixture(sizes: DataFrame, targets: DataFrame, scratch: Scratch, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Chosen documents: doc_id, source, n_tokens, repeats (1..max_repeats).

    Each document gets a hash-random key; within its source, documents are ordered by it in ranges of equal width of the key. Sums
    per range give each range its offset (distributed prefix sums), the running sum within a range does the rest, and the source
    is cut where the running total comes nearest to its budget. Whole epochs before the cut repeat every document of the source.
    Each document occurs floor(budget / available) times, and once more if it lies before the cut of the last epoch.

    No task holds more than one range (about RANGE_RECORDS documents), however large the source is. Documents with a NULL source,
    or a source without target, are not chosen; nor are documents without tokens. Repeated rows of `sizes` are documents of their
    own. The choice depends on doc_id and seed, not on the layout.
    """
    sizes = sizes.select("doc_id", "source", "n_tokens").where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    plan = F.broadcast(budgets(sizes, targets, total).where("budget > 0"))  # as many rows as targets
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**31)).cast("bigint")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("documents") / RANGE_RECORDS)).cast("bigint")
    keyed = scratch.save(
        sizes.join(plan.select("source", "max_repeats", "documents", "available", "budget"), "source")
        .select("doc_id", "source", "n_tokens", "max_repeats", "available", "budget", lot.alias("lot"), F.floor(lot * ranges / 2**31).cast("bigint").alias("range"))
    )
    per_range = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    offsets = per_range.select("source", "range", (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("offset"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("lot", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_nulls(keyed, offsets, ["source", "range"]).withColumn("up_to", F.col("offset") + running)
    epochs = F.floor(F.col("budget") / F.col("available"))
    cut = F.col("budget") - epochs * F.col("available")
    # Nearest to the cut: a document is in if at least half of it lies before the cut.
    again = (F.col("up_to") - F.col("n_tokens") / 2 <= cut) & (epochs < F.col("max_repeats"))
    return placed.select("doc_id", "source", "n_tokens", (epochs + again.cast("bigint")).alias("repeats")).where("repeats > 0")


def shares_report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, documents, available, budget, tokens, actual_share, most_repeats. All NULL-free; a source without documents has 0."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    rows = plan.join(got, "source", "left").select(*plan.columns, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    everything = F.sum("tokens").over(Window.partitionBy())  # as many rows as targets
    return rows.withColumn("actual_share", F.when(everything > 0, F.col("tokens") / everything).otherwise(F.lit(0.0)))
