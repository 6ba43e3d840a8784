"""References to records that do not exist: missing, deleted or late targets, and their rates per table and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import heavy_keys, shuffle_partitions

REFERENCE_COLUMNS = ["relation", "src_table", "src_column", "row_key", "ref_key", "ref_time"]
TARGET_COLUMNS = ["relation", "ref_key", "added_at", "deleted_at"]


def references_of(source: DataFrame, relation: str, src_table: str, columns: list[str], row_key: str, time: str) -> DataFrame:
    """Rows of REFERENCE_COLUMNS, one per source row and referring column, read in one pass over the source."""
    pairs = F.array(*[F.struct(F.lit(c).alias("src_column"), F.col(c).cast("string").alias("ref_key")) for c in columns])
    return (
        source.select(F.col(row_key).cast("bigint").alias("row_key"), F.col(time).alias("ref_time"), F.explode(pairs).alias("r"))
        .select(F.lit(relation).alias("relation"), F.lit(src_table).alias("src_table"), "r.src_column", "row_key", "r.ref_key", "ref_time")
        .where(F.col("ref_key").isNotNull())
    )


def targets_of(target: DataFrame, relation: str, key: str, added: str = "added_at", deleted: str = "deleted_at") -> DataFrame:
    """Rows of TARGET_COLUMNS: one per life of a target record."""
    return target.select(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("ref_key"), F.col(added).alias("added_at"), F.col(deleted).alias("deleted_at")).where(F.col("ref_key").isNotNull())


def orphan_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """Every reference without a valid target: src_table, src_column, row_key, ref_time, reason; distinct rows.

    References and target lives are co-partitioned by key, sorted by time and merged in one linear pass that carries three running
    sums: lives known at all, lives begun and lives open. A reference is good while a life is open (added_at <= time < deleted_at).
    Otherwise the reason is `missing` (no life of the key), `late` (all lives begin after the time) or `deleted`.

    Keys that hold a large share of the references are salted, and the lives of just these keys are copied to each salt, so no task
    gets a whole heavy key. Defined cases: a NULL key is no reference; a NULL time or a NULL added_at compares as unknown, so such
    a reference is `deleted` if its key exists; a life that ends before it begins is never open; an empty target table makes every
    reference `missing`; repeated rows count once; further columns are ignored.
    """
    spark = references.sparkSession
    references = references.select(*REFERENCE_COLUMNS).where(F.col("ref_key").isNotNull())
    targets = targets.select(*TARGET_COLUMNS).where(F.col("ref_key").isNotNull())
    salts = shuffle_partitions(spark)
    heavy = F.broadcast(heavy_keys(references, ["relation", "ref_key"]).withColumn("heavy", F.lit(True)))
    is_heavy = F.coalesce(F.col("heavy"), F.lit(False))

    refs = references.join(heavy, ["relation", "ref_key"], "left").select(
        "relation", "ref_key",
        F.when(is_heavy, F.pmod(F.xxhash64("row_key", "ref_time"), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"),
        F.col("ref_time").alias("at"), F.lit(1).alias("turn"), _zero("known"), _zero("begun"), _zero("open"),
        "src_table", "src_column", "row_key",
    )
    added, deleted = F.col("added_at"), F.col("deleted_at")
    opens = added.isNotNull() & (deleted.isNull() | (deleted > added))
    steps = F.array(
        _step(F.lit(None).cast("timestamp_ntz"), F.lit(1), F.when(added.isNull(), 1).otherwise(0), F.lit(0)),
        _step(added, F.lit(0), F.when(added.isNull(), 0).otherwise(1), opens.cast("int")),
        _step(deleted, F.lit(0), F.lit(0), -(opens & deleted.isNotNull()).cast("int")),
    )
    lives = (
        targets.withColumns({"added_at": added.cast("timestamp_ntz"), "deleted_at": deleted.cast("timestamp_ntz")})
        .join(heavy, ["relation", "ref_key"], "left")
        .withColumn("salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .select("relation", "ref_key", "salt", F.explode(steps).alias("s"))
        .select("relation", "ref_key", "salt", "s.*")
        .where((F.col("known") != 0) | (F.col("begun") != 0) | (F.col("open") != 0))
        .select("relation", "ref_key", "salt", "at", F.lit(0).alias("turn"), "known", "begun", "open")
    )
    merged = refs.withColumn("at", F.col("at").cast("timestamp_ntz")).unionByName(lives, allowMissingColumns=True)
    order = Window.partitionBy("relation", "ref_key", "salt").orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.select("*", *[F.sum(c).over(order).alias(f"{c}_so_far") for c in ("known", "begun", "open")]).where(F.col("turn") == 1)
    reason = F.when(F.col("known_so_far") == 0, F.lit("missing")).when((F.col("begun_so_far") == 0) & F.col("at").isNotNull(), F.lit("late")).otherwise(F.lit("deleted"))
    return (
        swept.where((F.col("open_so_far") <= 0) | F.col("at").isNull())
        .select("src_table", "src_column", "row_key", F.col("at").alias("ref_time"), reason.alias("reason"))
        .distinct()
    )


def orphan_rates(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per source table, column and month of the reference: distinct references, and orphans by reason. A NULL time makes the month NULL."""
    keys = ["src_table", "src_column", "month"]
    month = F.date_format("ref_time", "yyyy-MM").alias("month")
    all_refs = references.where(F.col("ref_key").isNotNull()).select("src_table", "src_column", "row_key", "ref_key", F.col("ref_time").cast("timestamp_ntz").alias("ref_time")).distinct()
    totals = all_refs.groupBy("src_table", "src_column", month).agg(F.count(F.lit(1)).alias("n_references"))
    counts = orphans.groupBy("src_table", "src_column", month).agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late")])
    same = [totals[k].eqNullSafe(counts[k]) for k in keys]
    return totals.join(counts, same, "left").select(
        *[totals[k] for k in keys], "n_references", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_missing", "n_deleted", "n_late")]
    )


def _zero(name: str) -> Column:
    return F.lit(0).alias(name)


def _step(at: Column, known: Column, begun: Column, opened: Column) -> Column:
    return F.struct(at.alias("at"), known.alias("known"), begun.alias("begun"), opened.alias("open"))
