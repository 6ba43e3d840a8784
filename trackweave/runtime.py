"""Session settings, table access and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that the plans rely on; a cluster's own settings win where they exist.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A local session for tests, the bench and the command line; folder becomes spark.checkpoint.dir."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor reaches.

    Where it is unset, a session whose driver is its only executor (master local[...]) gets a folder of its own; on a cluster that is
    an error, since executors would write to their own disks and read back other rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _remove_at_exit(spark, folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. A written table survives the loss of executors and ends the lineage before it."""

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._made = 0
        _remove_at_exit(spark, self.base)

    def save(self, frame: DataFrame) -> DataFrame:
        """Write the frame and return it as read back."""
        self._made += 1
        path = f"{self.base}/{self._made}"
        frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        """Delete all tables of the run. A caller that has written what it wants leaves here; results not yet read are lost."""
        _delete(self.spark, self.base)

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables of this run that no later plan reads."""
        for frame in saved:
            _delete(self.spark, frame._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone first; the folder is then left to its owner
            pass

    atexit.register(remove)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of fewer rows is never heavy.
LEAST_HEAVY = 10_000


def heavy(counts: DataFrame, total: int, share_of_task: float = 0.25) -> DataFrame:
    """Rows of `counts` (count, ...) with more than a fourth of an even task's share of `total`.

    At most shuffle partitions / share_of_task can pass, whatever the data: that bound makes the result fit for a broadcast.
    """
    least = max(LEAST_HEAVY, total * share_of_task / shuffle_partitions(counts.sparkSession))
    return counts.where(F.col("count") > F.lit(int(least)))


def heavy_keys(frame: DataFrame, keys: list[str], share_of_task: float = 0.25) -> DataFrame:
    """Keys that hold more rows than a fourth of an even task's share, by an exact, map-side combined count in one pass."""
    seen = Observation()
    counts = frame.groupBy(*keys).count().observe(seen, F.sum("count").alias("rows"))
    large = Scratch(frame.sparkSession, "heavy").save(counts.where(F.col("count") > LEAST_HEAVY))
    return heavy(large, seen.get["rows"] or 0, share_of_task).select(*keys)


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the key columns of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    joined = left.join(renamed, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"right_{k}" for k in keys])


def running(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The frame with `up_to`, the sum of `value` over the rows of equal keys up to this one by `order`, and `previous`, the `order` before it (NULL for the first).

    Values of `order` differ within a key. Rows are sorted in ranges by key and order and written; a key may hold any share of the
    rows, for it is summed range by range, and the sums of the ranges before are added.
    """
    placed = Scratch(frame.sparkSession, "running").save(frame.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(order)
    own = placed.withColumns({"_sum": F.sum(value).over(inside), "_previous": F.lag(order).over(inside)})
    totals = placed.groupBy("_range", *keys).agg(F.sum(value).alias("_n"), F.max(order).alias("_last"))
    by_range = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range")  # of a key, a row per range
    before = totals.select("_range", *keys, (F.sum("_n").over(by_range) - F.col("_n")).alias("_before"), F.lag("_last").over(by_range).alias("_before_last"))
    joined = join_nulls(own, before, ["_range", *keys])
    return joined.withColumns({"up_to": F.col("_sum") + F.col("_before"), "previous": F.coalesce("_previous", "_before_last")}).drop("_range", "_sum", "_previous", "_before", "_before_last")
