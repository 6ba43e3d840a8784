"""Match arrays that keep arriving: each pair once, decoded to match rows, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trackweave.sources.tables import decode_pair_matches


def new_matches(pairs: DataFrame, late: str | None = None) -> DataFrame:
    """Match rows of a stream of pair_matches, each pair_ord once, in whatever order and however late the rows come.

    The state holds the keys of all pairs seen (16 bytes each, on disk with the RocksDB state store). With `late` a watermark on
    ingested_at bounds it: keys are forgotten after that time, and rows that come later than that behind the newest are lost.
    """
    if late is None:
        return decode_pair_matches(pairs.dropDuplicates(["pair_ord"]))
    once = pairs.withColumn("ingested_at", pairs["ingested_at"].cast("timestamp")).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["pair_ord"])
    return decode_pair_matches(once)


def append_matches(pairs: DataFrame, table: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Everything that is there now, then stop: run it as often as data comes."""
    return new_matches(pairs, late).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
