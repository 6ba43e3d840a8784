"""Filling fixed-capacity containers: bounded-space online best-fit over many independent streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.runtime import Scratch

CAPACITY = 2048
#: Open bins of one stream; together they can leave at most OPEN_BINS bins of a stream partly filled.
OPEN_BINS = 256
#: Tokens that one stream packs (about 16,000 bins of 2,048): the open bins of a stream are below 2 % of its bins.
STREAM_TOKENS = 2**25


class BestFit:
    """Bounded-space best-fit. Open bins are kept by free space; a bitset has a bit per free space that some open bin has.

    An item goes to the fullest open bin that it fits. If it fits none, a bin is opened for it; if OPEN_BINS are open already, the
    fullest closes first. A bin without space left closes at once.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.count, self.made = 0, 0, 0

    def add(self, size: int) -> int:
        """The number of the bin that gets the item; 0 < size <= capacity."""
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            number = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - size
        if rest:
            self.bins[rest].append(number)
            self.bits |= 1 << rest
            self.count += 1
        return number

    def _take(self, free: int) -> int:
        same = self.bins[free]
        number = same.pop()
        if not same:
            self.bits ^= 1 << free
        self.count -= 1
        return number


def pack(sizes: DataFrame, scratch: Scratch, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, stream_tokens: int = STREAM_TOKENS) -> DataFrame:
    """Containers for items (doc_id, n_tokens): doc_id, piece, first_token, n_tokens, stream, container; one row per item or piece.

    An item larger than the capacity is split: pieces 0, 1, ... of exactly the capacity fill containers of their own, and the rest
    is packed like an item. Other items are whole in one container. A container is named by (stream, container).

    The items are spread by a hash of doc_id over ceil(total / stream_tokens) streams, each packed by one task in the order of that
    hash: the result depends on the items alone, not on the cluster. A task keeps the open bins only and streams through its items.
    An item of 0 tokens (an empty or NULL text) goes to container 0 of its stream, where it takes no space; a NULL n_tokens counts
    as 0. Repeated rows are items of their own. No items give no rows.
    """
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    streams = max(1, -(-total // stream_tokens))
    lot = F.xxhash64("doc_id")
    # Full pieces need no packing and may be many for one item: they are made by the JVM, in place.
    whole = F.floor(F.col("n_tokens") / capacity)
    rest = (F.col("n_tokens") - whole * capacity).alias("rest")
    lots = items.select("doc_id", "n_tokens", rest, whole.alias("full"), lot.alias("lot"), F.pmod(lot, F.lit(streams)).alias("stream"))
    full = lots.where("full > 0").select(
        "doc_id", "stream", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), "stream", F.concat(F.lit("f"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("container"))

    def best_fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = packer = None
        for part in parts:
            numbers = []
            for at, size in zip(part["stream"].to_numpy().tolist(), part["rest"].to_numpy().tolist()):
                if at != stream:
                    stream, packer = at, BestFit(capacity, open_bins)
                numbers.append(packer.add(size) if size else 0)
            yield part.assign(container=numbers)

    packed = (
        lots.where("rest > 0 OR full = 0")
        .repartitionById(streams, F.col("stream").cast("int"))
        .sortWithinPartitions("stream", "lot", "doc_id", "n_tokens")
        .mapInPandas(best_fit, lots.schema.add("container", T.LongType()))
        .select("doc_id", F.col("full").alias("piece"), (F.col("full") * capacity).alias("first_token"), F.col("rest").alias("n_tokens"), "stream", F.concat(F.lit("p"), F.col("container")).alias("container"))
    )
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens and the share of the space that is used (NULL without containers)."""
    bins = packed.groupBy("stream", "container").agg(F.sum("n_tokens").alias("used"))
    total = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    space = F.col("containers") * F.lit(capacity)
    return total.select("containers", "tokens", "fullest", (space - F.col("tokens")).alias("unused"), F.try_divide(F.col("tokens"), space).alias("used_share"))
