"""The most similar vectors for every vector: a forest of sorted hash strings with exact cosine at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import Scratch, heavy

#: Bits of a hash string: signs of random projections, held in two BIGINTs.
BITS = 128
#: Trees: sorted arrays of the hash strings, each rotated by a further BITS / TREES bits.
TREES = 10
#: Candidates that a vector's ascent meets at least, all trees together. Each tree is walked so many places to either side.
REACH = 32
#: Bits of 128 in which the strings of two candidates may differ; more where the norms of the centred vectors ask for it (most_apart).
MOST_DIFFERENT = {0.90: 38, 0.95: 32}
#: The chance that a pair of just the least cosine is missed, to which trees are added as the vectors grow in number (enough_trees); others keep TREES.
MOST_MISSED = {0.90: 0.09}
#: Vectors that the centre of the projections is the mean of, and the seed of the projections.
CENTRE_SAMPLE = 20_000
SEED = 20_240_131

#: A vector with so many others near it may have had a walk that ended at the reach: it lies in a dense region and is compared exactly.
CROWDED = REACH // 2


def near_each_other(least_cosine: float) -> float:
    """The cosine that two vectors of the least cosine to a third have to each other at least. So near are the vectors of a region that is dense."""
    return 2 * least_cosine**2 - 1


def grown(frame: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: it meets the other by a shuffle at every size, never by a broadcast."""
    return frame.hint("merge")


CODED = "space bigint, id bigint, tag bigint, idx int, high bigint, low bigint, print bigint, norm float"


def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, BITS)).astype(np.float32)


def most_apart(norm: Column, least_cosine: float) -> Column:
    """Bits in which a centred vector of this norm differs from a longer one of the least cosine: those expected and four standard deviations.

    The centre widens angles: vectors a distance d apart, of norms n or more, are at most 2 asin(d / 2n) apart.
    """
    half = (2 - 2 * least_cosine) ** 0.5 / 2
    share = F.when(norm > half, 2 * F.asin(half / norm) / np.pi).otherwise(1.0)
    return F.least(F.lit(BITS), F.ceil(BITS * share + 4 * F.sqrt(BITS * share * (1 - share)))).cast("smallint")


def enough_trees(count: int, least_cosine: float, most_missed: float | None) -> int:
    """Trees, TREES at least, with which a pair of the least cosine among `count` vectors is missed with this chance at most.

    A walk of REACH places covers the strings that agree in about log2(count / REACH) first bits.
    """
    if most_missed is None or count <= REACH:
        return TREES
    met = (1 - np.arccos(least_cosine) / np.pi) ** np.log2(count / REACH)
    return int(min(BITS, max(TREES, np.ceil(np.log(most_missed) / np.log1p(-met)))))


def hash_strings(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two BIGINT words per row. The vectors are brought to unit length first, so that multiples of a vector agree."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (unit - centre) @ _projections(vectors.shape[1]) > 0
    words = np.packbits(signs, axis=1).view(">i8").astype(np.int64)
    return words[:, 0], words[:, 1]


def _print(rows: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the raw bytes of each row (multilinear hash); together with the 128 bits of the hash string it names groups of exact copies."""
    words = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.shape[1] * rows.itemsize)
    words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
    odd = np.random.default_rng(SEED + 1).integers(0, 2**63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = words * odd
    mixed ^= mixed >> np.uint64(29)
    mixed *= odd[::-1]
    return np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(32)), axis=1).view(np.int64)


def _coded(space: np.ndarray, ids: np.ndarray, tags: np.ndarray, idx: np.ndarray, vectors: np.ndarray, raw: np.ndarray, centre: np.ndarray) -> pa.RecordBatch:
    vectors = vectors.astype(np.float32)
    high, low = hash_strings(vectors, centre)
    norm = np.linalg.norm(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - centre, axis=1).astype(np.float32)
    columns = [space.astype(np.int64), ids.astype(np.int64), tags.astype(np.int64), idx.astype(np.int32), high, low, _print(raw), norm]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["space", "id", "tag", "idx", "high", "low", "print", "norm"])


class Blobs:
    """Row vectors of byte blobs: id = image_id, idx = row number, one space for all. Usable: exactly rows x cols bytes, cols = width, not all zero."""

    def __init__(self, descriptors: DataFrame, width: int = 128) -> None:
        full = (F.col("rows") > 0) & (F.col("cols") == width) & (F.length("data") == F.col("rows").cast("bigint") * F.col("cols"))
        self.width = width
        self.source = descriptors.where(F.col("image_id").isNotNull() & full).select(F.col("image_id").cast("bigint").alias("id"), "rows", "data", F.xxhash64("data").alias("tag"))

    def coded(self) -> DataFrame:
        width = self.width
        sample = [np.frombuffer(r.data, np.uint8).reshape(r.rows, width) for r in _hash_sample(self.source, ["id", "tag"], 400).select("rows", "data").collect()]
        centre = _centre([v[v.any(axis=1)] for v in sample], width)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 256):
                    ids, tags, rows, data = (c.to_pylist() for c in batch.slice(start, 256).columns)
                    vectors = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
                    idx = np.concatenate([np.arange(n) for n in rows])
                    usable = vectors.any(axis=1)
                    ids, tags = np.repeat(np.array(ids, np.int64), rows), np.repeat(np.array(tags, np.int64), rows)
                    vectors = vectors[usable]
                    yield _coded(np.zeros(len(vectors)), ids[usable], tags[usable], idx[usable], vectors, vectors, centre)

        return self.source.select("id", "tag", "rows", "data").mapInArrow(code, CODED)

    def vectors(self, wanted: DataFrame) -> DataFrame:
        """key and vector of the wanted (key, id, tag, idx)."""
        return self.source.join(grown(wanted), ["id", "tag"]).select("key", F.substring("data", F.col("idx") * self.width + 1, F.lit(self.width)).alias("vector")).dropDuplicates(["key"])

    def rows(self) -> DataFrame:
        """space, id, idx, key (a hash of the blob), vector of every usable row vector."""
        rows = self.source.select("id", "tag", "data", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("idx"))
        vector = F.substring("data", F.col("idx") * self.width + 1, F.lit(self.width))
        return rows.select(F.lit(0).cast("bigint").alias("space"), "id", "idx", F.col("tag").alias("key"), vector.alias("vector")).where(F.col("vector") != F.lit(bytes(self.width)))

    def decoder(self) -> Callable[[pa.Array], np.ndarray]:
        width = self.width
        return lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).astype(np.float64)

    def prints(self) -> Callable[[pa.Array], np.ndarray]:
        width = self.width
        return lambda column: _print(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width))


class Arrays:
    """Vectors in a column of arrays of doubles: id = point3d_id, idx = level, a space per level. Usable: `width` finite entries, not all zero."""

    def __init__(self, points: DataFrame, width: int = 64) -> None:
        full = (F.size("descriptor") == width) & ~F.exists("descriptor", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        self.width = width
        self.source = points.where(F.col("point3d_id").isNotNull() & F.col("level").isNotNull() & full).select(
            F.col("point3d_id").cast("bigint").alias("id"), F.col("level").alias("idx"), F.col("descriptor").cast("array<double>").alias("vector"), F.xxhash64("descriptor").alias("tag")
        )

    def coded(self) -> DataFrame:
        width = self.width
        sample = np.array([r.vector for r in _hash_sample(self.source, ["id", "idx", "tag"], CENTRE_SAMPLE // 4).select("vector").collect()], float).reshape(-1, width)
        sample = sample[sample.any(axis=1)]
        centre = _centre([sample / np.abs(sample).max(axis=1, keepdims=True)], width)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, tags, idx = (c.to_numpy() for c in batch.columns[:3])
                vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
                usable = vectors.any(axis=1)
                vectors, idx = vectors[usable], idx[usable]
                scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # huge entries would overflow when squared
                yield _coded(1 + idx.astype(np.int64), ids[usable], tags[usable], idx, scaled, vectors, centre)

        return self.source.select("id", "tag", "idx", "vector").mapInArrow(code, CODED)

    def vectors(self, wanted: DataFrame) -> DataFrame:
        return self.source.join(grown(wanted), ["id", "tag", "idx"]).select("key", "vector").dropDuplicates(["key"])

    def rows(self) -> DataFrame:
        return self.source.select((1 + F.col("idx").cast("bigint")).alias("space"), "id", F.col("idx").cast("int").alias("idx"), F.col("tag").alias("key"), "vector").where(F.exists("vector", lambda v: v != 0))

    def decoder(self) -> Callable[[pa.Array], np.ndarray]:
        width = self.width

        def decode(column: pa.Array) -> np.ndarray:
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return vectors / np.abs(vectors).max(axis=1, keepdims=True)

        return decode

    def prints(self) -> Callable[[pa.Array], np.ndarray]:
        width = self.width
        return lambda column: _print(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0)


def _hash_sample(source: DataFrame, name: list[str], size: int) -> DataFrame:
    """About `size` different rows, those of the least hashes of their names: wherever they are stored, each has the same chance."""
    code = F.xxhash64(F.lit(SEED), *name)
    least = source.select(code.alias("code")).distinct().orderBy("code").limit(size).agg(F.max("code")).first()[0]
    return source.where(code <= F.lit(least).cast("bigint")).dropDuplicates(name)


def _centre(rows: list[np.ndarray], width: int) -> np.ndarray:
    """The mean of at most CENTRE_SAMPLE different unit vectors: all that is fitted. Copies count once, or a large group of them would become the centre."""
    vectors = np.unique(np.concatenate(rows)[:CENTRE_SAMPLE], axis=0).astype(np.float32) if rows else np.zeros((0, width), np.float32)
    if not len(vectors):
        return np.zeros(width, np.float32)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).mean(axis=0).astype(np.float32)


ENTRY = ("tree", "high", "low", "most", "key", "part")
MET = "key1 bigint, key2 bigint, tree bigint, high bigint, low bigint, most smallint, key bigint, part int"


def _met(entries: list[np.ndarray], fresh: int, reach: int, across: bool) -> np.ndarray:
    """Pairs of keys of sorted entries at most `reach` places apart in one tree, near enough by their strings, the later one new (from `fresh` on)."""
    tree, high, low, most, key, part = entries
    high, low = high.view(np.uint64), low.view(np.uint64)
    size, found = len(key), [np.zeros((0, 2), np.int64)]
    for step in range(1, min(reach, size - 1) + 1):
        start = max(0, fresh - step)
        a, b = slice(start, size - step), slice(start + step, size)
        near = tree[a] == tree[b]
        if across:
            near &= part[a] != part[b]
        count = np.bitwise_count(high[a] ^ high[b]) + np.bitwise_count(low[a] ^ low[b])
        at = np.nonzero(near & (count <= np.maximum(most[a], most[b])))[0] + start
        found.append(np.stack([key[at], key[at + step]], axis=1))
    pairs = np.concatenate(found)
    pairs.sort(axis=1)
    return pairs


def _visit(reach: int, across: bool = False):
    """Walks of one range of the sorted arrays: the pairs met, and the first and last `reach` entries, whose walks go on in other ranges.

    across: the entries are such ends of all ranges in one order, and only pairs of different ranges are wanted. A range of 2 reach
    entries or more is cut down to so many, so what is left between two ends is as long as before or too long for a walk.
    """

    def batch_of(pairs: np.ndarray, ends: list[np.ndarray]) -> pa.RecordBatch:
        missing = [pa.nulls(len(ends[0]), pa.int64())] * 2
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int32()]
        columns = [pa.concat_arrays([pa.array(pairs[:, i]), missing[i]]) for i in (0, 1)]
        columns += [pa.concat_arrays([pa.nulls(len(pairs), t), pa.array(c, t)]) for c, t in zip(ends, types[2:])]
        return pa.RecordBatch.from_arrays(columns, names=["key1", "key2", *ENTRY])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rest, seen = None, 0
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not across:
                now.append(np.full(len(batch), own, np.int32))
            first = [c[: max(0, reach - seen)] for c in now]
            seen += len(batch)
            fresh = 0
            if rest is not None:
                fresh = len(rest[0])
                now = [np.concatenate(c) for c in zip(rest, now)]
            pairs = _met(now, fresh, reach, across)
            rest = [c[max(0, len(c) - reach) :] for c in now]
            yield batch_of(pairs, [c[:0] for c in first] if across else first)
        if rest is not None and not across:
            known = max(0, reach - (seen - len(rest[0])))  # of a short range, entries that were among the first
            yield batch_of(np.zeros((0, 2), np.int64), [c[known:] for c in rest])

    return visit


def _rotated(high: Column, low: Column, by: int) -> tuple[Column, Column]:
    if by == 0:
        return high, low
    if by >= 64:
        return _rotated(low, high, by - 64) if by > 64 else (low, high)
    turn = lambda a, b: F.shiftleft(a, by).bitwiseOR(F.shiftrightunsigned(b, 64 - by))
    return turn(high, low), turn(low, high)


def candidates(entries: DataFrame, scratch: Scratch, trees: int = TREES, reach: int = REACH) -> DataFrame:
    """Distinct candidate pairs (key1 < key2) of hash strings (space, high, low, most, key) of one space, which differ in as many bits as `most` of either at most.

    A tree is a sorted array of the strings, rotated by its number; all trees are range-partitioned and sorted at once, so a region
    of the space that holds many vectors is cut into several tasks. A vector descends to its own place, next to which its longest
    prefix matches lie, however long they are; walking away from it means ascending to shorter common prefixes. The trees ascend in
    step: a prefix length at which fewer than `reach` candidates are met in all trees together has fewer than that in each, so
    walks of `reach` places meet all of them, and the candidates of the next length up to that number. They go on to the end of
    every walk, since what is met costs no more.

    The ends of the ranges, 2 reach entries of each, are walked once more in one task, so that walks cross from range to range and
    the candidates don't depend on the partitions.
    """
    forest = F.array(*[F.struct(F.lit(t).cast("bigint").alias("tree"), *[c.alias(n) for c, n in zip(_rotated(F.col("high"), F.col("low"), t * BITS // trees), ("high", "low"))]) for t in range(trees)])
    rows = entries.select(F.explode(forest).alias("t"), "space", "most", "key").select((F.col("space") * trees + F.col("t.tree")).alias("tree"), F.col("t.high").alias("high"), F.col("t.low").alias("low"), "most", "key")
    order = ["tree", "high", "low"]
    met = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order, "key").mapInArrow(_visit(reach), MET))
    ends = met.where(F.col("key").isNotNull()).select(*ENTRY)
    seams = ends.repartition(1).sortWithinPartitions(*order, "key").mapInArrow(_visit(reach, across=True), MET)
    pairs = scratch.save(met.where(F.col("key").isNull()).select("key1", "key2").unionByName(seams.select("key1", "key2")).distinct())
    scratch.drop(met)
    return pairs


def similar_pairs(vectors: Blobs | Arrays, least_cosine: float, most_different: int, scratch: Scratch, k: int = 3, most_missed: float | None = None) -> DataFrame:
    """Pairs of vectors (id1, idx1) < (id2, idx2) of one space with cosine >= least_cosine, one among the k most similar of the other; with the cosine.

    Exact copies form a class and only its first member (by id, idx) enters the forest, so many copies neither fill the reach of
    their neighbours nor make pairs among each other: the most similar others of a copy are the first k of its class, and classes
    near it take the places left. Equal cosines are ordered by (id, idx), copies first. Rows repeated exactly (id, idx, vector) count once.

    Cosines of the candidates are computed from the vectors themselves. The forest finds a pair with probability below 1: recall is
    measured in the tests and stated in the README. Vectors of dense regions, where walks end at the reach, are compared exactly. Vectors with NULL ids, of another length, all zero, or with NULL, NaN or
    infinite entries are no vectors; an empty table gives no rows.
    """
    copy = ["space", "high", "print"]
    once = vectors.coded().groupBy(*copy, "id", "idx", "tag").agg(F.first("low").alias("low"), F.greatest(F.lit(most_different).cast("smallint"), most_apart(F.first("norm"), least_cosine)).alias("most"))
    rows = scratch.save(once.withColumn("key", F.monotonically_increasing_id()))
    first = F.min(F.struct("id", "idx", "tag", "low", "most", "key")).alias("first")
    heads = scratch.save(rows.groupBy(*copy).agg(F.count(F.lit(1)).alias("count"), first).select(*copy, "count", "first.*"))

    several = heads.where("count > 1").select(*copy, "count")
    hot = F.broadcast(heavy(several, rows.count()).select(*copy))  # a class of so many copies doesn't go to one task: its first k + 1 go to its rows
    some = rows.join(hot, copy, "left_anti").join(grown(several.select(*copy)), copy, "left_semi").withColumn("hot", F.lit(False))
    multiple = scratch.save(some.unionByName(rows.join(hot, copy, "left_semi").withColumn("hot", F.lit(True))))
    place = F.row_number().over(Window.partitionBy(*copy).orderBy("id", "idx", "tag"))
    firsts = scratch.save(multiple.withColumn("place", place).where(F.col("place") <= k + 1))
    scratch.drop(rows)

    trees = enough_trees(heads.count(), least_cosine, most_missed)
    pairs = candidates(heads.select("space", "high", "low", "most", "key"), scratch, trees)
    measured = scratch.save(_with_cosine(pairs, heads, vectors, scratch).where(F.col("cosine") >= near_each_other(least_cosine)))
    scratch.drop(pairs)
    near = _with_dense_regions(measured, heads, vectors, least_cosine, k, scratch)

    partners = firsts.select(*copy, F.col("id").alias("id2"), F.col("idx").alias("idx2"), F.col("key").alias("key2"), "place")
    copies = multiple.where("NOT hot").join(grown(partners), copy).unionByName(multiple.where("hot").join(F.broadcast(partners.join(hot, copy, "left_semi")), copy))
    # For a member after the first k + 1, its first k; for one of them, the first k others.
    own_place = firsts.select("key", F.col("place").alias("own"))
    copies = copies.join(grown(own_place), "key", "left").where((F.col("key") != F.col("key2")) & ((F.col("place") <= k) | (F.col("own") <= k)))
    same = copies.select("id", "idx", "id2", "idx2", F.lit(1.0).alias("cosine"))

    ways = near.select(F.explode(F.array(F.struct(F.col("key1").alias("head"), F.col("key2").alias("other")), F.struct(F.col("key2").alias("head"), F.col("key1").alias("other")))).alias("w"), "cosine").select("w.*", "cosine")
    met = heads.join(grown(ways.select(F.col("head").alias("key")).distinct()), "key", "left_semi")  # heads near another; few
    alone = met.where("count = 1").select(F.col("key").alias("head"), "id", "idx", F.lit(1).alias("place"), F.lit(1).cast("bigint").alias("members"))
    together = firsts.join(grown(met.where("count > 1").select(*copy, "count", F.col("key").alias("head"))), copy).select("head", "id", "idx", "place", F.col("count").alias("members"))
    members = scratch.save(alone.unionByName(together))
    others = members.where(F.col("place") <= k).select(F.col("head").alias("other"), F.col("id").alias("id2"), F.col("idx").alias("idx2"))
    ranked = ways.join(grown(others), "other").withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("cosine"), "id2", "idx2"))).where(F.col("rank") <= k)
    nearby = ranked.join(grown(members), "head").where(F.col("rank") <= k + 1 - F.col("members")).select("id", "idx", "id2", "idx2", "cosine")

    first, second = F.struct("id", "idx"), F.struct(F.col("id2").alias("id"), F.col("idx2").alias("idx"))
    ordered = same.unionByName(nearby).select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "cosine").where("a != b")
    return ordered.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).select(F.col("a.id").alias("id1"), F.col("a.idx").alias("idx1"), F.col("b.id").alias("id2"), F.col("b.idx").alias("idx2"), "cosine")


def _with_dense_regions(measured: DataFrame, heads: DataFrame, vectors: Blobs | Arrays, least_cosine: float, k: int, scratch: Scratch) -> DataFrame:
    """The pairs (key1, key2, cosine) of the least cosine, where those among crowded vectors are replaced by each one's k nearest of all heads, found exactly.

    measured: the candidates near_each_other. Crowded are vectors with CROWDED of them or more; strings of vectors far apart come
    near by chance, more often the more vectors there are, and make no dense region. Crowded ones are compared in blocks of near
    ones with all that can have the least cosine to any of the block, so the work is that of the dense regions alone.
    """
    pairs = measured.where(F.col("cosine") >= least_cosine)
    crowded = scratch.save(measured.select(F.explode(F.array("key1", "key2")).alias("key")).groupBy("key").count().where(F.col("count") >= CROWDED).select("key"))
    blocks = -(-crowded.count() // QUERY_BLOCK)
    if not blocks:
        return pairs
    asking = heads.join(grown(crowded), "key", "left_semi")
    vector = vectors.vectors(asking.select("key", "id", "tag", "idx"))
    queries = scratch.save(asking.join(grown(vector), "key").withColumns({"head": F.col("key"), "key": F.col("tag")}).repartitionByRange(blocks, "space", "high", "low").withColumn("block", F.spark_partition_id()))
    named = vectors.rows()
    rest = pairs.join(grown(crowded.withColumnsRenamed({"key": "key1"}).withColumn("one", F.lit(1))), "key1", "left").join(grown(crowded.withColumnsRenamed({"key": "key2"}).withColumn("two", F.lit(1))), "key2", "left").where("one IS NULL OR two IS NULL")
    every, parts = rest.select("key1", "key2"), []
    for b in range(blocks):
        block = queries.where(F.col("block") == b)
        found = _nearest(named, block.orderBy("space", "high", "low"), vectors, k, least_cosine, copies_once=True)
        found = found.join(block.select("id", "idx", "key", "head"), ["id", "idx", "key"]).join(heads.select(F.col("id").alias("other_id"), F.col("idx").alias("other_idx"), F.col("tag").alias("other_key"), F.col("key").alias("other")), ["other_id", "other_idx", "other_key"])
        parts.append(scratch.save(found.select(F.least("head", "other").alias("key1"), F.greatest("head", "other").alias("key2"))))
        every = every.unionByName(parts[-1])
    every = scratch.save(every.distinct())
    near = scratch.save(_with_cosine(every, heads, vectors, scratch).where(F.col("cosine") >= least_cosine))
    scratch.drop(measured, crowded, queries, every, *parts)
    return near


#: Queries compared by one matrix product.
PRODUCT = 256


def _nearest(rows: DataFrame, queries: DataFrame, vectors: Blobs | Arrays, k: int, least: float = -1.0, copies_once: bool = False) -> DataFrame:
    """The k nearest of all rows for a block of queries, exactly: id, idx, key, other_id, other_idx, other_key, cosine.

    Rows and queries have (space, id, idx, key, vector). (id, idx, key) is the name of a row, which counts once however often it is
    repeated, by its most similar vector; a query doesn't meet its own name. Equal cosines are ordered by name. With a least cosine,
    rows are compared only if their angle to the mean of PRODUCT queries allows it to one of them, so queries should come near ones together.
    copies_once: exact copies count once, under their first name, and a query doesn't meet its copies.
    """
    decode, prints, width = vectors.decoder(), vectors.prints(), vectors.width
    asked = queries.select("space", "id", "idx", "key", "vector").toArrow()  # about QUERY_BLOCK rows
    table = decode(asked.column("vector").combine_chunks()) if len(asked) else np.zeros((0, width))
    spaces, q_ids, q_idx, q_keys = (asked.column(c).to_numpy() for c in ("space", "id", "idx", "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_size = np.linalg.norm(table, axis=1)
        asked_unit = (table / asked_size[:, None]).astype(np.float32)
        asked_print = prints(asked.column("vector").combine_chunks()) if copies_once and len(table) else None
        starts = range(0, len(table), PRODUCT)
        means = np.array([asked_unit[s : s + PRODUCT].mean(axis=0) for s in starts]).reshape(-1, width)
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-30)
        angle = lambda cosine: np.arccos(np.clip(cosine, -1, 1))
        within = [angle(asked_unit[s : s + PRODUCT] @ m).max() + np.arccos(least) + 2e-3 for s, m in zip(starts, means)]
        for batch in batches:
            space, ids, idx, keys = (batch.column(i).to_numpy() for i in range(4))
            order = np.lexsort((keys, idx, ids, space))
            space, ids, idx, keys, raw = space[order], ids[order], idx[order], keys[order], decode(batch.column(4))[order]
            if copies_once:
                mark = prints(batch.column(4))[order]
                kept = np.sort(np.unique(np.stack([space, mark], axis=1), axis=0, return_index=True)[1])  # the first by name
                space, ids, idx, keys, raw, mark = space[kept], ids[kept], idx[kept], keys[kept], raw[kept], mark[kept]
            else:
                mark = np.zeros(len(ids), np.int64)
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(space) != 0) | (np.diff(ids) != 0) | (np.diff(idx) != 0) | (np.diff(keys) != 0)
            name = np.cumsum(new) - 1
            size = np.linalg.norm(raw, axis=1)
            unit = (raw / size[:, None]).astype(np.float32)
            toward = angle(unit @ means.T) if least > -1 else None
            out: list[list[np.ndarray]] = []
            for number, start in enumerate(starts):
                q = slice(start, start + PRODUCT)
                rows_in = np.arange(len(ids)) if toward is None else np.nonzero(toward[:, number] <= within[number])[0]
                if not len(rows_in):
                    continue
                similar = asked_unit[q] @ unit[rows_in].T
                same = asked_print[q, None] == mark[rows_in] if copies_once else (q_ids[q, None] == ids[rows_in]) & (q_idx[q, None] == idx[rows_in]) & (q_keys[q, None] == keys[rows_in])
                similar[(spaces[q, None] != space[rows_in]) | same] = -2
                names = name[rows_in]
                firsts = np.nonzero(np.diff(names, prepend=-1))[0]
                by_name = similar if len(firsts) == len(names) else np.maximum.reduceat(similar, firsts, axis=1)
                kth = min(k, by_name.shape[1])
                floor = np.maximum(np.partition(by_name, -kth, axis=1)[:, -kth], least) - 1e-5  # float32 may swap near-equal ones: all within its error stay
                at, column = np.nonzero(similar >= np.maximum(floor, -1.5)[:, None])
                at, column = at + start, rows_in[column]
                exact = np.concatenate([np.einsum("ij,ij->i", table[at[c : c + 20_000]], raw[column[c : c + 20_000]]) for c in range(0, max(1, len(at)), 20_000)]) / (asked_size[at] * size[column])
                order = np.lexsort((-exact, name[column], at))
                at, column, exact = at[order], column[order], exact[order]
                best = np.ones(len(at), bool)
                best[1:] = (np.diff(at) != 0) | (np.diff(name[column]) != 0)
                at, column, exact = at[best], column[best], exact[best]
                order = np.lexsort((name[column], -exact, at))
                at, column, exact = at[order], column[order], exact[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                good = (place < k) & (exact >= least - 1e-9)
                at, column, exact = at[good], column[good], exact[good]
                out.append([q_ids[at], q_idx[at], q_keys[at], ids[column], idx[column], keys[column], mark[column], exact])
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "idx", "key", "other_id", "other_idx", "other_key", "mark", "cosine"])

    asking, other = ["id", "idx", "key"], ["other_id", "other_idx", "other_key"]
    found = rows.select("space", "id", "idx", "key", "vector").mapInArrow(scan, "id bigint, idx int, key bigint, other_id bigint, other_idx int, other_key bigint, mark bigint, cosine double")
    if copies_once:
        name = F.min(F.struct(*other)).alias("name")
        best = found.groupBy(*asking, "mark").agg(F.max("cosine").alias("cosine"), name).select(*asking, "name.*", "cosine")
    else:
        best = found.groupBy(*asking, *other).agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy(*asking).orderBy(F.desc("cosine"), *other))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_cosine(pairs: DataFrame, heads: DataFrame, vectors: Blobs | Arrays, scratch: Scratch) -> DataFrame:
    """key1, key2, cosine: only the vectors that a candidate needs are read out of their sources and moved."""
    keys = pairs.select(F.explode(F.array("key1", "key2")).alias("key")).distinct()
    wanted = scratch.save(heads.join(grown(keys), "key", "left_semi").select("key", "id", "tag", "idx"))
    read = scratch.save(vectors.vectors(wanted))
    decode = vectors.decoder()

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = decode(batch.column(2)), decode(batch.column(3))
            value = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["key1", "key2", "cosine"])

    one, two = (read.select(F.col("key").alias(f"key{n}"), F.col("vector").alias(f"vector{n}")) for n in (1, 2))
    return pairs.join(grown(one), "key1").join(grown(two), "key2").select("key1", "key2", "vector1", "vector2").mapInArrow(cosine, "key1 bigint, key2 bigint, cosine double")


#: Query vectors that one pass over the collection compares at once (10 MB of 128 floats).
QUERY_BLOCK = 20_000


def search(vectors: Blobs | Arrays, asked: Column, scratch: Scratch, k: int = 3) -> DataFrame:
    """The k most similar others of each asked vector (a condition on id and idx): id, idx, rank, other_id, other_idx, cosine.

    Every query is compared with all rows, in blocks of QUERY_BLOCK, by matrix products: a stated query set against everything. A
    good candidate of the forest says nothing about nearer ones that its walk did not visit. Equal cosines are ordered by
    (id, idx); rows repeated exactly count once; fewer than k others give fewer rows.
    """
    rows = vectors.rows().withColumn("key", F.lit(0).cast("bigint"))  # repeated rows and others of a name count once
    queries = scratch.save(rows.where(asked).distinct())
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id", "idx"), F.lit(blocks)))
    found = [scratch.save(_nearest(rows, numbered.where(F.col("block") == b), vectors, k)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found).select("id", "idx", "rank", "other_id", "other_idx", "cosine")
