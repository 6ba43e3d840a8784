"""Match graphs as node and edge tables: building, degrees, scores, tracks, roots, edge counts, problem labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trackweave.runtime import Scratch, join_nulls


def build_matching_graph(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_idx, image_id, feature_idx) and directed edges (src, dst, sim) of matches.

    matches: pair_ord, match_ord, image1, kp1, image2, kp2, score. A node's index is its rank by first appearance (pair_ord,
    match_ord, first end before second). A NULL score counts as 1.0; repeated matches stay edges of their own; a match with a NULL
    end is none. The rank is computed in ranges of the first appearance, so no task sees all nodes.
    """
    ends = matches.where(F.col("image1").isNotNull() & F.col("kp1").isNotNull() & F.col("image2").isNotNull() & F.col("kp2").isNotNull())
    first = F.struct(F.col("pair_ord").alias("pair_ord"), F.col("match_ord").alias("match_ord"), F.lit(0).alias("end"), F.col("image1").alias("image_id"), F.col("kp1").alias("feature_idx"))
    second = F.struct(F.col("pair_ord").alias("pair_ord"), F.col("match_ord").alias("match_ord"), F.lit(1).alias("end"), F.col("image2").alias("image_id"), F.col("kp2").alias("feature_idx"))
    seen = ends.select(F.explode(F.array(first, second)).alias("e")).select("e.*").groupBy("image_id", "feature_idx").agg(F.min(F.struct("pair_ord", "match_ord", "end")).alias("at"))
    nodes = ranked(seen, ["at.pair_ord", "at.match_ord", "at.end"], "node_idx").select("node_idx", "image_id", "feature_idx")
    one = nodes.select(F.col("node_idx").alias("src"), F.col("image_id").alias("image1"), F.col("feature_idx").alias("kp1"))
    two = nodes.select(F.col("node_idx").alias("dst"), F.col("image_id").alias("image2"), F.col("feature_idx").alias("kp2"))
    edges = ends.join(one, ["image1", "kp1"]).join(two, ["image2", "kp2"]).select("src", "dst", F.coalesce(F.col("score").cast("double"), F.lit(1.0)).alias("sim"))
    return nodes, edges


def ranked(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """The frame with its 0-based rank by `order` in column `name`, as BIGINT, without bringing all rows to one task.

    Rows are sorted in ranges, as many as the session's partitions make of their size, numbered within each and written. The counts,
    one row per range, are what the running total over all ranges reads.
    """
    place = F.monotonically_increasing_id()
    placed = Scratch(frame.sparkSession, "ranked").save(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    numbered = placed.withColumns({"_range": F.shiftright("_place", 33), "_number": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    return numbered.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_number")).drop("_place", "_range", "_number", "_before")


def ranked_within(frame: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The frame with its 0-based rank by `order` among the rows of equal keys; a key may hold any share of the rows."""
    placed = ranked(frame, [*keys, *order], "_rank")
    starts = placed.groupBy(*keys).agg(F.min("_rank").alias("_start"))
    return join_nulls(placed, starts, keys).withColumn(name, F.col("_rank") - F.col("_start")).drop("_rank", "_start")


def both_ends(edges: DataFrame, *more: str) -> DataFrame:
    """A row (node, other, ...) for each end of each edge."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), *more).select("e.*", *more)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, degree: edges in and out; 0 for a node without edges. An edge that is there in both directions counts twice."""
    counted = both_ends(edges).groupBy(F.col("node").alias("node_idx")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node_idx").join(counted, "node_idx", "left").select("node_idx", F.coalesce("degree", F.lit(0)).alias("degree"))


def scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, score: sum of the similarities of the edges in and out; 0.0 without edges. NULL, NaN and infinite similarities add nothing."""
    finite = F.when(F.abs("sim") < float("inf"), F.col("sim"))
    summed = both_ends(edges, "sim").groupBy(F.col("node").alias("node_idx")).agg(F.sum(finite).alias("score"))
    return nodes.select("node_idx").join(summed, "node_idx", "left").select("node_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node_idx, component: the smallest node of everything linked, directly or not. Nodes without edges are their own component.

    Alternating large and small stars: each pass links larger neighbours, then smaller ones, to the smallest, until all trees are
    stars. Passes are map-side combined aggregates and joins by node, written to the shared folder.
    """
    def written(frame: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        saved = scratch.save(frame.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)")).alias("h")))
        return saved, (seen.get["n"], seen.get["h"])

    links, mark = written(edges.where("src <> dst").select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct())
    changed = mark[0] > 0
    while changed:
        pairs = links.select(F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("high").alias("n")), F.struct(F.col("high").alias("v"), F.col("low").alias("n")))).alias("p")).select("p.*")
        least = pairs.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = pairs.where("n > v").join(least, "v").select(F.col("m").alias("low"), F.col("n").alias("high")).where("low <> high").distinct()
        large = scratch.save(large)
        root = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(root, "high")
        small = moved.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low <> high").union(root.select(F.col("m").alias("low"), "high")).distinct()
        following, now = written(small)
        changed, mark = mark != now, now
        scratch.drop(links, large)
        links = following
    found = links.select(F.col("high").alias("node_idx"), F.col("low").alias("component"))
    return nodes.select("node_idx").join(found, "node_idx", "left").select("node_idx", F.coalesce("component", "node_idx").alias("component"))


#: Edges left between tracks up to which they are replayed by one task (some seconds, 50 bytes an edge).
REPLAYED = 200_000


def track_labels(nodes: DataFrame, edges: DataFrame, scratch: Scratch, replayed: int = REPLAYED) -> DataFrame:
    """node_idx, track: tracks of at most one node per image, from a maximum spanning forest over the edges by (sim, src, dst) descending.

    Two tracks merge along an edge only if they share no image; the larger absorbs the smaller, and of equal ones the source's
    stays. A NULL or NaN similarity comes last. Tracks are numbered from 0 by the smallest position of their roots.

    What an edge does depends on the two tracks at its ends alone, so all edges that come first at both their tracks are taken at
    once: the tracks merge, edges are relabelled, and those between tracks that share an image, which they will for ever, are
    dropped. When at most `replayed` edges are left, they are replayed in the global order by one task. Both are exact.
    The rounds are as many as the longest chain of edges of falling order between tracks that merge.
    """
    last = F.lit(float("-inf"))
    order = F.coalesce(F.nanvl(F.col("sim").cast("double"), last), last)
    sets = scratch.save(nodes.select(F.col("node_idx").alias("track"), F.array(F.col("image_id").cast("bigint")).alias("images")))
    labels = scratch.save(nodes.select("node_idx", F.col("node_idx").alias("track")))
    left = _apart(edges.where("src <> dst").select(order.alias("sim"), "src", "dst", F.col("src").alias("t1"), F.col("dst").alias("t2")), sets, scratch)
    while left.count() > replayed:
        ends = left.select(F.explode(F.array("t1", "t2")).alias("t"), F.struct("sim", "src", "dst", "t1", "t2").alias("e"))
        first = ends.groupBy("t").agg(F.max("e").alias("e")).groupBy("e").count().where("count = 2").select("e.t1", "e.t2")
        size = lambda n: sets.select(F.col("track").alias(f"t{n}"), F.size("images").alias(f"n{n}"))
        keeps = F.col("n1") >= F.col("n2")
        merged = scratch.save(first.join(size(1), "t1").join(size(2), "t2").select(F.when(keeps, F.col("t2")).otherwise(F.col("t1")).alias("old"), F.when(keeps, F.col("t1")).otherwise(F.col("t2")).alias("new")))

        def renamed(frame: DataFrame, column: str, merged: DataFrame = merged) -> DataFrame:
            return frame.join(merged.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        joined = scratch.save(renamed(sets, "track").groupBy("track").agg(F.flatten(F.collect_list("images")).alias("images")))  # two tracks at most
        following = scratch.save(renamed(labels, "track").select("node_idx", "track"))
        fewer = _apart(renamed(renamed(left, "t1"), "t2").where("t1 <> t2").select("sim", "src", "dst", "t1", "t2"), joined, scratch)
        scratch.drop(sets, labels, left, merged)
        sets, labels, left = joined, following, fewer

    met = left.select(F.explode(F.array("t1", "t2")).alias("track")).distinct()
    heads = sets.join(met, "track", "left_semi").select(F.lit(0).alias("kind"), F.col("track").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0.0).alias("sim"), F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("dst"), "images")
    tails = left.select(F.lit(1).alias("kind"), F.col("t1").alias("a"), F.col("t2").alias("b"), "sim", "src", "dst", F.lit(None).cast("array<bigint>").alias("images"))
    roots = heads.unionByName(tails).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_forest, "track bigint, root bigint")
    roots = scratch.save(labels.join(roots, "track", "left").select("node_idx", F.coalesce("root", "track").alias("root")))
    numbers = ranked(roots.select("root").distinct(), ["root"], "track")
    return roots.join(numbers, "root").select("node_idx", "track")


def _apart(edges: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the edges between two tracks the first in order, if the tracks share no image."""
    first = edges.groupBy(F.least("t1", "t2").alias("low"), F.greatest("t1", "t2").alias("high")).agg(F.max(F.struct("sim", "src", "dst", "t1", "t2")).alias("e")).select("e.*")
    images = lambda n: sets.select(F.col("track").alias(f"t{n}"), F.col("images").alias(f"i{n}"))
    return scratch.save(first.join(images(1), "t1").join(images(2), "t2").where(~F.arrays_overlap("i1", "i2")).select("sim", "src", "dst", "t1", "t2"))


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["kind"] == 0].sort_values("a")
    nodes = head["a"].to_numpy()
    parent = np.arange(len(nodes)).tolist()
    images = [set(i) for i in head["images"]]
    tail = rows[rows["kind"] == 1].sort_values(["sim", "src", "dst"], ascending=False)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for one, two in zip(np.searchsorted(nodes, tail["a"].to_numpy(np.int64)).tolist(), np.searchsorted(nodes, tail["b"].to_numpy(np.int64)).tolist()):
        one, two = find(one), find(two)
        if one == two or not images[one].isdisjoint(images[two]):
            continue
        if len(images[one]) < len(images[two]):
            one, two = two, one
        parent[two] = one
        images[one] |= images[two]
        images[two] = set()
    return pd.DataFrame({"track": nodes, "root": nodes[[find(i) for i in range(len(nodes))]] if len(nodes) else nodes})


def intra_track(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (src, dst, sim, track) whose ends are in one track."""
    one = labels.select(F.col("node_idx").alias("src"), "track")
    two = labels.select(F.col("node_idx").alias("dst"), F.col("track").alias("other_track"))
    return edges.join(one, "src").join(two, "dst").where("track = other_track").select("src", "dst", "sim", "track")


def score_labels(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node_idx, score: sum of the similarities of a node's edges within its track."""
    return scores(nodes, intra_track(edges, labels))


def root_labels(labels: DataFrame, node_scores: DataFrame) -> DataFrame:
    """node_idx, is_root: the node of the largest (score, node_idx) of each track."""
    best = labels.join(node_scores, "node_idx").groupBy("track").agg(F.max(F.struct("score", "node_idx")).alias("best")).select(F.col("best.node_idx").alias("node_idx"), F.lit(True).alias("is_root"))
    return labels.select("node_idx").join(best, "node_idx", "left").select("node_idx", F.coalesce("is_root", F.lit(False)).alias("is_root"))


def count_track_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """track, edges: edges within each track, 0 for a track without any."""
    counted = intra_track(edges, labels).groupBy("track").agg(F.count(F.lit(1)).alias("edges"))
    return labels.select("track").distinct().join(counted, "track", "left").select("track", F.coalesce("edges", F.lit(0)).alias("edges"))


def count_edges_ab(edges: DataFrame, labels: DataFrame, roots: DataFrame) -> DataFrame:
    """track, root_edges, other_edges: edges within a track that touch its root, and the rest."""
    flag = lambda end: roots.select(F.col("node_idx").alias(end), F.col("is_root").alias(f"root_{end}"))
    marked = intra_track(edges, labels).join(flag("src"), "src").join(flag("dst"), "dst")
    touches = F.col("root_src") | F.col("root_dst")
    counted = marked.groupBy("track").agg(F.count_if(touches).alias("root_edges"), F.count_if(~touches).alias("other_edges"))
    return labels.select("track").distinct().join(counted, "track", "left").select("track", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("root_edges", "other_edges")])


def required_patches(nodes: DataFrame) -> DataFrame:
    """image_id, kp_ids: the keypoints of each image that the graph needs, ascending."""
    return nodes.groupBy("image_id").agg(F.sort_array(F.collect_set("feature_idx")).alias("kp_ids"))


def root_edges(edges: DataFrame, labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (src, dst, sim, track) of the star around each track's root: given ones that touch it, and new ones of similarity 1.0 for members without."""
    flag = lambda end: roots.select(F.col("node_idx").alias(end), F.col("is_root").alias(f"root_{end}"))
    touching = intra_track(edges, labels).join(flag("src"), "src").join(flag("dst"), "dst").where("(root_src OR root_dst) AND src <> dst").select("src", "dst", "sim", "track")
    track_root = labels.join(roots.where("is_root"), "node_idx").select("track", F.col("node_idx").alias("root"))
    members = labels.join(track_root, "track").where("node_idx <> root")
    met = touching.select("track", F.explode(F.array("src", "dst")).alias("node_idx")).distinct()
    added = members.join(met, ["track", "node_idx"], "left_anti").select(F.col("root").alias("src"), F.col("node_idx").alias("dst"), F.lit(1.0).alias("sim"), "track")
    return touching.unionByName(added)


def ba_problem_labels(points: DataFrame, max_tracks: int = 50) -> DataFrame:
    """point3d_id, problem: as many consecutive ids per problem as max_tracks."""
    return points.select("point3d_id", F.floor(F.col("point3d_id") / F.lit(max_tracks)).cast("bigint").alias("problem"))


def ka_problem_labels(labels: DataFrame, max_keypoints: int = 50) -> DataFrame:
    """node_idx, problem: tracks packed first-fit by size, descending; -1 for max_keypoints takes the largest track's size.

    Sizes are counted by Spark and packed as a histogram: tracks of one size are alike, so the packing reads one row per distinct
    size and lays runs of equal tracks into bins; the runs are joined back by the track's rank within its size. A track as large
    as a problem, or larger, is a problem of its own.
    """
    sizes = labels.groupBy("track").agg(F.count(F.lit(1)).alias("size"), F.min("node_idx").alias("first"))
    placed = ranked_within(sizes, ["size"], ["first"], "rank")
    histogram = [(r["size"], r["count"]) for r in sizes.groupBy("size").count().orderBy(F.desc("size")).collect()]  # one row per distinct track size
    most = max((s for s, _ in histogram), default=1) if max_keypoints == -1 else max_keypoints
    runs = pack_by_size(histogram, most)
    plan = labels.sparkSession.createDataFrame(runs, "size bigint, from_rank bigint, to_rank bigint, per_bin bigint, first_bin bigint")
    hit = placed.join(F.broadcast(plan), "size").where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    packed = hit.select("track", (F.col("first_bin") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per_bin"))).alias("problem"))
    return labels.join(packed, "track").select("node_idx", "problem")


def pack_by_size(histogram: list[tuple[int, int]], most: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, from_rank, to_rank, tracks per bin, first bin) of a first-fit of sizes given in descending order with their counts.

    When the size drops, bins are searched from the first again. Open bins are kept as runs of consecutive bins with one load.
    """
    bins: list[list[int]] = []  # [first bin, how many, load]
    made, out = 0, []
    for size, count in histogram:
        rank = 0
        if size >= most:
            out.append((size, 0, count, 1, made))
            made += count
            continue
        following: list[list[int]] = []
        for first, many, load in bins:
            fit = (most - load) // size
            left = count - rank
            if fit and left:
                full = min(many, left // fit)
                if full:
                    out.append((size, rank, rank + full * fit, fit, first))
                    following.append([first, full, load + fit * size])
                    rank += full * fit
                    first, many = first + full, many - full
                rest = count - rank
                if many and rest:
                    out.append((size, rank, count, rest, first))
                    following.append([first, 1, load + rest * size])
                    rank, first, many = count, first + 1, many - 1
            if many:
                following.append([first, many, load])
        left, fit = count - rank, most // size
        if left:
            out.append((size, rank, count, fit, made))
            full, rest = divmod(left, fit)
            if full:
                following.append([made, full, fit * size])
            if rest:
                following.append([made + full, 1, rest * size])
            made += full + bool(rest)
        bins = [b for b in following if b[2] < most]
    return out


def constant_nodes(nodes: DataFrame, constant_images: DataFrame | None = None, constant_keypoints: DataFrame | None = None, masked: DataFrame | None = None) -> DataFrame:
    """node_idx, is_constant: its image, or its keypoint (image_id, feature_idx), or the node itself (masked: node_idx) is held."""
    held = nodes
    flags: list[Column] = []
    for number, (table, keys) in enumerate(((constant_images, ["image_id"]), (constant_keypoints, ["image_id", "feature_idx"]), (masked, ["node_idx"]))):
        if table is not None:
            held = held.join(table.select(*keys).distinct().withColumn(f"_held{number}", F.lit(True)), keys, "left")
            flags.append(F.coalesce(f"_held{number}", F.lit(False)))
    return held.select("node_idx", F.greatest(F.lit(False), F.lit(False), *flags).alias("is_constant"))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the matches of `new` appended; known keypoints keep their index, new ones follow in order of appearance."""
    more_nodes, more_edges = build_matching_graph(new)
    base = nodes.agg(F.coalesce(F.max("node_idx") + 1, F.lit(0))).first()[0]
    known = nodes.select(F.col("node_idx").alias("old"), "image_id", "feature_idx")
    fresh = ranked(more_nodes.join(known, ["image_id", "feature_idx"], "left_anti"), ["node_idx"], "place")
    mapping = more_nodes.join(known, ["image_id", "feature_idx"]).select("node_idx", F.col("old").alias("to")).unionByName(fresh.select("node_idx", (F.col("place") + base).alias("to")))
    renamed = more_edges.join(mapping.withColumnRenamed("node_idx", "src"), "src").select(F.col("to").alias("src"), "dst", "sim")
    renamed = renamed.join(mapping.withColumnRenamed("node_idx", "dst"), "dst").select("src", F.col("to").alias("dst"), "sim")
    return nodes.unionByName(fresh.select((F.col("place") + base).alias("node_idx"), "image_id", "feature_idx")), edges.unionByName(renamed)
