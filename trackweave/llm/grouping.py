"""Consolidating pairwise links into groups by Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trackweave.runtime import Scratch

#: pair_id = id1 * PAIR_BASE + id2.
PAIR_BASE = 2**31 - 1
#: A keypoint is image_id * 2^31 + kp_id; ids of points, which join their observations, start above all keypoints.
KEYPOINT_SHIFT = 31
POINT_BASE = 2**62


def smallest_member(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a BIGINT, b BIGINT): node, label, where label is the smallest node of the component.

    Deterministic Boruvka hooking over a total order of the edges: each component selects its smallest outgoing edge. Edges are
    ordered by (smaller end, larger end) after relabelling, so the smallest edge of a component is the one to its smallest
    neighbour, and selections can only close cycles of two; there the smaller one becomes the root. The trees collapse by pointer
    doubling, then the edges are relabelled and deduplicated until none remain. At least half of the components vanish per round.

    All steps are joins and map-side combined aggregates on node ids; the rounds are written to the shared folder. No group of
    nodes or edges is gathered in one task. Rows with a NULL end and loops make no link (a node that has only loops is absent);
    repeated and reversed edges count once; no edges give no rows.
    """
    live = scratch.save(_canonical(edges.select("a", "b")))
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        chosen = scratch.save(both.groupBy("node").agg(F.min("to").alias("up")))
        trees = _collapse(chosen, scratch)
        renamed = _relabel(_relabel(live, trees, "a"), trees, "b")
        following = scratch.save(_canonical(renamed))
        scratch.drop(live)
        live = following
        rounds.append(trees)
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels, used = rounds.pop(), []
    used.append(labels)
    while rounds:  # from the small, late rounds back to the first, which has every node
        earlier = rounds.pop()
        used.append(earlier)
        later = labels.select(F.col("node").alias("up"), F.col("label").alias("new_label")) if "label" in labels.columns else labels.select(F.col("node").alias("up"), F.col("up").alias("new_label"))
        labels = earlier.join(later, "up", "left").select("node", F.coalesce("new_label", "up").alias("label"))
    saved = scratch.save(labels if "label" in labels.columns else labels.withColumnRenamed("up", "label"))
    scratch.drop(live, *used)
    return saved


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _relabel(edges: DataFrame, trees: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    return edges.join(trees.withColumnRenamed("node", end), end).select(F.col("up").alias(end), other)


def _collapse(chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """Root of each node: break the cycles of two, then double the pointers until none moves."""
    first = chosen.alias("c").join(chosen.alias("p"), F.col("c.up") == F.col("p.node"))
    is_root = (F.col("p.up") == F.col("c.node")) & (F.col("c.node") < F.col("c.up"))
    trees, moved = _jump(first.select(F.col("c.node"), F.when(is_root, F.col("c.node")).otherwise(F.col("c.up")).alias("up"), is_root.alias("moved")), scratch)
    scratch.drop(chosen)
    moved = 1
    while moved:
        pairs = trees.alias("c").join(trees.alias("p"), F.col("c.up") == F.col("p.node"))
        further, moved = _jump(pairs.select(F.col("c.node"), F.col("p.up"), (F.col("p.up") != F.col("c.up")).alias("moved")), scratch)
        scratch.drop(trees)
        trees = further
    return trees


def _jump(pointers: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    seen = Observation()
    saved = scratch.save(pointers.observe(seen, F.count_if("moved").alias("moved")).select("node", "up"))
    return saved, seen.get["moved"] or 0


def match_links(pair_matches: DataFrame) -> DataFrame:
    """Links (a, b) between keypoints from the elements of matches0 that are not NULL and not negative. A row with a NULL pair_id has none; a NULL stored_reversed counts as false."""
    id2 = F.col("pair_id") % PAIR_BASE
    id1 = F.floor((F.col("pair_id") - id2) / PAIR_BASE).cast("bigint")
    back = F.coalesce("stored_reversed", F.lit(False))
    return (
        pair_matches.where(F.col("pair_id").isNotNull())
        .select(F.when(back, id2).otherwise(id1).alias("from"), F.when(back, id1).otherwise(id2).alias("to"), F.posexplode("matches0").alias("kp1", "kp2"))
        .where(F.col("kp2") >= 0)
        .select(_keypoint(F.col("from"), F.col("kp1")).alias("a"), _keypoint(F.col("to"), F.col("kp2")).alias("b"))
    )


def track_links(tracks: DataFrame) -> DataFrame:
    """Links (a, b) from each observation of a point to a node of that point: as many as observations, whatever the size of the track.

    A point whose id has no node of its own (outside 0..2^61) links the observations of each of its rows to the row's smallest, and
    those to the smallest of all its rows.
    """
    known = tracks.where(F.col("point3d_id").isNotNull())
    plain = F.col("point3d_id").between(0, 2**61 - 1)
    observed = lambda o: (o["track_list_image_id"] >= 0) & (o["track_list_point2d_idx"] >= 0)
    keypoints = F.transform(F.filter(F.arrays_zip("track_list_image_id", "track_list_point2d_idx"), observed), lambda o: _keypoint(o["track_list_image_id"], o["track_list_point2d_idx"]))
    links = known.where(plain).select(F.explode(keypoints).alias("a"), (F.lit(POINT_BASE) + F.col("point3d_id")).alias("b"))
    rows = known.where(~plain).select("point3d_id", keypoints.alias("keypoints"), F.array_min(keypoints).alias("first"))
    least = rows.groupBy("point3d_id").agg(F.min("first").alias("least"))
    between = rows.join(least, "point3d_id").select(F.col("first").alias("a"), F.col("least").alias("b"))
    return links.unionByName(rows.select(F.explode("keypoints").alias("a"), F.col("first").alias("b"))).unionByName(between)


def keypoint_groups(pair_matches: DataFrame, tracks: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per keypoint that is linked to at least one other: image_id, kp_id and the smallest (image_id, kp_id) of its group.

    A keypoint that is the only observation of its point, and in no match, is in no row. NULL or empty arrays hold no links;
    repeated rows and further columns change nothing.
    """
    labels = smallest_member(match_links(pair_matches).unionByName(track_links(tracks)), scratch).where(F.col("node") < POINT_BASE)
    members = labels.where("node != label")
    heads = members.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return members.unionByName(heads).select(*_ids("node", "image_id", "kp_id"), *_ids("label", "group_image_id", "group_kp_id"))


def _keypoint(image, kp):
    return F.shiftleft(image.cast("bigint"), KEYPOINT_SHIFT).bitwiseOR(kp.cast("bigint"))


def _ids(node: str, image: str, kp: str):
    return F.shiftright(node, KEYPOINT_SHIFT).cast("int").alias(image), F.col(node).bitwiseAND(F.lit(2**KEYPOINT_SHIFT - 1)).cast("int").alias(kp)
