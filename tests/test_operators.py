"""Operators on small tables, against brute force and planted truth."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave import paths
from trackweave.functions import geometry, ids
from trackweave.functions.interpolation import Sampling, sample
from trackweave.operators import adjust, evaluation, extraction, graph, localize, references, sampling, views
from trackweave.operators.adjust import BundleSetup, KeypointOptions
from trackweave.operators.solver import Options
from trackweave.runtime import Scratch, running
from trackweave.sources import sinks, tables

NODES, EDGES = "node_idx bigint, image_id int, feature_idx int", "src bigint, dst bigint, sim double"


def forest(nodes, edges):
    """Tracks by one pass over all edges."""
    parent, images = {n: n for n, *_ in nodes}, {n: {i} for n, i, *_ in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in sorted(((s, a, b) for a, b, s in edges), reverse=True):
        a, b = find(a), find(b)
        if a != b and not images[a] & images[b]:
            if len(images[a]) < len(images[b]):
                a, b = b, a
            parent[b] = a
            images[a] |= images[b]
    roots = sorted({find(n) for n in parent})
    return {n: roots.index(find(n)) for n in parent}


def build(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_track_example(spark):
    nodes, edges = build(spark, [(0, 1, 0), (1, 2, 0), (2, 1, 1), (3, 3, 0)], [(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7)])
    labels = {r.node_idx: r.track for r in graph.track_labels(nodes, edges, Scratch(spark, "t")).collect()}
    assert labels == {0: 0, 1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("replayed", [0, 40, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_tracks_by_rounds_and_by_replay(spark, replayed, seed):
    rng = random.Random(seed)
    nodes = [(n, rng.randrange(9), n) for n in range(80)]
    edges = [(rng.randrange(80), rng.randrange(80), rng.choice([0.1, 0.2, 0.5, 0.7])) for _ in range(150)]
    n, e = build(spark, nodes, edges + [(7, 7, 0.9)])
    labels = {r.node_idx: r.track for r in graph.track_labels(n, e, Scratch(spark, "t"), replayed).collect()}
    assert labels == forest(nodes, edges)


def test_tracks_of_a_chain_and_of_odd_similarities(spark):
    nodes, edges = build(spark, [(i, i % 7, i) for i in range(30)], [(i, i + 1, 1.0 - i / 100) for i in range(29)] + [(0, 9, None), (3, 12, float("nan"))])
    by_rounds = {r.node_idx: r.track for r in graph.track_labels(nodes, edges, Scratch(spark, "t"), 0).collect()}
    replayed = {r.node_idx: r.track for r in graph.track_labels(nodes, edges, Scratch(spark, "t")).collect()}
    assert by_rounds == replayed and len(set(by_rounds.values())) == 5
    empty, none = build(spark, [], [])
    assert graph.track_labels(empty, none, Scratch(spark, "t")).count() == 0


def test_running_sums_and_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i / 7, rng.randrange(5)) for i in range(400)]
    got = running(spark.createDataFrame(rows, "k string, v double, n bigint"), ["k"], "v", "n").collect()
    for key in ("a", "b", None):
        own, total, before = sorted((r for r in got if r.k == key), key=lambda r: r.v), 0, None
        assert len(own) == sum(r[0] == key for r in rows)
        for r in own:
            total += r.n
            assert r.up_to == total and r.previous == before
            before = r.v
    places = graph.ranked_within(spark.createDataFrame(rows, "k string, v double, n bigint"), ["k"], ["v"], "place").collect()
    assert {(r.k, r.v): r.place for r in places} == {(k, v): sum(o[0] == k and o[1] < v for o in rows) for k, v, _ in rows}


def test_graph_against_one_pass(spark):
    rng = random.Random(5)
    nodes = [(n, rng.randrange(6), n) for n in range(120)]
    edges = [(rng.randrange(120), rng.randrange(120), rng.choice([0.1, 0.2, 0.5])) for _ in range(110)]
    edges = [e for e in edges if e[0] != e[1]]
    scratch = Scratch(spark, "t")
    n, e = build(spark, nodes, edges)
    table = scratch.save(graph.track_labels(n, e, scratch))
    labels = {r.node_idx: r.track for r in table.collect()}
    assert labels == forest(nodes, edges)
    scores = dict.fromkeys(range(120), 0.0)
    inner = {}
    for a, b, s in edges:
        if labels[a] == labels[b]:
            inner[labels[a]] = inner.get(labels[a], 0) + 1
            scores[a] += s
            scores[b] += s
    got = scratch.save(graph.score_labels(n, e, table))
    assert {r.node_idx: round(r.score, 9) for r in got.collect()} == {k: round(v, 9) for k, v in scores.items()}
    roots = {r.node_idx for r in graph.root_labels(table, got).where("is_root").collect()}
    best = {}
    for node, track in labels.items():
        best[track] = max(best.get(track, (-1, -1)), (round(scores[node], 9), node))
    assert {labels[r] for r in roots} == set(best) and len(roots) == len(best)
    counts = {r.track: r.edges for r in graph.count_track_edges(e, table).collect()}
    assert counts == {t: inner.get(t, 0) for t in best}
    star = graph.root_edges(e, table, graph.root_labels(table, got)).collect()
    assert all(r.src in roots or r.dst in roots for r in star)
    assert {x for r in star for x in (r.src, r.dst)} == {k for k, t in labels.items() if sum(v == t for v in labels.values()) > 1}
    problems = {r.node_idx: r.problem for r in graph.ka_problem_labels(table, 7).collect()}
    sizes = {}
    for node, p in problems.items():
        sizes[p] = sizes.get(p, 0) + 1
    assert set(problems) == set(labels) and max(sizes.values()) <= 7 and all(problems[a] == problems[b] for a in labels for b in labels if labels[a] == labels[b])


def test_matching_graph_keeps_first_appearance(spark):
    rows = [(0, 0, 5, 1, 6, 2, 0.5), (0, 1, 5, 3, 6, 2, None), (1, 0, 6, 2, 7, 9, 0.2), (2, 0, None, 1, 6, 1, 0.3), (2, 1, 5, 1, 6, 2, 0.5)]
    matches = spark.createDataFrame(rows, "pair_ord bigint, match_ord int, image1 int, kp1 int, image2 int, kp2 int, score double")
    nodes, edges = graph.build_matching_graph(matches)
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, 5, 1), (1, 6, 2), (2, 5, 3), (3, 7, 9)]
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 0.5), (0, 1, 0.5), (1, 3, 0.2), (2, 1, 1.0)]
    assert {r.node_idx: r.degree for r in graph.degrees(nodes, edges).collect()} == {0: 2, 1: 4, 2: 1, 3: 1}
    more = spark.createDataFrame([(9, 0, 7, 9, 8, 8, 0.9)], matches.schema)
    nodes, edges = graph.add_edges(nodes, edges, more)
    assert (4, 8, 8) in {tuple(r) for r in nodes.collect()} and (3, 4, 0.9) in {tuple(r) for r in edges.collect()}
    held = graph.constant_nodes(nodes, constant_images=spark.createDataFrame([(6,)], "image_id int"), masked=spark.createDataFrame([(3,)], "node_idx bigint"))
    assert {r.node_idx for r in held.where("is_constant").collect()} == {1, 3}


def test_rank_over_ranges(spark):
    rng = random.Random(1)
    values = [(rng.randrange(1000), i) for i in range(3000)]
    got = {r.i: r.place for r in graph.ranked(spark.createDataFrame(values, "v bigint, i bigint"), ["v", "i"], "place").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted(values))}


def field(shift):
    """One smooth field seen by a patch with its centre shifted."""
    y, x = np.meshgrid(np.arange(16.0), np.arange(16.0), indexing="ij")
    x, y = x + shift[0], y + shift[1]
    return np.stack([np.sin(x / 4), np.cos(y / 5), np.sin((x + y) / 6), np.cos((x - y) / 7)], axis=2)


def patch_row(level, name, kp, grid):
    return (level, name, kp, *grid.shape, 0, 0, 1.0, 1.0, 1.0, grid.ravel().tolist())


@pytest.mark.parametrize("strategy", ["featuremetric", "topological_reference"])
def test_keypoint_adjustment_recovers_a_shift(spark, strategy):
    patches = spark.createDataFrame([patch_row(0, "a", 0, field((0, 0))), patch_row(0, "b", 0, field((0.7, -0.4)))], sampling.PATCH)
    images = spark.createDataFrame([(1, "a"), (2, "b")], "image_id int, name string")
    keypoints = spark.createDataFrame([(1, 0, 8.0, 8.0), (2, 0, 8.0, 8.0), (3, 5, 1.0, 2.0)], "image_id int, kp_id int, x double, y double")
    nodes = spark.createDataFrame([(0, 1, 0, 0, True, 0), (1, 2, 0, 0, False, 0)], "node_idx bigint, image_id int, feature_idx int, track bigint, is_root boolean, problem bigint")
    edges = spark.createDataFrame([(0, 1, 0.8)], EDGES)
    refined, summary = adjust.refine_keypoints(nodes, edges, keypoints, patches, images, Scratch(spark, "t"), strategy)
    got = {(r.image_id, r.kp_id): (r.x, r.y) for r in refined.collect()}
    assert got[1, 0] == (8.0, 8.0) and got[3, 5] == (1.0, 2.0)
    assert np.abs(np.array(got[2, 0]) - [7.3, 8.4]).max() < 0.02
    (row,) = summary.collect()
    assert row.final_cost < row.initial_cost / 50
    near, _ = adjust.refine_keypoints(nodes, edges, keypoints, patches, images, Scratch(spark, "t"), strategy, KeypointOptions(bound=0.25))
    moved = {r.image_id: (r.x, r.y) for r in near.collect()}[2]
    assert max(abs(moved[0] - 8), abs(moved[1] - 8)) <= 0.25 + 1e-9


def test_query_keypoints_converge(spark):
    grid = field((0, 0))
    known = sample(grid[None], np.array([[7.1, 6.6]]), Sampling())[0][0]
    rows = [("q", 3, 7.5, 7.0, [known.tolist(), known.tolist()], *patch_row(0, "q", 3, grid)[3:])]
    frame = spark.createDataFrame(rows, "query string, kp_id int, x double, y double, references array<array<double>>, h int, w int, c int, x0 int, y0 int, sx double, sy double, upsampling double, data array<double>")
    (r,) = localize.refine_query_keypoints(frame).collect()
    assert abs(r.x - 7.1) < 1e-3 and abs(r.y - 7.6) < 1e-3 and r.final_cost < r.initial_cost  # pixel = place - 0.5, columns are x


def scene(n_images=4, n_points=60, seed=0):
    rng = np.random.default_rng(seed)
    points, params = rng.uniform(-1, 1, (n_points, 3)), np.array([1200.0, 500, 500, 0.0])
    rows = []
    for i in range(n_images):
        q = np.array([1.0, *rng.normal(0, 0.05, 3)])
        t = np.array([*rng.uniform(-1, 1, 2), 10.0])
        xy, _, _ = geometry.project("SIMPLE_RADIAL", params, geometry.rotation_matrix(q[None])[0], t, points)
        for p, (x, y) in zip(range(n_points), xy):
            rows.append((i, 1, p, float(x), float(y), *map(float, points[p]), "SIMPLE_RADIAL", params.tolist(), *map(float, q), *map(float, t)))
    return rows, "image_id int, camera_id int, point3d_id bigint, x double, y double, px double, py double, pz double, model string, params array<double>, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def test_point_adjustment_recovers_points(spark):
    rows, schema = scene()
    truth = {r[2]: np.array(r[5:8]) for r in rows}
    frame = spark.createDataFrame(rows, schema).withColumns({"px": F.col("px") + 0.1, "py": F.col("py") - 0.2})
    for r in adjust.adjust_points(frame, Options(loss_name="trivial", parameter_tolerance=1e-12)).collect():
        assert np.abs(np.array([r.px, r.py, r.pz]) - truth[r.point3d_id]).max() < 1e-4 and r.final_cost < 1e-6


def test_bundle_adjustment_lowers_the_cost_and_keeps_the_gauge(spark):
    rows, schema = scene(3, 40)
    frame = spark.createDataFrame(rows, schema)
    off = frame.withColumns({"px": F.col("px") + F.randn(1) * 0.02, "ty": F.col("ty") + F.when(F.col("image_id") > 0, 0.05).otherwise(0.0), "x": F.col("x") + F.randn(2) * 0.1})
    off = Scratch(spark, "t").save(off.groupBy("image_id", "camera_id", "point3d_id").agg(*[F.first(c).alias(c) for c in off.columns if c not in ("image_id", "camera_id", "point3d_id")]))
    one = off.groupBy("point3d_id").agg(F.first("px").alias("px"))
    off = off.drop("px").join(one, "point3d_id")
    start = {r.image_id: r for r in off.groupBy("image_id").agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.first("qx").alias("qx")).collect()}
    poses, params, points, costs = adjust.bundle_adjust(off, BundleSetup.gauge([0, 1, 2]), Options(loss_name="trivial", max_iterations=12))
    assert np.all(np.diff(costs) < 0) and costs[-1] < costs[0] / 100
    assert poses[0][1][1] == start[0].ty and poses[1][1][0] == start[1].tx and points.count() == 40
    assert params[1][1:3].tolist() == [500, 500]  # the principal point stays


def flat_scene(kind, n_images=4, n_points=30, seed=3):
    """Observations of true points under true poses, with patches whose descriptors say how far a place is from the true projection."""
    rng, params = np.random.default_rng(seed), np.array([900.0, 400.0, 400.0])
    points = np.stack([*rng.uniform(-1, 1, (2, n_points)), rng.uniform(-0.5, 0.5, n_points)], axis=1)
    warp = kind == "patch_warp"
    q = np.array([[1.0, 0, 0, 0] if warp else [1.0, *rng.normal(0, 0.05, 3)] for _ in range(n_images)])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    t = np.stack([*rng.uniform(-1.5, 1.5, (2, n_images)), np.full(n_images, 8.0)], axis=1)
    nodes = ((-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0), (1.0, 1.0)) if warp else ((0.0, 0.0),)
    rows = []
    for i in range(n_images):
        xy, _, _ = geometry.project("SIMPLE_PINHOLE", params, geometry.rotation_matrix(q[i : i + 1])[0], t[i], points)
        for p in range(n_points):
            x0, y0 = np.floor(xy[p]).astype(int) - 8
            dy, dx = np.mgrid[0:16, 0:16] + 0.5 + np.array([y0, x0])[:, None, None] - xy[p][::-1, None, None]
            data = np.stack([np.sin(dx / 7 + p), np.cos(dy / 6 - p)] if warp else [0.1 * dx, 0.1 * dy], axis=2)
            rows.append({"image_id": i, "camera_id": 1, "point3d_id": p, "x": xy[p, 0], "y": xy[p, 1], **dict(zip(("px", "py", "pz"), points[p])), "model": "SIMPLE_PINHOLE", "params": params.tolist(),
                         **dict(zip(("qw", "qx", "qy", "qz"), q[i])), **dict(zip(("tx", "ty", "tz"), t[i])), "h": 16, "w": 16, "c": 2, "x0": int(x0), "y0": int(y0), "sx": 1.0, "sy": 1.0, "upsampling": 1.0, "data": data.ravel().tolist(), "reference": [0.0, 0.0]})
    if warp:
        sources = {r["point3d_id"]: r for r in rows if r["image_id"] == 0}
        rows = [r | {f"src_{k}": v for k, v in sources[r["point3d_id"]].items() if k not in ("point3d_id", "px", "py", "pz", "x", "y", "reference")} for r in rows if r["image_id"]]
    return rows, q, t, points, Sampling(l2_normalize=False, nodes=nodes)


@pytest.mark.parametrize("kind, setup, dense", [
    ("geometric", {"refine_focal": False}, 4000), ("geometric", {"refine_focal": False}, 0), ("geometric", {}, 4000), ("geometric", {"refine_points": False, "refine_focal": False}, 4000), ("geometric", {"refine_poses": False, "refine_focal": False}, 4000),
    ("geometric", {"constant_points": {1, 2}, "constant_cameras": {1}}, 4000), ("feature_reference", {"refine_focal": False}, 4000), ("feature_reference", {"refine_focal": False}, 0), ("costmaps", {"refine_focal": False}, 4000), ("patch_warp", {"refine_focal": False, "refine_poses": False}, 4000),
])
def test_bundle_adjustment_finds_the_truth(spark, kind, setup, dense):
    rows, q, t, points, sampling_ = flat_scene(kind)
    rng = np.random.default_rng(1)
    setup = BundleSetup.gauge(range(4), **setup)
    off_point = {p: rng.normal(0, 0.004, 3) if setup.refine_points and p not in setup.constant_points else np.zeros(3) for p in range(30)}
    off_pose = {i: rng.normal(0, 0.003, 2) if i > 1 and setup.refine_poses else np.zeros(2) for i in range(4)}
    for r in rows:
        for k, name in enumerate(("px", "py", "pz")):
            r[name] += off_point[r["point3d_id"]][k]
        for k, name in enumerate(("tx", "ty")):
            r[name] += off_pose[r["image_id"]][k]
        if setup.refine_focal and not setup.constant_cameras:
            r["params"] = [903.0, 400.0, 400.0]
    frame = spark.createDataFrame(pd.DataFrame(rows))
    poses, params, found, costs = adjust.bundle_adjust(frame, setup, Options(loss_name="trivial", parameter_tolerance=0.0, max_iterations=25), Scratch(spark, "t"), kind, sampling_, dense)
    assert np.all(np.diff(costs) < 0) and costs[-1] < (1e-4 if kind == "patch_warp" else 1e-6) * costs[0]  # sampling between pixels leaves a rest in the warp
    # Both ends of a patch warp move with a point along the surface, so only its depth is determined.
    away = [np.abs(np.array([r.px, r.py, r.pz]) - points[r.point3d_id])[2 if kind == "patch_warp" else 0 :].max() for r in found.collect()]
    assert len(away) == 30 and max(away) < (1e-3 if kind == "patch_warp" else 1e-4), sorted(away)
    for i in range(4):
        if i in poses:
            assert np.abs(poses[i][1] - t[i]).max() < 1e-4
    if setup.refine_focal and not setup.constant_cameras:
        assert abs(params[1][0] - 900) < 0.01


def test_points_over_levels(spark):
    rows, _, _, points, how = flat_scene("feature_reference")
    frame = spark.createDataFrame(pd.DataFrame(rows)).withColumn("px", F.col("px") + 0.004)

    def rows_of_level(level, poses, cameras, found):
        return frame if found is None else frame.drop("px", "py", "pz").join(found, "point3d_id")

    costs = adjust.bundle_over_levels(rows_of_level, [1, 0], BundleSetup(refine_poses=False, refine_focal=False), Options(loss_name="trivial", parameter_tolerance=0.0), Scratch(spark, "t"), "feature_reference", how)
    assert len(costs) == 2 and costs[1][0] <= costs[0][-1] * 1.001 + 1e-12 and costs[1][-1] < 1e-9


def test_localisation(spark):
    rows, schema = scene(3, 60, 2)
    frame = spark.createDataFrame(rows, schema).select(F.col("image_id").cast("string").alias("query"), F.col("point3d_id").cast("int").alias("pos"), F.col("point3d_id").cast("int").alias("kp_id"), "point3d_id", "x", "y", "px", "py", "pz", "model", "params")
    few = frame.where("query = '2' AND pos < 4").withColumn("query", F.lit("few"))
    wrong = F.when(F.col("pos") % 5 == 0, F.col("x") + 400).otherwise(F.col("x"))
    given = frame.withColumn("x", wrong).union(few)
    queries = spark.createDataFrame([("0",), ("1",), ("2",), ("few",), ("none",)], "query string")
    images = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0, 7.0, 8.0, 9.0)], "name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    retrieval = spark.createDataFrame([("few", 1, "a"), ("few", 2, "b")], "query string, rank int, name string")
    got = {r.query: r for r in localize.localize_all(queries, given, retrieval=retrieval, images=images).collect()}
    truth = {str(r[0]): r[10:] for r in rows}
    for q in ("0", "1", "2"):
        assert got[q].success and got[q].num_inliers == 48 and np.abs(np.array([got[q].tx, got[q].ty, got[q].tz]) - truth[q][4:7]).max() < 1e-3
    assert not got["few"].success and got["few"].tx == 7.0 and not got["none"].success and got["none"].tx is None
    counts = {r.query: r.num_inliers for r in localize.recount_inliers(given, localize.localize(given)).collect()}
    assert counts["0"] == 48


def test_uniqueness_order_matters(spark):
    rows = [("q", 0, 1, 10, 0.5), ("q", 1, 1, 11, 0.4), ("q", 2, 2, 11, 0.1), ("q", 3, 2, 12, 0.1), ("q", 4, 3, 12, None), ("q", 5, 4, 10, 0.5)]
    frame = spark.createDataFrame(rows, "query string, pos int, kp_id int, point3d_id bigint, error double")
    first_then = {r.pos for r in localize.unique_min_error_two_keys(frame).collect()}
    other_way = {r.pos for r in localize.unique_min_error(localize.unique_min_error(frame, "kp_id"), "point3d_id").collect()}
    assert first_then == {0, 2} and other_way != first_then
    assert {r.pos for r in localize.unique_min_error(frame, "point3d_id").collect()} == {0, 2, 3}


def test_auc_by_hand(spark):
    frame = spark.createDataFrame([("m", 0.0005), ("m", 0.002), ("m", float("inf")), ("m", None)], "method string, error double")
    got = {r.threshold: r.auc for r in evaluation.auc_at(frame, ["method"], [0.001, 0.01], 0.001).collect()}
    assert got[0.001] == pytest.approx(25.0)
    assert got[0.01] == pytest.approx(100 * (0.25 * 0.001 + (0.25 + 0.5) / 2 * 0.001 + 0.5 * 0.008) / 0.01)


def test_nearest_distance_and_covisibility(spark):
    points = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 5.0, 5.0, 5.0)], "id int, x double, y double, z double")
    cloud = spark.createDataFrame([(0.1, 0.1, 0.4), (0.9, 0.1, 0.1)], "x double, y double, z double")
    assert {r.id: r.distance and round(r.distance, 6) for r in evaluation.nearest_point_distance(points, cloud, 1.0).collect()} == {1: 0.3, 2: None}
    tracks = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3), (3, 3)], "point3d_id bigint, image_id int")
    assert {(r.image1, r.image2): r.shared for r in evaluation.covisible_pairs(tracks).collect()} == {(1, 2): 2, (1, 3): 1}
    near = views.assign_nearest_keypoints(spark.createDataFrame([(1, 0, 2.2, 2.0), (1, 1, 9.0, 9.0)], "image_id int, pos int, x double, y double"), spark.createDataFrame([(1, 4, 2.0, 2.0), (1, 5, 2.9, 2.0)], "image_id int, kp_id int, x double, y double"))
    assert [(r.pos, r.kp_id) for r in near.collect()] == [(0, 4)]


def test_references(spark):
    rng = np.random.default_rng(1)
    rows = [(0, p, k, k + 1, k, rng.normal(p, 0.1, 6).tolist()) for p in range(3) for k in range(5)] + [(0, 9, 0, 1, 0, None), (0, 1, 7, 9, 9, [float("nan")] * 6)]
    frame = spark.createDataFrame(rows, "level int, point3d_id bigint, track_pos int, image_id int, kp_id int, descriptor array<double>")
    got = {r.point3d_id: r for r in references.extract_references(frame, l2=False).collect()}
    assert set(got) == {0, 1, 2}
    for p, r in got.items():
        matrix = np.array([x[5] for x in rows if x[1] == p and x[5] and x[2] < 5])
        best = ((matrix - references.robust_mean(matrix)) ** 2).sum(axis=1).argmin()
        assert r.src_kp_id == best and np.allclose(r.descriptor, matrix[best]) and len(r.observations) == 5
    table = references.extract_references(frame, l2=False)
    closest = {r.point3d_id: r.kp_id for r in references.closest_to(frame.where("point3d_id < 3 AND track_pos < 5"), table.select("level", "point3d_id", "mean"), ["level", "point3d_id"]).collect()}
    assert closest == {p: r.src_kp_id for p, r in got.items()}
    assert references.select_references(table, "robust_mean").count() == 3 and len(references.select_references(table, "all_observations").first().references) == 5


def test_patches_cut_sampled_and_missing(spark, tmp_path):
    grid = np.random.default_rng(2).normal(size=(12, 10, 2)).astype(np.float32)
    maps = tables.from_arrays(spark, 0, "a", {None: grid}, {})
    keypoints = spark.createDataFrame([("a", 0, 5.0, 6.0), ("a", 1, 0.2, 0.3), ("b", 0, 1.0, 1.0)], "image_name string, kp_id int, x double, y double")
    cut = sampling.extract_patches(maps, keypoints, 4)
    got = {r.kp_id: r for r in cut.collect()}
    assert set(got) == {0, 1} and (got[0].x0, got[0].y0, got[1].x0, got[1].y0) == (3, 4, 0, 0)
    assert np.allclose(np.array(got[0].data).reshape(4, 4, 2), grid[4:8, 3:7])
    assert [(r.image_name, r.missing) for r in references.missing_patches(keypoints.select("image_name", "kp_id"), cut).collect()] == [("b", 1)]
    sampled = sampling.sample_patches(cut.join(keypoints, ["image_name", "kp_id"]), Sampling(l2_normalize=False), gradients=True).where("kp_id = 0").first()
    assert np.allclose(sampled.descriptor, sample(grid[4:8, 3:7][None], np.array([[1.5, 1.5]]), Sampling(l2_normalize=False))[0][0])
    sinks.write_patches(cut, str(tmp_path / "patches"))
    again = tables.read_patches(spark, str(tmp_path / "patches"), level=0, names=keypoints.where("kp_id = 1"))
    assert again.count() == 1 and tables.read_patches(spark, str(tmp_path / "patches"), metadata_only=True).columns == [c for c in again.columns if c != "data"]
    short = cut.withColumn("h", F.lit(9)).join(keypoints, ["image_name", "kp_id"])
    assert all(r.descriptor is None for r in sampling.sample_patches(short).collect())


def test_extraction_of_the_identity_model(spark):
    image = np.arange(24.0).reshape(4, 6, 1)
    images = spark.createDataFrame([("a", 4, 6, 1, image.ravel().tolist()), ("b", 1, 1, 1, [1.0])], "image_name string, h int, w int, c int, data array<double>")
    rows = {(r.image_name, r.level): r for r in extraction.dense_features(images, pyramid=(1.0, 0.5)).collect()}
    assert rows["a", 0].data == image.ravel().tolist() and (rows["a", 1].h, rows["a", 1].w) == (2, 3) and rows["a", 0].kp_id is None
    assert rows["a", 1].data[0] == pytest.approx(image[:2, :2].mean())
    keypoints = spark.createDataFrame([("a", 0, 2.0, 2.0)], "image_name string, kp_id int, x double, y double")
    assert [r.image_name for r in extraction.required_features(images, keypoints, 2).collect()] == ["a"]


def test_blob_round_trips(spark):
    rng = np.random.default_rng(3)
    rows = [(i, k, *map(float, np.float32(rng.uniform(0, 900, 2)))) for i in (4, 5) for k in range(20)]
    keypoints = spark.createDataFrame(rows, "image_id int, kp_id int, x double, y double")
    blobs = sinks.encode_keypoints(keypoints).union(spark.createDataFrame([(9, 3, 2, None), (8, 3, 2, b"short")], "image_id int, rows int, cols int, data binary"))
    assert sorted(tuple(r) for r in tables.decode_keypoints(blobs).collect()) == sorted(rows)
    matches = spark.createDataFrame([(7, 3, 0, 10, 11), (7, 3, 1, 12, 13), (3, 9, 0, 1, 2)], "image1 int, image2 int, match_ord int, kp1 int, kp2 int")
    decoded = {(r.pair_id, r.match_ord): (r.kp1, r.kp2) for r in tables.decode_matches(sinks.encode_matches(matches)).collect()}
    base = ids.PAIR_BASE
    assert decoded == {(3 * base + 7, 0): (11, 10), (3 * base + 7, 1): (13, 12), (3 * base + 9, 0): (1, 2)}
    vectors = rng.integers(0, 255, (2, 128)).astype(np.uint8)
    descriptors = spark.createDataFrame([(3, 1, 128, vectors[0].tobytes()), (7, 1, 128, vectors[1].tobytes())], "image_id int, rows int, cols int, data binary")
    scored = tables.score_matches(spark.createDataFrame([(3 * base + 7, 0, 0, 0), (3 * base + 7, 1, 0, 5), (3 * base + 9, 0, 0, 0)], "pair_id bigint, match_ord int, kp1 int, kp2 int"), descriptors)
    a, b = vectors.astype(float)
    assert sorted(round(r.score, 9) for r in scored.collect()) == sorted([round(a @ b / np.sqrt((a @ a) * (b @ b)), 9), 1.0, 1.0])


def test_text_sources_and_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a b", "c")], "name1 string, name2 string").withColumn("name1", F.lit("a"))
    sinks.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [(r.name1, r.name2) for r in tables.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [("a", "c")]
    (tmp_path / "retrieval.txt").write_text("q b\nq a\n\nz\n")
    assert [(r.query, r["names"]) for r in tables.read_retrieval(spark, str(tmp_path / "retrieval.txt")).collect()] == [("q", ["b", "a"])]
    (tmp_path / "queries.txt").write_text("q.jpg PINHOLE 640 480 500 501 320 240\n")
    assert tables.read_queries(spark, str(tmp_path / "queries.txt")).first().params == [500.0, 501.0, 320.0, 240.0]
    model = tmp_path / "model"
    model.mkdir()
    (model / "cameras.txt").write_text("# cameras\n1 SIMPLE_RADIAL 640 480 500 320 240 0.1\n")
    (model / "images.txt").write_text("# images\n3 1 0 0 0 0.1 0.2 0.3 1 a/b.jpg\n1.5 2.5 7 3.5 4.5 -1\n4 1 0 0 0 0 0 0 1 c.jpg\n\n")
    (model / "points3D.txt").write_text("# points\n7 0.5 0.6 0.7 255 255 255 0.1 3 0 4 2\n")
    read = tables.read_model_text(spark, str(model))
    assert [(r.image_id, r.kp_id, r.x, r.point3d_id) for r in read["points2d"].orderBy("kp_id").collect()] == [(3, 0, 1.5, 7), (3, 1, 3.5, None)]
    assert [(r.track_pos, r.image_id, r.kp_id) for r in read["tracks"].orderBy("track_pos").collect()] == [(0, 3, 0), (1, 4, 2)]
    assert {r.name for r in read["images"].collect()} == {"a/b.jpg", "c.jpg"} and read["cameras"].first().params == [500.0, 320.0, 240.0, 0.1]
    sinks.write_model(read, str(tmp_path / "parquet"))
    assert tables.read_model(spark, str(tmp_path / "parquet"))["points3d"].first().z == 0.7
    poses = spark.createDataFrame([("a/b/c.jpg", 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0), ("d.jpg", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    sinks.write_poses(poses, str(tmp_path / "poses"), parent=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "poses")).collect()] == ["b/c.jpg 1.0 0.0 0.0 0.0 0.5 0.0 0.0"]
    sinks.write_ply(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), str(tmp_path / "ply"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ply")).collect()][-1] == "1.0 2.0 3.0"
    sinks.write_results(spark.createDataFrame([("s", 0.5)], "scene string, accuracy double"), str(tmp_path / "results"))
    assert tables.read_results(spark, str(tmp_path / "results")).first().accuracy == 0.5
    folder = tmp_path / "images"
    folder.mkdir()
    for name in ("a.png", "b.PNG", "c.JPG", "d.txt"):
        (folder / name).write_bytes(b"x")
    assert {r.path.rsplit("/", 1)[1] for r in tables.list_images(spark, str(folder)).collect()} == {"a.png", "c.JPG"}
    assert sinks.duplicate_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "image_id int, name string")).first().images == 2


def test_stream_of_matches(spark, tmp_path):
    from trackweave.streaming.ingest import append_matches

    schema = "pair_ord bigint, pair_id bigint, stored_reversed boolean, matches0 array<int>, matching_scores0 array<float>, ingested_at timestamp_ntz"
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, ids.PAIR_BASE * 3 + 7, True, [-1, 4], [0.0, 0.5], at), (1, ids.PAIR_BASE * 3 + 7, True, [-1, 4], [0.0, 0.5], at), (2, ids.PAIR_BASE * 3 + 7, None, None, None, at)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    append_matches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.pair_ord, r.image1, r.kp1, r.image2, r.kp2) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 3, 4, 7, 1)]


def test_summaries(spark):
    rows = spark.createDataFrame([(0, 4.0, 1.0, 10, 3), (1, 6.0, 2.0, 10, 5)], "problem bigint, initial_cost double, final_cost double, num_residuals bigint, iterations int")
    total = adjust.summary_totals(rows).first()
    assert (total.problems, total.initial_cost, total.final_cost, total.most_iterations) == (2, 10.0, 3.0, 5) and total.rms_cost == pytest.approx(np.sqrt(3 / 20))
    history = spark.createDataFrame([(0, [4.0, 1.0]), (1, [6.0, 3.0, 2.0])], "problem bigint, history array<double>")
    assert [r.cost for r in adjust.merge_histories(history).orderBy("iteration").collect()] == [10.0, 4.0, 3.0]


def test_references_of_a_model_and_node_offsets(spark):
    rows, q, t, points, how = flat_scene("feature_reference")
    frame = spark.createDataFrame(pd.DataFrame(rows))
    tracks = frame.select("point3d_id", F.col("image_id").alias("track_pos"), "image_id", F.col("point3d_id").cast("int").alias("kp_id"))
    images = frame.select("image_id", F.concat(F.lit("i"), "image_id").alias("name"), "camera_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz").distinct()
    patches = frame.select(F.lit(0).alias("level"), F.concat(F.lit("i"), "image_id").alias("image_name"), F.col("point3d_id").cast("int").alias("kp_id"), *[F.col(c).cast("int").alias(c) for c in ("h", "w", "c", "x0", "y0")], "sx", "sy", "upsampling", F.col("data").cast("array<float>").alias("data"))
    found = references.references_of_model(tracks, frame.select("point3d_id", "px", "py", "pz").distinct(), images, frame.select("camera_id", "model", "params").limit(1), patches, how, iterations=5).collect()
    assert len(found) == len(points) and all(np.abs(r.descriptor).max() < 1e-5 and len(r.observations) == 4 for r in found)
    wide = Sampling(nodes=((0.0, 0.0), (3.0, 0.0)))
    offsets = {r.point3d_id: np.array(r.offsets) for r in references.node_offsets(frame.where("image_id = 0"), wide).collect()}
    for p, own in offsets.items():
        depth = (geometry.rotation_matrix(q[:1])[0] @ points[p] + t[0])[2]
        assert np.abs(own[0]).max() < 1e-9 and abs(np.linalg.norm(own[1]) - 3 * depth / 900) < 1e-6
    costs = adjust.residual_rows(frame, "geometric").collect()
    assert len(costs) == 120 and max(np.abs(r.residual).max() for r in costs) < 1e-9


def test_clusters_of_retrieved_images(spark):
    tracks = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 20), (3, 21), (4, 12), (4, 20)], "point3d_id bigint, image_id int")
    retrieved = spark.createDataFrame([("a", 10), ("a", 11), ("a", 12), ("a", 21), ("b", 12), ("b", 20), ("b", 99)], "query string, image_id int")
    got = {(r.query, r.image_id): r.cluster for r in localize.covisibility_clusters(retrieved, tracks, Scratch(spark, "t")).collect()}
    assert got == {("a", 10): 10, ("a", 11): 10, ("a", 12): 10, ("a", 21): 21, ("b", 12): 12, ("b", 20): 12, ("b", 99): 99}


def test_database_rows(spark):
    cameras = spark.createDataFrame([(1, "PINHOLE", 10, 20, [1.0, 2.0, 3.0, 4.0], True), (2, "odd", 1, 1, None, None)], "camera_id int, model string, width int, height int, params array<double>, prior_focal_length boolean")
    one, two = sinks.encode_cameras(cameras).orderBy("camera_id").collect()
    assert one.model == 1 and np.frombuffer(bytes(one.params)).tolist() == [1, 2, 3, 4] and one.prior_focal_length == 1 and two.model is None and two.params is None
    matches = spark.createDataFrame([(5, 3, 0, 7, 8)], "image1 bigint, image2 bigint, match_ord int, kp1 int, kp2 int")
    pair = 3 * (2**31 - 1) + 5
    geometry_rows = spark.createDataFrame([(pair, 2, [float(i) for i in range(9)], None, None), (9, 1, None, None, None)], "pair_id bigint, config int, F array<double>, E array<double>, H array<double>")
    got = {r.pair_id: r for r in sinks.encode_two_views(matches, geometry_rows).collect()}
    assert np.frombuffer(bytes(got[pair].data), "<u4").tolist() == [8, 7] and np.frombuffer(bytes(got[pair].F)).tolist() == list(range(9)) and got[9].rows == 0
    assert np.frombuffer(bytes(got[9].H)).reshape(3, 3).tolist() == np.eye(3).tolist()
    images = spark.createDataFrame([(3, "c", 1), (5, "e", 1)], "image_id int, name string, camera_id int")
    assert [tuple(r) for r in sinks.pairs_of_matches(got and sinks.encode_matches(matches), images).collect()] == [("c", "e")]
    assert sinks.encode_images(images).columns == [f.split()[0] for f in sinks.DATABASE["images"].split(", ")]


def test_paths():
    assert paths.cache_path("image", True, None, "out/") == "out/image_featuremaps_sparse.parquet" and paths.cache_path("image", False) is None
    assert paths.cache_path("image", True, "a.parquet", "b") == "a.parquet" and paths.filled("{out}/{scene}", scene=3) == "{out}/3"
