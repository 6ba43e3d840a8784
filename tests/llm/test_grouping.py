import random

import pytest

from trackweave.llm import grouping
from trackweave.runtime import Scratch

PAIRS = "pair_ord bigint, pair_id bigint, stored_reversed boolean, matches0 array<int>, node bigint, label bigint, up bigint"
TRACKS = "level int, point3d_id bigint, track_list_image_id array<int>, track_list_point2d_idx array<int>, a bigint, b bigint"


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def labels(spark, edges):
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    return {r.node: r.label for r in grouping.smallest_member(frame, Scratch(spark, "t")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(None, 3), (5, None), (7, 7), (1, 2), (2, 1), (1, 2)]
    assert labels(spark, edges) == brute(edges)


def test_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)]
    shuffled = [(1000 + (i * 7919) % 257, 1000 + ((i + 1) * 7919) % 257) for i in range(256)]
    star = [(2000, i) for i in range(2001, 2300)] + [(5000 - i, 5000) for i in range(1, 200)]
    assert labels(spark, path + shuffled + star) == brute(path + shuffled + star)


def test_no_edges(spark):
    assert labels(spark, []) == {}
    assert labels(spark, [(1, 1), (None, None)]) == {}


def pair(a, b):
    return min(a, b) * (2**31 - 1) + max(a, b)


def test_keypoints_of_matches_and_tracks(spark):
    pairs = spark.createDataFrame(
        [(1, pair(3, 9), False, [-1, 4, None], 1, 1, 1), (1, pair(3, 9), False, [-1, 4, None], 1, 1, 1), (2, pair(3, 5), True, [0], 1, 1, 1), (3, None, False, [1], 1, 1, 1), (4, pair(1, 2), None, None, 1, 1, 1), (5, pair(1, 2), None, [], 1, 1, 1)], PAIRS
    )
    tracks = spark.createDataFrame(
        [
            (0, 7, [9, 8, -1, None, 6], [4, 2, 1, 1, None], 1, 1), (1, 7, [9, 8], [4, 2], 1, 1), (0, 8, [20], [1], 1, 1), (0, 9, [30, 30, 31], [1, 1, 2], 1, 1), (0, 10, None, None, 1, 1),
            (0, None, [40, 41], [1, 1], 1, 1), (0, -5, [50, 51], [1, 1], 1, 1), (0, 2**62 + 5, [60, 61], [1, 1], 1, 1),
        ], TRACKS,
    )
    rows = grouping.keypoint_groups(pairs, tracks, Scratch(spark, "t")).collect()
    groups = {(r.image_id, r.kp_id): (r.group_image_id, r.group_kp_id) for r in rows}
    assert len(rows) == len(groups)
    assert groups == {(3, 1): (3, 1), (9, 4): (3, 1), (8, 2): (3, 1), (5, 0): (3, 0), (3, 0): (3, 0), (30, 1): (30, 1), (31, 2): (30, 1), (50, 1): (50, 1), (51, 1): (50, 1), (60, 1): (60, 1), (61, 1): (60, 1)}


def test_empty_tables(spark):
    assert grouping.keypoint_groups(spark.createDataFrame([], PAIRS), spark.createDataFrame([], TRACKS), Scratch(spark, "t")).count() == 0
