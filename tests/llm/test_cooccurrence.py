import random
from collections import Counter
from itertools import combinations

import pytest

from trackweave.llm import cooccurrence

SCHEMA = "scene string, basket bigint, item int, n bigint, tile bigint, c1 bigint"


def brute(rows, least_count, least_lift):
    out = set()
    baskets = {}
    for scene, basket, item in rows:
        if basket is not None and item is not None:
            baskets.setdefault(scene, {}).setdefault(basket, set()).add(item)
    for scene, table in baskets.items():
        n, single, both = len(table), Counter(), Counter()
        for items in table.values():
            single.update(items)
            both.update(combinations(sorted(items), 2))
        out |= {(scene, a, b, n, single[a], single[b], c) for (a, b), c in both.items() if c >= least_count and c * n >= least_lift * single[a] * single[b]}
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for scene in ("s", "t", None):
        for basket in range(150):
            base = rng.randrange(6) * 5
            rows += [(scene, basket, base + rng.randrange(5)) for _ in range(rng.randrange(1, 6))] + [(scene, basket, rng.randrange(40)) for _ in range(rng.randrange(3))]
            if rng.random() < 0.7:
                rows.append((scene, basket, 99))
    rows += [("s", 1000, i) for i in range(40)]
    return rows + rows[:20] + [("s", None, 1), ("s", 5, None)]


@pytest.mark.parametrize(("block", "records"), [(1024, 200_000), (4, 60)])
def test_matches_brute_force_for_any_blocks(spark, monkeypatch, block, records):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    monkeypatch.setattr(cooccurrence, "RECORD_BLOCK", records)
    rows = rows_of(3)
    table = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)
    for lift in (3.0, 0.0):
        got = cooccurrence.together(table, 4, lift).collect()
        found = {(r.scene, r.item1, r.item2, r.n, r.c1, r.c2, r.c) for r in got}
        assert found == brute(rows, 4, lift) and len(got) == len(found)
        assert all(abs(r.lift - r.c * r.n / (r.c1 * r.c2)) < 1e-12 for r in got)


def test_empty_and_baskets_of_tracks(spark):
    assert cooccurrence.together(spark.createDataFrame([], SCHEMA)).count() == 0
    tracks = spark.createDataFrame([("s", 1, [1, 2, 1, -1, None], [0, 3, 0, 4, 5]), ("s", 1, [3], [1]), ("s", 2, [7, 8], [None, 1]), ("s", None, [1], [1]), ("s", 3, None, None)], "scene string, point3d_id bigint, track_list_image_id array<int>, track_list_point2d_idx array<int>")
    assert sorted({(r.basket, r.item) for r in cooccurrence.basket_items(tracks).collect()}) == [(1, 1), (1, 2), (1, 3), (2, 8)]
