import numpy as np
import pytest

from trackweave.llm import neighbours
from trackweave.runtime import Scratch

BLOBS = "image_id int, rows int, cols int, data binary, key bigint, space int, tag int"
ARRAYS = "level int, point3d_id bigint, descriptor array<double>, key bigint, space int, id int"


def blobs(spark, entries):
    return spark.createDataFrame([(i, r, c, None if d is None else bytes(d), 0, 0, 0) for i, r, c, d in entries], BLOBS)


def truth(ids, x, least, k=3):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for a in range(len(x)):
        near = sorted((-float(unit[a] @ unit[b]), ids[b]) for b in range(len(x)) if b != a and ids[b] != ids[a])
        out |= {tuple(sorted([ids[a], other])) for score, other in near[:k] if -score >= least}
    return out


def planted(rng, groups=60, others=1500):
    base = rng.integers(0, 120, (others, 128)) * (rng.random((others, 128)) < 0.4)
    near = [np.clip(base[g] + rng.normal(0, rng.uniform(1, 9), 128) * (base[g] > 0), 0, 255) for g in range(groups) for _ in range(rng.integers(1, 4))]
    return np.concatenate([base, np.array(near)]).astype(np.uint8)


def test_recall_against_brute_force(spark):
    x = planted(np.random.default_rng(1))
    ids, entries = [], []
    for image, start in enumerate(range(0, len(x), 50)):
        part = x[start : start + 50]
        ids += [(image, i) for i in range(len(part))]
        entries.append((image, len(part), 128, part.tobytes()))
    got = neighbours.similar_pairs(neighbours.Blobs(blobs(spark, entries + entries[:3])), 0.95, neighbours.MOST_DIFFERENT[0.95], Scratch(spark, "t")).collect()
    found, wanted = {((r.id1, r.idx1), (r.id2, r.idx2)) for r in got}, truth(ids, x.astype(float), 0.95)
    assert len(found) == len(got) and len(wanted) > 60
    assert found <= wanted and len(found) >= 0.97 * len(wanted)


def test_many_exact_copies_make_few_pairs(spark):
    rng = np.random.default_rng(2)
    one, other = rng.integers(1, 255, 128), rng.integers(1, 255, 128)
    near = np.clip(one + rng.integers(-3, 4, 128), 0, 255)
    x = np.array([one] * 400 + [near, near, other]).astype(np.uint8)
    got = neighbours.similar_pairs(neighbours.Blobs(blobs(spark, [(5, len(x), 128, x.tobytes())])), 0.95, 27, Scratch(spark, "t")).collect()
    found = {(r.idx1, r.idx2) for r in got}
    copies = {(a, b) for b in range(400) for a in range(min(b, 3))} | {(0, 3), (1, 3), (2, 3)}
    # 400 and 401 have each other, then the first two of the copies.
    assert found == copies | {(400, 401), (0, 400), (1, 400), (0, 401), (1, 401)}


def test_unusable_vectors_and_empty_tables(spark):
    ones = np.full(128, 9, np.uint8).tobytes()
    entries = [(1, 1, 128, ones), (2, 1, 128, ones), (3, 1, 128, bytes(128)), (4, 2, 128, ones), (5, 1, 128, None), (6, 0, 128, b""), (None, 1, 128, ones), (7, 1, 64, ones[:64])]
    pairs = lambda v, c: {(r.id1, r.idx1, r.id2, r.idx2) for r in neighbours.similar_pairs(v, c, neighbours.MOST_DIFFERENT[c], Scratch(spark, "t")).collect()}
    assert pairs(neighbours.Blobs(blobs(spark, entries)), 0.95) == {(1, 0, 2, 0)}
    assert pairs(neighbours.Blobs(blobs(spark, [])), 0.95) == set()
    v = np.random.default_rng(3).normal(size=64)
    w = v.copy()
    w[0] = np.nan
    rows = [(0, 1, v.tolist()), (0, 2, (v * 1e200).tolist()), (1, 3, v.tolist()), (0, 4, w.tolist()), (0, 5, [None] + v.tolist()[1:]), (0, 6, v.tolist()[:9]), (0, 7, [0.0] * 64), (0, 8, None), (0, 1, v.tolist())]
    table = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], ARRAYS)
    assert pairs(neighbours.Arrays(table), 0.90) == {(1, 0, 2, 0)}
    assert pairs(neighbours.Arrays(table.limit(0)), 0.90) == set()


def test_search_finds_the_nearest(spark):
    x = planted(np.random.default_rng(4), 20, 600)
    entries = [(i, 1, 128, r.tobytes()) for i, r in enumerate(x)]
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in neighbours.search(neighbours.Blobs(blobs(spark, entries + entries[:60])), neighbours.F.col("id") % 50 == 0, Scratch(spark, "t")).collect():
        got.setdefault(r.id, {})[r.rank] = r.other_id
    hits = total = 0
    for q in range(0, len(x), 50):
        near = sorted((b for b in range(len(x)) if b != q), key=lambda b: (-float(unit[q] @ unit[b]), b))[:3]
        total += 3
        hits += len(set(near) & set(got[q].values()))
    assert set(got) == set(range(0, len(x), 50)) and hits >= 0.95 * total


@pytest.mark.parametrize("spread", [0.3, 3.0, 9.0])
def test_a_third_of_the_rows_in_one_dense_region(spark, spread):
    rng = np.random.default_rng(5)
    base = rng.integers(40, 200, 128)
    x = np.concatenate([np.clip(np.rint(base + rng.normal(0, spread, (1000, 128))), 0, 255), planted(rng, 20, 1960)[:2000]]).astype(np.uint8)
    x = np.unique(x[rng.permutation(len(x))], axis=0)
    got = neighbours.similar_pairs(neighbours.Blobs(blobs(spark, [(1, len(x), 128, x.tobytes())])), 0.95, neighbours.MOST_DIFFERENT[0.95], Scratch(spark, "t")).collect()
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    similar = unit @ unit.T
    np.fill_diagonal(similar, -2)
    wanted = set()
    for a, row in enumerate(similar):
        wanted |= {tuple(sorted((a, int(b)))) for b in np.lexsort((np.arange(len(row)), -row))[:3] if row[b] >= 0.95}
    found = {(r.idx1, r.idx2) for r in got}
    # Cosines that are equal but for rounding may be ordered either way.
    assert len(found - wanted) <= 0.005 * len(wanted) and len(found & wanted) >= 0.99 * len(wanted)


def test_search_in_a_dense_region(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(40, 200, 128)
    x = np.concatenate([np.clip(np.rint(base + rng.normal(0, 9, (1000, 128))), 0, 255), planted(rng, 20, 1960)[:2000]]).astype(np.uint8)
    x = x[rng.permutation(len(x))]
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in neighbours.search(neighbours.Blobs(blobs(spark, [(i, 1, 128, r.tobytes()) for i, r in enumerate(x)])), neighbours.F.col("id") % 50 == 0, Scratch(spark, "t")).collect():
        got.setdefault(r.id, {})[r.rank] = r.other_id
    for q in range(0, len(x), 50):
        similar = unit @ unit[q]
        similar[q] = -2
        assert [got[q][rank] for rank in (1, 2, 3)] == np.lexsort((np.arange(len(x)), -similar))[:3].tolist()


def test_search_counts_repeated_rows_once_and_keeps_ties(spark):
    rng = np.random.default_rng(7)
    one = rng.integers(60, 180, 128)
    steps = rng.choice([-1, 1], (4, 128))
    near = [np.clip(one + s * size, 0, 255) for s, size in zip(steps, (2, 4, 6, 8))]
    lone = rng.integers(1, 255, 128)
    entries = [(0, one), *[(11, near[0])] * 6, *[(12, near[1])] * 6, (13, near[2]), (14, near[3]), (50, lone), *[(i, near[3]) for i in range(29, 20, -1)]]
    table = blobs(spark, [(i, 1, 128, x.astype(np.uint8).tobytes()) for i, x in entries]).coalesce(1)
    got = {(r.id, r.rank): r.other_id for r in neighbours.search(neighbours.Blobs(table), neighbours.F.col("id") % 50 == 0, Scratch(spark, "t"), 5).collect()}
    assert [got[0, rank] for rank in range(1, 6)] == [11, 12, 13, 14, 21]


def test_recall_with_a_strong_common_direction(spark):
    rng = np.random.default_rng(8)
    base = 1.6 + rng.normal(size=(2000, 64))
    x = np.concatenate([base, base + rng.normal(0, 0.55, base.shape)])
    rows = [(0, i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)]
    got = neighbours.similar_pairs(neighbours.Arrays(spark.createDataFrame(rows, ARRAYS).coalesce(1)), 0.95, neighbours.MOST_DIFFERENT[0.95], Scratch(spark, "t")).collect()
    found = {(r.id1, r.id2) for r in got}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    similar = unit @ unit.T
    np.fill_diagonal(similar, -2)
    wanted = {tuple(sorted((a, int(b)))) for a, row in enumerate(similar) for b in np.argsort(-row)[:3] if row[b] >= 0.95}
    assert len(wanted) > 500 and len(found & wanted) >= 0.95 * len(wanted)


def test_the_candidates_do_not_depend_on_the_partitions(spark):
    x = planted(np.random.default_rng(9), 80, 1200)
    table = blobs(spark, [(i, len(x[i : i + 40]), 128, x[i : i + 40].tobytes()) for i in range(0, len(x), 40)])
    results, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            scratch = Scratch(spark, "t")
            entries = scratch.save(neighbours.Blobs(table).coded().select("space", "high", "low", neighbours.F.lit(40).cast("smallint").alias("most"), (neighbours.F.col("id") * 1000 + neighbours.F.col("idx")).alias("key")))
            results.append({(r.key1, r.key2) for r in neighbours.candidates(entries, scratch).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] and len(results[0]) > 200


def test_walks_cross_short_ranges():
    rng = np.random.default_rng(10)
    size, reach = 300, 8
    high, low = np.sort(rng.integers(-(2**62), 2**62, size)), rng.integers(-(2**62), 2**62, size)
    entries = [np.repeat([0, 1], size // 2), high, low, np.full(size, 128, np.int16), np.arange(size), np.zeros(size, np.int32)]
    whole = {tuple(p) for p in neighbours._met(entries, 0, reach, False).tolist()}
    cuts = [0, 1, 2, 5, 40, 41, 50, 57, 66, 160, 168, 299, size]
    inner, ends = set(), []
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = [c[a:b] for c in entries[:5]] + [np.full(b - a, number, np.int32)]
        inner |= {tuple(p) for p in neighbours._met(part, 0, reach, False).tolist()}
        kept = [i for i in range(b - a) if i < reach or i >= b - a - reach]
        ends.append([c[kept] for c in part])
    seams = {tuple(p) for p in neighbours._met([np.concatenate(c) for c in zip(*ends)], 0, reach, True).tolist()}
    assert inner | seams == whole and not inner & seams


def test_strings_near_by_chance_make_no_dense_region(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 64))
    x[300:] = x[:100] + 0.1 * rng.standard_normal((100, 64))
    frame = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "point3d_id bigint, level int, descriptor array<double>")
    scans, nearest = [], neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda *a, **k: scans.append(1) or nearest(*a, **k))
    found = neighbours.similar_pairs(neighbours.Arrays(frame), 0.90, 60, Scratch(spark, "chance")).collect()  # so many bits that all have candidates
    assert {(r.id1, r.id2) for r in found} == {(i, 300 + i) for i in range(100)}
    assert not scans


def test_trees_grow_with_the_vectors():
    trees = [neighbours.enough_trees(n, 0.90, 0.09) for n in (0, 1_000, 100_000, 1_000_000, 10_000_000)]
    assert trees == sorted(trees) and trees[0] == neighbours.TREES and trees[-1] > trees[-2] > trees[-3] > neighbours.TREES
    assert neighbours.enough_trees(10_000_000, 0.95, None) == neighbours.TREES
