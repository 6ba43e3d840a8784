"""Queries over all rows, against brute force on the same files."""

import math

import numpy as np
import pyarrow.parquet as pq
from oracle import TESTDATA

from trackweave.plans import catalog

SF = f"{TESTDATA}/sf0.001"


def test_every_observation_gets_its_nearest_reference(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    wanted = {}
    for q in rows:
        others = sorted((r for r in rows if r["label"] == (q["label"] + 1) % 10), key=lambda r: r["vec_id"])
        if others:
            distance = ((np.array([r["embedding"] for r in others], float) - np.array(q["embedding"], float)) ** 2).sum(axis=1)
            wanted[(str(q["vec_id"] % 20), q["vec_id"], (q["label"] + 1) % 10)] = others[int(distance.argmin())]["vec_id"]
    got = catalog.queries()["nearest_reference"](spark, SF).collect()
    assert len(got) == len(wanted) and {(r.query, r.pos, r.point3d_id): r.src_kp_id for r in got} == wanted


def test_matches_without_a_usable_score_stay(spark):
    once, wanted = set(), []
    plain = lambda score: None if score is None or not math.isfinite(score) or abs(score) >= 1e6 else round(score, 4)
    for r in pq.read_table(f"{TESTDATA}/sf0.01/pair_matches.parquet").to_pylist():
        if r["pair_ord"] in once or r["matches0"] is None or r["pair_id"] is None:
            continue
        once.add(r["pair_ord"])
        scores = r["matching_scores0"] or []
        for i, m in enumerate(r["matches0"]):
            if m is not None and m >= 0:
                ends = (m, i) if r["stored_reversed"] else (i, m)
                wanted.append((r["pair_ord"], i, r["pair_id"] // 2147483647, ends[0], r["pair_id"] % 2147483647, ends[1], plain(scores[i] if i < len(scores) else None)))
    got = [(r.pair_ord, r.match_ord, r.image1, r.kp1, r.image2, r.kp2, plain(r.score)) for r in catalog.queries()["match_decode"](spark, f"{TESTDATA}/sf0.01").collect()]
    assert any(not isinstance(w[-1], float) for w in wanted)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
