import math
import random

import pytest

from trackweave.llm import percentiles
from trackweave.runtime import Scratch

SCHEMA = "g string, day string, x double, interval bigint, piece bigint, n bigint, code bigint"


def nearest_rank(values, percent):
    values = sorted(values)
    return values[max(1, math.ceil(len(values) * percent / 100)) - 1] + 0.0


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [("a", str(rng.randrange(3)), rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    rows += [(None, "0", float(rng.randrange(5))) for _ in range(101)] + [("one", None, 3.5), ("tie", "1", 2.0), ("tie", "1", 2.0), ("zero", "1", -0.0), ("zero", "1", 0.0)]
    return rows + [("a", "0", None), ("a", "0", math.nan), ("a", "1", math.inf), ("a", "1", -math.inf), ("none", "1", None)]


def expected(rows):
    groups = {}
    for g, _, x in rows:
        if x is not None and math.isfinite(x):
            groups.setdefault(g, []).append(x)
    return {(g, p): (len(v), nearest_rank(v, p)) for g, v in groups.items() for p in percentiles.PERCENTS}


@pytest.mark.parametrize("seed", [1])
def test_exact_and_the_same_from_parts(spark, seed):
    rows = rows_of(seed)
    table = frame(spark, rows)
    parts = [table.where("day = '0'"), table.where("day = '1'"), table.where("day = '2'"), table.where("day IS NULL"), table.limit(0)]
    for given in ([table], parts):
        found = percentiles.exact_percentiles(given, ["g"], "x", Scratch(spark, "t")).collect()
        assert {(r.g, r.percent): (r.n, r.value) for r in found} == expected(rows)
        assert len(found) == len(expected(rows)) and all(r.error == 0 for r in found)


def test_two_passes_bound_the_error(spark):
    rows = [("a", "0", float(x)) for x in range(1, 3000)]
    for r in percentiles.exact_percentiles([frame(spark, rows)], ["g"], "x", Scratch(spark, "t"), passes=3).collect():
        assert r.value <= nearest_rank(range(1, 3000), r.percent) <= r.value + r.error and r.error < 0.05 * r.value + 1


def test_empty(spark):
    assert percentiles.exact_percentiles([frame(spark, [])], ["g"], "x", Scratch(spark, "t")).count() == 0
    assert percentiles.exact_percentiles([frame(spark, [("a", "0", None)])], ["g"], "x", Scratch(spark, "t")).count() == 0


def test_kept_scores(spark):
    schema = "pair_ord bigint, matcher string, matched_at timestamp_ntz, matches0 array<int>, matching_scores0 array<float>"
    import datetime as dt

    day = dt.datetime(2024, 5, 6, 23)
    table = spark.createDataFrame([(1, "m", day, [2, -1, None, 0], [0.5, 0.1, 0.2, 0.25]), (1, "m", day, [2, -1, None, 0], [0.5, 0.1, 0.2, 0.25]), (2, None, None, [1, 1], [0.5]), (3, "m", day, None, None), (4, "m", day, [], [])], schema)
    got = sorted(((r.matcher, str(r.day), r.score) for r in percentiles.kept_scores(table).collect()), key=repr)
    assert got == sorted([("m", "2024-05-06", 0.5), ("m", "2024-05-06", 0.25), (None, "None", 0.5), (None, "None", None)], key=repr)
