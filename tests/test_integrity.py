import datetime as dt

import pytest

from trackweave.operators import integrity
from trackweave.operators.integrity import orphan_rates, orphan_references

REFS = "relation string, src_table string, src_column string, row_key bigint, ref_key string, ref_time timestamp_ntz, known int"
LIVES = "relation string, ref_key string, added_at timestamp_ntz, deleted_at timestamp_ntz, at int"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, refs, lives):
    return (
        spark.createDataFrame([("r", "t", "c", i, k, day(t), 7) for i, (k, t) in enumerate(refs)], REFS),
        spark.createDataFrame([("r", k, day(a), day(d), 7) for k, a, d in lives], LIVES),
    )


def reasons(spark, refs, lives):
    return {r.row_key: r.reason for r in orphan_references(*frames(spark, refs, lives)).collect()}


CASES = [("a", 5), ("a", 1), ("a", 10), ("a", 12), ("b", 3), (None, 3), ("a", None), ("c", 4), ("d", 4), ("e", 2)]
TARGETS = [("a", 2, 10), ("a", 11, None), ("c", None, None), ("d", 6, 5), ("e", 2, 2), ("a", 2, 10)]
EXPECTED = {1: "late", 2: "deleted", 4: "missing", 6: "deleted", 7: "deleted", 8: "late", 9: "deleted"}


def test_reasons_of_each_kind(spark):
    assert reasons(spark, CASES, TARGETS) == EXPECTED


def test_heavy_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(integrity, "heavy_keys", lambda frame, keys: frame.where("ref_key = 'a'").select(*keys).distinct())
    assert reasons(spark, CASES, TARGETS) == EXPECTED


def test_empty_tables(spark):
    assert reasons(spark, [("a", 1)], []) == {0: "missing"}
    assert reasons(spark, [], [("a", 1, None)]) == {}


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_rows_count_once(spark, copies):
    refs, lives = frames(spark, [("x", 1), ("a", 3)], [("a", 1, None)] * copies)
    for _ in range(copies - 1):
        refs = refs.union(refs)
    found = orphan_references(refs, lives)
    assert found.count() == 1
    (rate,) = orphan_rates(refs, found).collect()
    assert (rate.month, rate.n_references, rate.n_missing, rate.n_deleted, rate.n_late) == ("2024-01", 2, 1, 0, 0)
