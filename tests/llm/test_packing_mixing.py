import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import mixing, packing, tokens
from trackweave.llm.tokens import Counter
from trackweave.runtime import Scratch

COUNT = Counter(tokens.VOCABULARY)
SIZES = "doc_id bigint, n_tokens bigint, source string, stream bigint, lot bigint, range bigint"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b'", "'s", " ", "\n", "\r", "\t", "1", "23", ".", "é", "—", " ", "\x1c", "00:00:01,000 --> 00:00:02,500", "文", "²", "\x85"]), max_size=30).map("".join))
def test_memoised_count_is_the_tokenizers(text):
    assert COUNT(text) == COUNT.whole(text)


def test_counts_of_whole_files():
    film = "".join(f"{n}\n00:01:{n:02d},123 --> 00:01:{n:02d},900\nIt's a <i>line</i>,\n - really?\n\n" for n in range(1, 50))
    for text in (film, film.replace("\n", "\r\n"), "﻿" + film + "  \n\n", film[:777], "", "x" * 200_000, "\n" * 999):
        assert COUNT(text) == COUNT.whole(text)


def test_null_and_empty_texts(spark):
    table = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "two words", 5)], "doc_id bigint, text string, n_tokens bigint").withColumnRenamed("n_tokens", "n")
    assert {r.doc_id: r.n_tokens for r in tokens.with_tokens(table).collect()} == {1: 0, 2: 0, 3: 2}


def table(spark, sizes):
    return spark.createDataFrame([(i, n, "s", 0, 0, 0) for i, n in sizes], SIZES)


@pytest.mark.parametrize("stream_tokens", [10**9, 20_000])
def test_packing_is_whole_and_tight(spark, stream_tokens):
    rng = random.Random(1)
    sizes = [(i, int(rng.lognormvariate(5, 1.3))) for i in range(3000)] + [(9000, 2048), (9001, 2049), (9002, 10 * 2048), (9003, 0), (9004, None), (9005, 7), (9005, 7)]
    frame = table(spark, sizes)
    rows = packing.pack(frame, Scratch(spark, "t"), open_bins=32, stream_tokens=stream_tokens).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins[r.stream, r.container] = bins.get((r.stream, r.container), 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    assert max(bins.values()) <= 2048 and set(pieces) == {i for i, _ in sizes}
    wanted = {}
    for i, n in sizes:
        wanted[i] = wanted.get(i, 0) + (n or 0)
    assert {i: sum(n for *_, n in p) for i, p in pieces.items()} == wanted
    for i, n in sizes:
        if i != 9005:
            assert len(pieces[i]) == max(1, -(-(n or 0) // 2048))
            at = 0
            for _, first, size in sorted(pieces[i]):
                assert first == at
                at += size
    used = sum(wanted.values()) / (2048 * len(bins))
    assert used > (0.97 if stream_tokens > 20_000 else 0.75)
    again = packing.pack(frame.repartition(7), Scratch(spark, "t"), open_bins=32, stream_tokens=stream_tokens).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    (report,) = packing.fill_report(packing.pack(frame, Scratch(spark, "t"), stream_tokens=stream_tokens)).collect()
    assert report.tokens == sum(wanted.values()) and report.fullest <= 2048


def test_best_fit_picks_and_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.add(s) for s in (6, 7, 3, 4, 5, 4, 5)] == [0, 1, 1, 0, 2, 2, 3]
    packer = packing.BestFit(10, 2)
    assert [packer.add(s) for s in (6, 8, 5, 4)] == [0, 1, 2, 0]  # bin 1 closed for bin 2


def test_empty_packing(spark):
    assert packing.pack(table(spark, []), Scratch(spark, "t")).count() == 0
    assert packing.fill_report(packing.pack(table(spark, []), Scratch(spark, "t"))).first().containers == 0


TARGETS = "source string, target_share double, max_repeats int, n_tokens bigint, documents bigint"


def mix(spark, sizes, targets, total=None):
    sizes = spark.createDataFrame([(*s, 0, 0, 0) for s in sizes], "doc_id bigint, source string, n_tokens bigint, budget bigint, lot bigint, range bigint")
    targets = spark.createDataFrame([(*t, 0, 0) for t in targets], TARGETS)
    chosen = mixing.mixture(sizes, targets, Scratch(spark, "t"), total)
    report = {r.source: r for r in mixing.shares_report(chosen, mixing.budgets(sizes, targets, total)).collect()}
    return chosen.collect(), report


def docs(rng, source, n, first):
    return [(first + i, source, rng.randrange(1, 60)) for i in range(n)]


def test_shares_are_met_as_far_as_repeats_allow(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_RECORDS", 50)
    rng = random.Random(2)
    sizes = docs(rng, "big", 3000, 0) + docs(rng, "mid", 400, 10_000) + docs(rng, "tiny", 30, 20_000) + [(1, None, 5), (2, "other", 5), (3, "big", 0), (4, "big", None)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3), (None, 0.2, 1), ("none", None, None)]
    chosen, report = mix(spark, sizes, targets)
    assert {r.source for r in chosen} == {"big", "mid", "tiny"}
    for source, share in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(report[source].actual_share - share) < 0.01
        assert abs(report[source].tokens - report[source].budget) <= 60
    assert report["tiny"].most_repeats == 4 and report["absent"].tokens == 0 and report["none"].budget == 0
    repeats = [r.repeats for r in chosen if r.source == "mid"]
    assert max(repeats) <= 2 and len({r.doc_id for r in chosen}) == len(chosen)
    whole = 60_000
    chosen, report = mix(spark, sizes, targets, whole)
    assert report["tiny"].tokens == 4 * report["tiny"].available  # used up; the others take its rest in proportion
    assert abs(report["big"].tokens / report["mid"].tokens - 0.5 / 0.3) < 0.02
    assert abs(sum(r.tokens for r in report.values()) - whole) <= 120
    chosen, report = mix(spark, sizes, targets, 100 * whole)
    assert all(report[s].tokens == report[s].available * report[s].max_repeats for s in ("big", "mid", "tiny"))


def test_choice_does_not_depend_on_layout(spark):
    sizes = docs(random.Random(3), "a", 500, 0) + docs(random.Random(4), "b", 300, 1000)
    targets = [("a", 0.2, 1), ("b", 0.8, 1)]
    assert {tuple(r) for r in mix(spark, sizes, targets)[0]} == {tuple(r) for r in mix(spark, sizes[::-1], targets)[0]}


def test_empty_mixtures(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0] == [] and mix(spark, [(1, "a", 5)], [])[0] == []
    chosen, report = mix(spark, [(1, "a", 5)], [("a", 1.0, 0), ("b", 0.0, 2)])
    assert chosen == [] and report["a"].actual_share == 0.0
