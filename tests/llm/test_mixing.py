"""Mixtures against a plain reckoning."""

import pytest

from versemill.llm import mixing

DOCS, TARGETS = "doc_id long, source string, text string, uses int, part int", "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    chosen, report = mixing.mixed(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), **kw)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_and_caps(spark):
    docs = [(i, ["a", " A", "b", "c", None, "zzz"][i % 6], "one two three four " * (1 + i % 7)) for i in range(600)] + [(900, "a", None), (901, "a", "")]
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 1), ("gone", 0.1, 2)]
    chosen, report = mix(spark, docs, targets)
    assert set(report) == {"a", "b", "c", "gone"} and report["gone"].used_tokens == 0
    for r in report.values():
        mine = [x for x in chosen if x.source == r.source]
        assert sum(x.tokens * x.uses for x in mine) == r.used_tokens <= r.budget
        assert all(1 <= x.uses <= r.max_repeats for x in mine)
        if r.source != "gone":
            assert r.budget - r.used_tokens <= max(x.tokens for x in mine)
            assert r.actual_share == pytest.approx(r.target_share / 0.9, abs=0.02)
    assert len({x.uses for x in chosen if x.source == "b"}) <= 2


def test_prefix_of_the_random_order(spark, monkeypatch):
    """Ranges of any size give the same records: those that come first in the order of the hash."""
    docs = [(i, "a", "word " * (1 + i % 5)) for i in range(300)]
    first = {x.doc_id for x in mix(spark, docs, [("a", 1.0, 1)], total_tokens=400)[0]}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    again = {x.doc_id for x in mix(spark, docs, [("a", 1.0, 1)], total_tokens=400)[0]}
    assert first == again and 0 < len(first) < 300
    other = {x.doc_id for x in mix(spark, docs, [("a", 1.0, 1)], total_tokens=400, seed=5)[0]}
    assert other != first


def test_repeats_up_to_the_cap(spark):
    docs = [(1, "a", "x y z"), (2, "b", "x y z"), (3, "b", "x y z")]
    chosen, report = mix(spark, docs, [("a", 0.5, 3), ("b", 0.5, 9)], total_tokens=10_000)
    assert {x.doc_id: x.uses for x in chosen} == {1: 3, 2: 9, 3: 9} and report["a"].most_uses == 3 and report["a"].budget == 5000


def test_empty(spark):
    chosen, report = mix(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and report["a"].actual_share == 0.0
    assert mix(spark, [(1, "a", "x")], []) == ([], {})
    assert mix(spark, [(1, "a", "x")], [("a", None, 1), (None, 1.0, 1), ("b", 0.0, 1)]) == ([], {})
