"""Orphan references: spellings, intervals, hot keys, nulls, repeats, empty tables and clashing columns."""

from datetime import datetime

from versemill.operators import references as R


def at(day):
    return None if day is None else datetime(2024, 1, day)


def frames(spark, parents, kids):
    p = spark.createDataFrame([(k, at(s), at(e), "x") for k, s, e in parents], "id string, added_at timestamp_ntz, deleted_at timestamp_ntz, tab string")
    c = spark.createDataFrame([(i, v, at(t), "x", 1) for i, v, t in kids], "cid long, v string, t timestamp_ntz, k string, salt int")
    return p, c


def found(spark, parents, kids):
    p, c = frames(spark, parents, kids)
    return sorted(((r.ref_id, r.ref) for r in R.orphan_references({"kids": (c, "cid", "v", "t")}, p).collect()), key=repr)


def test_spellings_of_one_id(spark):
    same = ["1:2", " 1:2", "01:002", "1 : 2", "१:२", "１：２", "1-2", "1.2", "1–2\t", "1​:2"]
    other = ["tbd", "n/a", "12", "1:2:3", "9:9"]
    got = found(spark, [("1:2", 1, None)], [(i, v, 5) for i, v in enumerate(same + other)])
    assert [v for _, v in got] == other
    assert found(spark, [("1:2", 1, None)], [(1, None, 5), (2, "", 5), (3, "  ", 5)]) == []


def test_digits_of_the_supplementary_planes(spark):
    same = ["𝟏:𝟐", "𑁧:𑁨", "𑄷:𑄸", "0𝟙 - 𝟚"]
    assert found(spark, [("1:2", 1, None)], [(i, v, 5) for i, v in enumerate([*same, "𝟏:𝟑"])]) == [(len(same), "𝟏:𝟑")]


def test_time_of_the_record(spark):
    parents = [("1:1", 5, 10), ("1:1", 5, 10), ("1:1", 20, None), ("1:2", None, 7), ("1:3", 9, 9)]
    kids = [(1, "1:1", 4), (2, "1:1", 5), (3, "1:1", 9), (4, "1:1", 10), (5, "1:1", 15), (6, "1:1", 20), (7, "1:1", None), (8, "1:2", 1), (9, "1:2", 7), (10, "1:3", 9), (11, "1:9", None), (12, "1:3", None)]
    assert [i for i, _ in found(spark, parents, kids)] == sorted([1, 4, 5, 9, 10, 11, 12], key=lambda i: repr((i,)))


def test_overlapping_parents_and_repeats(spark):
    got = found(spark, [("1:1", 1, 10), ("1:1", 5, 20)], [(1, "1:1", 12), (1, "1:1", 12), (2, "1:1", 25), (2, "1:1", 25)])
    assert got == [(2, "1:1")]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "1:1", 1), (2, None, 1)]) == [(1, "1:1")]
    assert found(spark, [("1:1", 1, None)], []) == []


def test_hot_key_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_SALT", 10)
    monkeypatch.setattr(R, "HOT_KEYS", 10**9)
    kids = [(i, "1:1", 1 + i % 20) for i in range(400)] + [(1000, "2:2", 3)]
    got = found(spark, [("1:1", 8, None)], kids)
    assert got == sorted([(i, "1:1") for i in range(400) if 1 + i % 20 < 8] + [(1000, "2:2")], key=repr)


def test_counts_by_period(spark):
    p, c = frames(spark, [], [(1, "1:1", 1), (2, "01:1", 2), (3, "1:2", None)])
    rows = {(r.tab, r.period): (r.orphans, r["keys"]) for r in R.orphan_counts(R.orphan_references({"kids": (c, "cid", "v", "t")}, p)).collect()}
    assert rows == {("kids", "2024-01"): (2, 1), ("kids", "unknown"): (1, 1)}
