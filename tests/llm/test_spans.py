"""Shared spans against brute force, with copies, nulls, long texts and clashing columns."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from versemill.llm import fingerprints, spans

SCHEMA = "doc_id long, text string, rep long, at string, span string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def brute(rows, least=spans.SPAN):
    held = {}
    for i, t in rows:
        for p in range(len(t or "") - least + 1):
            held.setdefault(t[p : p + least], set()).add(i)
    return {(a, b) for ids in held.values() for a in ids for b in ids if a < b}


def corpus():
    rng = random.Random(5)
    shared = [words(rng, 60)[:n] for n in (239, 240, 241, 300)]
    rows = [(i, words(rng, 30) + s + words(rng, 30)) for i, s in enumerate(shared * 2, 1)]
    copy = words(rng, 80)
    rows += [(20, copy), (21, copy), (22, copy), (23, copy + "x"), (24, None), (25, ""), (26, "short"), (27, "short"), (28, "z" * 600), (29, "z" * 700), (30, words(rng, 4000) + shared[3])]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = {(r.doc_a, r.doc_b) for r in spans.shared_span_pairs(df).collect()}
    assert got == brute(rows) and (20, 23) in got and (28, 29) in got and (26, 27) not in got
    assert (2, 6) in got


def test_portions(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in spans.shared_portions(df).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for i, t in rows:
        covered = np.zeros(len(t or ""), bool)
        others = {x for j, x in rows if j != i and x}
        for p in range(len(t or "") - spans.SPAN + 1):
            if any(t[p : p + spans.SPAN] in x for x in others):
                covered[p : p + spans.SPAN] = True
        assert got[i].shared_chars == covered.sum(), i
    assert {got[i].class_id for i in (20, 21, 22)} == {20} and got[20].linked_classes == 1 and got[24].n_chars == 0


def test_classes_and_passages(spark):
    """Representative pairs plus membership say the same as the pairs; so do passages."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    portions = spans.shared_portions(df).collect()
    rep = {r.doc_id: r.class_id for r in portions}
    links = {(r.class_a, r.class_b) for r in spans.shared_span_links(df).collect()}
    expected = {tuple(sorted((rep[a], rep[b]))) for a, b in brute(rows) if rep[a] != rep[b]}
    assert links == expected
    held = {}
    for r in spans.shared_passages(df).collect():
        held.setdefault(r.passage, set()).add(r.class_id)
    assert {(a, b) for ids in held.values() for a in ids for b in ids if a < b} == expected
    count = {i: sum(i in x for x in expected) for i in rep.values()}
    assert {r.class_id: r.linked_classes for r in portions} == count


def test_hot_copies_and_formula(spark):
    """A text copied 10,000 times and a formula that closes 10,000 other records: rows by record, not by pair, and links whole."""
    rng = random.Random(9)
    copied, formula, pair = words(rng, 90), words(rng, 90)[:300], words(rng, 90)[:280]
    n = 10_000
    rows = [(i, copied) for i in range(n)] + [(n + i, f"{words(rng, 8)}-{i}-{formula}") for i in range(n)]
    rows += [(3 * n + i, f"{words(rng, 8)} {pair} {i} {formula} {i}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    passages = spans.shared_passages(df).collect()
    assert max(r.holders for r in passages) == n + 2 and len(passages) < 1.1 * n
    got = spans.shared_portions(df)
    row = got.where(f"doc_id < {n}").selectExpr("count(distinct class_id) as classes", "min(shared_share) as share", "max(linked_classes) as links", "min(copies) as copies").first()
    assert (row.classes, row.share, row.links, row.copies) == (1, 1.0, 0, n)
    row = got.where(f"doc_id >= {n}").selectExpr("min(linked_classes) as least", "max(linked_classes) as most", "min(shared_chars) as shared").first()
    assert (row.least, row.most) == (n + 1, n + 1) and row.shared >= 300


def test_empty_and_repeated(spark):
    assert spans.shared_span_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "q" * 300, 0, "", ""), (1, "q" * 300, 0, "", "")], SCHEMA)
    assert spans.shared_span_pairs(twice).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ", min_size=24, max_size=60), st.text(alphabet="ab ", max_size=40), st.text(alphabet="abc", max_size=40))
def test_winnowing_guarantee(shared, one, two):
    a = set(fingerprints.winnow(one + shared + two, 16, 9)[1].tolist())
    b = set(fingerprints.winnow(two + shared + one, 16, 9)[1].tolist())
    assert a & b


def test_gram_hashes_are_of_the_grams():
    h = fingerprints.gram_hashes("abcabcé𝄞abc", 3)
    assert len(h) == 9 and h[0] == h[3] == h[8] and len(set(h.tolist())) == 7
    assert len(fingerprints.gram_hashes("ab", 3)) == 0
