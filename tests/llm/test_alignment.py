"""Alignment: length beads, lexical paths, and a small invented corpus whose pairs are known."""

import random

from versemill.llm import alignment as A

STEMS = [a + b for a in ("kan", "tar", "mul", "sev", "dhog", "bhir", "lav", "pus", "rim", "gotr") for b in ("ik", "al", "uj", "im", "ot", "ag")]
ENGLISH = [a + b for a in ("sto", "riv", "lam", "kin", "gar", "ser", "clo", "bro", "voi", "swo") for b in ("dan", "mor", "tik", "lun", "far", "gop")]


def corpus(rng, chapters=30, verses=20):
    v, s, truth = [], [], set()
    row = 0
    for ch in range(1, chapters + 1):
        clauses = []
        for n in range(1, verses + 1):
            halves = [rng.sample(range(len(STEMS)), 4) for _ in range(2)]
            row += 1
            v.append((row, f"{ch}:{n}", ch, n, None, " |\n".join(" ".join(STEMS[k] + rng.choice(["aḥ", "ena", "asya"]) for k in h) for h in halves), "x"))
            clauses.append((n, ["the " + " the ".join(ENGLISH[k] for k in h) for h in halves]))
        no = 0
        i = 0
        while i < len(clauses):
            kind = rng.random()
            if kind < 0.1:
                i += 1
                continue
            no += 1
            if kind < 0.25 and i + 1 < len(clauses):
                s.append((ch, "telang", no, "; ".join(clauses[i][1] + clauses[i + 1][1]) + "."))
                truth |= {(f"{ch}:{clauses[i][0]}", no), (f"{ch}:{clauses[i + 1][0]}", no)}
                i += 2
                continue
            if kind < 0.4:
                s.append((ch, "telang", no, clauses[i][1][0] + "."))
                s.append((ch, "telang", no + 1, clauses[i][1][1] + "."))
                truth |= {(f"{ch}:{clauses[i][0]}", no), (f"{ch}:{clauses[i][0]}", no + 1)}
                no += 1
            else:
                s.append((ch, "telang", no, "; ".join(clauses[i][1]) + "."))
                truth.add((f"{ch}:{clauses[i][0]}", no))
            if rng.random() < 0.1:
                no += 1
                s.append((ch, "telang", no, "This is explained in a note on the former passage."))
            i += 1
    return v, s, truth


VERSES = "row_id long, id string, ch int, n int, devanagari string, iast string, rendition string"
SENTENCES, ALIGN = "ch int, rendition string, sent_no int, text string", "chapter int, records array<struct<id:string,telang:array<struct<para:string,anchors:array<string>>>,arnold:string>>"


def frames(spark, v, s, align=(), glossary=()):
    return spark.createDataFrame(v, VERSES), spark.createDataFrame(s, SENTENCES), spark.createDataFrame(list(align), ALIGN), spark.createDataFrame(list(glossary), "term string, rendering string")


def test_known_pairs(spark):
    v, s, truth = corpus(random.Random(11))
    v = v + [(9000 + i, *r[1:]) for i, r in enumerate(v[:5])] + [(9500, None, 1, 1, None, "x", "x"), (9501, "1:99", 1, 99, None, None, "x")]
    s = s + [(1, "telang", 900, None), (1, "telang", 901, ""), (None, "telang", 1, "x"), (77, "telang", 1, "alone")] + s[:1]
    pairs, words = A.aligned(*frames(spark, v, s, [(1, [("1:1", [("T00", ["stone river", "x"])], None)])], [("kana", "stone"), ("_note", "n"), (None, None)]))
    got = {(r.verse_id, r.sent_no) for r in pairs.collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    learnt = {}
    for r in words.collect():
        learnt.setdefault(r.stem, []).append((r.weight, r.word))
    assert sum(max(x)[1] == A.english_stems(ENGLISH[STEMS.index(e)])[0] for e, x in learnt.items() if e in STEMS) >= 0.9 * len(STEMS)


def test_paths_of_training_agree(spark, monkeypatch):
    v, s, _ = corpus(random.Random(2), chapters=3, verses=6)
    monkeypatch.setattr(A, "LEAST", 0.05)  # many counts of a single batch are below

    def all_rows():
        return [{tuple(x)[:-1]: x[-1] for x in df.collect()} for df in A.aligned(*frames(spark, v, s))]

    one = all_rows()
    monkeypatch.setattr(A, "BROADCAST_BYTES", 1)
    two = all_rows()
    for x, y in zip(one, two):
        assert set(x) == set(y) and all(abs(x[k] - y[k]) < 1e-6 for k in x)


def test_path_reaches_far_in_a_large_chapter():
    n = 4100
    weight = {f"a{k}": {f"A{k}": 0.52} for k in range(2 * n)}  # a share that the path takes and an offer does not
    halves = [[f"a{2 * k}", f"a{2 * k + 1}"] for k in range(n)]
    # the first half is the only one rendered, by the last sentence: the path itself has to reach it
    found = A.lexical_alignment(halves, list(range(n)), [[] for _ in range(n - 1)] + [["A0", "A1"]], weight)
    assert [(i, j) for i, j, _ in found] == [(0, n - 1)]


def test_empty(spark):
    v, s, _ = corpus(random.Random(2), chapters=1, verses=2)
    for a, b in ((v, []), ([], s), ([], [])):
        assert A.aligned(*frames(spark, a, b))[0].count() == 0


def test_partitions_and_batches_change_nothing(spark):
    """The same rows for any number of partitions and any size of Arrow batches."""
    v, s, _ = corpus(random.Random(2), chapters=3, verses=6)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    one = {(r.verse_id, r.sent_no) for r in A.aligned(*frames(spark, v, s))[0].collect()}
    held = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "7")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {(r.verse_id, r.sent_no) for r in A.aligned(*frames(spark, v, s))[0].collect()} == one
    finally:
        spark.conf.set(key, held[0])
        spark.conf.set("spark.sql.shuffle.partitions", held[1])


def test_best_path_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        gains = [{j: 0.5 + rng.random() for j in range(m) if rng.random() < 0.6} for _ in range(n)]

        def best(i, last):
            if i == n:
                return 0.0
            return max([best(i + 1, last), *(g - A.RENDERED + (A.AHEAD if j > last else 0) + best(i + 1, j) for j, g in gains[i].items() if j >= last)])

        path = A._best_path(gains, m)
        assert sorted(path.values()) == [path[i] for i in sorted(path)]
        last, total = -1, 0.0
        for i in sorted(path):
            total += gains[i][path[i]] - A.RENDERED + (A.AHEAD if path[i] > last else 0)
            last = path[i]
        assert abs(total - best(0, -1)) < 1e-9


def test_length_beads_of_long_chapters():
    """Rows worked out again give the same beads whatever their number; a long chapter takes little memory."""
    rng = random.Random(8)
    a = [rng.randint(20, 90) for _ in range(700)]
    b = [x + rng.randint(-3, 3) for x in a]
    assert [x[:4] for x in A.length_beads(a, b)] == [(k, k + 1, k, k + 1) for k in range(700)]
    cost = sum(x[4] for x in A.length_beads(a[:40], b[10:50]))
    assert cost < sum(x[4] for x in A.length_beads(a[:40], b[30:70])) + 200


def test_length_beads():
    assert [(i, j, k, m) for i, j, k, m, _ in A.length_beads([10, 20, 30], [11, 19, 31])] == [(0, 1, 0, 1), (1, 2, 1, 2), (2, 3, 2, 3)]
    assert [x[:4] for x in A.length_beads([40, 42], [85])] == [(0, 2, 0, 1)]
    assert A.length_beads([], []) == [] and len(A.length_beads([5], [])) == 1 and len(A.length_beads([], [5, 5])) == 2


def test_moved_sentence_is_found():
    weight = {e: {f: 1.0} for e, f in zip("abcdefghij", "ABCDEFGHIJ")}
    halves = [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]]
    found = A.lexical_alignment(halves, [0, 1, 2], [list("GHI"), list("ABC"), list("DEF"), list("XYZ"), []], weight)
    assert {(i, j) for i, j, _ in found} == {(0, 1), (1, 2), (2, 0)}


def test_moved_half_rendered_by_two_sentences():
    weight = {e: {f: 1.0} for e, f in zip("abcdefghijkl", "ABCDEFGHIJKL")}
    halves = [["a", "b", "c", "d"], ["e", "f", "g"], ["h", "i", "j"]]
    found = A.lexical_alignment(halves, [0, 1, 2], [list("EFG"), list("HIJ"), list("ABC"), list("BCD"), list("XYZ")], weight)
    assert {(i, j) for i, j, _ in found} == {(1, 0), (2, 1), (0, 2), (0, 3)}


def test_stems():
    assert A.verse_halves("योगेन कर्मस्य ।\nसञ्जय उवाच\nतद्वगं च", None) == [["yog", "karm"], ["tadvag"]]
    assert A.verse_halves(None, None) == [] and A.verse_halves("", "rāmasya |\nca tu") == [["rām"]]
    assert A.english_stems("Throweth, throws THROW; mercies mercy") == ["throw", "throw", "throw", "merci", "merci"]
