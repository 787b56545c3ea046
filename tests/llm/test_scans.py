"""Scan noise planted into clean text must be found and undone."""

from versemill.llm import scans

PAGES = "chapter int, telang_paras array<struct<text:string,is_footnote:boolean>>, word string, line int"
CLEAN = ["The great lotus empties the near lamp.", "The far-off merchant stains the mother, O Bilpukara!", "The mariner hides the young serpent among the flames.", "Know that the season drinks the memory."] * 6


def run(spark, paras, clean=CLEAN):
    df = spark.createDataFrame([(1, [(p, False) for p in paras], "x", 1), (2, None, "x", 1), (3, [(None, None)], "x", 1), (4, [], "x", 1)], PAGES)
    found = scans.scan_findings(df, [spark.createDataFrame([(c,) for c in clean], "text string")])
    return df, found


def test_findings_and_repair(spark):
    para = "The grcat lotus empties the near la-\n43\nCHAPTER I, 57.\nmp. The far-\noff merchant stains the mo¬\nther, O Bi1pukara!\nTHE LAY OF RIVERS\nThe mari ner hides the young serpent among the flarnes."
    df, found = run(spark, [para, "[12] THE LAY OF RIVERS", ""])
    got = {(r.para, r.line, r.kind, r.word) for r in found.collect()}
    assert got == {
        (0, 0, "misread", "great"), (0, 0, "hyphen", "lamp"), (0, 1, "furniture", ""), (0, 2, "furniture", ""), (0, 3, "hyphen", "far-off"), (0, 4, "hyphen", "mother"),
        (0, 5, "misread", "bilpukara"), (0, 6, "furniture", ""), (0, 7, "misread", "mariner"), (0, 7, "misread", "flames"), (1, 0, "furniture", ""),
    }
    text = {r.para: r.text for r in scans.repaired(df, found).collect()}
    assert text == {0: "The great lotus empties the near lamp. The far-off merchant stains the mother, O Bilpukara! The mariner hides the young serpent among the flames."}


def test_numbers_of_the_text_stay(spark):
    para = "Of these there were in number 700. Of these there were in number\n108.\nKnow that the season drinks the memory. Of these there were in number 33. The lotus\n44\nempties the lamp."
    _, found = run(spark, [para])
    assert [(r.line, r.kind) for r in found.collect()] == [(3, "furniture")]


def test_heads_of_many_books(spark):
    """A thousand heads of twenty pages each, in capitals and in title case: none is too rare among the others."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(7))
    rows = []
    for book in range(1000):
        title = f"{word()} {word()}"
        heads = [title.upper()] * 18 + [title.title()] * 2
        rows.append((book, [(f"The great lotus empties the\n{h} {k}\nnear lamp.", False) for k, h in enumerate(heads, 1)], "x", 1))
    found = scans.scan_findings(spark.createDataFrame(rows, PAGES).repartition(4), [spark.createDataFrame([(c,) for c in CLEAN], "text string")])
    got = found.groupBy("kind", "line").count().collect()
    assert [(r.kind, r.line, r["count"]) for r in got] == [("furniture", 1, 20_000)]


def test_names_on_a_line_of_their_own_stay(spark):
    """A word of a head that is common in the text does not make its own line page matter."""
    paras = ["THE LAY OF RIVERS\nThe great mother empties the near lamp, O\nMother!"] * 3 + ["the mother, the mother, the mother"] * 5 + ["MOTHER OF RIVERS\nx y"] * 2
    _, found = run(spark, paras)
    assert {(r.para, r.line) for r in found.where("kind = 'furniture'").collect()} == {(0, 0), (1, 0), (2, 0), (8, 0), (9, 0)}


def test_other_alphabets(spark):
    clean = ["Der große König liebt die Bäume und die Flüsse."] * 8
    _, found = run(spark, ["Der große König liebt die Bäu-\nme und die Flusse."], clean)
    assert {(r.line, r.kind, r.word) for r in found.collect()} == {(0, "hyphen", "baume")}


def test_two_confusions_meet(spark):
    """Two confusions far apart in one word; the same result as trying every pair of them."""
    _, found = run(spark, ["The serpcnt is anioug the flowers; thc yoiing mariucr hides."], CLEAN + ["serpent among flowers young mariner hides"] * 6)
    assert {r.word for r in found.collect()} >= {"serpent", "young", "mariner"}


def test_clean_and_empty(spark):
    _, found = run(spark, ["The great lotus empties the near lamp."])
    assert found.count() == 0
    _, found = run(spark, [])
    assert found.count() == 0
    df = spark.createDataFrame([], PAGES)
    assert scans.scan_findings(df, []).count() == 0


def test_explained():
    assert scans.explained("grcat", "great") == 1 and scans.explained("knovv", "know") == 1 and scans.explained("5ai1", "sail") == 2
    assert scans.explained("great", "treat") == 0 and scans.explained("a" * 3000 + "c", "a" * 3000 + "e") == 1
