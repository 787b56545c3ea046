"""Leaks: forms that make no difference, near misses, and agreement with brute force."""

import random

from versemill.llm.leaks import holds, leak_report, leaked_items, letters, replaceable

ITEM = "Three times a weapon covers this cord, and each time the endless tether is spared. Of four streams the needy one throws the bosom, the others only drag a far-off flame."


def both(doc, item=ITEM):
    return holds(letters(doc), letters(item))


def test_runs_of_words():
    w = ITEM.split()
    assert both("x y " + " ".join(w[5:17]) + " z") and not both("x y " + " ".join(w[5:16]) + " z")
    assert both(" ".join(w[:12])) and both(" ".join(w[-12:]))


def test_forms_that_make_no_difference():
    assert both(ITEM.upper()) and both(ITEM.replace(" ", "  ").replace(",", ""))
    assert both("Why\n> " + ITEM[:40] + "-\n> " + ITEM[40:90] + "\n> " + ITEM[90:])
    assert both(ITEM.replace("a", "а").replace("o", "ο")) and both("​".join(ITEM)) and both(ITEM.replace("e", "é"))
    assert both(ITEM.replace(" ", " ").replace("weapon", "wea­pon"))
    assert both(ITEM.replace(" ", "&nbsp;"))


def test_replaced_words():
    w = ITEM.split()
    for spots, expected in (((0, 10, 20), True), ((7, 15, 23), True), ((0, 1, 2), True), ((5, 11, 18, 25), False), ((len(w) - 1, 12, 3), True)):
        x = list(w)
        for s in spots:
            x[s] = "replacement"
        assert both("So: " + " ".join(x) + " end.") is expected, spots


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = []
    for d in range(60):
        body = [rng.choice(vocab) for _ in range(60)]
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            n = rng.choice([8, 11, 12, 13, 20, 30])
            at = rng.randint(0, 30 - n)
            body[20:20] = src[at : at + n]
        docs.append((d, " ".join(body)))

    def spelled(doc, item):
        d, t = doc.split(), item.split()
        return any(d[i : i + 12] == t[j : j + 12] for i in range(len(d) - 11) for j in range(len(t) - 11)) or any(sum(a != b for a, b in zip(d[i : i + 30], t)) <= 3 for i in range(len(d) - 29))

    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs] + [(100, None, 0, "x"), (101, "", 0, "x"), (0, docs[0][1], 0, "x")], "doc_id long, text string, item_id int, print string")
    it = spark.createDataFrame([(i, t) for i, t in items] + [(50, None), (51, "")], "item_id long, text string")
    found = leaked_items(df, it)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, i) for d, t in docs for i, x in items if spelled(t, x)}
    report = {r.item_id: r.documents for r in leak_report(found, it).collect()}
    assert set(report) == {*range(12), 50, 51} and report[50] == 0


def test_short_items(spark):
    tiny = "a b c d e f g h i j k l m n"
    items = {1: "red fox", 2: "the owl sees a cat", 3: "the owl sees a mole", 4: tiny}
    filler = " ".join(f"word{i} thing{i * 7}" for i in range(20))
    docs = [(1, f"{filler} red fox {filler}"), (2, f"{filler} bored foxes {filler}"), (3, f"{filler} The owl sees a cat! {filler}"), (4, f"{filler} the owl sees a mole. {filler}")]
    docs += [(5, f"{filler} {' '.join(tiny.split()[1:13])} {filler}"), (6, f"{filler} a b X d e f X h i j X l m n {filler}"), (7, f"{filler} {' '.join(tiny.split()[:8])} {filler}")]
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    # of the five words of items 2 and 3 two may be replaced: each of documents 3 and 4 holds both
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 2), (4, 3), (3, 3), (4, 2), (5, 4), (6, 4)}


def test_short_items_are_never_lost(spark):
    """Random items of 1 to 16 words, verbatim and with as many words replaced as may be; every true case shares a seed and is held."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    items, docs, expected = [], [], set()
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20):
        for _ in range(6):
            i, text = len(items), [word() for _ in range(n)]
            items.append((i, " ".join(text)))
            for replaced in {0, replaceable(n)}:
                x = list(text)
                for spot in rng.sample(range(n), replaced):
                    x[spot] = word()
                expected.add((len(docs), i))
                docs.append((len(docs), " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])))
    assert all(holds(letters(docs[d][1]), letters(items[i][1])) for d, i in expected)
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert expected <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_long_replacing_words_and_long_items():
    w = ITEM.split()
    x = list(w)
    x[7], x[15] = "incomprehensibilities" * 3, "o-n-e w o r d"
    assert both("So: " + " ".join(x) + " end.")
    rng = random.Random(1)
    long_item = " ".join("".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(30_000))  # over a million letters
    assert both("start " + " ".join(long_item.split()[29_900:29_912]) + " end", long_item)


def test_hot_prints_give_way(spark):
    """Items with a common opening: its prints are passed over, every leak is found all the same, that of the opening too."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    opening = " ".join(word() for _ in range(14))
    items = [(i, opening + " " + " ".join(word() for _ in range(20))) for i in range(60)]
    docs = [(i, "x " + items[i][1].split(" ", 14)[14] + " y") for i in range(0, 60, 5)] + [(100, f"a b {opening} c")]
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(0, 60, 5)} | {(100, i) for i in range(60)}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaked_items(docs, items).count() == 0
    assert leaked_items(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
