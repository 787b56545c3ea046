"""Hand-computed answers of the relational, sequence, event, segmentation, witness and consensus operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from versemill.operators import consensus as A
from versemill.operators import events as E
from versemill.operators import packs, quality, segmentation, witness
from versemill.operators import relational as R
from versemill.operators import sequence as S
from versemill.operators.search import prefix_search

COUNTS = {1: 47, 2: 72, 3: 43}


def units(spark):
    return spark.createDataFrame([(ch, n, f"{ch}:{n}") for ch, k in COUNTS.items() for n in range(1, k + 1)], "ch int, n int, id string")


def test_first_unread(spark):
    rows = [(1, f"1:{n}") for n in range(1, 48)] + [(2, "1:2"), (2, "9:9")] + [(3, f"{c}:{n}") for c, k in COUNTS.items() for n in range(1, k + 1)] + [(None, "1:1")]
    got = {r.reader_id: r.next_id for r in S.first_unread(units(spark), spark.createDataFrame(rows, "reader_id long, id string")).collect()}
    assert got == {1: "2:1", 2: "1:1", 3: None}


def test_unit_of_day(spark):
    sizes = spark.createDataFrame(list(COUNTS.items()), "ch int, total int")
    got = {r.day: r.id for r in S.unit_of_day(spark.range(1, 801).withColumnRenamed("id", "day"), sizes).collect()}
    assert got[100] == "1:34" and len(got) == 800 and all(1 <= int(i.split(":")[1]) <= COUNTS[int(i.split(":")[0])] for i in got.values())


def test_packs_of_ten(spark):
    got = S.packs(units(spark).where("ch = 1")).groupBy("pack_id").count().collect()
    assert sorted((r.pack_id, r["count"]) for r in got) == [("ch01-1", 10), ("ch01-2", 10), ("ch01-3", 10), ("ch01-4", 10), ("ch01-5", 7)]


def test_fraction(spark):
    df = spark.createDataFrame([(0, 47), (47, 47), (10, 20), (5, 0), (99, 47), (None, 3)], "a int, b int")
    assert [r.f for r in df.select(R.fraction(F.col("a"), F.col("b")).alias("f")).collect()][:5] == [0.0, 1.0, 0.5, 0.0, 1.0]


def test_inherited_needs_agreement(spark):
    rows = [("r", i, v) for i, v in enumerate([None, 1, None, 1, None, 2, None])]
    got = [r.filled for r in S.inherited(spark.createDataFrame(rows, "by string, k int, v int"), "by", ["k"], "v").orderBy("k").collect()]
    assert got == [None, 1, 1, 1, None, 2, None]


def test_debounce(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, i, t0 + timedelta(milliseconds=ms)) for i, ms in enumerate([0, 100, 250, 900])] + [(1, 9, None)]
    got = E.debounced(spark.createDataFrame(rows, "by int, k int, at timestamp_ntz"), "by", "at", "k", 300_000)
    assert sorted(r.k for r in got.collect()) == [2, 3]


def test_writes_and_deletes(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("b", None, 4), (None, 1, 5)], "k string, at int, id int")
    assert {r.k: r.id for r in R.first_write_wins(rows, ["k"], "at", "id").collect()} == {"a": 2, "b": 4, None: 5}
    assert {r.k: r.id for r in R.last_write_wins(rows, ["k"], "at", "id").collect()} == {"a": 1, "b": 4, None: 5}
    assert sorted(r.id for r in R.delete_by_keys(rows, rows.where("k = 'a'"), "k").collect()) == [4, 5]
    assert R.delete_by_keys(rows, rows.limit(0), "k").count() == 5


def test_contiguity_and_spans(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 2)], "ch int, n int")
    assert {r.ch: r.gaps for r in S.contiguity(df, "ch", "n").collect()} == {2: 1, 3: 1}
    got = S.spans(df.where("ch = 2"), "ch", "n", F.lit(9)).orderBy("n").collect()
    assert [(r.n, r.until) for r in got] == [(1, 3), (3, 9)]


def test_two_way_difference(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.side, r.x) for r in R.two_way_difference(a, b).collect()) == [("left", 1), ("left", 2), ("right", 3)]


def test_search(spark):
    rows = [(1, 1, "1:1", "The karma of yoga", None), (1, 2, "1:2", "Karman", "yogin"), (1, 3, "1:3", "yoga", ""), (1, 4, None, None, None)]
    df = spark.createDataFrame(rows, "ch int, n int, id string, meaning string, takeaway string")
    hit = lambda q: [r.n for r in prefix_search(df, q, ["id", "meaning", "takeaway"], ["ch", "n"]).collect()]
    assert hit("karma* yog*") == [1, 2] and hit("*** ::") == [] and hit("zzz") == []


def test_poem():
    poem = "अथ प्रथमोऽध्यायः\nधृतराष्ट्र उवाच\nधर्मक्षेत्रे कुरुक्षेत्रे ।\nकिमकुर्वत ॥१-१॥\n॥१-१॥\nसञ्जय उवाच\nदृष्ट्वा तु ॥१–२॥"
    got = segmentation.verses_of(poem)
    assert [(x[0], x[2], x[3]) for x in got] == [(1, 1, "धृतराष्ट्र"), (2, 2, "सञ्जय")]
    assert not any("॥" in x[4] for x in got) and segmentation.verses_of("") == []
    got = segmentation.verses_of("राजा भरत सिंह उवाच\nधर्मक्षेत्रे ॥१-१॥\nक ख ग घ उवाच\nकुरुक्षेत्रे ॥१-२॥")
    assert [(x[3], x[4]) for x in got] == [("राजा भरत सिंह", "धर्मक्षेत्रे"), (None, "क ख ग घ उवाच\nकुरुक्षेत्रे")]


def test_turns(spark):
    df = spark.createDataFrame([("x Arjuna said: a. b. Krishna said: c",), ("none",)], "t string")
    got = [[(x.speaker, x.text) for x in r.t] for r in df.select(segmentation.turns(F.col("t")).alias("t")).collect()]
    assert got == [[("Arjuna", "a. b."), ("Krishna", "c")], []]


def test_allocation(spark):
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 6)], "ch int, start int, until int")
    paras = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 3, 0, "c")], "ch int, start int, k int, text string")
    got = sorted((r.text, r.verse, r.status) for r in segmentation.allocated(spans, paras).collect())
    assert got == [("a", 1, "auto"), ("b", 2, "auto"), ("c", None, "manual(span 3-5)")]


def test_witness_verdicts():
    assert witness.verdict("योगः\nकर्म", "yogaḥ", "karma") == ("MATCH", None, None, None, None)
    assert witness.verdict("तत्र आसीत्\nकर्म", "tatrāsīt", "karma")[0] == "SANDHI-JOINT"
    assert witness.verdict("योगः\nकर्म", "yogaḥ", None)[0] == "MISSING"
    assert witness.verdict("योगः\nकर्म", "bhogaḥ", "karma") == ("DIVERGENCE", "first", 0, "yogaḥ", "bhogaḥ")
    assert witness.verdict("योगः", "a", "b")[0] == "DIVERGENCE" and witness.verdict(None, "a", "b")[0] == "DIVERGENCE"
    assert witness.first_divergence(["a", "b"], ["a", "b"]) is None and witness.first_divergence(["a", "b"], ["a", "b", "c"]) == (2, "ab", "abc")
    for one, other in (("समःशत्रौ", "समश्शत्रौ"), ("शुभाँल्लोकान्", "शुभांलोकान्"), ("सम्बन्ध", "संबंध"), ("किम् अकुर्वत", "किंअकुर्वत"), ("ॐ", "ओं")):
        assert witness.canonical(one) == witness.canonical(other), one
    assert witness.canonical("कर्म") != witness.canonical("काम") and witness.joint("tat", "ca") == "tacca" and witness.joint("vane", "atra") == "vanetra" and witness.joint("naraḥ", "karoti") is None
    assert witness.joint("tatra", "iva") == "tatreva" and witness.joint("naraḥ", "gacchati") == "narogacchati" and witness.joint("tu", "pāṇḍava") is None


def test_witness_copies_with_headings(spark):
    cut = witness.reading_halves
    assert cut("vyāsa uvāca\nyogaḥ |\nkarma", "व्यास") == ("yogaḥ |", "karma") == cut("vyāsa uvаса\nyogaḥ |\nkarma", "व्यास")
    assert cut("a\nb\nc\nd", None) == ("a b", "c d") and cut("vyāsa uvāca\na\nb\nc\nd", None) == ("a b", "c d")
    assert cut("yogaḥ", None) == ("yogaḥ", None) == cut("vyāsa uvāca\nyogaḥ", None) and cut(None, None) == (None, None) and cut("a\nb\nc", None) is None
    ours = spark.createDataFrame([(k, "व्यास उवाच\nयोगः ।\nकर्म") for k in "abcde"], "id string, devanagari string")
    copies = [("a", "व्यास", "vyāsa uvāca\nyogaḥ |\nkarma"), ("b", "व्यास", "vyāsa uvāca\nyogaḥ |\nkāma"), ("c", None, "yogaḥ\nkarma"), ("d", None, "yogaḥ\nkarma\nkarma")]
    got = {r.id: (r.status, r.position) for r in witness.witness_diff(ours, spark.createDataFrame(copies, "id string, speaker string, iast string")).collect()}
    assert {k: s for k, (s, _) in got.items()} == {"a": "MATCH", "b": "DIVERGENCE", "c": "MATCH", "d": "DIVERGENCE", "e": "MISSING"}
    assert got["b"][1] == 1 and got["d"][1] is None
    assert witness.is_heading("श्रीभगवानुवाच") and witness.is_heading("a b uvāca") and not witness.is_heading("uvāca") and not witness.is_heading("a b c uvāca")


ALIGN = "chapter int, records array<struct<id:string,telang:array<struct<para:string,anchors:array<string>>>,arnold:string,arnold_shared:boolean,notes:string>>, dropped array<struct<para:string,reason:string>>"
PAGES = "chapter int, telang_paras array<struct<text:string,is_footnote:boolean>>, arnold string"


def consensus(spark, meaning, prose, verse):
    telang = [("T00", ["x"])] if prose is not None else []
    align = spark.createDataFrame([(1, [("1:1", telang, "A01", False, "")], [])], ALIGN)
    pages = spark.createDataFrame([(1, [("note", True), (prose or "", False)], None if verse is None else f"CHAPTER I\n\n{verse}")], PAGES)
    glossary = spark.createDataFrame([], "term string, rendering string")
    row = A.verdicts(spark.createDataFrame([("1:1", meaning)], "id string, meaning string"), align, pages, glossary).first()
    return row.status


def test_verdict_ladder(spark):
    text = "the warrior drops the heavy bow"
    assert consensus(spark, text, "A warrior drops a heavy bow.", "drops the bow, warrior heavy") == "CONSENSUS"
    assert consensus(spark, text, "A warrior drops a heavy bow.", "something else entirely here") == "SINGLE-SOURCE"
    assert consensus(spark, text, "nothing like it", "something else entirely here") == "ORPHAN"
    assert consensus(spark, text, "A warrior drops a heavy bow.", None) == "ARNOLD-ABSENT"
    assert consensus(spark, text, None, "drops the bow") == "TELANG-ABSENT"
    assert consensus(spark, "the bow", "bow", "bow") == "NAME-LIST"


def test_paragraph_codes_skip_footnotes(spark):
    pages = spark.createDataFrame([(1, [("a", False), ("n", True), ("b", None)], None), (2, None, None), (3, [], "")], PAGES)
    assert sorted((r.para, r.text) for r in A.coded_paragraphs(pages).collect()) == [("T00", "a"), ("T01", "b")]


def test_glossary_leaks_by_substring(spark):
    g = spark.createDataFrame([("vanta", "chariot"), ("_note", "x"), (None, "y"), ("z", None), ("vanta", "chariot")], "term string, rendering string")
    d = spark.createDataFrame([(1, "the Vantas"), (2, "vanta, a chariot"), (3, None), (4, "none")], "id long, text string")
    assert [(r.id, r.term) for r in quality.glossary_leaks(d, "id", "text", g).collect()] == [(1, "vanta")]


def test_glossary_leaks_of_terms_of_several_runs(spark):
    g = spark.createDataFrame([("kuru kshetra", "field"), ("go-pala", "herdsman"), ("d'or", "gold"), ("no2", "second"), ("108", "beads")], "term string, rendering string")
    d = spark.createDataFrame([(1, "On Kuru Kshetras"), (2, "kshetra of kuru"), (3, "a Go-pala"), (4, "gopala"), (5, "lad'or"), (6, "No2"), (7, "no 2"), (8, "x1080"), (9, "108 beads"), (10, "the go-pala, a herdsman"), (11, None)], "id long, text string")
    want = sorted((t.id, x.term) for t in d.collect() for x in g.collect() if t.text and x.term in t.text.lower() and x.rendering not in t.text.lower())
    assert want == [(1, "kuru kshetra"), (3, "go-pala"), (5, "d'or"), (6, "no2"), (8, "108")]
    assert sorted((r.id, r.term) for r in quality.glossary_leaks(d, "id", "text", g).collect()) == want


def test_rendered_pack(spark):
    u = spark.createDataFrame([(1, n, f"1:{n}", None, "द", "d", f"m{n}", " ") for n in (1, 2)], "ch int, n int, id string, speaker string, devanagari string, iast string, meaning string, takeaway string")
    empty = spark.createDataFrame([], "id string, note string")
    text = packs.rendered(u, spark.createDataFrame([], "ch int, title string"), empty, spark.createDataFrame([], "pack_id string, status string")).first().text
    assert "# Pack ch01-1" in text and "**pending**" in text and "**Meaning:** m2" in text and "Takeaway" not in text


def test_near_terms(spark):
    words = spark.createDataFrame([("adhibhilta",), ("lotuss",), ("lotus",), ("kettles",), ("garden",), ("garten",), (None,)], "lemma string")
    terms = spark.createDataFrame([("adhibhuta",), ("lotust",), ("garden",), ("kettle",), ("nothing",), (None,)], "term string")
    got = {r.lemma: r.term for r in A.near_terms(words, terms).collect()}
    assert got == {"adhibhilta": "adhibhuta", "lotuss": "lotust", "kettles": "kettle", "garten": "garden"}


def test_near_terms_after_all_double_deletions(spark):
    terms = ["abcdefghijklmnopqrstu"[:n].translate({ord(c): c.upper() if n % 2 else c for c in "abcdefghijklmnopqrstu"}) for n in range(6, 22, 5)] + ["abcdefghij", "ABCDEFGHIJKLM", "nopqrstuvwxyzabc", "NOPQRSTUVWXYZABCDEF"]
    lost = {t[:i] + t[i + 1 : j] + t[j + 1 :] for t in terms for i in range(len(t)) for j in range(i + 1, len(t))} - set(terms)
    rows = [(w, t) for w in lost if len(w) >= 7 for t in terms if abs(len(w) - len(t)) <= 2]
    near = spark.createDataFrame(rows, "lemma string, term string").where("levenshtein(lemma, term) <= 2").groupBy("lemma").agg(F.min("term").alias("term"))
    got = A.near_terms(spark.createDataFrame([(w,) for w in lost if len(w) >= 7], "lemma string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert near.count() > 400 and sorted(got.collect()) == sorted(near.collect())
