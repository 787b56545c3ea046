"""Editors' alignments against the texts: paragraph codes, contexts, containment, coverage and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions.lexical import Lexicon, lemmas, normalized_word, stem
from versemill.runtime import small, stored


def coded_paragraphs(pages: DataFrame) -> DataFrame:
    """(chapter, para, text): non-footnote paragraphs numbered T00.. after the filter (FLT8)."""
    kept = F.filter("telang_paras", lambda p: ~F.coalesce(p["is_footnote"], F.lit(False)))
    return pages.select("chapter", F.posexplode(kept).alias("k", "p")).select("chapter", F.format_string("T%02d", "k").alias("para"), F.col("p.text").alias("text"))


def stanzas(pages: DataFrame) -> DataFrame:
    """(chapter, k, text): stanzas of the verse translation, 0 being the chapter's heading (SEG6, JN9)."""
    cut = F.filter(F.transform(F.split("arnold", "\n[ \t]*\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")
    return pages.where("arnold is not null").select("chapter", F.posexplode(cut).alias("k", "text"))


def records(align: DataFrame) -> DataFrame:
    """(chapter, id, telang, arnold, notes), one row for each record."""
    return align.select("chapter", F.explode("records").alias("r")).select("chapter", "r.id", "r.telang", "r.arnold", "r.notes")


def spans(align: DataFrame) -> DataFrame:
    """(chapter, id, position, para, anchors) of every paragraph a record names."""
    return records(align).select("chapter", "id", F.posexplode("telang").alias("position", "t")).select("chapter", "id", "position", "t.para", "t.anchors")


def contexts(align: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, context): the named paragraphs in order, joined by a blank line; unknown ones drop out (JN8)."""
    joined = spans(align).join(coded_paragraphs(pages), ["chapter", "para"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return joined.groupBy("id").agg(F.array_join(parts, "\n\n").alias("context"))


# fixed values: speakers whose name with a point opens a stanza
LABELS = ("Sanjaya", "Krishna", "Arjuna", "Dhritarashtra")


def stanza_of(align: DataFrame, pages: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(id, stanza): by a letter and the stanza's number after the heading, without a speaker's label; malformed codes and
    numbers beyond give none (JN9)."""
    coded = records(align).where(F.col("arnold").rlike("^[A-Z][0-9]{1,6}$")).select("chapter", "id", F.substring("arnold", 2, 6).cast("int").alias("k"))
    text = F.regexp_replace("text", rf"^({'|'.join(labels)})\.[ \t\r\n]*", "")
    return coded.join(stanzas(pages), ["chapter", "k"]).select("id", text.alias("stanza"))


def unfound_anchors(align: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, para, anchor): quotes that the named paragraph does not hold, or whose paragraph is unknown (JN14, DQ8)."""
    quotes = spans(align).select("chapter", "id", "para", F.explode("anchors").alias("anchor"))
    met = quotes.join(coded_paragraphs(pages), ["chapter", "para"], "left")
    return met.where(F.col("text").isNull() | ~F.contains("text", "anchor")).select("id", "para", "anchor").distinct()


def paragraph_coverage(align: DataFrame, pages: DataFrame) -> DataFrame:
    """(chapter, para, used, dropped, state): 'open' if neither, 'both' if used and dropped (JN15, DQ9, DQ17)."""
    used = spans(align).select("chapter", "para").distinct().withColumn("used", F.lit(True))
    dropped = align.select("chapter", F.explode("dropped").alias("d")).select("chapter", "d.para").distinct().withColumn("dropped", F.lit(True))
    out = coded_paragraphs(pages).select("chapter", "para").join(used, ["chapter", "para"], "left").join(dropped, ["chapter", "para"], "left")
    no = F.lit(False)
    out = out.select("chapter", "para", F.coalesce("used", no).alias("used"), F.coalesce("dropped", no).alias("dropped"))
    state = F.when(F.col("used") & F.col("dropped"), "both").when(F.col("used"), "used").when(F.col("dropped"), "dropped").otherwise("open")
    return out.withColumn("state", state)


def lemma_rows(texts: DataFrame, key: str, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(key, lemma), distinct (LX5)."""
    return texts.select(key, F.explode(lemmas(F.col(text), lexicon)).alias("lemma"))


def name_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(word): words that begin with a small letter somewhere in the whole corpus (LX7)."""
    words = F.filter(F.split(F.regexp_replace(text, "[^A-Za-z ]", " "), " +"), lambda w: w.rlike("^[a-z]"))
    return texts.select(F.explode(words).alias("w")).select(F.lower("w").alias("word")).distinct()


def nameless_lemma_rows(texts: DataFrame, key: str, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(key, lemma) without names: words with a capital that never occur without one (LX8, FLT15)."""
    words = texts.select(key, F.explode(F.filter(F.split(F.regexp_replace(text, "[^A-Za-z ]", " "), " +"), lambda w: w != "")).alias("w")).withColumn("word", F.lower("w"))
    ordinary = name_vocabulary(texts, text).withColumn("known", F.lit(True))
    kept = words.join(ordinary, "word", "left").where(~F.col("w").rlike("^[A-Z]") | F.col("known"))
    return kept.select(key, F.explode(lemmas(F.col("word"), lexicon)).alias("lemma")).distinct()


def expanded(rows: DataFrame, key: str | list[str], edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(key, lemma): the lemmas and, one step, what the edges (lemma, also) add; not transitive (LX6, ST3).

    Lemmas of six letters or more that no term (lemma, also) is, are first read as the term they are a misreading of (JN20).
    """
    keys = [key] if isinstance(key, str) else key
    grown = rows.unionByName(rows.join(small(edges), "lemma").select(*keys, F.col("also").alias("lemma")))
    if terms is not None:
        near = near_terms(rows.select("lemma"), terms.select(F.col("lemma").alias("term")))
        glossed = near.join(terms.withColumnRenamed("lemma", "term"), "term").select("lemma", "also")
        grown = grown.unionByName(rows.join(glossed.unionByName(terms), "lemma").select(*keys, F.col("also").alias("lemma")))
    return grown.distinct()


def synonym_edges(glossary: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(lemma, also): a term and its rendering stand for each other; old words for today's; members of a concept for all its
    members (LX6). Words of the lexicon take the path of lemmas, terms and renderings only lose their ending."""
    spark = glossary.sparkSession
    good = glossary.where("term is not null and rendering is not null and term not like '\\\\_%'")
    pair = good.select(stem(F.lower("term")).alias("lemma"), stem(F.lower("rendering")).alias("also"))
    pair = pair.unionByName(pair.select(F.col("also").alias("lemma"), F.col("lemma").alias("also")))
    fixed = [*lexicon.archaic.items(), *((x, y) for words in lexicon.concepts.values() for x in words for y in words)]
    if fixed:
        own = _pairs(spark, fixed)
        pair = pair.unionByName(own.select(normalized_word(F.col("x"), lexicon).alias("lemma"), normalized_word(F.col("y"), lexicon).alias("also")))
    return stored(pair.where("lemma <> also and lemma <> '' and also <> ''").distinct())


def _pairs(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(x, y): word lists of a lexicon as a frame of one row, taken apart."""
    return spark.range(1).select(F.inline(F.arrays_zip(F.lit([x for x, _ in rows]).alias("x"), F.lit([y for _, y in rows]).alias("y"))))


def term_glosses(glossary: DataFrame, lexicon: Lexicon) -> DataFrame | None:
    """(lemma, also): terms of the lexicon and the words of their glosses; null without any."""
    rows = [(term, word) for term, words in lexicon.terms.items() for word in words]
    if not rows:
        return None
    own = _pairs(glossary.sparkSession, rows)
    return own.select(normalized_word(F.col("x"), lexicon).alias("lemma"), normalized_word(F.col("y"), lexicon).alias("also")).distinct()


def matched(ours: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """(on, lemma, ok): whether the source of the same key has our lemma, exactly or, from seven letters on, within two edits.

    Only lemmas without an exact hit are looked for in like ones. Which words are alike is worked out once over the distinct
    words of both sides, not in each key.
    """
    exact = stored(ours.join(source.select(*on, "lemma").distinct().withColumn("hit", F.lit(True)), [*on, "lemma"], "left"))
    long = exact.where("hit is null and length(lemma) >= 7").select(*on, "lemma")
    terms = source.where("length(lemma) >= 7").select(*on, F.col("lemma").alias("term")).distinct()
    alike = _near_pairs(long.select("lemma").distinct(), terms.select("term").distinct(), []).where(F.levenshtein("lemma", "term", 2) >= 0)
    near = long.join(small(stored(alike)), "lemma").join(terms, [*on, "term"], "left_semi").select(*on, "lemma").distinct().withColumn("fuzzy", F.lit(True))
    return exact.join(near, [*on, "lemma"], "left").select(*on, "lemma", F.coalesce("hit", "fuzzy", F.lit(False)).alias("ok"))


def coverage(ours: DataFrame, source: DataFrame, key: str, units: DataFrame | None = None) -> DataFrame:
    """(key, total, covered, share, uncovered): our lemmas found in the source of the same key (LX9, LX10, AG15, JN19, ST1, ST2).

    Units without lemmas have a share of 1; without `units` (key) they have no row. Without a source nothing is covered.
    """
    left = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("lemma")))), " ")
    out = matched(ours, source, [key]).groupBy(key).agg(F.count("*").alias("total"), F.count_if("ok").alias("covered"), left.alias("uncovered"))
    if units is not None:
        out = units.select(key).distinct().join(out, key, "left")
    zero = F.lit(0)
    return out.select(key, F.coalesce("total", zero).alias("total"), F.coalesce("covered", zero).alias("covered"), F.coalesce(F.col("covered") / F.col("total"), F.lit(1.0)).alias("share"), F.coalesce("uncovered", F.lit("")).alias("uncovered"))


def verdicts(units: DataFrame, align: DataFrame, pages: DataFrame, glossary: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(id, status, total, covered_prose, covered_verse, share_prose, share_verse, uncovered): how far two translations bear
    out a unit's meaning (LX11).

    Half of the lemmas must be covered. In this order: fewer than three lemmas NAME-LIST, blank prose TELANG-ABSENT, no
    stanza ARNOLD-ABSENT, both CONSENSUS, one SINGLE-SOURCE, none ORPHAN. Shares have two places, ties to the even one, and
    are null for a source that is absent or not asked. uncovered has the lemmas that the source in question leaves open: of
    one source the other's, of none those that both leave open (ST4). Both sources go through one join and one aggregate.
    """
    prose, verse = stored(contexts(align, pages)), stored(stanza_of(align, pages))
    ours = stored(nameless_lemma_rows(units.where("meaning is not null").select("id", "meaning"), "id", "meaning", lexicon))
    rows = prose.select("id", F.lit("p").alias("side"), F.col("context").alias("text")).unionByName(verse.select("id", F.lit("v").alias("side"), F.col("stanza").alias("text")))
    source = expanded(rows.select("id", "side", F.explode(lemmas(F.col("text"), lexicon)).alias("lemma")), ["id", "side"], synonym_edges(glossary, lexicon), term_glosses(glossary, lexicon))
    both = ours.select("id", F.explode(F.lit(["p", "v"])).alias("side"), "lemma")
    met = matched(both, stored(source), ["id", "side"])
    of = lambda side: F.col("side") == side
    open_ = lambda side: F.array_sort(F.collect_list(F.when(of(side) & ~F.col("ok"), F.col("lemma"))))
    met = met.groupBy("id").agg(F.count_if(of("p")).alias("total"), F.count_if(of("p") & F.col("ok")).alias("p"), F.count_if(of("v") & F.col("ok")).alias("v"), open_("p").alias("open_p"), open_("v").alias("open_v"))
    out = units.select("id").join(met, "id", "left")
    out = out.join(prose.where("trim(context) <> ''").select("id", F.lit(True).alias("has_prose")).distinct(), "id", "left").join(verse.select("id", F.lit(True).alias("has_verse")).distinct(), "id", "left")
    n, p, v = (F.coalesce(c, F.lit(0)) for c in ("total", "p", "v"))
    names, no_prose, no_verse = n < 3, F.col("has_prose").isNull(), F.col("has_verse").isNull()
    by_p, by_v = p * 2 >= n, v * 2 >= n
    status = F.when(names, "NAME-LIST").when(no_prose, "TELANG-ABSENT").when(no_verse, "ARNOLD-ABSENT").when(by_p & by_v, "CONSENSUS").when(by_p | by_v, "SINGLE-SOURCE").otherwise("ORPHAN")
    none = F.array().cast("array<string>")
    left = F.when(names, none).when(no_prose, F.col("open_v")).when(no_verse, F.col("open_p")).when(by_p & by_v, none).when(by_p, F.col("open_v")).when(by_v, F.col("open_p")).otherwise(F.array_intersect("open_p", "open_v"))
    share = lambda c, absent: F.when(~names & ~absent, F.bround(c / n, 2))
    return out.select("id", status.alias("status"), n.alias("total"), p.alias("covered_prose"), v.alias("covered_verse"), share(p, no_prose).alias("share_prose"), share(v, no_verse & ~no_prose).alias("share_verse"), F.array_join(left, " ").alias("uncovered"))


def _near_pairs(words: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """(on, lemma, term), distinct: pairs that may be within two edits. words(on, lemma), terms(on, term), of six letters or more.

    A word within two edits of a term holds one of the term's three parts unchanged, moved by two letters at most: words and
    terms meet on equal parts.
    """
    cut = lambda i: F.floor(F.length("term") * i / 3)
    parts = F.array(*(F.struct(cut(i).alias("start"), F.substring("term", (cut(i) + 1).cast("int"), (cut(i + 1) - cut(i)).cast("int")).alias("piece")) for i in range(3)))
    cuts = terms.select(*on, "term", F.inline(parts))
    sizes = F.sequence(F.lit(2), (F.floor((F.length("lemma") + 2) / 3) + 1).cast("int"))  # of a term two letters longer
    spots = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("lemma") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring("lemma", i, n).alias("piece")))))
    met = words.select(*on, "lemma", F.inline(spots)).join(cuts, [*on, "piece"])
    return met.where((F.abs(F.col("at") - 1 - F.col("start")) <= 2) & (F.abs(F.length("lemma") - F.length("term")) <= 2)).select(*on, "lemma", "term").distinct()


def near_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(lemma, term): the first term, by alphabet, within two edits of a word of seven letters or more (the term having six
    or more), or within one of a word of six (the term having six); words that are terms themselves have no row (JN20, LX9).

    words(lemma), terms(term); nulls never meet.
    """
    w = words.select("lemma").where("length(lemma) >= 6").distinct().join(terms.select(F.col("term").alias("lemma")).distinct(), "lemma", "left_anti")
    met = _near_pairs(w, terms.select("term").where("length(term) >= 6").distinct(), [])
    close = ((F.length("lemma") >= 7) & (F.levenshtein("lemma", "term", 2) >= 0)) | ((F.length("lemma") == 6) & (F.length("term") == 6) & (F.levenshtein("lemma", "term", 1) >= 0))
    return met.where(close).groupBy("lemma").agg(F.min("term").alias("term"))
