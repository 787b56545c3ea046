"""Long exact spans shared between records (problem 8): repeated-phrase automata over winnowed passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm.fingerprints import winnow
from versemill.runtime import stored

#: Shortest shared span, and length of a phrase; a phrase is kept in each run of SPAN - PHRASE + 1, so that no span is without one.
SPAN, PHRASE = 240, 200
#: What a phrase lacks to a span: so many characters before and after an occurrence decide with whom it is shared.
REST = SPAN - PHRASE
#: Characters of a phrase that go into an automaton (the rest is compared where they occur), and records for each automaton.
STEM, SHARD_ROWS = 48, 100
#: Holders of a passage that one task pairs with all others.
BLOCK = 1_000


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, digest, n_chars, text); the digest stands for texts long enough to hold a span."""
    base = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).where("doc is not null")
    base = base.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    return base.select("doc", F.when(F.col("n_chars") >= SPAN, F.sha2("text", 256)).alias("digest"), "n_chars", "text")


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kept = [winnow(t, PHRASE, SPAN - PHRASE + 1) if d is not None else ([], np.empty(0, np.uint64)) for d, t in zip(pdf.digest, pdf.text)]
        yield pdf[["doc", "digest", "n_chars"]].assign(at=pd.Series([list(p) for p, _ in kept], dtype="object", index=pdf.index), print=pd.Series([list(h.view(np.int64)) for _, h in kept], dtype="object", index=pdf.index))


def _classes(prints: DataFrame) -> DataFrame:
    """(doc, digest, n_chars, rep, copies) of each record, rep being the least id with the very same text.

    Only ids, digests and lengths are shuffled; min() and count() pre-aggregate copies, so a hot class is no hot task.
    """
    one = prints.groupBy("doc").agg(F.max(F.struct("n_chars", "digest")).alias("x")).select("doc", "x.digest", "x.n_chars")
    one = one.withColumn("class", F.coalesce("digest", F.col("doc").cast("string")))
    reps = one.groupBy("class").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    return stored(one.join(reps, "class").select("doc", "digest", "n_chars", "rep", "copies"))


def _occurrences(docs: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
    """One shard: its phrases as an automaton, its records streamed through it.

    (rep, start, stop, print, left, right): where a phrase stands, with up to REST characters around it; neighbouring places
    of the same phrase with the same surroundings are one interval.
    """
    import ahocorasick

    by_stem: dict[str, set[tuple[str, int]]] = {}
    for phrase, mark in zip(phrases.phrase, phrases["print"]):
        by_stem.setdefault(phrase[:STEM], set()).add((phrase, mark))
    rows: list[tuple[int, int, int, int, str, str]] = []
    if by_stem:
        automaton = ahocorasick.Automaton()
        for stem, full in by_stem.items():
            automaton.add_word(stem, sorted(full))
        automaton.make_automaton()
        for rep, text in zip(docs.rep, docs.text):
            if len(text) < SPAN:
                continue
            open_: dict[tuple[int, str, str], list[int]] = {}
            for end, full in automaton.iter(text):
                start = end - STEM + 1
                for phrase, mark in full:
                    if text.startswith(phrase, start):
                        key = (mark, text[max(0, start - REST) : start], text[start + PHRASE : start + SPAN])
                        run = open_.get(key)
                        if run is not None and run[1] == start - 1:
                            run[1] = start
                        else:
                            if run is not None:
                                rows.append((rep, *run, *key))
                            open_[key] = [start, start]
            rows.extend((rep, *run, *key) for key, run in open_.items())
    out = pd.DataFrame(rows, columns=["rep", "start", "stop", "print", "left", "right"])
    return out.astype({"rep": "int64", "start": "int64", "stop": "int64", "print": "int64", "left": "object", "right": "object"})


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The classes; and (rep, start, stop, print, left, right): every occurrence of a phrase that two classes keep.

    One narrow pass over the texts makes the prints. After that only texts that hold a recurring print move, once: by the
    guarantee of winnowing no other text has a span in common with any.
    """
    base = _base(docs, id_col, text_col)
    rows = stored(base.mapInPandas(_prints, "doc long, digest string, n_chars int, at array<int>, print array<bigint>"))
    members = _classes(rows)
    reps = members.where("doc = rep and digest is not null").select("doc", "digest")
    prints = rows.where("digest is not null").join(reps, ["doc", "digest"], "left_semi").select(F.col("doc").alias("rep"), "digest", F.inline(F.arrays_zip("at", "print")))
    prints = stored(prints)
    recurring = prints.groupBy("print").agg(F.min(F.struct("rep", "at")).alias("first"), F.max("rep").alias("last"))
    recurring = stored(recurring.where("first.rep < last").select("print", "first"))
    held = stored(prints.join(recurring.select("print"), "print").select("rep", "digest", "print").distinct())
    holders = stored(held.select("rep", "digest").distinct())
    texts = base.where("digest is not null").withColumnRenamed("doc", "rep").join(holders, ["rep", "digest"], "left_semi").select("rep", "text")
    texts = stored(texts.dropDuplicates(["rep"]))
    confirmed = recurring.select("print", F.col("first.rep").alias("rep"), (F.col("first.at") + 1).cast("int").alias("at")).join(texts, "rep")
    confirmed = confirmed.select("print", F.substring("text", F.col("at"), F.lit(PHRASE)).alias("phrase"))
    shards = max(1, holders.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")
    wanted = held.select(shard.alias("shard"), "print").distinct().join(confirmed, "print").select("shard", "print", "phrase")
    routed = texts.select(shard.alias("shard"), "rep", "text")
    schema = "rep long, start long, stop long, print long, left string, right string"
    return members, stored(routed.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(_occurrences, schema))


def _spans(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which occurrences are part of a shared span, and with whom.

    Occurrences of a phrase with the same surroundings are one neighbourhood. A phrase with a single neighbourhood is shared
    by all its holders. Else the neighbourhoods meet on equal text: a span that begins o characters before the phrase needs
    the last o characters before and the first REST - o after it to be the same; o has REST + 1 values, whatever the number
    of holders. Returns (print, left, right, most, least): the spans' begins before the phrase; and (print, o, before, after,
    left, right): the neighbourhoods of each span, one of the spans with the same neighbourhoods.
    """
    hood = ["print", "left", "right"]
    hoods = found.groupBy(*hood).agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
    sizes = hoods.groupBy("print").agg(F.count("*").alias("hoods"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    hoods = hoods.join(sizes.select("print", "hoods"), "print")
    hoods = stored(hoods.withColumns({"least": F.greatest(F.lit(0), REST - F.length("right")), "most": F.least(F.lit(REST), F.length("left"))}).where("least <= most"))
    alone = hoods.where("hoods = 1 and first < last")
    each = hoods.where("hoods > 1").select(*hood, "first", "last", F.explode(F.sequence("least", "most")).alias("o"))
    after = F.substring("right", F.lit(1), REST - F.col("o"))
    before = F.substring("left", F.length("left") - F.col("o") + 1, F.col("o"))
    each = each.select(*hood, "first", "last", "o", before.alias("before"), after.alias("after"))
    span = ["print", "o", "before", "after"]
    sign = F.sum(F.xxhash64("left", "right").cast("decimal(20,0)"))
    met = each.groupBy(*span).agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("n"), sign.alias("sign")).where("lo < hi")
    met = stored(met.drop("lo", "hi"))
    shared = each.select(*hood, *span[1:]).join(met.select(*span), span)
    bounds = alone.select(*hood, "most", "least").unionByName(shared.groupBy(*hood).agg(F.max("o").alias("most"), F.min("o").alias("least")))
    one = met.groupBy("print", "n", "sign").agg(F.min(F.struct("o", "before", "after")).alias("s")).select("print", "s.o", "s.before", "s.after")
    groups = each.select(*hood, *span[1:]).join(one, span).unionByName(alone.select(*hood, F.lit(-1).alias("o"), F.lit("").alias("before"), F.lit("").alias("after")))
    return bounds, groups


def _passages(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(passage, rep, holders): the holders of each set of classes that share a span; a set with several spans is one passage.

    A passage all of whose holders have the same other one as their widest adds nothing to it and is left out.
    """
    rows = found.select("rep", "print", "left", "right").distinct().join(groups, ["print", "left", "right"])
    rows = stored(rows.select(F.md5(F.concat_ws("\0", F.col("print").cast("string"), F.col("o").cast("string"), "before", "after")).alias("passage"), "rep").distinct())
    mark = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(20,0)"))
    sets = rows.groupBy("passage").agg(F.count("*").alias("holders"), mark(1).alias("one"), mark(2).alias("two")).where("holders > 1")
    kept = sets.groupBy("holders", "one", "two").agg(F.min("passage").alias("passage")).select("passage", "holders")
    rows = stored(rows.join(kept, "passage").select("passage", "rep", "holders"))
    widest = rows.groupBy("rep").agg(F.max(F.struct("holders", "passage"))["passage"].alias("widest"))
    inside = rows.join(widest, "rep").groupBy("passage").agg(F.min("widest").alias("lo"), F.max("widest").alias("hi")).where("lo <> hi or lo = passage")
    return stored(rows.join(inside.select("passage"), "passage"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, a <> b) of the holders (passage, a) and all holders (passage, rep, holders) of their passages, not distinct.

    A passage of many holders is split: each block of BLOCK of the left ones meets all the others in a task of its own.
    """
    blocks = F.ceil(F.col("holders") / BLOCK).cast("int")
    one = left.select("passage", "a", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("block"))
    two = right.select("passage", F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return one.join(two, ["passage", "block"]).where("a <> b").select("passage", "a", "b")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(passage, class_id, holders): which texts share spans of SPAN or more, without pairs: one row for each passage and text.

    Two different texts have a span in common if and only if they hold a passage together; a formula in n records is n
    rows. Copies stand as their class, the least id with that text (shared_portions has the class of every record).
    """
    _, found = _found(docs, id_col, text_col)
    return _passages(found, _spans(found)[1]).select("passage", F.col("rep").alias("class_id"), "holders")


def _linked(passages: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: classes that share a span."""
    return _met(passages.select("passage", F.col("rep").alias("a"), "holders"), passages).where("a < b").select("a", "b").distinct()


def shared_span_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (class_a, class_b), class_a < class_b, of different texts with a span in common, each text once."""
    _, found = _found(docs, id_col, text_col)
    return _linked(_passages(found, _spans(found)[1])).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def shared_span_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_a, doc_b), doc_a < doc_b, whose texts have at least SPAN consecutive code points in common.

    Records with the very same text form a class, of which one is compared. Of each run of SPAN - PHRASE + 1 phrases the
    one of least hash is kept, so any shared span holds a kept phrase. Phrases that two classes keep are confirmed as text
    and compiled into one automaton for each shard of records; every record that holds one streams through its shard's
    automaton, which yields each occurrence with what surrounds it. Occurrences meet on equal surroundings, compared as text;
    members take the place of their class at the end. This is the expansion of shared_passages and of the classes: it has
    as many rows as pairs exist.

    Null, empty and shorter texts are in no pair. A repeated id counts once (its longest text). Empty tables give no rows.
    """
    members, found = _found(docs, id_col, text_col)
    reps = _linked(_passages(found, _spans(found)[1]))
    one, two = members.select(F.col("doc").alias("x"), F.col("rep").alias("a")), members.select(F.col("doc").alias("y"), F.col("rep").alias("b"))
    across = reps.join(one, "a").join(two, "b").select("x", "y")
    many = members.where(f"copies > 1 and n_chars >= {SPAN}").select(F.col("rep").alias("passage"), F.col("doc").alias("rep"), F.col("copies").alias("holders"))
    within = _met(many.select("passage", F.col("rep").alias("a"), "holders"), many).where("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_portions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each record: (doc_id, class_id, copies, n_chars, shared_chars, shared_share, linked_classes).

    shared_chars counts characters that lie in a span of at least SPAN that another record holds too; with another copy
    of the whole text (of SPAN or more) all of it is shared. linked_classes counts the other texts it shares a span with:
    copies are not expanded, and neither is a text's widest passage, whose holders are counted. Null and empty texts have no
    characters and a share of 0.
    """
    members, found = _found(docs, id_col, text_col)
    bounds, groups = _spans(found)
    ranges = found.join(bounds, ["print", "left", "right"]).select("rep", (F.col("start") - F.col("most")).alias("from"), (F.col("stop") - F.col("least") + SPAN).alias("to"))
    order = Window.partitionBy("rep").orderBy("from", "to")
    upto = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = ranges.withColumn("gain", F.greatest(F.lit(0), F.col("to") - F.greatest("from", upto))).groupBy("rep").agg(F.sum("gain").alias("covered"))
    passages = _passages(found, groups)
    widest = passages.groupBy("rep").agg(F.max(F.struct("holders", "passage")).alias("w")).select("rep", "w.holders", F.col("w.passage").alias("widest"))
    others = passages.join(widest.select("rep", "widest"), "rep").where("passage <> widest").select("passage", F.col("rep").alias("a"), "holders", "widest")
    met = _met(others, passages).select("a", "b").distinct().join(widest.select(F.col("rep").alias("a"), "widest"), "a")
    met = met.join(passages.select(F.col("passage").alias("widest"), F.col("rep").alias("b")), ["widest", "b"], "left_anti").groupBy("a").agg(F.count("*").alias("more"))
    links = widest.join(met.withColumnRenamed("a", "rep"), "rep", "left").select("rep", (F.col("holders") - 1 + F.coalesce("more", F.lit(0))).alias("linked"))
    out = members.join(covered, "rep", "left").join(links, "rep", "left")
    shared = F.when((F.col("copies") > 1) & (F.col("n_chars") >= SPAN), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "copies", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"),
        F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("shared_share"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked_classes"),
    )
