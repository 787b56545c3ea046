"""Reading level of each document (problem 5): smoothed unigram language models, one for each level."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from versemill.runtime import small, stored

#: Levels of the scale, weight of the smoothing towards all words (in pseudo-counts a word), and rounds over unlabelled texts.
LEVELS, SMOOTHING, ROUNDS = (1, 2, 3, 4, 5), 0.5, 2


def _words(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(doc, word, n): words of the texts taken together, in lower case, without markup and entities."""
    text = F.lower(F.concat_ws(" \n ", *(df[c] for c in text_cols)))
    text = F.regexp_replace(text, r"<[^>]*>|&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);", " ")
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))
    return df.select(df[id_col].cast("long").alias("doc"), F.explode(words).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


def _model(words: DataFrame, weights: DataFrame) -> tuple[DataFrame, list[float]]:
    """(word, s1..s5) log probabilities of each word that the weighted texts hold, and the levels' log priors."""
    weight = {k: F.col("w")[i] for i, k in enumerate(LEVELS)}
    sums = [F.sum(F.col("n") * weight[k]).alias(f"c{k}") for k in LEVELS]
    counts = stored(words.join(weights, "doc").groupBy("word").agg(*sums))
    total: Row = counts.agg(F.count("*").alias("v"), *(F.sum(f"c{k}").alias(f"t{k}") for k in LEVELS)).first()
    prior: Row = weights.agg(*(F.sum(weight[k]).alias(f"p{k}") for k in LEVELS)).first()
    v, mass = total["v"] or 1, sum(total[f"t{k}"] or 0.0 for k in LEVELS) or 1.0
    share = sum(F.col(f"c{k}") for k in LEVELS) / F.lit(mass) * F.lit(SMOOTHING * v)
    scores = [F.log((F.col(f"c{k}") + share) / F.lit((total[f"t{k}"] or 0.0) + SMOOTHING * v)).alias(f"s{k}") for k in LEVELS]
    docs = sum(prior[f"p{k}"] or 0.0 for k in LEVELS)
    return counts.where(" + ".join(f"c{k}" for k in LEVELS) + " > 0").select("word", *scores), [math.log(((prior[f"p{k}"] or 0.0) + 1) / (docs + len(LEVELS))) for k in LEVELS]


def _posterior(docs: DataFrame, words: DataFrame, model: tuple[DataFrame, list[float]]) -> DataFrame:
    """(doc, w): the levels' posterior probabilities of each text as an array; the priors where no word is known.

    The scores are one array and each step one column, so that no expression is written out more than once in the code.
    """
    table, priors = model
    sums = words.join(small(table), "word").groupBy("doc").agg(*(F.sum(F.col("n") * F.col(f"s{k}")).alias(f"s{k}") for k in LEVELS))
    scored = docs.join(sums, "doc", "left").select("doc", F.array(*(F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(p) for k, p in zip(LEVELS, priors))).alias("s"))
    odds = scored.select("doc", F.transform(F.arrays_zip("s", F.array_repeat(F.array_max("s"), len(LEVELS)).alias("top")), lambda x: F.exp(x["s"] - x["top"])).alias("o"))
    whole = F.aggregate("o", F.lit(0.0), lambda a, b: a + b)
    return odds.select("doc", F.transform(F.arrays_zip("o", F.array_repeat(whole, len(LEVELS)).alias("sum")), lambda x: x["o"] / x["sum"]).alias("w"))


def reading_levels(docs: DataFrame, labels: DataFrame, id_col: str = "draft_id", text_cols: tuple[str, ...] = ("meaning_simple", "takeaway"), level_col: str = "reading_level") -> DataFrame:
    """(doc_id, level, confidence, words) of each record whose first text is not null or blank.

    A unigram model for each level, smoothed towards the words of all levels, is trained on the labelled texts and then,
    ROUNDS times, on all texts weighted by their posterior (labelled ones keep their label), so that words the labels
    never show are learnt too. The level is the one of highest posterior, the lower one of equals; confidence is that
    posterior. Counts cover all records; only word tables of measured size are broadcast. Labels out of the scale, null or
    without a record are ignored, the lower of two labels of one record holds; without any label all levels are as likely.
    A repeated id is one record with all its words.
    """
    full = docs.where(F.length(F.regexp_replace(F.coalesce(docs[text_cols[0]], F.lit("")), r"[\s\p{Z}\p{Cf}]+", "")) > 0)
    words = stored(_words(full, id_col, list(text_cols)))
    ids = stored(full.select(full[id_col].cast("long").alias("doc")).where("doc is not null").distinct())
    known = labels.where(labels[level_col].isin(*LEVELS)).groupBy(labels[id_col].cast("long").alias("doc")).agg(F.min(level_col).alias("level")).join(ids, "doc", "left_semi")
    known = stored(known.select("doc", F.array(*((F.col("level") == k).cast("double") for k in LEVELS)).alias("w")))
    weights = known
    for _ in range(ROUNDS):
        guess = _posterior(ids.join(known, "doc", "left_anti"), words, _model(words, weights))
        weights = stored(known.unionByName(guess))
    final = _posterior(ids, words, _model(words, weights))
    best = F.array_max("w")
    level = F.element_at(F.lit(list(LEVELS)), F.array_position("w", best).cast("int"))
    sizes = words.groupBy("doc").agg(F.sum("n").alias("words"))
    return final.join(sizes, "doc", "left").select(F.col("doc").alias("doc_id"), level.alias("level"), best.alias("confidence"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
