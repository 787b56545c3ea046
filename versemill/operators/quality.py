"""Data-quality rules: each gives violations (id, check, detail); a gate lets a write pass only without any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions.cleaning import grade, is_blank


def violations(rows: DataFrame, key: Column, check: str, broken: Column, detail: Column) -> DataFrame:
    """The rows that break a rule; a rule that is null for a row is not broken."""
    return rows.where(broken).select(key.cast("string").alias("id"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def report(parts: list[DataFrame]) -> DataFrame:
    """All rules' violations together."""
    return reduce(DataFrame.unionByName, parts)


def draft_rules(drafts: DataFrame, cap: float = 8.0) -> list[DataFrame]:
    """DQ1-DQ4: approval, blank fields, grade and provenance of approved drafts."""
    key = F.col("draft_id")
    approved = F.col("status") == "approved"
    ok = drafts.where(approved)
    value = grade(F.col("meaning_simple"))
    return [
        violations(drafts, key, "approved", ~F.coalesce(approved, F.lit(False)), F.coalesce("status", F.lit("none"))),
        *(violations(ok, key, f"blank-{c}", is_blank(F.col(c)), F.lit(c)) for c in ("meaning_simple", "takeaway")),
        violations(ok, key, "grade", value > cap, F.floor(value)),
        violations(ok, key, "provenance", F.coalesce(F.size("provenance"), F.lit(0)) < 1, F.lit("none")),
    ]


# fixed values: runs of letters and marks; and those, of white space, and of all else
_LETTERS = r"[\p{L}\p{M}]+"
_RUNS = _LETTERS + r"|\s+|[^\p{L}\p{M}\s]+"


def _pieces(word: Column, n: int) -> Column:
    """All runs of n letters of a word; the word itself if shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))


def glossary_leaks(texts: DataFrame, key: str, text: str, glossary: DataFrame) -> DataFrame:
    """(id, term, rendering): a text holds a term without that rendering (LX14, DQ5), found as parts of words.

    The corpus's distinct words are cut into pieces of the terms' lengths and joined with the terms on equality; texts meet
    the terms through the words they hold, and only the texts that do are read for the term and the rendering. A term that
    is no one run of letters meets through the longest run in it; where a term has no letter, runs of white space and of
    other signs count as words too. No term meets all texts. Null texts and terms give no rows.
    """
    terms = glossary.where("term is not null and rendering is not null and term not like '\\\\_%'").select(F.lower("term").alias("term"), F.lower("rendering").alias("rendering")).distinct()
    runs = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    longest = lambda x: F.coalesce(F.array_max(F.transform(x, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))
    letter = F.col("term").rlike(_LETTERS)
    terms = terms.select("term", "rendering", letter.alias("letter"), F.when(letter, longest(runs(F.col("term"), _LETTERS))).otherwise(longest(runs(F.col("term"), _RUNS))).alias("run"))
    sizes = [(r.n, r.letter) for r in terms.select(F.length("run").alias("n"), "letter").distinct().collect()]  # lengths of words: a few dozen
    pattern = _LETTERS if all(lettered for _, lettered in sizes) else _RUNS
    low = F.lower(F.col(text))
    words = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array_distinct(runs(low, pattern))).alias("word"))
    pieces = F.flatten(F.array(*(_pieces(F.col("word"), n) for n in sorted({n for n, _ in sizes})))) if sizes else F.array(F.col("word"))
    holding = words.select("word").distinct().select("word", F.explode(F.array_distinct(pieces)).alias("run")).join(terms, "run")
    met = words.join(holding, "word").select("id", "term", "rendering").distinct()
    return texts.select(F.col(key).alias("id"), low.alias("low")).join(met, "id").where(F.contains("low", "term") & ~F.contains("low", "rendering")).select("id", "term", "rendering").distinct()


def gate(found: DataFrame) -> bool:
    """Whether there is no violation (one action)."""
    return found.isEmpty()
