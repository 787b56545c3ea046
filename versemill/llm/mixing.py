"""Mixing sources to target weights (problem 7): hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.runtime import kept_in_worker, small, stored

#: Records in one range of a source's random order: the most that one task sums up.
RANGE_ROWS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _trimmed(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def token_counts(docs: DataFrame, id_col: str, group_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens) of every row, whole texts; source in lower case without outer spaces. One narrow pass."""

    def loaded():
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = kept_in_worker(("tokenizer", tokenizer), loaded)  # the file is read once by each worker, not by each task
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf.doc, "source": pdf.source, "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf.text]})

    return docs.select(docs[id_col].cast("long").alias("doc"), _trimmed(docs[group_col]).alias("source"), docs[text_col].alias("text")).mapInPandas(count, "doc long, source string, tokens long")


def _targets(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats) of each source with a positive share; a repeated source counts with its shares' sum and least cap."""
    source = _trimmed(targets["source"])
    good = targets.select(source.alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null and share > 0")
    return good.groupBy("source").agg(F.sum("share").alias("share"), F.greatest(F.min("max_repeats"), F.lit(0)).alias("max_repeats"))


def _plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """A row for each target source: what is there, its budget, whole epochs and the rest of the last one."""
    there = counted.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available"))
    plan = _targets(targets).join(there, "source", "left").withColumns({"records": F.coalesce("records", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        reachable = plan.where(most > 0).agg(F.min(most / F.col("share"))).first()[0]
        total_tokens = int(reachable or 0)
    budget = F.floor(F.lit(float(total_tokens)) * F.col("share") + F.lit(1e-6)).cast("long")
    plan = plan.withColumn("budget", budget).withColumn("fill", F.least("budget", most))
    epochs = F.coalesce(F.expr("cast(try_divide(fill, available) as bigint)"), F.lit(0))
    return plan.withColumn("epochs", epochs).withColumn("rest", F.col("fill") - F.col("epochs") * F.col("available"))


def char_counts(docs: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """(doc, source, tokens) with characters for tokens: a size that needs no tokenizer."""
    return docs.select(docs[id_col].cast("long").alias("doc"), _trimmed(docs[group_col]).alias("source"), F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("long").alias("tokens"))


def _order(seed: int) -> Column:
    """A record's seeded random key: 32 hexadecimal digits, of which the first 13 are also its place between 0 and 1."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string")))


def mixed(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, uses) of all records used at least once; and the report of shares by source.

    Each source gets target_share of total_tokens; by default of the largest total at which every target source that has
    tokens can fill its share within max_repeats. Its records stand in the order of a seeded hash; the order is cut into
    ranges, token sums of the ranges give each range's start, and a running sum within it each record's place. A source is
    used whole as often as its budget holds, and the next time up to the last record that still fits. A given total that
    a source cannot fill within max_repeats leaves that source at its most; the report shows it. Sources without target,
    null sources and texts without tokens take no part (uses 0); a target source without records reports zeros. Every row
    is a record of its own, also with a repeated id. Without a tokenizer sizes are characters.
    """
    sizes = token_counts(docs, id_col, source_col, text_col, tokenizer) if tokenizer else char_counts(docs, id_col, source_col, text_col)
    counted = stored(sizes.where("tokens > 0"))
    plan = stored(_plan(counted, targets, total_tokens))
    ranked = counted.join(small(plan.select("source", "records", "epochs", "rest", "max_repeats")), "source")
    key = _order(seed)
    spot = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    ranked = ranked.withColumns({"key": key, "part": F.floor(spot * F.ceil(F.col("records") / RANGE_ROWS)).cast("long")})
    starts = ranked.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.join(starts, ["source", "part"]).withColumn("upto", F.col("start") + F.sum("tokens").over(inside))
    uses = F.least(F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int"), F.col("max_repeats")).cast("int")
    chosen = placed.select(F.col("doc").alias("doc_id"), "source", "tokens", uses.alias("uses")).where("uses > 0")
    used = chosen.groupBy("source").agg(F.count("*").alias("records_used"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    report = plan.join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("records_used", "used_tokens", "most_uses")})
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row for each target source
    report = report.select("source", F.col("share").alias("target_share"), F.coalesce(F.try_divide(F.col("used_tokens"), whole), F.lit(0.0)).alias("actual_share"), "budget", "used_tokens", "available", "records", "records_used", "most_uses", "max_repeats")
    return chosen, report
