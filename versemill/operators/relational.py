"""Relational operators over units, sections and user records: listings, flags, bridges, merges and counts.

All are plain DataFrame operations. Ties are always broken by a key so that results repeat. Null keys never match; empty
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_units(verses: DataFrame, key: str = "id") -> DataFrame:
    """One row for each unit still in the text (no end time): the latest start, then the least row_id (SNK7)."""
    order = F.struct(F.col("added_at"), -F.col("row_id"))
    rest = [c for c in verses.columns if c != key]
    latest = verses.where("deleted_at is null").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_u"))
    return latest.select(key, "_u.*").select(verses.columns)


def fraction(part: Column, whole: Column) -> Column:
    """part of whole, clamped to 0..1; 0 where the whole is not positive (FN-M1)."""
    inside = F.least(F.greatest(part, F.lit(0)), whole)
    return F.when(whole <= 0, F.lit(0.0)).otherwise(inside.cast("double") / whole)


def first_write_wins(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The earliest row of each key, as insert-or-ignore keeps it (SNK8). Rows with a null time come last."""
    return _one(rows, keys, F.min_by, F.struct(F.col(at).isNull(), at, tie))


def last_write_wins(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key, as insert-or-replace keeps it (SNK7). Rows with a null time come first."""
    return _one(rows, keys, F.max_by, F.struct(F.col(at).isNotNull(), at, tie))


def _one(rows: DataFrame, keys: list[str], pick, order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(rows.columns)


def delete_by_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among the keys; an empty set of keys deletes nothing (SNK10). Rows with a null key stay."""
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def flagged(units: DataFrame, marks: DataFrame, on: str, name: str) -> DataFrame:
    """The units with a flag, never null, whether their key is among the marks (FLT5, JN16)."""
    seen = marks.select(F.col(on)).where(F.col(on).isNotNull()).distinct().withColumn("_m", F.lit(True))
    return units.join(seen, on, "left").withColumn(name, F.coalesce("_m", F.lit(False))).drop("_m")


def dangling(refs: DataFrame, units: DataFrame, ref: str, key: str) -> DataFrame:
    """References to keys no unit has (JN13); null references are none."""
    return refs.where(F.col(ref).isNotNull()).join(units.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def section_progress(sections: DataFrame, units: DataFrame, reads: DataFrame) -> DataFrame:
    """(ch, title, read, total, fraction) of every section, 0 where nothing is read (AG1, JN2, JN5, FN-M1).

    Reads are reduced to distinct units before the join, so repeated reads of a hot unit cost one row.
    """
    read = reads.select("id").where("id is not null").distinct().withColumn("_r", F.lit(1))
    counts = units.select("ch", "id").distinct().join(read, "id", "left").groupBy("ch").agg(F.count("_r").alias("read"), F.count("*").alias("total"))
    out = sections.join(counts, "ch", "left").withColumns({"read": F.coalesce("read", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    return out.select("ch", "title", "read", "total", fraction(F.col("read"), F.col("total")).alias("fraction"))


def reader_sections(units: DataFrame, reads: DataFrame) -> DataFrame:
    """(reader_id, ch, read, total, complete): a reader's distinct units in each section begun; complete if all are read (AG5)."""
    totals = units.select("ch", "id").distinct().groupBy("ch").agg(F.count("*").alias("total"))
    each = reads.where("reader_id is not null and id is not null").select("reader_id", "id").distinct().join(units.select("ch", "id").distinct(), "id")
    each = each.groupBy("reader_id", "ch").agg(F.count("*").alias("read"))
    return each.join(totals, "ch").select("reader_id", "ch", "read", "total", (F.col("read") == F.col("total")).alias("complete"))


def bridge(tags: DataFrame, key: str, items: str) -> DataFrame:
    """One row for each item of a tag's array with its 0-based position (WN9, FN-A1); null and empty arrays give none."""
    return tags.select(key, F.posexplode(items).alias("position", "item"))


def carried_forward(fresh: DataFrame, old: DataFrame, key: str, keep: list[str], defaults: dict[str, str]) -> DataFrame:
    """Fresh records with the kept fields of the old record of the same key, or the default without one (JN7, WN11)."""
    prior = old.select(key, *(F.col(c).alias(f"_{c}") for c in keep))
    out = fresh.join(prior, key, "left")
    return out.select(*fresh.columns, *(F.coalesce(F.col(f"_{c}"), F.lit(defaults.get(c))).alias(c) for c in keep))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    """Rows by value, null as a value of its own (AG6)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def two_way_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity, tagged by side; no rows mean equal tables (ST6)."""
    one = left.exceptAll(right).withColumn("side", F.lit("left"))
    return one.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def top_in_order(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order (SO2): a top-k plan, no full sort."""
    return rows.orderBy(*order).limit(n)


def numbered(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Rows with a 1-based number within each group (WN1)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
