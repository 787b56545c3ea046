"""Sequence operators: gaps, neighbours, packs, spans, inheritance and round robin, all as windows without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguity(units: DataFrame, section: str, number: str) -> DataFrame:
    """(section, units, least, most, gaps) of sections whose distinct numbers are not just 1..N (WN2)."""
    each = units.groupBy(section).agg(F.count_distinct(number).alias("units"), F.min(number).alias("least"), F.max(number).alias("most"))
    return each.where("least <> 1 or most <> units").withColumn("gaps", (F.col("most") - F.col("units")).cast("bigint"))


def ranked_units(units: DataFrame) -> DataFrame:
    """(ch, n, id, spot): each distinct unit's 1-based spot in the text's order. A sum over the sections before it and a
    number within the section, so that no window spans the whole text."""
    one = units.groupBy("ch", "n").agg(F.min("id").alias("id"))
    sizes = one.groupBy("ch").agg(F.count("*").alias("size"))
    starts = sizes.select("ch", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("ch")) - F.col("size")).alias("start"))  # a row a section
    inside = F.row_number().over(Window.partitionBy("ch").orderBy("n"))
    return one.join(starts, "ch").select("ch", "n", "id", (F.col("start") + inside).cast("bigint").alias("spot"))


def first_unread(units: DataFrame, reads: DataFrame) -> DataFrame:
    """(reader_id, next_id) of every reader: the first unit not read, null when all are (WN3).

    A reader's spots in order equal their row numbers as long as nothing is missing: the number of such rows is the length
    of the unbroken beginning, and the next spot is the gap. One window by reader; no reader meets all units.
    """
    spots = ranked_units(units)
    readers = reads.where("reader_id is not null").select("reader_id").distinct()
    mine = reads.where("reader_id is not null").select("reader_id", "id").distinct().join(spots, "id").select("reader_id", "spot")
    mine = mine.withColumn("k", F.row_number().over(Window.partitionBy("reader_id").orderBy("spot")))
    begun = mine.where("k = spot").groupBy("reader_id").agg(F.max("spot").alias("upto"))
    at = readers.join(begun, "reader_id", "left").select("reader_id", (F.coalesce("upto", F.lit(0)) + 1).alias("spot"))
    return at.join(spots.select("spot", F.col("id").alias("next_id")), "spot", "left").select("reader_id", "next_id")


def neighbours(units: DataFrame) -> DataFrame:
    """(id, previous, following) within the section, null at its edges (WN4)."""
    w = Window.partitionBy("ch").orderBy("n")
    return units.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("following"))


def packs(units: DataFrame, size: int = 10) -> DataFrame:
    """(ch, n, id, pack, pack_id): packs of a fixed size in each section, the last one shorter (WN5, FN-S15)."""
    pack = (F.floor((F.row_number().over(Window.partitionBy("ch").orderBy("n")) - 1) / size) + 1).cast("int")
    return units.select("ch", "n", "id", pack.alias("pack")).withColumn("pack_id", F.format_string("ch%02d-%d", "ch", "pack"))


def spans(anchors: DataFrame, section: str, at: str, end: Column) -> DataFrame:
    """Anchors with the half-open span up to the section's next anchor, or `end` after the last (WN6, JN18)."""
    return anchors.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(section).orderBy(at)), end))


def inherited(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Unknown values filled where the nearest known ones before and after agree; the first row has none before it (WN7)."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("filled", F.coalesce(F.col(value), F.when(before == after, before)))


def unit_of_day(days: DataFrame, sections: DataFrame) -> DataFrame:
    """(day, id): round robin over the sections in order, then over a section's units (WN12, FN-M2). sections: ch, total > 0."""
    ordered = sections.where("total > 0").select("ch", "total", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ch")) - 1).alias("turn"))
    count = ordered.agg(F.count("*").alias("c")).first()["c"]
    if not count:
        return days.select("day", F.lit(None).cast("string").alias("id"))
    at = days.select("day", F.pmod(F.col("day") - 1, F.lit(count)).cast("int").alias("turn"), F.floor((F.col("day") - 1) / count).cast("int").alias("round"))
    unit = F.pmod(F.col("round"), F.col("total")) + 1
    return at.join(ordered, "turn").select("day", F.concat_ws(":", "ch", unit).alias("id"))
