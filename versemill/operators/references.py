"""References to records that do not exist: missing, deleted or not yet there at the record's time (problem 2)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key gets one more salt for each this many child rows; raised so that at most HOT_KEYS keys can be hot.
ROWS_PER_SALT = 200_000
HOT_KEYS = 256

_DIGITS = [chr(c) for c in range(0x80, 0x10000) if unicodedata.decimal(chr(c), None) is not None]  # as the SQL has them
_ALL_DIGITS = _DIGITS + [chr(c) for c in range(0x10000, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]


def same_key(raw: Column) -> Column:
    """Key under which two spellings of an id "a:b" are equal.

    Spaces, invisible format characters, leading zeros, the script or width of digits and the sign between the numbers
    make no difference. A text of any other shape is its own key (without spaces). Null or blank gives null.
    """
    plain = F.translate(raw, "".join(_ALL_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _ALL_DIGITS))
    plain = F.regexp_replace(plain, r"[\s\p{Z}\p{Cf}\p{Cc}]+", "")
    two = r"^0*([0-9]+)[^\p{L}\p{N}]+0*([0-9]+)$"
    parts = F.concat_ws(":", F.regexp_extract(plain, two, 1), F.regexp_extract(plain, two, 2))
    return F.when(plain == "", None).when(plain.rlike(two), parts).otherwise(F.concat(F.lit("="), plain))


def orphan_references(children: dict[str, tuple[DataFrame, str, str, str]], parents: DataFrame, key: str = "id", start: str = "added_at", end: str = "deleted_at") -> DataFrame:
    """Rows (tab, ref_id, ref, at) of references to a parent that was not there at the record's time.

    children maps a table's name to (frame, id column, reference column, time column). A parent is there from `start` up
    to, not including, `end`; null start: since ever, null end: still; an interval that ends before it starts counts as
    none. Overlapping or repeated parent rows count once for each moment. With a null time only a key that no parent ever
    had is an orphan. Null or blank references are none. Rows delivered twice give one row. Other columns are ignored, so
    extra or clashing ones do no harm; empty tables give no rows (empty parents: every reference).

    Tagged parent and child keys are united in long form and grouped by key. Within a key, in order of time, a running sum
    of parent starts and ends is the parent flag that each child row sees; rows without it are kept. Hot keys are split
    over salts after a count by key, and the parents' few events are repeated for each salt of a hot key only.
    """
    kids = None
    for name, (df, id_col, ref_col, time_col) in children.items():
        one = df.select(F.lit(name).alias("tab"), df[id_col].cast("long").alias("ref_id"), df[ref_col].alias("ref"), df[time_col].cast("timestamp_ntz").alias("at"))
        kids = one if kids is None else kids.unionByName(one)
    kids = kids.withColumn("k", same_key(F.col("ref"))).where("k is not null")

    counts = kids.groupBy("k").count()
    floor = max(ROWS_PER_SALT, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_KEYS)
    hot = counts.where(F.col("count") > floor).select(F.col("k").alias("hot_k"), F.ceil(F.col("count") / floor).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # at most HOT_KEYS rows by the choice of floor

    spans = parents.select(same_key(parents[key]).alias("k"), parents[start].cast("timestamp_ntz").alias("s"), parents[end].cast("timestamp_ntz").alias("e"))
    spans = spans.where("k is not null and (s is null or e is null or s < e)").distinct()
    since_ever = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    begin = spans.select("k", F.coalesce("s", since_ever).alias("at"), F.lit(1).alias("delta"))
    finish = spans.where("e is not null").select("k", F.col("e").alias("at"), F.lit(-1).alias("delta"))
    events = begin.unionByName(finish).join(hot, F.col("k") == F.col("hot_k"), "left")
    events = events.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    events = events.select("k", "salt", "at", "delta", F.lit(True).alias("parent"), F.lit(None).cast("string").alias("tab"), F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("string").alias("ref"))

    tagged = kids.join(hot, F.col("k") == F.col("hot_k"), "left")
    tagged = tagged.withColumn("salt", F.pmod(F.xxhash64("tab", "ref_id", "ref"), F.coalesce("salts", F.lit(1))).cast("int"))
    tagged = tagged.select("k", "salt", "at", F.lit(0).alias("delta"), F.lit(False).alias("parent"), "tab", "ref_id", "ref")

    # a row without time comes last and so sees every parent of its key; an end at a child's very time comes before it
    seen = Window.partitionBy("k", "salt").orderBy(F.col("at").asc_nulls_last(), F.col("parent").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = events.unionByName(tagged).withColumns({"there": F.sum("delta").over(seen), "ever": F.max("parent").over(seen)})
    orphan = F.when(F.col("at").isNull(), ~F.col("ever")).otherwise(F.col("there") <= 0)
    return flagged.where(~F.col("parent") & orphan).select("tab", "ref_id", "ref", "at").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period (tab, period, orphans, keys): period is the month of the record's time, 'unknown' without one.

    Sums counts by table, period and reference first, so that a hot reference is one row before the second shuffle.
    """
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    each = orphans.select("tab", period.alias("period"), same_key(F.col("ref")).alias("k")).groupBy("tab", "period", "k").agg(F.count("*").alias("n"))
    return each.groupBy("tab", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("keys"))
