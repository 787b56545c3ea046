"""Event operators in batch: debounce, dwell and last-action state. versemill.streaming has the same over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gap(rows: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    following = F.lead(at).over(Window.partitionBy(by).orderBy(at, tie))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.where(F.col(at).isNotNull() & F.col(by).isNotNull()).withColumn("gap_us", micros(following) - micros(F.col(at)))


def debounced(rows: DataFrame, by: str, at: str, tie: str, quiet_us: int) -> DataFrame:
    """Rows followed by a quiet time of at least quiet_us, or by nothing (RX3, RX4). Null times or keys are left out."""
    return _gap(rows, by, at, tie).where(F.col("gap_us").isNull() | (F.col("gap_us") >= quiet_us)).drop("gap_us")


def dwelt(rows: DataFrame, by: str, at: str, tie: str, least_us: int) -> DataFrame:
    """Rows after which the next one comes no sooner than least_us (RX6); a last row has no next one and counts."""
    return debounced(rows, by, at, tie, least_us)


def toggled_state(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Each key's state after all toggles, on after an odd number of distinct ones, and the time of the last (RX7)."""
    return rows.groupBy(*keys).agg((F.count_distinct(tie) % 2 == 1).alias("marked"), F.max(at).alias("last_at"))
