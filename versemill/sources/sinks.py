"""Sinks: record files, gated exports, packs, keyed updates and idempotent seeding.

Tables are parquet folders. A rewrite goes to a new folder first and takes the old one's name when it is complete, so a
lost executor or a failed job leaves the old table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.operators.relational import delete_by_keys
from versemill.runtime import release, stored
from versemill.sources.readers import exists


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, overwritten (SNK1, SNK4)."""
    rows.write.mode("overwrite").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """The folder with these rows instead of its old ones; they may come from that very folder (SNK2, SNK9)."""
    spark = rows.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if exists(spark, path):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(fresh), hadoop(path))
    fs.delete(hadoop(old), True)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Rows take the place of those of the same key, the rest stays (SNK7); the last of equal keys in rows is arbitrary."""
    rows = rows.dropDuplicates([key])
    old = spark.read.parquet(path) if exists(spark, path) else rows.limit(0)
    replace_table(delete_by_keys(old, rows, key).unionByName(rows), path)


def upsert_buckets(spark: SparkSession, rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """The same over a table kept in folders by the key's hash: only the buckets that the rows touch are read and written (SNK7).

    The merged rows are stored first, then each touched folder is replaced as its write commits; the others stay as they are.
    Scale the number of buckets with the table, once, when it is made.
    """
    rows = stored(rows.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    merged = rows
    if exists(spark, path):
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
        merged = stored(delete_by_keys(old, rows, key).unionByName(rows))
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    release(rows, merged)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table kept in buckets, without their numbers."""
    return spark.read.parquet(path).drop("_bucket")


def insert_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Rows whose key is new are appended, the others ignored (SNK8)."""
    rows = rows.dropDuplicates([key])
    if exists(spark, path):
        rows = delete_by_keys(rows, spark.read.parquet(path), key)
    rows.write.mode("append").parquet(path)


def delete_keys(spark: SparkSession, keys: DataFrame, path: str, key: str) -> None:
    """Rows of these keys removed; nothing is written for an empty set (SNK10)."""
    if not keys.isEmpty():
        replace_table(delete_by_keys(spark.read.parquet(path), keys, key), path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Tables emptied, their schemas kept; one after the other, as plain folders have no common transaction (SNK9, SNK12)."""
    for path in paths:
        replace_table(spark.read.parquet(path).limit(0), path)


def gated_export(tables: dict[str, DataFrame], faults: DataFrame, path: str, order: dict[str, list[str]]) -> int:
    """All tables or none: with any fault nothing is written; returns the number of faults (SNK3). Files are in key order."""
    n = faults.count()
    if not n:
        for name, rows in tables.items():
            rows.orderBy(*order[name]).write.mode("overwrite").json(f"{path}/{name}")
    return n


def write_packs(packs: DataFrame, path: str) -> None:
    """A folder for each pack with its text (SNK5)."""
    packs.select("pack_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("pack_id").text(path)


def sign_off(spark: SparkSession, packs: DataFrame, pack_id: str, status: str, at: str, path: str) -> None:
    """A pack's status set or reopened; an unknown pack is an error (SNK6)."""
    if packs.where(F.col("pack_id") == pack_id).isEmpty():
        raise ValueError(f"no pack {pack_id}")
    upsert(spark, spark.createDataFrame([(pack_id, status, at)], "pack_id string, status string, signed_off_at string"), path, "pack_id")


def seed(spark: SparkSession, tables: dict[str, DataFrame], stamp: str, path: str) -> bool:
    """Content tables written anew unless the stamp and the first table's row count are those already there; user tables
    elsewhere are never touched (SNK11). Returns whether it wrote."""
    first = next(iter(tables))
    if exists(spark, f"{path}/meta"):
        meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}  # two rows
        if meta.get("stamp") == stamp and exists(spark, f"{path}/{first}") and meta.get("rows") == str(spark.read.parquet(f"{path}/{first}").count()):
            return False
    for name, rows in tables.items():
        replace_table(rows, f"{path}/{name}")
    n = spark.read.parquet(f"{path}/{first}").count()
    replace_table(spark.createDataFrame([("stamp", stamp), ("rows", str(n))], "key string, value string"), f"{path}/meta")
    return True


def clamped_scale(x: float) -> float:
    """A font scale within its bounds (SNK13)."""
    return min(max(x, 0.85), 1.3)
