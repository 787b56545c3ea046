"""Queries of problem 2, references to records that do not exist, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.operators import references as R
from versemill.runtime import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    feelings = table(spark, folder, "feelings").select("feeling_id", "created_at", F.explode("verses").alias("verse_id"))
    children = {
        "feelings": (feelings, "feeling_id", "verse_id", "created_at"),
        "progress": (table(spark, folder, "progress"), "progress_id", "verse_id", "read_at"),
        "bookmarks": (table(spark, folder, "bookmarks"), "bookmark_id", "verse_id", "created_at"),
    }
    return R.orphan_references(children, table(spark, folder, "verses"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("tab", "ref_id", F.col("ref").alias("verse_id")).distinct()


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_counts(_orphans(spark, folder))


_SAME = "translate(%s, '" + "".join(R._DIGITS) + "', '" + "".join(str(R.unicodedata.decimal(c)) for c in R._DIGITS) + "')"


def _key(column: str) -> str:
    plain = rf"regexp_replace({_SAME % column}, '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}]+', '', 'g')"
    two = r"^0*([0-9]+)[^\p{L}\p{N}]+0*([0-9]+)$"
    return rf"CASE WHEN {plain} = '' THEN NULL WHEN regexp_matches({plain}, '{two}') THEN regexp_extract({plain}, '{two}', 1) || ':' || regexp_extract({plain}, '{two}', 2) ELSE '=' || {plain} END"


_CASES = f"""
WITH refs AS (
  SELECT 'feelings' AS tab, feeling_id AS ref_id, unnest(verses) AS verse_id, created_at AS ts FROM feelings
  UNION ALL SELECT 'progress', progress_id, verse_id, read_at FROM progress
  UNION ALL SELECT 'bookmarks', bookmark_id, verse_id, created_at FROM bookmarks),
r AS (SELECT DISTINCT *, {_key('verse_id')} AS k FROM refs),
v AS (SELECT DISTINCT {_key('id')} AS k, added_at, deleted_at FROM verses),
live AS (SELECT DISTINCT r.tab, r.ref_id, r.verse_id, r.ts FROM r JOIN v ON r.k = v.k
  WHERE r.ts IS NULL OR ((v.added_at IS NULL OR v.added_at <= r.ts) AND (v.deleted_at IS NULL OR r.ts < v.deleted_at))),
cases AS (SELECT r.* FROM r LEFT JOIN live l ON r.tab = l.tab AND r.ref_id IS NOT DISTINCT FROM l.ref_id AND r.verse_id = l.verse_id AND r.ts IS NOT DISTINCT FROM l.ts
  WHERE r.k IS NOT NULL AND l.tab IS NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}
ORACLES = {
    "p2_found": _CASES + "SELECT DISTINCT tab, ref_id, verse_id FROM cases",
    "p2_periods": _CASES + "SELECT tab, coalesce(strftime(ts, '%Y-%m'), 'unknown') AS period, count(*) AS orphans, count(DISTINCT k) AS keys FROM cases GROUP BY 1, 2",
}
