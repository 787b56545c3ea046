"""Queries of the training-text problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm import alignment, forms, leaks, mixing, reading, scans, spans
from versemill.runtime import table


def _aligned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return alignment.aligned(*(table(spark, folder, name) for name in ("verses", "renderings", "align", "glossary")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder)[0].select("verse_id", "rendition", "sent_no")


def p1_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder)[1]


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_findings(table(spark, folder, "triptych"), [table(spark, folder, "renderings").select("text"), table(spark, folder, "verses").select("meaning")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder).select("chapter", "para", "line", "kind", "word").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired(table(spark, folder, "triptych"), _scan(spark, folder))


#: Fields of the verses and the script each is written in.
FIELDS = {"devanagari": "devanagari", "iast": "latin"}


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return forms.normal_forms(table(spark, folder, "verses"), "row_id", FIELDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.not_plain(table(spark, folder, "verses"), "row_id", FIELDS)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return forms.lookalike_groups(_forms(spark, folder))


def p4_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select("row_id", "field", "plain")


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "draft"), table(spark, folder, "reading_labels"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("level >= 4").select(F.col("doc_id").alias("draft_id"))


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).groupBy("level").agg(F.count("*").alias("drafts"), F.sum("words").alias("words"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, folder), table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def _mix_chars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), tokenizer=None)


def p7_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The same mixing with sizes in characters, which SQL can count too."""
    return _mix_chars(spark, folder)[0].withColumnRenamed("tokens", "chars")


def p7_chars_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix_chars(spark, folder)[1].select("source", "target_share", "actual_share", "budget", F.col("used_tokens").alias("used_chars"), "records", "records_used", F.col("most_uses").cast("int").alias("most_uses"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_span_pairs(table(spark, folder, "documents"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_portions(table(spark, folder, "documents"))


def p8_links(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_span_links(table(spark, folder, "documents"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_passages(table(spark, folder, "documents"))


_NAME = r"lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_MIXED = f"""WITH d AS (SELECT doc_id AS doc, {_NAME} AS source, length(text) AS chars FROM documents WHERE length(text) > 0),
goal AS (SELECT {_NAME} AS source, sum(target_share) AS share, greatest(min(coalesce(max_repeats, 1)), 0) AS cap FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1),
there AS (SELECT source, count(*) AS records, sum(chars)::BIGINT AS available FROM d GROUP BY source),
g AS (SELECT goal.source, share, cap, coalesce(records, 0) AS records, coalesce(available, 0) AS available, coalesce(available, 0) * cap AS most FROM goal LEFT JOIN there ON goal.source = there.source),
whole AS (SELECT floor(min(most / share) FILTER (WHERE most > 0)) AS total FROM g), b AS (SELECT g.*, floor(coalesce(total, 0) * share + 1e-6)::BIGINT AS budget FROM g, whole),
plan AS (SELECT *, CASE WHEN available = 0 THEN 0 ELSE least(budget, most) // available END AS epochs, least(budget, most) AS fill FROM b),
placed AS (SELECT d.doc, d.source, d.chars, p.epochs, p.cap, p.fill - p.epochs * p.available AS rest, sum(d.chars) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc), d.doc, d.chars ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN plan p ON d.source = p.source),
used AS (SELECT doc AS doc_id, source, chars, least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, cap)::INT AS uses FROM placed)"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_dictionary, p3_found, p3_repaired, p4_found, p4_groups, p4_plain, p5_found, p5_profile, p6_found, p6_items, p7_mix, p7_shares, p7_chars, p7_chars_shares, p8_found, p8_shared, p8_links, p8_passages)
}
#: The rest has no SQL: it needs rolling hashes, tokenizers, trained tables or code-point rules; tests hold it against brute force.
ORACLES: dict[str, str] = {
    "p7_chars": _MIXED + " SELECT * FROM used WHERE uses > 0",
    "p7_chars_shares": _MIXED + """, s AS (SELECT source, count(*) AS records_used, sum(chars * uses)::BIGINT AS used_chars, max(uses) AS most_uses FROM used WHERE uses > 0 GROUP BY source),
r AS (SELECT p.source, p.share AS target_share, p.budget, coalesce(s.used_chars, 0) AS used_chars, p.records, coalesce(s.records_used, 0) AS records_used, coalesce(s.most_uses, 0)::INT AS most_uses FROM plan p LEFT JOIN s ON p.source = s.source)
SELECT source, target_share, CASE WHEN sum(used_chars) OVER () = 0 THEN 0.0::DOUBLE ELSE used_chars::DOUBLE / sum(used_chars) OVER () END AS actual_share, budget, used_chars, records, records_used, most_uses FROM r""",
}
