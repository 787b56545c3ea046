"""Reading-library queries: listings, progress, bookmarks, tags, packs, gaps and event folds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.operators import events as E
from versemill.operators import relational as R
from versemill.operators import sequence as S
from versemill.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_CURRENT = """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST, row_id) AS k FROM verses WHERE deleted_at IS NULL),
units AS (SELECT * FROM ranked WHERE k = 1), toc AS (SELECT n AS ch, min(title) AS title, min(verse_count) AS verse_count FROM chapters GROUP BY n)"""


def units(spark: SparkSession, folder: str) -> DataFrame:
    return R.current_units(table(spark, folder, "verses"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chapters").groupBy(F.col("n").alias("ch")).agg(F.min("title").alias("title"), F.min("verse_count").alias("verse_count"))


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """First read of each unit by each reader, as insert-or-ignore keeps it; badly written ids find no unit and drop out of joins."""
    rows = table(spark, folder, "progress").where("reader_id is not null and verse_id is not null and read_at is not null")
    return R.first_write_wins(rows.select("reader_id", "verse_id", "read_at", "progress_id"), ["reader_id", "verse_id"], "read_at", "progress_id").withColumnRenamed("verse_id", "id")


_READS = """, reads AS (SELECT reader_id, verse_id AS id, min(read_at) AS read_at FROM progress WHERE reader_id IS NOT NULL AND verse_id IS NOT NULL AND read_at IS NOT NULL GROUP BY ALL)"""


def bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Bookmarks without repeated deliveries: the last delivery of each id wins."""
    return R.last_write_wins(table(spark, folder, "bookmarks"), ["bookmark_id"], "ingested_at", "verse_id")


_MARKS = """, marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bookmark_id ORDER BY ingested_at DESC NULLS LAST, verse_id DESC NULLS LAST) AS d FROM bookmarks) WHERE d = 1)"""


@query(_CURRENT + "SELECT ch, n, id, speaker, meaning FROM units")
def section_listing(spark, folder):
    """FLT1, SO1: units in the text's order."""
    return units(spark, folder).select("ch", "n", "id", "speaker", "meaning").orderBy("ch", "n")


@query(_CURRENT + "SELECT id, devanagari, meaning FROM units WHERE id = '1:1'")
def unit_lookup(spark, folder):
    """FLT2: point lookup, none or one row; the filter reaches the scan."""
    return R.current_units(table(spark, folder, "verses").where("id = '1:1'")).select("id", "devanagari", "meaning")


@query(_CURRENT + _MARKS + "SELECT id, EXISTS (SELECT 1 FROM marks WHERE marks.verse_id = units.id) AS bookmarked FROM units")
def unit_exists(spark, folder):
    """FLT5, JN16: whether each unit is bookmarked, never null."""
    marks = bookmarks(spark, folder).select(F.col("verse_id").alias("id"))
    return R.flagged(units(spark, folder).select("id"), marks, "id", "bookmarked")


@query(_CURRENT + _READS + "SELECT DISTINCT id FROM reads")
def read_ids(spark, folder):
    """FLT4: ids ever read."""
    return reads(spark, folder).select("id").distinct()


@query(_CURRENT + _READS + _MARKS + """, meta AS (SELECT 'units' AS key, count(*) AS value FROM units UNION ALL SELECT 'sections', count(*) FROM toc UNION ALL SELECT 'read', count(DISTINCT r.id) FROM reads r JOIN units u ON r.id = u.id UNION ALL SELECT 'saved', count(*) FROM marks)
SELECT w.key, coalesce(m.value, 0) AS value FROM (VALUES ('units'), ('sections'), ('read'), ('saved'), ('not there')) w(key) LEFT JOIN meta m ON w.key = m.key""")
def meta_values(spark, folder):
    """AG2-AG4, FLT3, SRC13: totals as key and value, looked up with a default."""
    u = units(spark, folder).select("id")
    parts = {
        "units": u.agg(F.count("*").alias("value")),
        "sections": sections(spark, folder).agg(F.count("*").alias("value")),
        "read": reads(spark, folder).select("id").distinct().join(u, "id", "left_semi").agg(F.count("*").alias("value")),
        "saved": bookmarks(spark, folder).agg(F.count("*").alias("value")),
    }
    meta = None
    for k, df in parts.items():
        df = df.select(F.lit(k).alias("key"), "value")
        meta = df if meta is None else meta.unionByName(df)
    wanted = spark.range(1).select(F.explode(F.lit([*parts, "not there"])).alias("key"))
    return wanted.join(meta, "key", "left").select("key", F.coalesce("value", F.lit(0)).alias("value"))


@query(_CURRENT + _READS + """, counts AS (SELECT u.ch, count(r.id) AS read, count(*) AS total FROM (SELECT DISTINCT ch, id FROM units) u LEFT JOIN (SELECT DISTINCT id FROM reads) r ON u.id = r.id GROUP BY u.ch)
SELECT t.ch, t.title, coalesce(c.read, 0) AS read, coalesce(c.total, 0) AS total, CASE WHEN coalesce(c.total, 0) <= 0 THEN 0.0::DOUBLE ELSE c.read::DOUBLE / c.total END AS fraction FROM toc t LEFT JOIN counts c ON t.ch = c.ch""")
def progress_per_section(spark, folder):
    """AG1, JN2, JN5, FN-M1, SNK8: the flagship; sections without a read unit keep a 0."""
    return R.section_progress(sections(spark, folder), units(spark, folder), reads(spark, folder))


_READER_SECTIONS = """, sizes AS (SELECT ch, count(DISTINCT id) AS total FROM units GROUP BY ch), mine AS (SELECT r.reader_id, u.ch, count(DISTINCT r.id) AS read FROM reads r JOIN units u ON r.id = u.id GROUP BY ALL)"""


@query(_CURRENT + _READS + _READER_SECTIONS + "SELECT m.reader_id, m.ch, m.read, s.total, m.read = s.total AS complete FROM mine m JOIN sizes s ON m.ch = s.ch")
def completed_sections(spark, folder):
    """AG5, AG3, FN-A2: each reader's progress in the sections begun."""
    return R.reader_sections(units(spark, folder), reads(spark, folder))


@query(_CURRENT + _MARKS + "SELECT m.bookmark_id, m.reader_id, u.id, u.ch, u.n, m.created_at FROM units u JOIN marks m ON u.id = m.verse_id")
def bookmarks_recent(spark, folder):
    """JN3, SO3: bookmarks with their unit, newest first, ties by id."""
    marks = bookmarks(spark, folder).select("bookmark_id", "reader_id", F.col("verse_id").alias("id"), "created_at")
    joined = units(spark, folder).select("id", "ch", "n").join(marks, "id")
    return joined.select("bookmark_id", "reader_id", "id", "ch", "n", "created_at").orderBy(F.desc("created_at"), "bookmark_id")


@query(_CURRENT + _MARKS + """SELECT m.reader_id, u.ch, coalesce(t.title, '') AS title, count(*) AS n, string_agg(u.id, ' ' ORDER BY m.created_at DESC NULLS LAST, m.bookmark_id) AS ids
FROM units u JOIN marks m ON u.id = m.verse_id LEFT JOIN toc t ON u.ch = t.ch GROUP BY ALL""")
def bookmarks_grouped(spark, folder):
    """AG13, JN17: each reader's bookmarks by section, newest first inside, with the title or ''."""
    marks = bookmarks(spark, folder).select("reader_id", F.col("verse_id").alias("id"), "created_at", "bookmark_id")
    rows = units(spark, folder).select("id", "ch").join(marks, "id").join(sections(spark, folder).select("ch", "title"), "ch", "left")
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "bookmark_id", "id")), lambda a, b: F.when(a["t"].isNull() & b["t"].isNotNull(), 1).when(b["t"].isNull() & a["t"].isNotNull(), -1).when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).when(a["bookmark_id"] < b["bookmark_id"], -1).when(a["bookmark_id"] > b["bookmark_id"], 1).otherwise(0))
    return rows.groupBy("reader_id", "ch", F.coalesce("title", F.lit("")).alias("title")).agg(F.count("*").alias("n"), F.array_join(F.transform(newest, lambda x: x["id"]), " ").alias("ids"))


@query(_CURRENT + """, items AS (SELECT feeling_id, name, unnest(verses) AS id, generate_subscripts(verses, 1) - 1 AS position FROM feelings)
SELECT i.feeling_id, i.name, i.position::INT AS position, u.id, u.meaning FROM items i JOIN units u ON i.id = u.id""")
def feeling_units(spark, folder):
    """JN4, SO4, WN9: a feeling's units in curated order."""
    f = table(spark, folder, "feelings")
    items = R.bridge(f, "feeling_id", "verses").join(f.select("feeling_id", "name"), "feeling_id")
    return items.join(units(spark, folder).select(F.col("id").alias("item"), "meaning"), "item").select("feeling_id", "name", "position", F.col("item").alias("id"), "meaning")


@query("SELECT DISTINCT f.feeling_id, v AS ref FROM (SELECT feeling_id, unnest(verses) AS v FROM feelings) f WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM verses WHERE verses.id = f.v)")
def dangling_refs(spark, folder):
    """JN13, DQ12: references of feelings as written that no unit ever had."""
    refs = table(spark, folder, "feelings").select("feeling_id", F.explode("verses").alias("ref"))
    return R.dangling(refs, table(spark, folder, "verses"), "ref", "id").select("feeling_id", "ref").distinct()


@query(_CURRENT + """, marked AS (SELECT id, count(*) AS drafts, count(*) FILTER (WHERE status = 'approved') AS approved FROM draft GROUP BY id),
copies AS (SELECT s.id, min(s.iast) AS iast FROM (SELECT unnest(sanskrit) AS s FROM triptych) GROUP BY s.id)
SELECT u.id, coalesce(m.drafts, 0) AS drafts, coalesce(m.approved, 0) AS approved, c.iast IS NULL AS no_copy, coalesce(c.iast = u.iast, false) AS same_copy FROM units u LEFT JOIN marked m ON u.id = m.id LEFT JOIN copies c ON u.id = c.id""")
def optional_enrichment(spark, folder):
    """JN6, JN10-JN12, SRC14: units with what optional tables say of them; missing gives defaults."""
    drafts = table(spark, folder, "draft").groupBy("id").agg(F.count("*").alias("drafts"), F.count_if(F.col("status") == "approved").alias("approved"))
    copies = table(spark, folder, "triptych").select(F.explode("sanskrit").alias("s")).groupBy("s.id").agg(F.min("s.iast").alias("copy"))
    out = units(spark, folder).select("id", "iast").join(drafts, "id", "left").join(copies, "id", "left")
    return out.select("id", F.coalesce("drafts", F.lit(0)).alias("drafts"), F.coalesce("approved", F.lit(0)).alias("approved"), F.col("copy").isNull().alias("no_copy"), F.coalesce(F.col("copy") == F.col("iast"), F.lit(False)).alias("same_copy"))


@query(_CURRENT + """, newest AS (SELECT id, arg_max(ROW(meaning_simple, takeaway, status), ROW(updated_at, draft_id)) AS d FROM draft WHERE updated_at IS NOT NULL GROUP BY id)
SELECT u.id, u.devanagari, coalesce(d[1], '') AS meaning_simple, coalesce(d[2], '') AS takeaway, coalesce(d[3], 'draft') AS status FROM units u LEFT JOIN newest n ON u.id = n.id""".replace("d[1]", "n.d[1]").replace("d[2]", "n.d[2]").replace("d[3]", "n.d[3]"))
def carry_forward(spark, folder):
    """JN7, WN11: fresh records keep the editorial fields of the newest draft, or defaults."""
    old = R.last_write_wins(table(spark, folder, "draft").where("updated_at is not null").select("id", "meaning_simple", "takeaway", "status", "updated_at", "draft_id"), ["id"], "updated_at", "draft_id")
    return R.carried_forward(units(spark, folder).select("id", "devanagari"), old, "id", ["meaning_simple", "takeaway", "status"], {"meaning_simple": "", "takeaway": "", "status": "draft"})


@query(_CURRENT + _READS + "SELECT reader_id, id, read_at FROM reads")
def first_write_wins(spark, folder):
    """SNK8: the first read of each unit by each reader stays."""
    return reads(spark, folder).select("reader_id", "id", "read_at")


@query("WITH x AS (SELECT 1)" + _MARKS + "SELECT bookmark_id, reader_id, verse_id, created_at FROM marks")
def last_write_wins(spark, folder):
    """SNK7: the last delivery of each bookmark stays."""
    return bookmarks(spark, folder).select("bookmark_id", "reader_id", "verse_id", "created_at")


@query("WITH x AS (SELECT 1)" + _MARKS + "SELECT bookmark_id, verse_id FROM marks WHERE verse_id IS NULL OR verse_id NOT IN (SELECT id FROM verses WHERE deleted_at IS NOT NULL AND id IS NOT NULL)")
def delete_by_keys(spark, folder):
    """SNK10: bookmarks without those of units that were ever deleted."""
    gone = table(spark, folder, "verses").where("deleted_at is not null").select(F.col("id").alias("verse_id"))
    return R.delete_by_keys(bookmarks(spark, folder), gone, "verse_id").select("bookmark_id", "verse_id")


@query("SELECT status, count(*) AS n FROM draft GROUP BY status")
def status_histogram(spark, folder):
    """AG6: drafts by status."""
    return R.histogram(table(spark, folder, "draft"), "status")


@query("""SELECT split_part(id, ':', 1)::INT AS ch, count(*) AS drafts, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status IS DISTINCT FROM 'approved') AS open,
count(*) FILTER (WHERE status IN ('rejected', 'draft')) AS failing FROM draft GROUP BY 1""")
def flag_counts(spark, folder):
    """AG7-AG10, FLT7: conditional counts by section."""
    d = table(spark, folder, "draft").withColumn("ch", F.split_part("id", F.lit(":"), F.lit(1)).cast("int"))
    ok = F.col("status") == "approved"
    return d.groupBy("ch").agg(F.count("*").alias("drafts"), F.count_if(ok).alias("approved"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("open"), F.count_if(F.col("status").isin("rejected", "draft")).alias("failing"))


@query("SELECT draft_id, id, meaning_simple FROM draft WHERE status = 'approved'")
def approved_only(spark, folder):
    """FLT7: the filter and three columns reach the scan."""
    return table(spark, folder, "draft").where("status = 'approved'").select("draft_id", "id", "meaning_simple")


_RANKED = _CURRENT + _READS + """, spots AS (SELECT ch, n, min(id) AS id, row_number() OVER (ORDER BY ch, n) AS spot FROM units GROUP BY ch, n)"""


@query(_RANKED + """, readers AS (SELECT DISTINCT reader_id FROM reads), mine AS (SELECT reader_id, spot, row_number() OVER (PARTITION BY reader_id ORDER BY spot) AS k FROM (SELECT DISTINCT r.reader_id, s.spot FROM reads r JOIN spots s ON r.id = s.id)),
begun AS (SELECT reader_id, max(spot) AS upto FROM mine WHERE k = spot GROUP BY 1) SELECT r.reader_id, s.id AS next_id FROM readers r LEFT JOIN begun b ON r.reader_id = b.reader_id LEFT JOIN spots s ON s.spot = coalesce(b.upto, 0) + 1""")
def first_unread(spark, folder):
    """WN3: each reader's first gap, without meeting all units."""
    return S.first_unread(units(spark, folder), reads(spark, folder))


@query(_CURRENT + ", spots AS (SELECT ch, n, min(id) AS id FROM units GROUP BY ch, n) SELECT ch, n, id, row_number() OVER (ORDER BY ch, n) AS spot FROM spots")
def unit_numbering(spark, folder):
    """WN1, SO5: each unit's place in the text, in numeric order."""
    return S.ranked_units(units(spark, folder))


@query(_CURRENT + "SELECT ch, count(DISTINCT n) AS units, min(n) AS least, max(n) AS most, max(n) - count(DISTINCT n) AS gaps FROM units GROUP BY ch HAVING min(n) <> 1 OR max(n) <> count(DISTINCT n)")
def contiguity_violations(spark, folder):
    """WN2, AG11: sections whose numbers are not 1..N."""
    return S.contiguity(units(spark, folder), "ch", "n")


@query(_CURRENT + "SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS following FROM units WINDOW w AS (PARTITION BY ch ORDER BY n)")
def prev_next_unit(spark, folder):
    """WN4: neighbours in the section."""
    return S.neighbours(units(spark, folder))


_PACKS = _CURRENT + ", packed AS (SELECT ch, n, id, ((row_number() OVER (PARTITION BY ch ORDER BY n) - 1) // 10 + 1)::INT AS pack FROM units)"


@query(_PACKS + "SELECT ch, n, id, pack, printf('ch%02d-%d', ch, pack) AS pack_id FROM packed")
def review_packs(spark, folder):
    """WN5, FN-S15: packs of ten."""
    return S.packs(units(spark, folder))


@query(_PACKS + ", ok AS (SELECT DISTINCT id FROM draft WHERE status = 'approved') SELECT printf('ch%02d-%d', ch, pack) AS pack_id, count(*) AS units, count(ok.id) AS approved, count(*) = count(ok.id) AS signed FROM packed LEFT JOIN ok ON packed.id = ok.id GROUP BY 1")
def pack_signoff(spark, folder):
    """AG10, SNK6: how much of each pack is approved."""
    ok = table(spark, folder, "draft").where("status = 'approved'").select("id").distinct().withColumn("ok", F.lit(1))
    packed = S.packs(units(spark, folder)).join(ok, "id", "left")
    return packed.groupBy("pack_id").agg(F.count("*").alias("units"), F.count("ok").alias("approved"), (F.count("*") == F.count("ok")).alias("signed"))


@query(_CURRENT + """, a AS (SELECT DISTINCT chapter AS ch, split_part(r.id, ':', 2)::INT AS n FROM (SELECT chapter, unnest(records) AS r FROM align) WHERE r.arnold IS NOT NULL)
SELECT a.ch, a.n, coalesce(lead(a.n) OVER (PARTITION BY a.ch ORDER BY a.n), t.verse_count + 1)::INT AS until FROM a LEFT JOIN toc t ON a.ch = t.ch""")
def anchor_spans(spark, folder):
    """WN6, JN18, SEG3: spans between anchored units, the last up to the section's registered end."""
    a = table(spark, folder, "align").select(F.col("chapter").alias("ch"), F.explode("records").alias("r")).where("r.arnold is not null")
    a = a.select("ch", F.split_part("r.id", F.lit(":"), F.lit(2)).cast("int").alias("n")).distinct().join(sections(spark, folder).select("ch", "verse_count"), "ch", "left")
    return S.spans(a, "ch", "n", F.col("verse_count") + 1).select("ch", "n", "until")


_KNOWN = "CASE WHEN regexp_matches(verse_id, '^[0-9]{1,6}:[0-9]{1,6}$') THEN split_part(verse_id, ':', 1)::INT END"


@query(f"""WITH p AS (SELECT DISTINCT reader_id, progress_id, read_at, {_KNOWN} AS ch FROM progress WHERE reader_id IS NOT NULL),
f AS (SELECT *, last_value(ch IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(ch IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM p WINDOW w AS (PARTITION BY reader_id ORDER BY read_at NULLS LAST, progress_id))
SELECT reader_id, progress_id, coalesce(ch, CASE WHEN a = b THEN b END) AS filled FROM f WHERE ch IS NULL""")
def inherit_unknown(spark, folder):
    """WN7: reads whose section cannot be read off take it over where the neighbours agree."""
    p = table(spark, folder, "progress").where("reader_id is not null").select("reader_id", "progress_id", "read_at", F.when(F.col("verse_id").rlike("^[0-9]{1,6}:[0-9]{1,6}$"), F.split_part("verse_id", F.lit(":"), F.lit(1)).try_cast("int")).alias("ch")).distinct()
    return S.inherited(p, "reader_id", [F.col("read_at").asc_nulls_last(), "progress_id"], "ch").where("ch is null").select("reader_id", "progress_id", "filled")


@query("SELECT id, arg_min(draft_id, ROW(updated_at, draft_id)) AS draft_id, min(updated_at) AS updated_at FROM draft WHERE updated_at IS NOT NULL GROUP BY id")
def first_per_group(spark, folder):
    """WN8: the first draft of each unit."""
    return table(spark, folder, "draft").where("updated_at is not null").groupBy("id").agg(F.min_by("draft_id", F.struct("updated_at", "draft_id")).alias("draft_id"), F.min("updated_at").alias("updated_at"))


@query(_CURRENT + """, sizes AS (SELECT ch, count(DISTINCT n) AS total, row_number() OVER (ORDER BY ch) - 1 AS turn, count(*) OVER () AS c FROM units GROUP BY ch), days AS (SELECT unnest(range(1, 367)) AS day)
SELECT d.day, s.ch || ':' || (((d.day - 1) // s.c) % s.total + 1) AS id FROM days d JOIN sizes s ON (d.day - 1) % s.c = s.turn""")
def unit_of_day(spark, folder):
    """WN12, FN-M2, FN-D1: the unit of each day of a year."""
    sizes = units(spark, folder).groupBy("ch").agg(F.count_distinct("n").alias("total"))
    return S.unit_of_day(spark.range(1, 367).withColumnRenamed("id", "day"), sizes)


@query("""WITH p AS (SELECT DISTINCT reader_id, progress_id, read_at, verse_id FROM progress WHERE reader_id IS NOT NULL AND read_at IS NOT NULL), g AS (SELECT *, lead(read_at) OVER (PARTITION BY reader_id ORDER BY read_at, progress_id) AS nxt FROM p)
SELECT reader_id, progress_id, verse_id FROM g WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(read_at) >= 3600000000""")
def event_debounce(spark, folder):
    """RX3, RX4: reads with a quiet hour after them."""
    p = table(spark, folder, "progress").select("reader_id", "progress_id", "read_at", "verse_id").distinct()
    return E.debounced(p, "reader_id", "read_at", "progress_id", 3_600_000_000).select("reader_id", "progress_id", "verse_id")


@query("""WITH p AS (SELECT DISTINCT reader_id, progress_id, read_at, verse_id FROM progress WHERE reader_id IS NOT NULL AND read_at IS NOT NULL), g AS (SELECT *, lead(read_at) OVER (PARTITION BY reader_id ORDER BY read_at, progress_id) AS nxt FROM p)
SELECT verse_id, count(*) AS dwells FROM g WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(read_at) >= 1500000 GROUP BY verse_id""")
def event_dwell(spark, folder):
    """RX6: how often each id was dwelt on for 1.5 seconds or more."""
    p = table(spark, folder, "progress").select("reader_id", "progress_id", "read_at", "verse_id").distinct()
    return E.dwelt(p, "reader_id", "read_at", "progress_id", 1_500_000).groupBy("verse_id").agg(F.count("*").alias("dwells"))


@query("SELECT reader_id, verse_id, count(DISTINCT bookmark_id) % 2 = 1 AS marked, max(created_at) AS last_at FROM bookmarks WHERE reader_id IS NOT NULL AND verse_id IS NOT NULL GROUP BY 1, 2")
def latest_state(spark, folder):
    """RX7: bookmark toggles folded into a state."""
    return E.toggled_state(table(spark, folder, "bookmarks").where("reader_id is not null and verse_id is not null"), ["reader_id", "verse_id"], "created_at", "bookmark_id")


@query(_CURRENT + ", c AS (SELECT s.id, s.iast FROM (SELECT unnest(sanskrit) AS s FROM triptych)), v AS (SELECT id, iast FROM units) SELECT 'left' AS side, id, iast FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM c) UNION ALL SELECT 'right', id, iast FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM v)")
def table_equality(spark, folder):
    """ST6, DQ13: the text against its copy, both ways."""
    copy = table(spark, folder, "triptych").select(F.explode("sanskrit").alias("s")).select("s.id", "s.iast")
    return R.two_way_difference(units(spark, folder).select("id", "iast"), copy)


@query(_CURRENT + "SELECT ch, sha256(string_agg(id || '=' || coalesce(meaning, ''), chr(10) ORDER BY n)) AS digest, count(*) AS units FROM units GROUP BY ch")
def content_digest(spark, folder):
    """AG14, FN-H1, FN-J2: one digest for each section over its units in order."""
    line = F.concat(F.col("id"), F.lit("="), F.coalesce("meaning", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return units(spark, folder).groupBy("ch").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"), F.count("*").alias("units"))
