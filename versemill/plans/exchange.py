"""Queries that write to the shared folder and read back, or read what others land: sinks, bundles, pages and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import cleaning as C
from versemill.functions.releases import available
from versemill.operators import relational as R
from versemill.operators import segmentation
from versemill.plans import library
from versemill.plans.library import _CURRENT, _MARKS, bookmarks, sections, units
from versemill.runtime import fresh_folder, stored, table
from versemill.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_ONE = "WITH x AS (SELECT 1)"


@query("SELECT n, name, title, verse_count FROM chapters")
def written_records(spark, folder):
    """SNK1, SNK4, SRC7, FN-J2: a table as records and back, unknown keys ignored."""
    at = fresh_folder(spark)
    sinks.write_records(table(spark, folder, "chapters").withColumn("unknown", F.lit(1)), at)
    return spark.read.schema("n int, name string, title string, verse_count int").json(at)


@query(_ONE + _MARKS + "SELECT bookmark_id, reader_id, verse_id FROM marks")
def upserted_marks(spark, folder):
    """SNK7, RX7: first deliveries written, then all last ones put in their place, bucket by bucket."""
    at, rows = fresh_folder(spark), table(spark, folder, "bookmarks")
    first = R.first_write_wins(rows, ["bookmark_id"], "ingested_at", "verse_id").select("bookmark_id", "reader_id", "verse_id")
    for batch in (first, bookmarks(spark, folder).select("bookmark_id", "reader_id", "verse_id")):
        sinks.upsert_buckets(spark, batch, at, "bookmark_id")
    return sinks.read_buckets(spark, at)


@query("SELECT draft_id, status FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY updated_at NULLS LAST) AS k FROM draft WHERE status = 'approved' UNION ALL SELECT *, 1 FROM draft WHERE status IS DISTINCT FROM 'approved') WHERE k = 1")
def inserted_drafts(spark, folder):
    """SNK2, SNK8: approved drafts written, then all inserted; those that are there stay."""
    at, d = fresh_folder(spark), table(spark, folder, "draft").select("draft_id", "status")
    sinks.insert_new(spark, d.where("status = 'approved'"), at, "draft_id")
    sinks.insert_new(spark, d, at, "draft_id")
    return spark.read.parquet(at)


@query(_ONE + _MARKS + "SELECT 'kept' AS step, count(*) AS n FROM marks WHERE verse_id IS NULL OR verse_id NOT IN (SELECT id FROM verses WHERE deleted_at IS NOT NULL AND id IS NOT NULL) UNION ALL SELECT 'cleared', 0")
def deleted_marks(spark, folder):
    """SNK9, SNK10, SNK12: marks deleted by keys, then the table cleared."""
    at = fresh_folder(spark)
    bookmarks(spark, folder).select("bookmark_id", "verse_id").write.parquet(at)
    sinks.delete_keys(spark, table(spark, folder, "verses").where("deleted_at is not null and id is not null").select(F.col("id").alias("verse_id")), at, "verse_id")
    kept = stored(spark.read.parquet(at).agg(F.lit("kept").alias("step"), F.count("*").alias("n")).select("step", "n"))
    sinks.clear(spark, [at])
    return kept.unionByName(spark.read.parquet(at).agg(F.lit("cleared").alias("step"), F.count("*").alias("n")).select("step", "n"))


@query(_CURRENT + "SELECT 'refused' AS run, (SELECT count(*) FROM draft WHERE status IS DISTINCT FROM 'approved') AS faults, 0 AS rows UNION ALL SELECT 'written', 0, count(*) FROM units")
def gated_exports(spark, folder):
    """SNK3: an export refused for its faults leaves nothing behind, one without any is written whole."""
    at, u = fresh_folder(spark), units(spark, folder).select("id", "ch", "n", "meaning")
    faults = table(spark, folder, "draft").where("not (status <=> 'approved')")
    refused = sinks.gated_export({"verses": u}, faults, f"{at}/refused", {"verses": ["ch", "n"]})
    written = sinks.gated_export({"verses": u}, faults.limit(0), f"{at}/written", {"verses": ["ch", "n"]})
    rows = {name: spark.read.json(f"{at}/{name}/verses").count() if readers.exists(spark, f"{at}/{name}/verses") else 0 for name in ("refused", "written")}
    return spark.createDataFrame([("refused", refused, rows["refused"]), ("written", written, rows["written"])], "run string, faults long, rows long")


@query(_CURRENT + "SELECT unnest([1, 2, 3])::INT AS run, unnest([true, false, true]) AS wrote, (SELECT count(*) FROM units) AS rows")
def seeded_tables(spark, folder):
    """SNK11: written once for a stamp, again for another."""
    at, u = fresh_folder(spark), units(spark, folder)
    wrote = [sinks.seed(spark, {"verses": u}, stamp, at) for stamp in ("one", "one", "two")]
    n = spark.read.parquet(f"{at}/verses").count()
    return spark.createDataFrame([(k, w, n) for k, w in enumerate(wrote, 1)], "run int, wrote boolean, rows long")


@query("SELECT unnest([0.5, 0.85, 1.0, 1.3, 2.0])::DOUBLE AS wanted, unnest([0.85, 0.85, 1.0, 1.3, 1.3])::DOUBLE AS kept")
def clamped_scales(spark, folder):
    """SNK13: a font scale within its bounds."""
    return spark.createDataFrame([(x, sinks.clamped_scale(x)) for x in (0.5, 0.85, 1.0, 1.3, 2.0)], "wanted double, kept double")


def _signed(spark, folder) -> DataFrame:
    packs = library.review_packs(spark, folder).select("pack_id").distinct()
    at = fresh_folder(spark)
    first = packs.agg(F.min("pack_id")).first()[0]
    for status in ("pending", "approved"):
        sinks.sign_off(spark, packs, first, status, "2024-01-01", at)
    return spark.read.parquet(at)


@query(library._PACKS + "SELECT min(printf('ch%02d-%d', ch, pack)) AS pack_id, 'approved' AS status, '2024-01-01' AS signed_off_at FROM packed")
def signed_packs(spark, folder):
    """SNK6: a pack signed off after it was pending."""
    return _signed(spark, folder)


@query(_CURRENT + r""", v AS (SELECT * FROM units), sizes AS (SELECT ch, count(*) AS k, count(DISTINCT n) AS d, min(n) AS lo, max(n) AS hi FROM v GROUP BY ch)
SELECT coalesce(t.ch, s.ch)::VARCHAR AS id, 'count' AS "check", coalesce(k, 0)::VARCHAR AS detail FROM toc t FULL JOIN sizes s ON t.ch = s.ch WHERE t.verse_count IS DISTINCT FROM s.k
UNION ALL SELECT ch::VARCHAR, 'contiguity', hi::VARCHAR FROM sizes WHERE lo <> 1 OR hi <> k OR d <> k
UNION ALL SELECT id, 'id', ch || ':' || n FROM v WHERE id IS DISTINCT FROM ch || ':' || n
UNION ALL SELECT id, 'blank', 'text' FROM v WHERE coalesce(trim(devanagari), '') = '' OR coalesce(trim(meaning), '') = ''
UNION ALL SELECT name, 'reference', ref FROM (SELECT name, unnest(verses) AS ref FROM feelings) f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = f.ref)""")
def bundle_rules(spark, folder):
    """SRC10, DQ13, DQ15: the text as a bundle's tables, and what makes it unfit."""
    u = units(spark, folder).select("id", "ch", "n", "speaker", "devanagari", "iast", "meaning", "takeaway")
    toc = sections(spark, folder).select(F.col("ch").alias("n"), F.lit("").alias("name"), "title", F.col("verse_count").alias("verses"))
    return readers.bundle_table_faults({"chapters": toc, "verses": u, "feelings": table(spark, folder, "feelings").select("name", "line", "verses")})


@query(r"SELECT sha256(text || chr(10)) AS sha256, (length(text) + 1)::INT AS chars, count(*) AS files FROM (SELECT arnold AS text FROM triptych WHERE arnold IS NOT NULL) GROUP BY ALL")
def landed_pages(spark, folder):
    """SRC1-SRC6, SRC8, FN-H1: texts landed as one file each, read back with their digests."""
    at = fresh_folder(spark)
    texts = table(spark, folder, "triptych").where("arnold is not null").select("chapter", F.col("arnold").alias("value"))
    texts.repartition("chapter").write.partitionBy("chapter").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(at)
    return readers.pages(spark, f"{at}/*/*.txt").groupBy("sha256", "chars").agg(F.count("*").alias("files"))


@query(_CURRENT + r""", w AS (SELECT id, ch, n, speaker, list_filter(list_transform(string_split(iast, chr(10)), lambda x: regexp_replace(x, '^ +|[ /|]+$', '', 'g')), lambda x: x <> '') AS lines FROM units WHERE iast IS NOT NULL AND ch < 100)
SELECT id, lines[1] AS first, lines[2] AS second FROM w WHERE len(lines) = 2 AND NOT contains(array_to_string(lines, ' '), '<')""")
def witness_pages(spark, folder):
    """SRC9: pages of half verses with references, cut into readings."""
    u = units(spark, folder).where("iast is not null and ch < 100")  # references have two digits for the section
    lines = F.filter(F.transform(F.split("iast", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ /|]+$", ""))), lambda x: x != "")
    u = u.select("ch", "n", lines.alias("l")).where("size(l) = 2 and not contains(array_join(l, ' '), '<')")
    ref = lambda half: F.format_string(f" /  Bhg_%02d.%03d{half}", "ch", "n")
    pages = u.select(F.col("ch").cast("string").alias("name"), F.concat(F.lit("<p>"), F.col("l")[0], ref("a"), F.lit("<br>\n"), F.col("l")[1], ref("c"), F.lit("</p>")).alias("text"))
    return readers.readings(pages).select("id", "first", "second")


@query("""SELECT n, CASE WHEN n % 3 <> 0 AND n > 5 THEN 'v' || n || '.0' END AS tag, CASE WHEN n % 3 <> 0 AND n > 5 THEN n * 10::BIGINT END AS size FROM (SELECT DISTINCT n FROM chapters)""")
def offered_releases(spark, folder):
    """SRC12, FLT16, FN-V2: releases made of chapter numbers: newer ones with a package of the host are offered."""
    n = F.col("n")
    asset = lambda name, host: F.struct(F.lit(name).alias("name"), F.lit(host).alias("browser_download_url"), (n * 10).cast("long").alias("size"))
    package = F.when(n % 3 == 0, asset("app.apk", "http://elsewhere/x.apk")).otherwise(asset("App.APK", "https://github.com/x.apk"))
    told = F.to_json(F.struct(F.concat(F.lit("v"), n, F.lit(".0")).alias("tag_name"), F.lit(None).cast("string").alias("body"), F.array(asset("notes.txt", "https://github.com/n"), package).alias("assets"), F.lit(1).alias("unknown")))
    return table(spark, folder, "chapters").select("n").distinct().select("n", available(told, F.lit("5.0.0")).alias("r")).select("n", "r.tag", "r.size")


@query(r"SELECT chapter, string_agg(x, chr(10) ORDER BY i) AS poem FROM (SELECT chapter, unnest(sanskrit).devanagari AS x, generate_subscripts(sanskrit, 1) AS i FROM triptych) WHERE x IS NOT NULL AND NOT contains(x, '<') GROUP BY chapter")
def poem_bodies(spark, folder):
    """FN-S3: verses taken out of a page's poem elements, what stands between them left."""
    s = table(spark, folder, "triptych").select("chapter", F.transform(F.filter("sanskrit", lambda v: v["devanagari"].isNotNull() & ~F.contains(v["devanagari"], F.lit("<"))), lambda v: v["devanagari"]).alias("v")).where("size(v) > 0")
    page = F.array_join(F.transform("v", lambda x: F.concat(F.lit("<poem>"), x, F.lit("</poem>\n॥ १ ॥ note\n"))), "")
    return s.select("chapter", C.poems(page).alias("poem"))


@query("""WITH t AS (SELECT chapter, [p.text for p in telang_paras if not coalesce(p.is_footnote, false)] AS k FROM triptych), s AS (SELECT t.chapter, k, c.verse_count AS size FROM t JOIN (SELECT n, min(verse_count) AS verse_count FROM chapters GROUP BY n) c ON t.chapter = c.n),
r AS (SELECT chapter, size, len(k) AS have, unnest(k) AS text, generate_subscripts(k, 1) AS i FROM s)
SELECT chapter AS ch, CASE WHEN have = size THEN i::INT END AS verse, text, CASE WHEN have = size THEN 'auto' ELSE 'manual(span 1-' || size || ')' END AS status FROM r""")
def allocated_paragraphs(spark, folder):
    """SEG3: a section's paragraphs to its units, one each where the counts agree, else by hand."""
    kept = F.filter("telang_paras", lambda p: ~F.coalesce(p["is_footnote"], F.lit(False)))
    paras = table(spark, folder, "triptych").select(F.col("chapter").alias("ch"), F.lit(1).alias("start"), F.posexplode(kept).alias("k", "p")).select("ch", "start", "k", F.col("p.text").alias("text"))
    spans = sections(spark, folder).select("ch", F.lit(1).alias("start"), (F.col("verse_count") + 1).alias("until"))
    return segmentation.allocated(spans, paras)


@query(_CURRENT + ", s AS (SELECT ch, n, meaning FROM units WHERE meaning IS NOT NULL AND NOT contains(meaning, ' said:')) SELECT ch, 'Speaker' AS speaker, trim(meaning) AS text FROM s")
def speaker_turns(spark, folder):
    """SEG2: turns of a page of speeches."""
    u = units(spark, folder).where("meaning is not null and not contains(meaning, ' said:')")
    page = u.select("ch", F.concat(F.lit("Speaker said: "), "meaning").alias("t"))
    return page.select("ch", F.inline(segmentation.turns(F.col("t")))).select("ch", "speaker", "text")


@query("SELECT n, (strpos(t, 'Chapter ') )::INT AS place FROM (SELECT DISTINCT n, 'Contents' || chr(10) || 'Chapter ' || CASE WHEN n % 2 = 0 THEN 'I.' ELSE 'X' END || chr(10) || 'text' AS t FROM chapters)")
def title_places(spark, folder):
    """SEG5: where a chapter's title stands, by patterns in order of trust."""
    n = F.col("n")
    numeral = F.when(n % 2 == 0, "I").otherwise("X")
    page = F.concat(F.lit("Contents\nChapter "), numeral, F.when(n % 2 == 0, ".").otherwise(""), F.lit("\ntext"))
    return table(spark, folder, "chapters").select("n").distinct().select("n", segmentation.chapter_title_at(page, numeral).alias("place"))
