"""Script, witness, poem, pack and stream queries. Rule engines have no SQL; the rest does."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill.functions import translit as T
from versemill.functions.cleaning import is_blank
from versemill.operators import packs, segmentation, witness
from versemill.plans import library
from versemill.plans.library import _CURRENT, units
from versemill.runtime import fresh_folder, table
from versemill.streaming import reads as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in pairs)


_LETTERS = [(c, x, "C") for c, x in T.CONSONANTS.items()] + [(c + T.NUKTA, T.DOTTED.get(c, x), "C") for c, x in T.CONSONANTS.items()]
_LETTERS += [(c, x, "O") for c, x in T.VOWELS.items()] + [(c, x, "O") for c, x in T.MARKS.items()] + [(c, x, "S") for c, x in T.SIGNS.items()] + [(T.VIRAMA, "", "S")]
_SOUNDS = [(x, c, "C") for c, x in T.CONSONANTS.items() if x not in T.VOWELS.values()] + [(x, c, "V") for c, x in T.VOWELS.items()]
_SOUNDS += [(x, c, "O") for c, x in T.MARKS.items() if x != "oṃ"]
_SIGN = [(x, c) for c, x in T.SIGNS.items()] + [("a", "")]
_TOKENS = "|".join(x.replace("|", r"\|") for x, _, _ in sorted(_SOUNDS, key=lambda r: -len(r[0])))
_SCRIPTS = f"letters(tok, sound, kind) AS (VALUES {_values(_LETTERS)}), sounds(tok, letter, kind) AS (VALUES {_values(_SOUNDS)}), signs(tok, sign) AS (VALUES {_values(_SIGN)})"


def _cut(name: str, source: str, column: str, pattern: str) -> str:
    """Tokens of a column in order, each with its place."""
    pattern = pattern.replace("'", "''")
    return f"{name} AS (SELECT key, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM (SELECT key, regexp_extract_all({column}, '{pattern}') AS toks FROM {source}))"


def _iast_sql(name: str, source: str, column: str) -> str:
    """CTEs that end in name(key, text): a consonant has its a unless a sign or a virama comes next."""
    spelled = f"""{name}_s AS (SELECT key, p, coalesce(l.sound, t.tok) || CASE WHEN l.kind = 'C' AND coalesce(lead(l.kind) OVER w, 'O') <> 'S' THEN 'a' ELSE '' END AS x FROM {name}_t t LEFT JOIN letters l ON t.tok = l.tok WINDOW w AS (PARTITION BY key ORDER BY p))"""
    apart = f"nfc_normalize({column})"
    for code, letters in T._COMPOSED.items():
        apart = f"replace({apart}, '{chr(code)}', '{letters}')"
    return f"{_cut(name + '_t', source, apart, f'(?s)[{"".join(T.CONSONANTS)}]{T.NUKTA}?|.')}, {spelled}, {name} AS (SELECT key, string_agg(x, '' ORDER BY p) AS text FROM {name}_s GROUP BY key)"


def _devanagari_sql(name: str, source: str, column: str) -> str:
    """CTEs that end in name(key, text): a vowel after a consonant is a sign, a consonant without one gets a virama."""
    joined = f"""{name}_j AS (SELECT key, p, t.tok, s.kind, s.letter, lag(s.kind) OVER w AS before, lead(s.kind) OVER w AS following FROM {name}_t t LEFT JOIN sounds s ON t.tok = s.tok WINDOW w AS (PARTITION BY key ORDER BY p))"""
    spelled = f"""{name}_s AS (SELECT key, p, CASE WHEN kind = 'V' AND before = 'C' THEN coalesce(g.sign, '') WHEN kind = 'C' THEN letter || CASE WHEN following = 'V' THEN '' ELSE '{T.VIRAMA}' END ELSE coalesce(letter, j.tok) END AS x FROM {name}_j j LEFT JOIN signs g ON j.tok = g.tok)"""
    return f"{_cut(name + '_t', source, f'nfc_normalize({column})', f'(?s){_TOKENS}|.')}, {joined}, {spelled}, {name} AS (SELECT key, string_agg(x, '' ORDER BY p) AS text FROM {name}_s GROUP BY key)"


_BOTH = f"WITH {_SCRIPTS}, v AS (SELECT row_id AS key, devanagari, iast FROM verses), {_iast_sql('i', 'v', 'devanagari')}, {_devanagari_sql('d', 'v', 'iast')}"
_WRITTEN = "SELECT v.key AS row_id, CASE WHEN v.devanagari = '' THEN '' ELSE i.text END AS iast, CASE WHEN v.iast = '' THEN '' ELSE d.text END AS devanagari FROM v LEFT JOIN i ON v.key = i.key LEFT JOIN d ON v.key = d.key"


@query(f"{_BOTH} {_WRITTEN}")
def transliterate(spark, folder):
    """TR1, TR2, SO7: every verse field in the other script."""
    v = table(spark, folder, "verses")
    return v.select("row_id", T.as_column(T.to_iast, F.col("devanagari")).alias("iast"), T.as_column(T.to_devanagari, F.col("iast")).alias("devanagari"))


@query(f"""{_BOTH}, {_devanagari_sql('di', 'i', 'text')}, {_iast_sql('id', 'd', 'text')}
SELECT v.key AS row_id, 'devanagari' AS field, v.devanagari AS original, di.text AS back FROM v JOIN di ON v.key = di.key WHERE v.devanagari <> di.text
UNION ALL SELECT v.key, 'iast', v.iast, id.text FROM v JOIN id ON v.key = id.key WHERE v.iast <> id.text""")
def roundtrip(spark, folder):
    """TR5, DQ14: verse fields that do not come back from the other script, either way."""
    v = table(spark, folder, "verses")
    ways = {"devanagari": lambda t: T.to_devanagari(T.to_iast(t)), "iast": lambda t: T.to_iast(T.to_devanagari(t))}
    each = [v.select("row_id", F.lit(c).alias("field"), F.col(c).alias("original"), T.as_column(way, F.col(c)).alias("back")) for c, way in ways.items()]
    return each[0].unionByName(each[1]).where("original <> back")


@query(f"""{_BOTH}, w AS ({_WRITTEN}) SELECT 0::BIGINT AS to_iast, 0::BIGINT AS to_devanagari, count(*) AS strings, sum(length(iast))::BIGINT AS iast_chars, sum(length(devanagari))::BIGINT AS devanagari_chars FROM w""")
def engine_differential(spark, folder):
    """TR3, TR4, TR6: strings on which the two engines differ, over all verses, and how much the second one wrote."""
    v = table(spark, folder, "verses")
    one, two = T.as_column(T.to_iast, F.col("devanagari")), T.as_column(T.to_iast_by_syllable, F.col("devanagari"))
    three, four = T.as_column(T.to_devanagari, F.col("iast")), T.as_column(T.to_devanagari_by_syllable, F.col("iast"))
    both = v.select((~one.eqNullSafe(two)).alias("a"), (~three.eqNullSafe(four)).alias("b"), F.length(two).alias("m"), F.length(four).alias("n"))
    return both.agg(F.count_if("a").alias("to_iast"), F.count_if("b").alias("to_devanagari"), F.count("*").alias("strings"), F.sum("m").alias("iast_chars"), F.sum("n").alias("devanagari_chars"))


def _readings(spark, folder):
    copy = table(spark, folder, "triptych").select(F.explode("sanskrit").alias("s")).select("s.id", "s.speaker", "s.iast")
    one = copy.groupBy("id").agg(F.min(F.struct(F.coalesce("iast", F.lit("")).alias("iast"), F.coalesce("speaker", F.lit("")).alias("speaker"))).alias("c"))
    return one.select("id", F.nullif("c.speaker", F.lit("")).alias("speaker"), F.nullif("c.iast", F.lit("")).alias("iast"))


@query()
def witness_diff(spark, folder):
    """TR7-TR10, LX12, FN-S11, FN-S12, FN-S16, AG8: the text against its copy's IAST, the whole text of both."""
    return witness.witness_diff(units(spark, folder), _readings(spark, folder))


@query(_CURRENT + ", c AS (SELECT id, nullif(c.speaker, '') AS theirs FROM (SELECT s.id, min({'iast': coalesce(s.iast, ''), 'speaker': coalesce(s.speaker, '')}) AS c FROM (SELECT unnest(sanskrit) AS s FROM triptych) GROUP BY s.id)) SELECT u.id, u.speaker AS ours, c.theirs FROM units u JOIN c ON u.id = c.id WHERE u.speaker IS NOT NULL AND c.theirs IS NOT NULL AND NOT contains(u.speaker, c.theirs) AND NOT contains(c.theirs, u.speaker)")
def speaker_notes(spark, folder):
    """FLT17: speakers that the copy names otherwise."""
    return witness.speaker_notes(units(spark, folder), _readings(spark, folder))


def _poems(spark, folder):
    u = units(spark, folder).where(~is_blank(F.col("devanagari")))
    native = lambda c: F.translate(c.cast("string"), "0123456789", "०१२३४५६७८९")
    verse = F.concat(F.coalesce(F.concat("speaker", F.lit(" उवाच\n")), F.lit("")), "devanagari", F.lit(" ॥"), native(F.col("ch")), F.lit("-"), native(F.col("n")), F.lit("॥"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", verse.alias("t")))), lambda x: x["t"])
    return u.groupBy("ch").agg(F.array_join(lines, "\n").alias("poem"))


_LINES = r"regexp_replace(regexp_replace(regexp_replace(x, chr(39) || chr(39) || '+', '', 'g'), '<br\s*/?>|&nbsp;', ' ', 'g'), '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00AD}]', '', 'g')"


@query(_CURRENT + rf""", full_ AS (SELECT * FROM units WHERE devanagari IS NOT NULL AND trim(devanagari, E' \t\r\n\f') <> ''),
cut AS (SELECT *, list_filter(list_transform(string_split(devanagari, chr(10)), lambda x: regexp_replace({_LINES}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS l FROM full_)
SELECT ch, row_number() OVER (PARTITION BY ch ORDER BY n)::INT AS n, ch AS marked_ch, n AS marked_n, speaker, nfc_normalize(array_to_string(CASE WHEN regexp_matches(l[1], '^[^\s।॥]+(\s+[^\s।॥]+){{0,2}}\s+उवाच$') THEN l[2:] ELSE l END, chr(10))) AS devanagari FROM cut""")
def parse_poems(spark, folder):
    """SEG1, WN1, WN10, FN-S8: chapters written as poems with markers and cut into verses again."""
    return segmentation.parsed_poems(_poems(spark, folder))


@query(_CURRENT + ", full_ AS (SELECT * FROM units WHERE devanagari IS NOT NULL AND trim(devanagari, E' \\t\\r\\n\\f') <> '') SELECT ch, row_number() OVER (PARTITION BY ch ORDER BY n)::INT AS n, ch AS marked_ch, n AS marked_n, speaker FROM full_")
def poem_numbers(spark, folder):
    """SEG1, WN1, WN10: number, marker and speaker of each verse cut from its chapter's poem."""
    return segmentation.parsed_poems(_poems(spark, folder)).select("ch", "n", "marked_ch", "marked_n", "speaker")


@query()
def pack_texts(spark, folder):
    """JN12, SNK5: every review pack as Markdown."""
    notes = table(spark, folder, "draft").where("trim(coalesce(align_notes, '')) <> ''").select("id", F.concat(F.lit("**Notes:** "), "align_notes").alias("note")).distinct()
    status = library.pack_signoff(spark, folder).where("signed").select("pack_id", F.lit("approved").alias("status"))
    return packs.rendered(units(spark, folder), library.sections(spark, folder), notes, status)


def _drained(spark, query):
    """Run a stream over all that is there, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@query("""WITH u AS (SELECT DISTINCT id, ch FROM verses WHERE deleted_at IS NULL), p AS (SELECT DISTINCT progress_id, verse_id FROM progress WHERE verse_id IS NOT NULL)
SELECT u.ch, count(*) AS reads FROM p JOIN u ON p.verse_id = u.id GROUP BY u.ch""")
def live_counts_stream(spark, folder):
    """RX1, RX2: reads by section, computed by a stream over the table's files in complete mode."""
    events = stream.replay(spark, f"{folder}/progress.parquet")
    u = table(spark, folder, "verses").where("deleted_at is null").select("id", "ch").distinct()
    name = f"live_counts_{abs(hash(folder)) % 10**9}"
    _drained(spark, stream.live_section_counts(events, u).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", fresh_folder(spark)).start())
    return spark.table(name)


@query(library.ORACLES["event_debounce"].replace("SELECT reader_id, progress_id, verse_id FROM g", "SELECT reader_id, progress_id, read_at FROM g"))
def event_debounce_stream(spark, folder):
    """RX3, RX6, RX7: debounced reads from a stream with state and timers. The end of the table is an event of nobody far ahead
    in time, which lets the timers of all reads still open fire."""
    at = fresh_folder(spark)
    rows = table(spark, folder, "progress").select("reader_id", "progress_id", "read_at")
    end = rows.agg(F.max("read_at").alias("read_at")).select(F.lit(-1).cast("long").alias("reader_id"), F.lit(-1).cast("long").alias("progress_id"), (F.col("read_at") + F.expr("interval 1000 days")).alias("read_at"))
    end.write.parquet(f"{at}/end")
    events = stream.replay(spark, f"{folder}/progress.parquet").select("reader_id", "progress_id", "read_at").unionByName(stream.replay(spark, f"{at}/end"))
    out = stream.debounced(events, 3_600_000)
    _drained(spark, out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start())
    return spark.read.schema("reader_id long, progress_id long, read_at timestamp").parquet(f"{at}/out").where("reader_id >= 0").withColumn("read_at", F.col("read_at").cast("timestamp_ntz"))
