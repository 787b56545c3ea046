"""Text, quality and consensus queries with their SQL."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from versemill.functions import cleaning as C
from versemill.functions import lexical as L
from versemill.operators import consensus as A
from versemill.operators import quality as Q
from versemill.operators.search import prefix_search
from versemill.plans import library, scripts
from versemill.plans.library import _CURRENT, units
from versemill.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_TRIM = r"regexp_replace(%s, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')"


@query(_CURRENT + r"""SELECT ch, n, id, meaning FROM (SELECT *, list_transform(regexp_extract_all(lower(concat_ws(' ', id, meaning, takeaway, iast)), '[\p{L}\p{M}\p{Nd}]+'), lambda t: t) AS toks FROM units)
WHERE len(list_filter(toks, lambda t: starts_with(t, 'great'))) > 0 AND len(list_filter(toks, lambda t: starts_with(t, 's'))) > 0 ORDER BY ch, n LIMIT 50""")
def search_prefix_and(spark, folder):
    """FTS1, FN-S13, SO2, JN1: all words as prefixes in any column, first 50 in text order."""
    return prefix_search(units(spark, folder), "great* s*", ["id", "meaning", "takeaway", "iast"], ["ch", "n"]).select("ch", "n", "id", "meaning")


@query(r"SELECT feeling_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(line, '[ \t\r\n\f]+'), lambda w: regexp_replace(w, '[^\p{L}\p{Nd}]', '', 'g')), lambda w: w <> ''), lambda w: w || '*'), ' ') AS query FROM feelings")
def sanitize_query(spark, folder):
    """FN-S13: typed text to prefix terms."""
    return table(spark, folder, "feelings").select("feeling_id", C.sanitized_query(F.col("line")).alias("query"))


@query("SELECT draft_id, regexp_replace(meaning_simple, '<[^>]+>', '', 'g') AS text FROM draft WHERE meaning_simple LIKE '%<%'")
def strip_tags(spark, folder):
    """FN-S10: drafts with markup remains, without it."""
    return table(spark, folder, "draft").where("meaning_simple like '%<%'").select("draft_id", C.without_tags(F.col("meaning_simple")).alias("text"))


_REFS = "regexp_replace(text, '(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>', '', 'g')"
_MATH = rf"""array_to_string(list_transform(string_split({_REFS}, '<math>'), lambda x, i: CASE WHEN i = 1 THEN x WHEN NOT contains(x, '</math>') THEN ' ' || x
ELSE replace(regexp_replace(split_part(x, '</math>', 1), '\\mbox\{{([^}}]*)\}}', '\1', 'g'), chr(92), '') || substr(x, strpos(x, '</math>') + 7) END), '')"""
_MARKUP = f"regexp_replace({_MATH}, '<[^>]+>', ' ', 'g')"


@query(f"SELECT doc_id, {_TRIM % ('regexp_replace(' + _MARKUP + r''', '[ \t]+', ' ', 'g')''')} AS text FROM documents")
def clean_markup(spark, folder):
    """FN-S1: references, math and tags out of all documents."""
    return table(spark, folder, "documents").select("doc_id", C.without_markup(F.col("text")).alias("text"))


_QUOTES = "chr(39) || chr(39) || '+'"


@query("SELECT doc_id, " + _TRIM % f"regexp_replace(regexp_replace(regexp_replace(text, {_QUOTES}, '', 'g'), '<br[ \\t\\r\\n]*/?>|&nbsp;', ' ', 'g'), '{C.INVISIBLE}', '', 'g')" + " AS text FROM documents")
def clean_lines(spark, folder):
    """FN-S2, DQ16: wiki quotes, breaks, hard spaces and invisible characters out of all documents."""
    return table(spark, folder, "documents").select("doc_id", C.clean_line(F.col("text")).alias("text"))


_SCANS = rf"""p AS (SELECT chapter, unnest(telang_paras) AS p, generate_subscripts(telang_paras, 1) - 1 AS para FROM triptych),
cleaned AS (SELECT chapter, para::INT AS para, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(p.text, chr(10)), lambda x: NOT (regexp_matches({_TRIM % 'x'}, '^[0-9]{{1,3}}$') OR regexp_matches(replace({_TRIM % 'x'}, ' ', ''), '{C.HEAD_LINE}'))), chr(10)),
'([0-9A-Za-z_])-[ \t\r\n]*\n[ \t\r\n]*([0-9A-Za-z_])', '\1\2', 'g'), '[ \t]+', ' ', 'g') AS text FROM p)"""


@query(f"WITH {_SCANS} SELECT * FROM cleaned")
def clean_scans(spark, folder):
    """FN-S4: rule-based scan cleaning of every paragraph."""
    p = table(spark, folder, "triptych").select("chapter", F.posexplode("telang_paras").alias("para", "p"))
    return p.select("chapter", "para", C.clean_scan(F.col("p.text")).alias("text"))


@query(rf"""WITH {_SCANS}, cut AS (SELECT chapter, para, unnest(string_split(text, chr(10) || chr(10))) AS x, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM cleaned),
s AS (SELECT chapter, para, k::INT AS k, replace({_TRIM % 'x'}, chr(10), ' ') AS s FROM cut)
SELECT chapter, para, k, regexp_replace(s, '^[0-9]{{1,2}}[ \t]+([a-z])', '\1') AS text, length(s) < 40 AND regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '\p{{Ll}}') AS residue FROM s
WHERE s <> '' AND NOT regexp_matches(s, '{C.MARK}') AND NOT (length(s) < 40 AND (contains(s, 'APTER') OR contains(s, 'TKR'))) AND NOT (NOT contains(s, ' ') AND length(s) <= 28 AND regexp_matches(lower(s), '{C.HEAD_WORD}'))""")
def scan_paragraphs(spark, folder):
    """FLT10, FLT12, FLT13: paragraphs of the cleaned scans that are text, and which of them are a residue in capitals."""
    p = table(spark, folder, "triptych").select("chapter", F.posexplode("telang_paras").alias("para", "p")).select("chapter", "para", C.clean_scan(F.col("p.text")).alias("text"))
    cut = p.select("chapter", "para", F.posexplode(F.split("text", "\n\n")).alias("k", "x"))
    one = C.scan_paragraph(F.col("x"))
    residue = C.is_residue(F.replace(C.stripped(F.col("x")), F.lit("\n"), F.lit(" ")))
    return cut.select("chapter", "para", (F.col("k") + 1).alias("k"), one.alias("text"), residue.alias("residue")).where("text is not null")


@query(rf"""WITH p AS (SELECT chapter, unnest(telang_paras) AS p, generate_subscripts(telang_paras, 1) - 1 AS para FROM triptych), h AS (SELECT chapter, para::INT AS para, p.text AS t, strpos(lower(p.text), 'chapter') AS place FROM p WHERE contains(lower(p.text), 'chapter'))
SELECT chapter, para, place::INT AS place, coalesce(regexp_matches(list_filter(list_transform(string_split(substr(t, place, 120), chr(10)), lambda x: {_TRIM % 'x'}), lambda x: x <> '')[2], '^[0-9]{{1,3}}$'), false) AS headline FROM h""")
def chapter_marks(spark, folder):
    """FLT11: where paragraphs of the scans name a chapter, and whether that heads a page."""
    p = table(spark, folder, "triptych").select("chapter", F.posexplode("telang_paras").alias("para", "p")).select("chapter", "para", F.col("p.text").alias("t"))
    met = p.withColumn("place", F.locate("chapter", F.lower("t"))).where("place > 0")
    return met.select("chapter", "para", "place", C.is_running_headline(F.col("t"), F.col("place")).alias("headline"))


_NOTE = "(regexp_matches(%s, '" + C.FOOTNOTE_MARK.replace("'", "''") + "') OR (length(%s) < 150 AND regexp_matches(%s, ',?[ \\t\\n]+pp?\\.[ \\t\\n]*[0-9]')) OR regexp_matches(%s, '" + C.FOOTNOTE_OPENER + "'))"


@query(f"WITH p AS (SELECT chapter, unnest(telang_paras) AS p, generate_subscripts(telang_paras, 1) - 1 AS para FROM triptych) SELECT chapter, para::INT AS para, p.is_footnote AS marked, {_NOTE % ((_TRIM % 'p.text',) * 4)} AS looks FROM p")
def footnote_paragraphs(spark, folder):
    """FLT9, FLT14: what looks like a footnote against the mark it has."""
    p = table(spark, folder, "triptych").select("chapter", F.posexplode("telang_paras").alias("para", "p"))
    return p.select("chapter", "para", F.col("p.is_footnote").alias("marked"), C.looks_footnote(F.col("p.text")).alias("looks"))


_PARAS = """paras AS (SELECT chapter, printf('T%02d', k - 1) AS para, kept[k].text AS text FROM (SELECT chapter, kept, unnest(range(1, len(kept) + 1)) AS k FROM (SELECT chapter, list_filter(telang_paras, lambda p: NOT coalesce(p.is_footnote, false)) AS kept FROM triptych)))"""
_RECORDS = "recs AS (SELECT chapter, r.id, r.telang, r.arnold, r.notes FROM (SELECT chapter, unnest(records) AS r FROM align)), spans AS (SELECT chapter, id, i - 1 AS position, telang[i].para AS para, telang[i].anchors AS anchors FROM (SELECT *, unnest(range(1, len(telang) + 1)) AS i FROM recs))"


@query(f"WITH {_PARAS} SELECT chapter, para, length(text) AS size FROM paras")
def paragraph_numbering(spark, folder):
    """FLT8, FN-S15: paragraphs numbered after footnotes are dropped."""
    return A.coded_paragraphs(table(spark, folder, "triptych")).select("chapter", "para", F.length("text").cast("bigint").alias("size"))


_CONTEXTS = "ctx AS (SELECT s.id, string_agg(p.text, chr(10) || chr(10) ORDER BY s.position, p.text) AS context FROM spans s JOIN paras p ON s.chapter = p.chapter AND s.para = p.para GROUP BY s.id)"


@query(f"WITH {_PARAS}, {_RECORDS}, {_CONTEXTS} SELECT * FROM ctx")
def context_paragraphs(spark, folder):
    """JN8: each record's prose context."""
    return A.contexts(table(spark, folder, "align"), table(spark, folder, "triptych"))


_STANZAS = r"""cut AS (SELECT chapter, list_filter(list_transform(regexp_split_to_array(arnold, '\n[ \t]*\n'), lambda s: regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda s: s <> '') AS parts FROM triptych WHERE arnold IS NOT NULL),
stanza AS (SELECT r.id, c.parts[substr(r.arnold, 2)::INT + 1].regexp_replace('^(Sanjaya|Krishna|Arjuna|Dhritarashtra)\\.[ \\t\\r\\n]*', '') AS stanza FROM recs r JOIN cut c ON r.chapter = c.chapter WHERE regexp_matches(r.arnold, '^[A-Z][0-9]{1,6}$') AND substr(r.arnold, 2)::INT < len(c.parts))"""


@query(f"WITH {_RECORDS}, {_STANZAS} SELECT * FROM stanza")
def stanza_lookup(spark, folder):
    """JN9, SEG6: the stanza a record's code names."""
    return A.stanza_of(table(spark, folder, "align"), table(spark, folder, "triptych"))


@query(f"WITH {_PARAS}, {_RECORDS}, q AS (SELECT chapter, id, para, unnest(anchors) AS anchor FROM spans) SELECT DISTINCT q.id, q.para, q.anchor FROM q LEFT JOIN paras p ON q.chapter = p.chapter AND q.para = p.para WHERE p.text IS NULL OR NOT contains(p.text, q.anchor)")
def containment_refs(spark, folder):
    """JN14, DQ8: anchors their paragraph does not hold."""
    return A.unfound_anchors(table(spark, folder, "align"), table(spark, folder, "triptych"))


@query(f"""WITH {_PARAS}, {_RECORDS}, d AS (SELECT DISTINCT chapter, x.para FROM (SELECT chapter, unnest(dropped) AS x FROM align)), u AS (SELECT DISTINCT chapter, para FROM spans)
SELECT p.chapter, p.para, u.para IS NOT NULL AS used, d.para IS NOT NULL AS dropped, CASE WHEN u.para IS NOT NULL AND d.para IS NOT NULL THEN 'both' WHEN u.para IS NOT NULL THEN 'used' WHEN d.para IS NOT NULL THEN 'dropped' ELSE 'open' END AS state
FROM paras p LEFT JOIN u ON p.chapter = u.chapter AND p.para = u.para LEFT JOIN d ON p.chapter = d.chapter AND p.para = d.para""")
def paragraph_coverage(spark, folder):
    """JN15, DQ9, DQ17, AG12, AG16: which paragraphs are used, dropped or open."""
    return A.paragraph_coverage(table(spark, folder, "align"), table(spark, folder, "triptych"))


@query("SELECT n, CASE WHEN n BETWEEN 1 AND 199 THEN (['','C'])[n // 100 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[(n % 100) // 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[n % 10 + 1] END AS numeral, translate(n::VARCHAR, '0123456789', '०१२३४५६७८९') AS native FROM (SELECT DISTINCT n FROM chapters)")
def numerals(spark, folder):
    """FN-S5, FN-S9: chapter numbers as numerals and in native digits; the SQL has numerals up to 199."""
    n = F.col("n")
    return table(spark, folder, "chapters").select("n").distinct().select("n", C.roman_column(n).alias("numeral"), C.native_digits(n).alias("native"))


@query(r"""WITH l AS (SELECT unnest(string_split(p.text, chr(10))) AS line FROM (SELECT unnest(telang_paras) AS p FROM triptych)), h AS (SELECT regexp_extract(line, '^(?i:chapter) +([A-Za-z]+)(?:, *([0-9lOI. ]{1,8}))?', 1) AS raw, nullif(regexp_extract(line, '^(?i:chapter) +([A-Za-z]+), *([0-9lOI. ]{1,8})', 2), '') AS num FROM l WHERE regexp_matches(line, '^(?i:chapter) +[A-Za-z]+')),
r AS (SELECT * FROM (VALUES ('VIR', 7), ('XIR', 12), ('XNI', 13), ('RV', 4), ('M', 3), ('XVIIR', 18)) t(a, b)), k AS (SELECT * FROM (VALUES ('I',1),('II',2),('III',3),('IV',4),('V',5),('VI',6),('VII',7),('VIII',8),('IX',9),('X',10),('XI',11),('XII',12),('XIII',13),('XIV',14),('XV',15),('XVI',16),('XVII',17),('XVIII',18)) t(a, b))
SELECT h.raw, h.num, coalesce(r.b, k.b, r2.b)::INT AS chapter, CASE WHEN regexp_matches(translate(regexp_replace(h.num, '[ .]', '', 'g'), 'lIO', '110'), '^[0-9]{1,9}$') THEN translate(regexp_replace(h.num, '[ .]', '', 'g'), 'lIO', '110')::INT END AS verse, count(*) AS n
FROM h LEFT JOIN r ON upper(h.raw) = r.a LEFT JOIN k ON regexp_replace(h.raw, '[^IVXLCDM]', '', 'g') = k.a LEFT JOIN r r2 ON regexp_replace(h.raw, '[^IVXLCDM]', '', 'g') = r2.a GROUP BY ALL""")
def running_heads(spark, folder):
    """SEG4, FN-S6, FN-S7: chapter heads in the scans as read, with the numbers they stand for; the SQL has them up to XVIII."""
    lines = table(spark, folder, "triptych").select(F.explode("telang_paras").alias("p")).select(F.explode(F.split("p.text", "\n")).alias("line"))
    heads = lines.where(F.col("line").rlike("^(?i:chapter) +[A-Za-z]+")).select(F.regexp_extract("line", "^(?i:chapter) +([A-Za-z]+)", 1).alias("raw"), F.nullif(F.regexp_extract("line", "^(?i:chapter) +([A-Za-z]+), *([0-9lOI. ]{1,8})", 2), F.lit("")).alias("num"))
    return heads.groupBy("raw", "num").agg(F.count("*").alias("n")).select("raw", "num", C.read_roman(F.col("raw"), most=None).alias("chapter"), C.read_number(F.col("num")).alias("verse"), "n")


_CODES = [0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD, 0x2060, 0x34F, 0x200E, 0x200F, 0x180E]


@query(" UNION ALL ".join(f"SELECT row_id, '{f}' AS field, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({f}, '{C.INVISIBLE}'), lambda c: printf('%04X', unicode(c))))), ' ') AS codes FROM verses WHERE regexp_matches({f}, '{C.INVISIBLE}')" for f in ("devanagari", "iast")))
def invisible_chars(spark, folder):
    """DQ16, ST7: which invisible characters each field holds."""
    code = F.create_map(*(F.lit(x) for c in _CODES for x in (chr(c), f"{c:04X}")))
    out = None
    for f in ("devanagari", "iast"):
        found = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(f, F.lit(C.INVISIBLE), F.lit(0)), lambda c: F.try_element_at(code, c)))), " ")
        one = table(spark, folder, "verses").where(F.col(f).rlike(C.INVISIBLE)).select("row_id", F.lit(f).alias("field"), found.alias("codes"))
        out = one if out is None else out.unionByName(one)
    return out


_WORDS = "words AS (SELECT DISTINCT unnest(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(meaning), '\\^', '', 'g'), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w <> '')) AS word FROM verses)"


@query(f"WITH {_WORDS} SELECT word, {L.stem_sql('word')} AS stem, {L.negation_sql('word')} AS root FROM words")
def stem_tokens(spark, folder):
    """LX1, LX3: stem and negation root of every word."""
    words = table(spark, folder, "verses").select(F.explode(L.plain_words(F.col("meaning"))).alias("word")).distinct()
    return words.select("word", L.stem(F.col("word")).alias("stem"), L.negation_root(F.col("word")).alias("root"))


_STOP = ", ".join(map(repr, L.STOPWORDS))


def _map_sql(word: str, table: dict[str, str]) -> str:
    return f"coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in table.items())}}}[{word}], {word})"


def _form_sql(word: str) -> str:
    """A word by way of negation, alias and family."""
    return _map_sql(_map_sql(f"coalesce({L.negation_sql(word)}, {word})", L.ALIASES), L.family_forms())



def _lemmas_sql(source: str, key: str, text: str, out: str) -> str:
    """CTEs that end in out(key, lemma)."""
    clean = f"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({text}), '\\^', '', 'g'), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w <> '')"
    form = _form_sql("w")
    return f"""{out}_w AS (SELECT {key}, unnest({clean}) AS w FROM {source}), {out} AS (SELECT DISTINCT {key}, lemma FROM (
SELECT {key}, {L.stem_sql('f')} AS lemma FROM (SELECT {key}, {form} AS f FROM {out}_w WHERE w NOT IN ({_STOP})) UNION ALL SELECT {key}, {L.stem_sql('f')} FROM (SELECT {key}, left(w, length(w) - 2) AS f FROM {out}_w WHERE length(w) > 5 AND w LIKE '%ily')) WHERE lemma <> '')"""


@query(f"WITH {_lemmas_sql('verses', 'row_id', 'meaning', 'l')} SELECT * FROM l")
def lemma_sets(spark, folder):
    """LX2, LX4, LX5: content lemmas of every meaning."""
    return A.lemma_rows(table(spark, folder, "verses"), "row_id", "meaning")


_VOCAB = "vocab AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split_regex(regexp_replace(meaning, '[^A-Za-z ]', ' ', 'g'), ' +')) AS w FROM {src}) WHERE regexp_matches(w, '^[a-z]'))"


@query(f"WITH {_VOCAB.format(src='verses')} SELECT word FROM vocab")
def name_vocab(spark, folder):
    """LX7: ordinary words of the whole corpus."""
    return A.name_vocabulary(table(spark, folder, "verses"), "meaning")


def _nameless_sql(source: str, key: str) -> str:
    kept = f"kept AS (SELECT {key}, lower(w) AS word FROM (SELECT {key}, unnest(string_split_regex(regexp_replace(meaning, '[^A-Za-z ]', ' ', 'g'), ' +')) AS w FROM {source}) WHERE w <> '' AND (NOT regexp_matches(w, '^[A-Z]') OR lower(w) IN (SELECT word FROM vocab)))"
    return f"{_VOCAB.format(src=source)}, {kept}, {_lemmas_sql('kept', key, 'word', 'ours')}"


@query(f"WITH {_nameless_sql('verses', 'row_id')} SELECT * FROM ours")
def names_stripped(spark, folder):
    """LX8, FLT15: lemmas without names."""
    return A.nameless_lemma_rows(table(spark, folder, "verses").select("row_id", "meaning"), "row_id", "meaning")


_OLD = f"SELECT {L.stem_sql('x')} AS lemma, {L.stem_sql('y')} AS also FROM (SELECT {_form_sql('x')} AS x, {_form_sql('y')} AS y FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in L.ARCHAIC.items())}) t(x, y))"
_EDGES = f"""gl AS (SELECT {L.stem_sql('t')} AS t, {L.stem_sql('r')} AS r FROM (SELECT lower(term) AS t, lower(rendering) AS r FROM glossary WHERE term IS NOT NULL AND rendering IS NOT NULL AND NOT starts_with(term, '_'))),
edges AS (SELECT DISTINCT lemma, also FROM (SELECT t AS lemma, r AS also FROM gl UNION ALL SELECT r, t FROM gl UNION ALL {_OLD}) WHERE lemma <> also AND lemma <> '' AND also <> '')"""


@query(f"WITH src AS (SELECT ch || '/' || rendition || '/' || sent_no AS id, text FROM renderings), {_lemmas_sql('src', 'id', 'text', 'l')}, {_EDGES} SELECT id, lemma FROM l UNION SELECT l.id, e.also FROM l JOIN edges e ON l.lemma = e.lemma")
def lemma_expansion(spark, folder):
    """LX6, ST3: sentence lemmas grown by one step of synonyms."""
    rows = table(spark, folder, "renderings").select(F.concat_ws("/", "ch", "rendition", "sent_no").alias("id"), "text")
    return A.expanded(A.lemma_rows(rows, "id", "text"), "id", A.synonym_edges(table(spark, folder, "glossary")))


@query(f"""WITH src AS (SELECT chapter, p.text AS text FROM (SELECT chapter, unnest(telang_paras) AS p FROM triptych)), {_lemmas_sql('src', 'chapter', 'text', 'l')}, rend AS (SELECT ch || '/' || rendition || '/' || sent_no AS id, text FROM renderings), {_lemmas_sql('rend', 'id', 'text', 'r')},
t AS (SELECT DISTINCT lemma AS term FROM r), w AS (SELECT DISTINCT lemma FROM l WHERE length(lemma) >= 6 AND lemma NOT IN (SELECT term FROM t))
SELECT lemma, min(term) AS term FROM w JOIN t ON (length(lemma) >= 7 AND length(term) >= 6 AND abs(length(lemma) - length(term)) <= 2 AND levenshtein(lemma, term) <= 2) OR (length(lemma) = 6 AND length(term) = 6 AND levenshtein(lemma, term) <= 1) GROUP BY lemma""")
def fuzzy_lemma_match(spark, folder):
    """JN20, LX9: words of the scans that clean text has only in a like form."""
    scans = table(spark, folder, "triptych").select(F.explode("telang_paras").alias("p")).select(F.lit(1).alias("k"), F.col("p.text").alias("text"))
    clean = table(spark, folder, "renderings").select(F.lit(1).alias("k"), "text")
    return A.near_terms(A.lemma_rows(scans, "k", "text"), A.lemma_rows(clean, "k", "text").select(F.col("lemma").alias("term")))


def _coverage_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT o.id, count(*) AS total, count(*) FILTER (WHERE ok) AS covered, coalesce(string_agg(lemma, ' ' ORDER BY lemma) FILTER (WHERE NOT ok), '') AS uncovered FROM (
SELECT o.id, o.lemma, EXISTS (SELECT 1 FROM {source} s WHERE s.id = o.id AND (s.lemma = o.lemma OR (length(o.lemma) >= 7 AND length(s.lemma) >= 7 AND levenshtein(o.lemma, s.lemma) <= 2))) AS ok FROM ours o) o GROUP BY o.id)"""


_SIDES = f"""{_CURRENT}, {_PARAS}, {_RECORDS}, {_CONTEXTS}, {_STANZAS}, mean AS (SELECT id, meaning FROM units WHERE meaning IS NOT NULL), {_nameless_sql('mean', 'id')}, {_EDGES},
{_lemmas_sql('ctx', 'id', 'context', 'p')}, {_lemmas_sql('stanza', 'id', 'stanza', 'a')}, px AS (SELECT * FROM p UNION SELECT p.id, e.also FROM p JOIN edges e ON p.lemma = e.lemma), ax AS (SELECT * FROM a UNION SELECT a.id, e.also FROM a JOIN edges e ON a.lemma = e.lemma), {_coverage_sql('cp', 'px')}, {_coverage_sql('ca', 'ax')}"""


@query(_SIDES + " SELECT DISTINCT u.id, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(covered::DOUBLE / total, 1.0) AS share, coalesce(uncovered, '') AS uncovered FROM units u LEFT JOIN cp ON u.id = cp.id")
def coverage_prose(spark, folder):
    """LX9, LX10, AG15, JN19, ST1, ST2: how much of each meaning its prose context covers."""
    mean = units(spark, folder).where("meaning is not null").select("id", "meaning")
    source = A.lemma_rows(A.contexts(table(spark, folder, "align"), table(spark, folder, "triptych")), "id", "context")
    return A.coverage(A.nameless_lemma_rows(mean, "id", "meaning"), A.expanded(source, "id", A.synonym_edges(table(spark, folder, "glossary"))), "id", units(spark, folder))


@query(_SIDES + """, j AS (SELECT u.id, coalesce(cp.total, 0) AS n, coalesce(cp.covered, 0) AS p, coalesce(ca.covered, 0) AS v, coalesce(trim(ctx.context), '') = '' AS no_prose, s.stanza IS NULL AS no_verse,
coalesce(string_split(nullif(cp.uncovered, ''), ' '), []) AS op, coalesce(string_split(nullif(ca.uncovered, ''), ' '), []) AS ov FROM units u LEFT JOIN cp ON u.id = cp.id LEFT JOIN ca ON u.id = ca.id LEFT JOIN ctx ON u.id = ctx.id LEFT JOIN (SELECT DISTINCT id, true AS stanza FROM stanza) s ON u.id = s.id),
k AS (SELECT *, CASE WHEN n < 3 THEN 'NAME-LIST' WHEN no_prose THEN 'TELANG-ABSENT' WHEN no_verse THEN 'ARNOLD-ABSENT' WHEN p * 2 >= n AND v * 2 >= n THEN 'CONSENSUS' WHEN p * 2 >= n OR v * 2 >= n THEN 'SINGLE-SOURCE' ELSE 'ORPHAN' END AS status FROM j)
SELECT id, status, n AS total, p AS covered_prose, v AS covered_verse, CASE WHEN n >= 3 AND NOT no_prose THEN round_even(p::DOUBLE / n, 2) END AS share_prose, CASE WHEN n >= 3 AND (no_prose OR NOT no_verse) THEN round_even(v::DOUBLE / n, 2) END AS share_verse,
array_to_string(CASE status WHEN 'NAME-LIST' THEN [] WHEN 'CONSENSUS' THEN [] WHEN 'TELANG-ABSENT' THEN ov WHEN 'ARNOLD-ABSENT' THEN op WHEN 'SINGLE-SOURCE' THEN CASE WHEN p * 2 >= n THEN ov ELSE op END ELSE list_filter(op, lambda x: list_contains(ov, x)) END, ' ') AS uncovered FROM k""")
def consensus_verdicts(spark, folder):
    """LX11, ST4: the verdict ladder, with shares and what is left uncovered."""
    return A.verdicts(units(spark, folder), *(table(spark, folder, t) for t in ("align", "triptych", "glossary")))


_GRADE = """(CASE WHEN len(sents) = 0 OR len(ws) = 0 THEN 0.0::DOUBLE ELSE 0.39::DOUBLE * (len(ws)::DOUBLE / len(sents)) + 11.8::DOUBLE * (list_sum(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END))::DOUBLE / len(ws)) - 15.59::DOUBLE END)"""
_GRADED = rf"""graded AS (SELECT *, {_GRADE} AS g FROM (SELECT *, list_filter(string_split_regex(meaning_simple, '[.!?]+'), lambda s: regexp_replace(s, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') <> '') AS sents, regexp_extract_all(meaning_simple, '[A-Za-z'']+') AS ws FROM draft))"""


@query(f"WITH {_GRADED} SELECT draft_id, floor(g * 1000 + 0.5)::BIGINT AS grade_milli, round_even(g, 2) AS grade FROM graded WHERE meaning_simple IS NOT NULL")
def readability_grade(spark, folder):
    """LX13, FN-M3: grades of all drafts, in thousandths, and with two places, ties to the even one."""
    value = C.grade(F.col("meaning_simple"))
    return table(spark, folder, "draft").where("meaning_simple is not null").select("draft_id", F.floor(value * 1000 + 0.5).alias("grade_milli"), F.bround(value, 2).alias("grade"))


_BLANK = "coalesce(" + _TRIM + " = '', true)"
_DRAFT_RULES = f"""SELECT draft_id::VARCHAR AS id, 'approved' AS "check", coalesce(status, 'none') AS detail FROM draft WHERE status IS DISTINCT FROM 'approved'
UNION ALL SELECT draft_id::VARCHAR, 'blank-meaning_simple', 'meaning_simple' FROM draft WHERE status = 'approved' AND {_BLANK % 'meaning_simple'}
UNION ALL SELECT draft_id::VARCHAR, 'blank-takeaway', 'takeaway' FROM draft WHERE status = 'approved' AND {_BLANK % 'takeaway'}
UNION ALL SELECT draft_id::VARCHAR, 'grade', floor(g)::BIGINT::VARCHAR FROM graded WHERE status = 'approved' AND g > 8.0
UNION ALL SELECT draft_id::VARCHAR, 'provenance', 'none' FROM draft WHERE status = 'approved' AND coalesce(len(provenance), 0) < 1"""


def _draft_report(spark, folder):
    return Q.draft_rules(table(spark, folder, "draft"))


@query(f"SELECT draft_id, {_BLANK % 'meaning_simple'} AS no_meaning, {_BLANK % 'takeaway'} AS no_takeaway FROM draft")
def blank_fields(spark, folder):
    """FN-S17, DQ2: blank fields of drafts."""
    return table(spark, folder, "draft").select("draft_id", C.is_blank(F.col("meaning_simple")).alias("no_meaning"), C.is_blank(F.col("takeaway")).alias("no_takeaway"))


_LEAKS = """SELECT DISTINCT d.doc_id AS id, g.term, g.rendering FROM documents d, (SELECT DISTINCT lower(term) AS term, lower(rendering) AS rendering FROM glossary WHERE term IS NOT NULL AND rendering IS NOT NULL AND NOT starts_with(term, '_')) g
WHERE contains(lower(d.text), g.term) AND NOT contains(lower(d.text), g.rendering)"""


@query(_LEAKS)
def glossary_leaks(spark, folder):
    """LX14, DQ5: terms of the glossary left in documents without their rendering."""
    return Q.glossary_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "glossary"))


_ALIGN_RULES = r"""SELECT id, 'quarantine-note' AS "check", 'no spans' AS detail FROM recs WHERE coalesce(len(telang), 0) = 0 AND coalesce(trim(notes), '') = ''
UNION ALL SELECT chapter || '', 'id-coverage', 'ids are not 1..' || count(*) FROM (SELECT DISTINCT chapter, split_part(id, ':', 2)::INT AS n FROM recs) GROUP BY chapter HAVING min(n) <> 1 OR max(n) <> count(*)
UNION ALL SELECT c.ch || '', 'verse-count', c.verse_count || ' registered' FROM toc c LEFT JOIN (SELECT ch, count(DISTINCT n) AS k FROM units GROUP BY ch) u ON c.ch = u.ch WHERE coalesce(u.k, 0) <> c.verse_count
UNION ALL SELECT id, 'blank-iast', 'iast' FROM units WHERE """ + _BLANK % "iast" + r"""
UNION ALL SELECT id, 'verse-id', ch || ':' || n FROM units WHERE id <> ch || ':' || n
UNION ALL SELECT feeling_id::VARCHAR, 'feelings-ref', v FROM (SELECT DISTINCT feeling_id, unnest(verses) AS v FROM feelings) f WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM verses WHERE verses.id = f.v)
UNION ALL SELECT row_id::VARCHAR, 'nfc', 'iast' FROM verses WHERE iast <> nfc_normalize(iast)
UNION ALL SELECT row_id::VARCHAR, 'nfc', 'devanagari' FROM verses WHERE devanagari <> nfc_normalize(devanagari)
UNION ALL SELECT id, 'blank-devanagari', 'devanagari' FROM units WHERE """ + _BLANK % "devanagari" + f"""
UNION ALL SELECT DISTINCT s.id, 'unknown-para', s.para FROM spans s LEFT JOIN paras p ON s.chapter = p.chapter AND s.para = p.para WHERE p.para IS NULL
UNION ALL SELECT DISTINCT q.id, 'anchor', q.anchor FROM (SELECT chapter, id, para, unnest(anchors) AS anchor FROM spans) q JOIN paras p ON q.chapter = p.chapter AND q.para = p.para WHERE NOT contains(p.text, q.anchor)
UNION ALL SELECT c.chapter || '/' || c.para, CASE WHEN u AND d THEN 'dropped-and-used' ELSE 'para-coverage' END, c.para FROM (SELECT chapter, para, EXISTS (SELECT 1 FROM spans s WHERE s.chapter = p.chapter AND s.para = p.para) AS u, EXISTS (SELECT 1 FROM (SELECT chapter, unnest(dropped) AS x FROM align) g WHERE g.chapter = p.chapter AND g.x.para = p.para) AS d FROM paras p) c WHERE u = d
UNION ALL SELECT DISTINCT draft_id::VARCHAR, 'glossary', g.term FROM draft d, (SELECT DISTINCT lower(term) AS term, lower(rendering) AS rendering FROM glossary WHERE term IS NOT NULL AND rendering IS NOT NULL AND NOT starts_with(term, '_')) g
WHERE d.status = 'approved' AND contains(lower(concat_ws(' ', d.meaning_simple, d.takeaway)), g.term) AND NOT contains(lower(concat_ws(' ', d.meaning_simple, d.takeaway)), g.rendering)
UNION ALL SELECT row_id::VARCHAR, 'invisible-char', field || ' ' || codes FROM ({ORACLES['invisible_chars']})
UNION ALL SELECT row_id::VARCHAR, 'round-trip', field FROM ({scripts.ORACLES['roundtrip']})"""


def _report(spark, folder):
    @F.pandas_udf("boolean")
    def off_form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t is not None and unicodedata.normalize("NFC", t) != t)

    u, toc, align = units(spark, folder), library.sections(spark, folder), table(spark, folder, "align")
    recs = A.records(align)
    numbers = recs.select("chapter", F.split_part("id", F.lit(":"), F.lit(2)).cast("int").alias("n")).distinct().groupBy("chapter").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    sizes = toc.join(u.groupBy("ch").agg(F.count_distinct("n").alias("k")), "ch", "left")
    joined = F.concat_ws(":", "ch", "n")
    dangling = library.dangling_refs(spark, folder)
    pages = table(spark, folder, "triptych")
    codes = A.coded_paragraphs(pages).select("chapter", "para")
    unknown = A.spans(align).select("chapter", "id", "para").distinct().join(codes, ["chapter", "para"], "left_anti").select("id", "para").distinct()
    quotes = A.unfound_anchors(align, pages).join(unknown, ["id", "para"], "left_anti").select("id", "anchor").distinct()
    covered = A.paragraph_coverage(align, pages)
    approved = table(spark, folder, "draft").where("status = 'approved'").select("draft_id", F.concat_ws(" ", "meaning_simple", "takeaway").alias("blob"))
    leaks = Q.glossary_leaks(approved, "draft_id", "blob", table(spark, folder, "glossary")).select("id", "term").distinct()
    return Q.report([
        *_draft_report(spark, folder),
        Q.violations(recs, F.col("id"), "quarantine-note", (F.coalesce(F.size("telang"), F.lit(0)) == 0) & (F.coalesce(F.trim("notes"), F.lit("")) == ""), F.lit("no spans")),
        Q.violations(numbers, F.col("chapter"), "id-coverage", (F.col("lo") != 1) | (F.col("hi") != F.col("k")), F.concat(F.lit("ids are not 1.."), F.col("k"))),
        Q.violations(sizes, F.col("ch"), "verse-count", F.coalesce("k", F.lit(0)) != F.col("verse_count"), F.concat(F.col("verse_count"), F.lit(" registered"))),
        Q.violations(u, F.col("id"), "blank-iast", C.is_blank(F.col("iast")), F.lit("iast")),
        Q.violations(u, F.col("id"), "verse-id", F.col("id") != joined, joined),
        Q.violations(dangling, F.col("feeling_id"), "feelings-ref", F.lit(True), F.col("ref")),
        *(Q.violations(table(spark, folder, "verses"), F.col("row_id"), "nfc", off_form(F.col(c)), F.lit(c)) for c in ("iast", "devanagari")),
        Q.violations(u, F.col("id"), "blank-devanagari", C.is_blank(F.col("devanagari")), F.lit("devanagari")),
        Q.violations(unknown, F.col("id"), "unknown-para", F.lit(True), F.col("para")),
        Q.violations(quotes, F.col("id"), "anchor", F.lit(True), F.col("anchor")),
        Q.violations(covered.where("state = 'open'"), F.concat_ws("/", "chapter", "para"), "para-coverage", F.lit(True), F.col("para")),
        Q.violations(covered.where("state = 'both'"), F.concat_ws("/", "chapter", "para"), "dropped-and-used", F.lit(True), F.col("para")),
        Q.violations(leaks, F.col("id"), "glossary", F.lit(True), F.col("term")),
        Q.violations(invisible_chars(spark, folder), F.col("row_id"), "invisible-char", F.lit(True), F.concat_ws(" ", "field", "codes")),
        Q.violations(scripts.roundtrip(spark, folder), F.col("row_id"), "round-trip", F.lit(True), F.col("field")),
    ])


#: The rules of the report by name.
RULES = (
    "approved blank-meaning_simple blank-takeaway grade provenance quarantine-note id-coverage verse-count blank-iast blank-devanagari verse-id feelings-ref nfc "
    "unknown-para anchor para-coverage dropped-and-used glossary invisible-char round-trip"
).split()


_ALL_RULES = f"{_CURRENT}, {_PARAS}, {_RECORDS}, {_GRADED}, found AS ({_DRAFT_RULES} UNION ALL {_ALIGN_RULES})"


@query(_ALL_RULES + " SELECT * FROM found")
def quality_report(spark, folder):
    """DQ1-DQ12, DQ14, DQ16, DQ17: all rules as rows."""
    return _report(spark, folder)


@query(_ALL_RULES + f""" SELECT r."check", count(f.id) AS n, count(f.id) = 0 AS passes FROM (SELECT unnest([{', '.join(f"'{r}'" for r in RULES)}]) AS "check") r LEFT JOIN found f ON r."check" = f."check" GROUP BY r."check" """)
def quality_gate(spark, folder):
    """SNK3: violations of every rule; an export is refused unless all pass."""
    rules = spark.range(1).select(F.explode(F.lit(RULES)).alias("check"))
    return rules.join(_report(spark, folder), "check", "left").groupBy("check").agg(F.count("id").alias("n"), (F.count("id") == 0).alias("passes"))


@query("""WITH t AS (SELECT n, 'v' || (n // 4) || '.' || (n % 4) AS a, (n // 5) || '.' || (n % 5) || '.0' AS b FROM chapters), p AS (SELECT DISTINCT *, list_transform(string_split(ltrim(a, 'vV'), '.'), lambda x: coalesce(try_cast(x AS INT), 0)) || [0] AS x, list_transform(string_split(b, '.'), lambda x: coalesce(try_cast(x AS INT), 0)) AS y FROM t)
SELECT n, a, b, (CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END)::INT AS sign FROM p""")
def version_compare(spark, folder):
    """FN-V1: versions made of chapter numbers, compared."""
    n = F.col("n")
    t = table(spark, folder, "chapters").select("n", F.concat(F.lit("v"), F.floor(n / 4), F.lit("."), n % 4).alias("a"), F.concat(F.floor(n / 5), F.lit("."), n % 5, F.lit(".0")).alias("b")).distinct()
    return t.select("n", "a", "b", C.compare_versions(F.col("a"), F.col("b")).alias("sign"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f', floor(n_chars / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n_chars / 1048576 * 10 + 0.5) / 10) || ' MB' END AS size FROM documents")
def format_bytes(spark, folder):
    """FN-M4: sizes for people."""
    return table(spark, folder, "documents").select("doc_id", C.bytes_text(F.col("n_chars")).alias("size"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, coalesce(json_extract_string(props, '$.ref'), 'none') AS ref FROM events")
def json_props(spark, folder):
    """FN-J1, FN-P1: fields of a JSON column, unknown keys ignored, defaults for missing ones."""
    p = F.from_json("props", "page string, ref string")
    return table(spark, folder, "events").select("event_id", p["page"].alias("page"), F.coalesce(p["ref"], F.lit("none")).alias("ref"))
