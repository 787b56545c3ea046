"""Cleaning of marked-up and scanned text as column expressions; no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^[ \t\r\n\f]+|[ \t\r\n\f]+$"
# fixed values: opening marks and openers by which a footnote paragraph is told
FOOTNOTE_MARK = r"^['®^•*\-–0-9‘’“”‟\"\[■]"
FOOTNOTE_OPENER = r"^(Literally|The original|In the original|Who, as|That is|I\.?e\.?|l\.e\.?|Several of these|This is a|Sew|SeWeg|Schlegel|Nilakantha|Lassen|Cf\.|Scil)"
# fixed values: characters that show nothing
INVISIBLE = "[​‌‍﻿­⁠͏‎‏᠎]"


def stripped(text: Column) -> Column:
    """Without white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only (FN-S17)."""
    return F.coalesce(stripped(text) == "", F.lit(True))


def without_tags(text: Column) -> Column:
    """Tags removed (FN-S10)."""
    return F.regexp_replace(text, "<[^>]+>", "")


def without_markup(text: Column) -> Column:
    """References dropped, math unwrapped, other tags a space, runs of blanks one (FN-S1)."""
    text = F.regexp_replace(text, r"(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", "")

    def plain_math(part: Column, k: Column) -> Column:
        """What follows an opening tag: up to the closing one without boxes and backslashes, then as it is."""
        inner = F.substring_index(part, "</math>", 1)
        rest = F.substring(part, F.length(inner) + len("</math>") + 1, F.length(part))
        bare = F.replace(F.regexp_replace(inner, r"\\mbox\{([^}]*)\}", "$1"), F.lit("\\"), F.lit(""))
        return F.when(k == 0, part).when(F.contains(part, F.lit("</math>")), F.concat(bare, rest)).otherwise(F.concat(F.lit(" "), part))

    text = F.array_join(F.transform(F.split(text, "<math>"), plain_math), "")
    return stripped(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "[ \t]+", " "))


def clean_line(line: Column) -> Column:
    """Quote marks of bold and italics, line-break tags, hard spaces and invisible characters removed (FN-S2)."""
    line = F.regexp_replace(F.regexp_replace(line, "''+", ""), r"<br[ \t\r\n]*/?>|&nbsp;", " ")
    return stripped(F.regexp_replace(line, INVISIBLE, ""))


def poems(text: Column) -> Column:
    """Bodies of all poem elements, a line each (FN-S3)."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<poem>(.*?)</poem>"), F.lit(1)), "\n")


# fixed values: how scans print the book's running head, a chapter's mark or a signature, and what is left of misread chapter marks
HEAD_LINE, HEAD_WORD = r"^B[IHA]{2,}[A-Z.]*$", "^b.*gav?a?d"
MARK = r"^[0-9]{1,3}$|^\.?(?i:chapter)[ \t]+[IVXivx]+[ \t]*,?[ \t]*[^ \t]{0,8}\.?$|^[A-Za-z][ \t]+[0-9]{1,3}$"
MARK_PARTS = ("APTER", "TKR")


def is_page_matter(line: Column) -> Column:
    """A line that is a lone page number or the book's running head (FN-S4)."""
    return stripped(line).rlike("^[0-9]{1,3}$") | F.replace(stripped(line), F.lit(" "), F.lit("")).rlike(HEAD_LINE)


def clean_scan(text: Column) -> Column:
    """Page matter dropped, words broken over lines joined, runs of blanks one (FN-S4)."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~is_page_matter(x))
    # fixed value: the letters and blanks around a break
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"([0-9A-Za-z_])-[ \t\r\n]*\n[ \t\r\n]*([0-9A-Za-z_])", "$1$2")
    return F.regexp_replace(joined, "[ \t]+", " ")


def is_running_head(paragraph: Column) -> Column:
    """The book's running head as one misread word (FLT10)."""
    s = stripped(paragraph)
    return ~F.contains(s, F.lit(" ")) & (F.length(s) <= 28) & F.lower(s).rlike(HEAD_WORD)


def is_running_headline(text: Column, at: Column) -> Column:
    """Whether a chapter's mark at a 1-based place heads a page: the next line that is not blank is a lone page number (FLT11)."""
    lines = F.filter(F.transform(F.split(F.substring(text, at, F.lit(120)), "\n"), stripped), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(2)).rlike("^[0-9]{1,3}$"), F.lit(False))


def is_residue(paragraph: Column) -> Column:
    """A short paragraph all in capitals (FLT13)."""
    s = stripped(paragraph)
    return (F.length(s) < 40) & s.rlike("\\p{Lu}") & ~s.rlike("\\p{Ll}")


def scan_paragraph(paragraph: Column) -> Column:
    """A scanned paragraph on one line, a marginal number before its first word dropped; null where it is a number, a mark of
    a chapter, a signature, a misread mark or a running head (FLT12)."""
    s = F.replace(stripped(paragraph), F.lit("\n"), F.lit(" "))
    misread = (F.length(s) < 40) & (F.contains(s, F.lit(MARK_PARTS[0])) | F.contains(s, F.lit(MARK_PARTS[1])))
    return F.when((s != "") & ~s.rlike(MARK) & ~misread & ~is_running_head(s), F.regexp_replace(s, "^[0-9]{1,2}[ \t]+([a-z])", "$1"))


def looks_footnote(text: Column) -> Column:
    """Opens with a mark or a note's opener, or is a short citation of a page (FLT9, FLT14)."""
    s = stripped(text)
    return s.rlike(FOOTNOTE_MARK) | ((F.length(s) < 150) & s.rlike(r",?[ \t\n]+pp?\.[ \t\n]*[0-9]")) | s.rlike(FOOTNOTE_OPENER)


# fixed values: what stands for 0..9 of hundreds, tens and ones; thousands are so many M
_PLACES = tuple((10**k, ["", i, i * 2, i * 3, i + v, v, v + i, v + i * 2, v + i * 3, i + x]) for k, i, v, x in ((2, "C", "D", "M"), (1, "X", "L", "C"), (0, "I", "V", "X")))
_NUMERAL = "^(M*)(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def roman(n: int) -> str:
    """A number as a numeral (FN-S5)."""
    return "M" * (n // 1000) + "".join(signs[n // value % 10] for value, signs in _PLACES)


def roman_column(n: Column) -> Column:
    """The numeral of any number from 1; null below."""
    places = [F.element_at(F.lit(signs), (F.floor(n / value) % 10 + 1).cast("int")) for value, signs in _PLACES]
    return F.when(n >= 1, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *places))


def roman_value(s: Column) -> Column:
    """The number of a well-formed numeral of any length, or null."""
    places = [(F.array_position(F.lit(signs), F.regexp_extract(s, _NUMERAL, k)) - 1) * value for k, (value, signs) in enumerate(_PLACES, start=2)]
    return F.when(s.rlike(_NUMERAL) & (s != ""), sum(places, F.length(F.regexp_extract(s, _NUMERAL, 1)) * 1000).cast("int"))


# fixed values: numerals as scans misread them
_MISREAD_ROMAN = {"VIR": 7, "XIR": 12, "XNI": 13, "RV": 4, "M": 3, "XVIIR": 18}


def read_roman(raw: Column, most: int | None = 18) -> Column:
    """The number of a numeral as scanned, 1..most, or null (FN-S6); with no most, numerals of any size.

    Beyond the reference's 18 no letter is dropped: what is no numeral as it stands is read in capitals, then with l for I.
    """
    table = {roman(i): i for i in range(1, (most or 18) + 1)}
    known = F.create_map(*(F.lit(x) for kv in {**table, **_MISREAD_ROMAN}.items() for x in kv))
    misread = F.create_map(*(F.lit(x) for kv in _MISREAD_ROMAN.items() for x in kv))
    small = F.coalesce(F.try_element_at(misread, F.upper(raw)), F.try_element_at(known, F.regexp_replace(raw, "[^IVXLCDM]", "")))
    return small if most else F.coalesce(small, *(roman_value(x) for x in (raw, F.upper(raw), F.translate(raw, "l", "I"))))


def read_number(raw: Column) -> Column:
    """The number of digits as scanned: blanks and points dropped, l and I for 1, O for 0; null otherwise (FN-S7)."""
    s = F.translate(F.regexp_replace(raw, "[ .]", ""), "lIO", "110")
    return F.when(s.rlike("^[0-9]{1,9}$"), s.cast("int"))


def native_digits(n: Column) -> Column:
    """A number in Devanagari digits (FN-S9)."""
    return F.translate(n.cast("string"), "0123456789", "०१२३४५६७८९")


def sanitized_query(raw: Column) -> Column:
    """Prefix terms of a typed query: words reduced to letters and digits, each with a star (FN-S13)."""
    words = F.filter(F.transform(F.split(raw, r"[ \t\r\n\f]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]", "")), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("*"))), " ")


def bytes_text(n: Column) -> Column:
    """B, KB or MB with one decimal (FN-M4)."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + F.lit(0.5)) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MB")))


def version_parts(tag: Column) -> Column:
    """A version's numbers; v dropped, what is no number 0 (FN-V1)."""
    return F.transform(F.split(F.regexp_replace(F.trim(tag), "^[vV]", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1, number by number, missing ones 0 (FN-V1)."""
    x, y = version_parts(a), version_parts(b)
    size = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), size - F.size(v)))
    signs = F.filter(F.zip_with(pad(x), pad(y), lambda p, q: F.signum((p - q).cast("double")).cast("int")), lambda s: s != 0)
    return F.coalesce(F.try_element_at(signs, F.lit(1)), F.lit(0))


def grade(text: Column) -> Column:
    """Flesch-Kincaid grade by vowel groups; a capitalized word counts one syllable, empty text 0 (LX13)."""
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: stripped(s) != ""))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))

    def syllables(w: Column) -> Column:
        groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
        silent = F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)
        return F.when(w.rlike("^[A-Z]"), 1).otherwise(F.greatest(F.lit(1), groups - silent))

    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, b: a + b)
    n = F.size(words)
    value = F.lit(0.39) * (n / sentences) + F.lit(11.8) * (total / n) - F.lit(15.59)
    return F.when((sentences > 0) & (n > 0), value).otherwise(F.lit(0.0))
