"""Visually identical text with different characters (problem 4): confusables skeleton and plain coding."""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.runtime import small, stored

# fixed values: marks that look like the bar between half verses, and like a visarga
_BARS, _COLONS = "|।│ǀ｜∣❘⎮⏐׀", ":：꞉ः׃︓ː᛬⁚։∶܃܄"
# fixed values: sequences of vowels and vowel signs that look like one sign and that the public table does not list
_SIGNS = {"अो": "ओ", "अौ": "औ", "आे": "ओ", "आै": "औ", "ाे": "ो", "ाै": "ौ", "ेा": "ो", "ैा": "ौ"}
# fixed values: letters without a Latin prototype in the public table that print like one, each before it
_ALSO = "κk ĸk ӏl ԝw ѡw ԛq հh սu ոn ցg ɩi γy νv"


def _public_confusables() -> dict[str, str]:
    """Character to prototype of the Unicode confusables table (UTS 39), read from the ICU library that comes with Spark.

    The file is ICU's own: a data header, then keys (code point and length of its prototype), an index and a string table.
    """
    homes = [os.path.join(os.path.dirname(pyspark.__file__), "jars"), os.path.join(os.environ.get("SPARK_HOME", ""), "jars")]
    jar = next((x for home in homes for x in sorted(glob.glob(os.path.join(home, "icu4j-*.jar")))), None)
    if jar is None:
        raise FileNotFoundError("no icu4j library among Spark's jars: the public confusables table is read from it")
    with zipfile.ZipFile(jar) as z:
        data = z.read(next(x for x in z.namelist() if x.endswith("/confusables.cfu")))
    data = data[struct.unpack_from(">H", data)[0] :]
    keys, n, index, _, strings, size = struct.unpack_from(">6I", data, 12)
    text = data[strings : strings + 2 * size]
    out = {}
    for i, (key, at) in enumerate(zip(struct.unpack_from(f">{n}I", data, keys), struct.unpack_from(f">{n}H", data, index))):
        length = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(at) if length == 1 else text[2 * at : 2 * (at + length)].decode("utf-16-be")
    return out


_CONFUSABLES = _public_confusables()


def _is_home(ch: str, script: str) -> bool:
    """Whether a character is a usual one of the script's plain texts: the Devanagari block; or ASCII, and marks on it."""
    if script == "devanagari":
        return "ऀ" <= ch <= "ॿ" or "꣠" <= ch <= "ꣿ"
    return ch < "\x7f" or "̀" <= ch <= "ͯ"


def _homes(script: str) -> dict[str, list[str]]:
    """Skeleton of the public table to the script's own characters that have it, the one that is its own skeleton first."""
    out: dict[str, list[str]] = {}
    block = [*range(0x20, 0x7F)] if script == "latin" else [*range(0x900, 0x980), *range(0xA8E0, 0xA900)]
    for ch in sorted(map(chr, block), key=lambda c: (c in _CONFUSABLES, not c.isalpha(), c)):
        if unicodedata.category(ch)[0] in "LMN":
            out.setdefault(_CONFUSABLES.get(ch, ch), []).append(ch)
    return out


_SKELETONS = {script: _homes(script) for script in ("devanagari", "latin")}
_EXTRA = {x[0]: x[1] for x in _ALSO.split()}
#: Sequences of the script's own characters that the public table gives one of its characters as skeleton. With a virama
#: they are consonants before a vowel, which print apart.
_SEQUENCES = {s: c for c, s in _CONFUSABLES.items() if len(s) > 1 and "ऀ" <= c <= "ॿ" and all("ऀ" <= x <= "ॿ" for x in s) and "्" not in s} | _SIGNS
_SEQUENCE = re.compile("|".join(sorted(map(re.escape, _SEQUENCES), key=len, reverse=True)))
_NAMED = re.compile(r"LATIN (?:LETTER SMALL CAPITAL|(SMALL|CAPITAL) LETTER) ([A-Z])(?: WITH (?:FISH)?HOOK)?$")


def _look_alike(ch: str, script: str) -> str:
    """The script's own character or letters that a foreign letter, mark or digit looks like; itself if none does."""
    seen = _CONFUSABLES.get(ch, ch)
    homes = _SKELETONS[script].get(seen)
    if homes:  # a capital stands for a capital, a digit for a digit, where the table takes them together
        return next((x for x in homes if unicodedata.category(x) == unicodedata.category(ch)), homes[0])
    if script == "latin":
        if ch in _EXTRA:
            return _EXTRA[ch]
        if len(seen) > 1 and seen.isascii() and seen.isalnum():
            return seen
        named = _NAMED.match(unicodedata.name(ch, ""))  # small capitals and hooked letters, which the table leaves alone
        if named:
            return named[2] if named[1] == "CAPITAL" else named[2].lower()
    return ch


def _prototype(ch: str, script: str) -> str:
    """What stands for a character in plain text of a script, 'devanagari' or 'latin'; '' for invisible ones."""
    if ch in " \n":
        return ch
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch in "\t\x0b\x0c":
        return " "
    if kind in ("Zl", "Zp") or ch in "\r\x85":
        return "\n"
    if kind in ("Cf", "Cc") or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180F:
        return ""
    if ch in _BARS:
        return "।" if script == "devanagari" else "|"
    if ch in _COLONS:
        return "ः" if script == "devanagari" else ":"
    return ch if kind[0] not in "LMN" or _is_home(ch, script) else _look_alike(ch, script)


class _Prototypes(dict):
    """The prototypes of a script by code point, worked out when a character is first met."""

    def __init__(self, script: str):
        self.script = script

    def __missing__(self, code: int) -> str:
        self[code] = _prototype(chr(code), self.script)
        return self[code]


_TABLES = {script: _Prototypes(script) for script in ("devanagari", "latin")}


def skeleton(text: str | None, script: str) -> str | None:
    """Decompose, put each character's prototype in its place, decompose again; once more as long as that changes something."""
    if text is None:
        return None
    while True:
        out = unicodedata.normalize("NFKD", text).translate(_TABLES[script])
        if script == "devanagari":
            out = _SEQUENCE.sub(lambda m: _SEQUENCES[m[0]], out)
        out = unicodedata.normalize("NFD", out)
        if out == text or len(out) == 0:
            return out
        text = out


def plain(text: str | None, script: str) -> str | None:
    """The plain coding: the skeleton, composed."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text, script))


def _foreign(text: str, script: str) -> bool:
    """Whether a letter of another script is left."""
    home = "DEVANAGARI" if script == "devanagari" else "LATIN"
    return not all(unicodedata.name(ch, "").startswith(home) for ch in set(text) if ch.isalpha())


def is_plain(text: str | None, script: str) -> bool:
    """Whether a text is its own plain coding and has no letter of a foreign script left. Null and empty texts are."""
    return not text or (text == plain(text, script) and not _foreign(text, script))


def long_form(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(row_id, field, script, original), one row for each record and field that is not null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("script"), df[f].alias("original")) for f, s in fields.items()))
    return df.select(df[id_col].cast("long").alias("row_id"), F.explode(pairs).alias("x")).select("row_id", "x.field", "x.script", "x.original").where("original is not null")


def normal_forms(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Long form (row_id, field, original, plain, skeleton, foreign), one row for each record and field that is not null.

    fields maps a column to its script, 'devanagari' or 'latin'. Texts equal in looks have equal skeletons; foreign says
    whether a letter of another script without a look-alike is left. Null fields give no row, empty ones an empty plain
    text. One narrow pass in Arrow batches, no shuffle.
    """

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bare = [skeleton(t, s) for t, s in zip(pdf.original, pdf.script)]
            composed = [unicodedata.normalize("NFC", b) for b in bare]
            yield pd.DataFrame({"row_id": pdf.row_id, "field": pdf.field, "original": pdf.original, "plain": composed, "skeleton": bare, "foreign": [_foreign(t, s) for t, s in zip(composed, pdf.script)]})

    return long_form(df, id_col, fields).mapInPandas(forms, "row_id long, field string, original string, plain string, skeleton string, foreign boolean")


def _variants(forms: DataFrame) -> DataFrame:
    """(field, skeleton, original, n, plain, foreign): the codings of each group of equal skeletons, counted.

    Equal originals are counted before they meet their group, so a hot text is one row.
    """
    return forms.groupBy("field", "skeleton", "original").agg(F.count("*").alias("n"), F.min("plain").alias("plain"), F.max("foreign").alias("foreign"))


def lookalike_groups(forms: DataFrame) -> DataFrame:
    """Groups of differing originals with one skeleton: (field, skeleton, variants, records, plain), only with two variants or more."""
    groups = _variants(forms).groupBy("field", "skeleton").agg(F.count("*").alias("variants"), F.sum("n").alias("records"), F.min("plain").alias("plain"))
    return groups.where("variants > 1")


def not_plain(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(row_id, field) of the fields that are not in plain coding: of each group of equal skeletons, the records whose coding
    is not the group's plain one, or of which no plain one exists (a foreign letter without a look-alike).

    Groups are made of distinct codings; the records find theirs by the text itself. A repeated record comes out once for
    each of its rows; null and empty fields never do.
    """
    cases = stored(_variants(normal_forms(df, id_col, fields)).where("original <> plain or foreign").select("field", "original"))
    return long_form(df, id_col, fields).select("row_id", "field", "original").join(small(cases), ["field", "original"], "left_semi").select("row_id", "field")
