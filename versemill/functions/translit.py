"""Devanagari to IAST and back: a state walker and, as a check on it, an engine that works on whole syllables.

Both take and give composed text. Digits become ASCII digits, the danda a bar and the double danda two. What neither script
knows passes unchanged; a virama without a consonant is dropped, a nukta makes another sound of its consonant, which the way
back does not know. Known limit: a lone anusvara or visarga after a word-initial inherent vowel cannot be told from the
bare sign, so a word-initial "aṃ" or "aḥ" loses its vowel on the way back; the round-trip query reports such words.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the scripts' letters side by side
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split(), "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split()))
SIGNS = dict(zip("ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split(), "ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split()))
CONSONANTS = dict(
    zip(
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
        "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḷ".split(),
    )
)
MARKS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "।": "|", "॥": "||", "ॐ": "oṃ"} | {chr(0x966 + i): str(i) for i in range(10)}
VIRAMA, NUKTA = "्", "़"
# fixed values: consonants that a nukta changes
DOTTED = dict(zip("क ख ग ज झ ड ढ फ य ल".split(), "q kh ġ z zh ṛ ṛh f ẏ ḷ".split()))


# fixed values: letters that composition makes of a consonant and a nukta
_COMPOSED = {0x929: "न" + NUKTA, 0x931: "र" + NUKTA, 0x934: "ळ" + NUKTA}


def _spelled(text: str) -> str:
    """Composed text in which every nukta stands apart."""
    return unicodedata.normalize("NFC", text).translate(_COMPOSED)


def to_iast(text: str) -> str:
    """Character walker: a consonant waits for a sign, a virama or anything else, which brings out its inherent a."""
    out: list[str] = []
    waiting = ""  # the consonant whose vowel is still open
    for ch in _spelled(text):
        if ch == VIRAMA:
            waiting = ""
            continue
        if ch == NUKTA and waiting:
            out[-1] = DOTTED.get(waiting, CONSONANTS[waiting])
            continue
        if ch in SIGNS and waiting:
            out.append(SIGNS[ch])
            waiting = ""
            continue
        if waiting:
            out.append("a")
        waiting = ch if ch in CONSONANTS else ""
        out.append(CONSONANTS.get(ch) or VOWELS.get(ch) or MARKS.get(ch) or SIGNS.get(ch) or ch)
    return "".join(out) + "a" * bool(waiting)


_SYLLABLE = re.compile(f"([{''.join(CONSONANTS)}])({NUKTA}*)({VIRAMA}|[{''.join(SIGNS)}])?|([{''.join(VOWELS)}{''.join(MARKS)}{''.join(SIGNS)}])|{VIRAMA}")


def to_iast_by_syllable(text: str) -> str:
    """The same mapping, one regular match for each consonant with what it carries."""

    def one(m: re.Match) -> str:
        if m[1]:
            return (DOTTED if m[2] and m[1] in DOTTED else CONSONANTS)[m[1]] + ("" if m[3] == VIRAMA else SIGNS[m[3]] if m[3] else "a")
        return "" if m[4] is None else VOWELS.get(m[4]) or SIGNS.get(m[4]) or MARKS[m[4]]

    return _SYLLABLE.sub(one, _spelled(text))


_SOUND_VOWEL = {v: k for k, v in VOWELS.items()}
_SOUND_SIGN = {v: k for k, v in SIGNS.items()}
_SOUND_CONSONANT = {v: k for k, v in CONSONANTS.items() if v not in _SOUND_VOWEL}
_SOUND_MARK = {"ṃ": "ं", "ḥ": "ः", "m̐": "ँ", "'": "ऽ", "||": "॥", "|": "।"} | {str(i): chr(0x966 + i) for i in range(10)}
_TOKENS = sorted({*_SOUND_VOWEL, *_SOUND_CONSONANT, *_SOUND_MARK}, key=len, reverse=True)
_TOKEN = re.compile("|".join(map(re.escape, _TOKENS)) + "|.", re.S)


def to_devanagari(text: str) -> str:
    """Longest token first; a consonant without a vowel after it gets a virama."""
    out: list[str] = []
    open_consonant = False
    for token in _TOKEN.findall(unicodedata.normalize("NFC", text)):
        if token in _SOUND_VOWEL:
            if open_consonant:
                out.append(_SOUND_SIGN.get(token, ""))
            else:
                out.append(_SOUND_VOWEL[token])
            open_consonant = False
            continue
        if open_consonant:
            out.append(VIRAMA)
        open_consonant = token in _SOUND_CONSONANT
        out.append(_SOUND_CONSONANT.get(token) or _SOUND_MARK.get(token) or token)
    return "".join(out) + VIRAMA * open_consonant


_C, _V = "|".join(sorted(map(re.escape, _SOUND_CONSONANT), key=len, reverse=True)), "|".join(sorted(map(re.escape, _SOUND_VOWEL), key=len, reverse=True))
_RUN = re.compile(f"((?:{_C})+)({_V})?|({_V})|({'|'.join(sorted(map(re.escape, _SOUND_MARK), key=len, reverse=True))})")


def to_devanagari_by_syllable(text: str) -> str:
    """The same mapping, one regular match for each run of consonants with its vowel."""

    def one(m: re.Match) -> str:
        if m[1]:
            letters = [_SOUND_CONSONANT[x] for x in re.findall(_C, m[1])]
            return VIRAMA.join(letters) + (VIRAMA if m[2] is None else _SOUND_SIGN.get(m[2], ""))
        return _SOUND_VOWEL[m[3]] if m[3] else _SOUND_MARK[m[4]]

    return _RUN.sub(one, unicodedata.normalize("NFC", text))


def as_column(engine, text: Column) -> Column:
    """An engine over a string column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(engine, na_action="ignore")

    return run(text)
