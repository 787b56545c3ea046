"""Segmentation of running text into records: verses between markers, turns of speakers, paragraphs for spans of units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"॥\s*([०-९0-9]+)\s*[-–]\s*([०-९0-9]+)\s*॥")
_HIDDEN = dict.fromkeys(map(ord, "​‌‍﻿­"))


def _speaker(line: str) -> str | None:
    """The name of up to three words that a line gives as the speaker's, "said" standing apart at its end; null for other lines."""
    words = line.split()
    name = words[:-1]
    return " ".join(name) if words and words[-1] == "उवाच" and 1 <= len(name) <= 3 and not any(c in w for w in name for c in "।॥") else None


def _number(digits: str) -> int:
    return int("".join(str(unicodedata.digit(d)) for d in digits))


def verses_of(poem: str) -> list[tuple[int, int, int, str | None, str]]:
    """(number, marked chapter, marked verse, speaker, text) of a poem (SEG1, WN1, WN10, FN-S2, FN-S8).

    A marker closes a verse, text before it on its line included; one without text makes none. A speaker's heading stands
    for the next verse only. Before the first verse all lines are preamble until a heading or a line that ends in a danda.
    """
    out: list[tuple[int, int, int, str | None, str]] = []
    held: list[str] = []
    speaker: str | None = None
    inside = False
    for raw in poem.splitlines():
        line = re.sub(r"<br\s*/?>|&nbsp;", " ", re.sub("''+", "", raw)).translate(_HIDDEN).strip()
        if not line:
            continue
        mark, heading = _MARK.search(line), _speaker(line)
        if mark:
            held.append(_MARK.sub("", line).strip())
            text = unicodedata.normalize("NFC", "\n".join(x for x in held if x)).strip()
            if text:
                out.append((len(out) + 1, _number(mark[1]), _number(mark[2]), speaker, text))
            held, speaker, inside = [], None, True
        elif heading and not held:
            speaker = heading
        elif inside or speaker is not None or line.endswith("।"):
            inside = True
            held.append(line)
    return out


def parsed_poems(poems: DataFrame) -> DataFrame:
    """(ch, n, marked_ch, marked_n, speaker, devanagari) of poems (ch, poem); null poems give none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ch, *x) for ch, poem in zip(pdf.ch, pdf.poem) if poem for x in verses_of(poem)]
            yield pd.DataFrame(rows, columns=["ch", "n", "marked_ch", "marked_n", "speaker", "devanagari"])

    return poems.select("ch", "poem").mapInPandas(parse, "ch int, n int, marked_ch int, marked_n int, speaker string, devanagari string")


def turns(text: Column) -> Column:
    """array<struct<speaker, text>>: what follows each "Name said:" up to the next one (SEG2)."""
    named = F.regexp_extract_all(text, F.lit(r"([A-Z][\p{L}]+) said:"), F.lit(1))
    said = F.filter(F.split(text, r"[A-Z][\p{L}]+ said:"), lambda x: F.lit(True))
    return F.zip_with(named, F.slice(said, F.lit(2), F.greatest(F.size(said) - 1, F.lit(1))), lambda s, t: F.struct(s.alias("speaker"), F.trim(t).alias("text")))


def allocated(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(ch, verse, text, status): paragraphs of a span of units, one to each where the counts are equal, else by hand (SEG3).

    spans: ch, start, until (half open, no overlaps); paragraphs: ch, start (of their span), k (0-based), text.
    """
    counts = paragraphs.groupBy("ch", "start").agg(F.count("*").alias("have"))
    met = paragraphs.join(spans, ["ch", "start"]).join(counts, ["ch", "start"])
    fits = F.col("have") == F.col("until") - F.col("start")
    status = F.when(fits, "auto").otherwise(F.format_string("manual(span %d-%d)", "start", F.col("until") - 1))
    return met.select("ch", F.when(fits, (F.col("start") + F.col("k")).cast("int")).alias("verse"), "text", status.alias("status"))


def chapter_title_at(text: Column, numeral: Column) -> Column:
    """1-based place of a chapter's title, by patterns in order of trust; null if none is there (SEG5)."""
    ways = [F.concat(F.lit(r"(?m)^Chapter +"), numeral, F.lit(r"\.?\s*$")), F.concat(F.lit(r"(?m)^CHAPTER +"), numeral, F.lit(r"\.?\s*$")), F.concat(F.lit(r"(?i)chapter +"), numeral, F.lit(r"\b"))]
    return F.coalesce(*(F.nullif(F.regexp_instr(text, way), F.lit(0)) for way in ways))
