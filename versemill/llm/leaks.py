"""Evaluation texts leaking into training text (problem 6): winnowed fingerprints joined, hits extended."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.fingerprints import gram_hashes, winnow
from versemill.llm.forms import _is_home, _look_alike
from versemill.runtime import BROADCAST_BYTES, small, stored

#: Words in a row that make a leak, words that may be replaced in a whole item, letters of a fingerprint, and its window.
#: GRAM + WINDOW - 1 = 24 letters in common are always found.
WORDS, REPLACED, GRAM, WINDOW = 12, 3, 16, 9
SURE = GRAM + WINDOW - 1
#: A print that more items than HOT hold gives way, on both sides, to any other print of its window. The list of such prints
#: may be cut at HOTTEST: a print not on it is only dearer, none is lost.
HOT, HOTTEST = 32, 10_000
#: Candidate items that travel with one copy of a document's text, about.
TOGETHER = 128

_QUOTES = re.compile(r"\n[ \t]*(?:[>|][ \t]*)+")
_TAGS = re.compile(r"<[^<>\n]{1,80}>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});")
_JOINING = "-‐‑"


class _Letters(dict):
    """What is left of a character by code point: its letter or digit without look-alikes, a space between words, or nothing."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind[0] in "LMN" and not _is_home(ch, "latin"):
            ch = _look_alike(ch, "latin").lower()
        if ch.isalnum():
            self[code] = ch
        else:
            self[code] = " " if ch.isspace() or kind == "Pd" and ch not in _JOINING else ""
        return self[code]


_LETTERS = _Letters()

#: A text reduced to its letters, and where its words begin among them.
Reduced = tuple[str, list[int]]


def letters(text: str | None) -> Reduced:
    """The text's letters and digits without case, marks, look-alikes and all else; and where its words begin among them.

    Quote marks of a reply, markup and entities go; a word broken over a line, with a hyphen or not, runs on.
    """
    text = _TAGS.sub(" ", _QUOTES.sub("\n", "\n" + (text or "")))
    words = unicodedata.normalize("NFKD", text).lower().translate(_LETTERS).split()
    return "".join(words), [0, *accumulate(map(len, words[:-1]))] if words else []


def replaceable(n: int) -> int:
    """How many words of an item of n may be replaced: REPLACED, but always fewer than half, so that most of the item stands."""
    return min(REPLACED, max(0, (n - 1) // 2))


def _blocks(sizes: list[int], k: int) -> list[int]:
    """Where k runs of words begin, the shortest of which has as many letters as can be."""

    def cut(least: int) -> list[int] | None:
        at, run = [0], 0
        for i, size in enumerate(sizes):
            if run >= least and len(at) < k:
                at.append(i)
                run = 0
            run += size
        return at if len(at) == k and run >= least else None

    lo, hi = 1, max(1, sum(sizes) // k)
    best = cut(1) or list(range(k))
    while lo <= hi:
        mid = (lo + hi) // 2
        found = cut(mid)
        if found:
            best, lo = found, mid + 1
        else:
            hi = mid - 1
    return best


def seeds(item: Reduced) -> list[tuple[int, int]] | None:
    """(place, letters) of grams of which every leak of the item holds one whole; null where winnowed prints find every leak.

    Of k replaced words some of k + 1 runs of words stands whole; of any WORDS words in a row so does one of the aligned runs
    of half as many. Where all such stretches have SURE letters, winnowing is enough. Shorter ones are looked up themselves.
    """
    t, begins = item
    n = len(begins)
    if not n:
        return []
    ends = [*begins[1:], len(t)]
    starts = _blocks([b - a for a, b in zip(begins, ends)], replaceable(n) + 1)
    runs = [(begins[i], ends[j - 1]) for i, j in zip(starts, [*starts[1:], n])]
    least = min(b - a for a, b in runs)
    if n > WORDS:
        least = min(least, *(ends[i + WORDS - 1] - begins[i] for i in range(n - WORDS + 1)))
        half = WORDS // 2
        runs += [(begins[i], ends[i + half - 1]) for i in range(0, n - half + 1, half)]
    return None if least >= SURE else sorted({(a, min(GRAM, b - a)) for a, b in runs})


def holds(doc: Reduced, item: Reduced) -> bool:
    """Whether the document holds WORDS whole words of the item in a row, or all of it with at most REPLACED replaced.

    What replaces a word ends where a word of the document ends and is no longer than the item.
    """
    d, bounds = doc[0], [*doc[1], len(doc[0])]
    t, begins = item
    n = len(begins)
    if not n or not d:
        return False
    ends = [*begins[1:], len(t)]
    most = replaceable(n)
    short = len(t) < GRAM
    words = [t[a:b] for a, b in zip(begins, ends)]
    failed: set[tuple[int, int, int, int]] = set()

    def reach(i: int, p: int, step: int, left: int) -> bool:
        """Whether the words from i on, forwards or backwards, fit the document from p on with `left` replacements."""
        start = (i, p, step, left)
        if start in failed:
            return False
        while 0 <= i < n:
            w = words[i]
            if d.startswith(w, p) if step > 0 else p >= len(w) and d.endswith(w, 0, p):
                p += step * len(w)
                i += step
                continue
            if left:
                if step > 0:
                    near = bounds[bisect_right(bounds, p) : bisect_right(bounds, p + len(t))]
                else:
                    near = reversed(bounds[bisect_left(bounds, p - len(t)) : bisect_left(bounds, p)])
                if any(reach(i + step, b, step, left - 1) for b in near):
                    return True
            failed.add(start)
            return False
        return True

    def whole(i: int, j: int, p: int, q: int) -> bool:
        return any(reach(i - 1, p, -1, k) and reach(j, q, 1, most - k) for k in range(most + 1))

    own = seeds(item)
    seen: dict[int, int] = {}  # by shift: how far the item has been compared
    for at, size in own if own is not None else ((at, GRAM) for at in range(0, len(t) - GRAM + 1, WINDOW)):
        gram = t[at : at + size]
        p = d.find(gram)
        while p >= 0:
            shift = p - at
            if short and not _at_words(doc[1], bounds, p, p + size):  # so few letters count as whole words only
                pass
            elif seen.get(shift, -1) < at + size:
                lo, hi = at, at + size
                while lo and lo + shift and t[lo - 1] == d[lo + shift - 1]:
                    lo -= 1
                while hi < len(t) and hi + shift < len(d) and t[hi] == d[hi + shift]:
                    hi += 1
                seen[shift] = hi
                i, j = bisect_left(begins, lo), bisect_right(ends, hi)
                if j - i >= min(WORDS, n) or j > i and whole(i, j, begins[i] + shift, ends[j - 1] + shift):
                    return True
            p = d.find(gram, p + 1)
    return False


def _at_words(starts: list[int], bounds: list[int], p: int, q: int) -> bool:
    """Whether the letters from p to q are whole words."""
    i, j = bisect_left(starts, p), bisect_left(bounds, q)
    return i < len(starts) and starts[i] == p and j < len(bounds) and bounds[j] == q


def _ranked(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes with the hot ones last; one to one."""
    if not len(hot):
        return h
    order = h >> np.uint64(1)
    order[np.isin(h, hot)] |= np.uint64(1 << 63)
    return order


def _item_prints(batches: Iterator[pd.DataFrame], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes, found = [], []
        for text in pdf.text:
            item = letters(text)
            own = seeds(item)
            if own is None:
                at = np.unique(winnow(item[0], GRAM, WINDOW, lambda h: _ranked(h, hot))[1].view(np.int64))
                sizes.append(np.zeros(len(at), np.int32))
            else:
                at = np.array([gram_hashes(item[0][a : a + n], n)[0] for a, n in own], np.uint64).view(np.int64)
                sizes.append(np.array([n for _, n in own], np.int32))
            found.append(at)
        yield pd.DataFrame({"id": pdf.id, "gram": pd.Series(sizes, dtype="object"), "prints": pd.Series(found, dtype="object")})


def _prints(batches: Iterator[pd.DataFrame], hot: np.ndarray, grams: list[int], wanted: np.ndarray | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf.text:
            t = letters(text)[0]
            own = [winnow(t, GRAM, WINDOW, lambda h: _ranked(h, hot))[1]]
            for g in grams:
                h = gram_hashes(t, g)
                own.append(h if wanted is None else h[np.isin(h, wanted)])
            rows.append(np.unique(np.concatenate(own).view(np.int64)))
        yield pd.DataFrame({"id": pdf.id, "prints": pd.Series(rows, dtype="object")})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, Reduced] = {}
    for pdf in batches:
        docs, items = [], []
        for doc, text, candidates in zip(pdf.doc_id, pdf.text, pdf.candidates):
            reduced = letters(text)
            for x in candidates:
                if len(seen) > 10_000:
                    seen.clear()
                item = seen.get(x["item"]) or seen.setdefault(x["item"], letters(x["item"]))
                if holds(reduced, item):
                    docs.append(doc)
                    items.append(x["item_id"])
        yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "item_id": pd.Series(items, dtype="int64")})


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: the document holds 12 words in a row of the item, or all of it with at most three replaced.

    Both sides keep the least hash of each WINDOW of GRAM-letter grams over text reduced to its letters; equal prints make
    candidates, which are extended in the texts. An item some leak of which can keep fewer than SURE letters in a row is
    looked up by grams as long as the stretches that must stand: documents give all their grams of those lengths, of which
    only the wanted ones are kept while the list of them is small. Prints that many items share give way to others of their
    window. Null and empty texts hold nothing; of an item fewer than half of the words may be replaced; one of under GRAM
    letters counts only as whole words of the document. A document's text travels once for about TOGETHER candidates.
    Repeated ids and rows give one row.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].alias("text")).where("doc_id is not null and text is not null")
    items = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("item")).where("item_id is not null and item is not null")
    texts = items.select(F.col("item_id").alias("id"), F.col("item").alias("text"))
    none = np.empty(0, np.uint64)

    def prints_of_items(hot: np.ndarray) -> DataFrame:
        found = texts.mapInPandas(lambda batches: _item_prints(batches, hot), "id long, gram array<int>, prints array<bigint>")
        return stored(found.select(F.col("id").alias("item_id"), F.inline(F.arrays_zip(F.col("gram").alias("gram"), F.col("prints").alias("print")))).distinct())

    test = prints_of_items(none)
    shared = test.where("gram = 0").groupBy("print").agg(F.count_distinct("item_id").alias("n")).where(f"n > {HOT}")
    hot = np.array([r["print"] for r in shared.orderBy(F.desc("n"), "print").limit(HOTTEST).collect()], np.int64).view(np.uint64)
    if len(hot):
        test = prints_of_items(hot)
    own = test.where("gram > 0")
    grams = sorted(r.gram for r in own.select("gram").distinct().collect())  # at most GRAM lengths, of short items
    wanted = None
    if grams and own.select("print").distinct().count() * 8 <= BROADCAST_BYTES:
        wanted = np.array([r["print"] for r in own.select("print").distinct().collect()], np.int64).view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast((hot, grams, wanted))
    train = docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(lambda batches: _prints(batches, *held.value), "id long, prints array<bigint>")
    train = train.select(F.col("id").alias("doc_id"), F.explode("prints").alias("print"))
    candidates = train.join(small(test.select("item_id", "print").distinct()), "print").select("doc_id", "item_id").distinct()
    groups = max(1, items.count() // TOGETHER)
    grouped = candidates.join(items.distinct(), "item_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("part"))
    grouped = stored(grouped.agg(F.collect_list(F.struct("item_id", "item")).alias("candidates")).select("doc_id", "candidates"))
    return docs.join(grouped, "doc_id").select("doc_id", "text", "candidates").mapInPandas(_confirm, "doc_id long, item_id long").distinct()


def leak_report(found: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Which items leaked: (item_id, documents), 0 for those that did not."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select(items[item_id].cast("long").alias("item_id")).distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
