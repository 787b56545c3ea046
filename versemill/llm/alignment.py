"""Sentence alignment of verses and their English renderings (problem 1).

By length first; word-translation probabilities by expectation-maximization on the confident pairs; then a realignment by
dynamic programming with lexical scores, which also finds what was moved.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions.translit import to_iast
from versemill.llm.forms import plain
from versemill.runtime import BROADCAST_BYTES, release, stored

#: Iterations of each training, trainings (the second on realigned pairs), and the least probability a table keeps.
ITERATIONS, TRAININGS, FLOOR = 5, 2, 1e-3
#: The code of no word at all; words stand as 64-bit hashes in training.
NO_WORD = 0
#: Cells or pairs that one batch of beads may open at once, and the least count, over all beads, of a pair that is kept.
WIDEST, LEAST = 8_000_000, 1e-4
#: Least p(word | stem) and p(stem | word) of a dictionary entry; share of a half verse a sentence must render.
FORWARD, BACKWARD, RENDERED, MOVED = 0.02, 0.12, 0.5, 0.55
#: What a sentence not yet used is preferred by: of two equal verses each then gets its own.
AHEAD = 0.01
#: Largest cost of a length bead to count as confident.
CONFIDENT = 3.0
# fixed values: endings of the inflected words, longest first
_ENDINGS = "iṣyanti iṣyati iṣyate iṣyatu ebhyaḥ ebhiḥ ānāṃ antu anti ante eyuḥ atāṃ eta etu atu ati ate ata asya ena āya āni aiḥ eṣu āḥ aḥ aṃ ān āt au iṃ iḥ uḥ uṃ e ā a i u"
# fixed values: particles, and the word that ends a speaker's heading
_PARTICLES, _SAID = frozenset("ca tu api iti eva hi".split()), "uvāc"


def _stem(word: str) -> str:
    """The word without its longest ending that leaves three letters or more."""
    return next((word[: -len(end)] for end in _ENDINGS.split() if word.endswith(end) and len(word) - len(end) > 2), word)


def verse_halves(devanagari: str | None, iast: str | None) -> list[list[str]]:
    """Stems of each half of a verse, from its Devanagari or, without it, its IAST; speakers' headings are no half."""
    text = to_iast(plain(devanagari, "devanagari")) if devanagari and devanagari.strip() else plain(iast, "latin") or ""
    halves = []
    for line in re.split(r"[\n|]+", text.replace("ṁ", "ṃ")):
        words = [w.lower() for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", line)]
        stems = [_stem(w) for w in words]
        if stems and _SAID not in stems:
            halves.append([w for w in stems if w not in _PARTICLES])
    return [h for h in halves if h]


def english_stems(text: str | None) -> list[str]:
    """Words of a sentence in lower case without endings of number, person and tense."""
    out = []
    for w in re.findall(r"[A-Za-z]+(?:-[A-Za-z]+)*", text or ""):
        w = w.lower()
        if len(w) > 3:
            w = re.sub(r"(?:eth|es|s|ed|e)$", "", w)
        out.append(re.sub("y$", "i", w))
    return out


def _lists(**columns: list) -> pd.DataFrame:
    """A frame whose columns hold lists; without rows too they keep the type of objects."""
    return pd.DataFrame({k: pd.Series(v, dtype="object") for k, v in columns.items()})


# fixed values: (verses, sentences, price) of the kinds of beads
_BEADS = ((1, 1, 0.0), (1, 2, 1.6), (2, 1, 1.2), (2, 2, 3.0), (1, 0, 3.5), (0, 1, 3.5), (3, 1, 3.5))


def length_beads(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, float]]:
    """The cheapest sequence of beads (a from, to, b from, to, cost) by length alone, 0-1 to 3-1.

    The whole table is searched, but only every so many rows are kept and the rows between worked out again on the way back:
    the memory is that of a square root of the rows.
    """
    n, m = len(a), len(b)
    ratio = sum(b) / max(1, sum(a))
    sa, sb = np.concatenate([[0], np.cumsum(a)]) * ratio, np.concatenate([[0], np.cumsum(b)])
    lone = next(k for k, x in enumerate(_BEADS) if x[:2] == (0, 1))
    slope = _BEADS[lone][2] * np.arange(m + 1)

    def row(i: int, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Costs and kinds of row i; before: the rows above it, the nearest last."""
        best, kind = np.full(m + 1, np.inf), np.zeros(m + 1, np.int8)
        if not i:
            best[0] = 0
        for k, (x, y, price) in enumerate(_BEADS):
            if not x or i < x or y > m:
                continue
            la = sa[i] - sa[i - x]
            lb = sb[y:] - sb[: m + 1 - y]
            new = before[-x][: m + 1 - y] + price + ((lb - la) ** 2 / (2 * 6.8 * np.maximum(np.maximum(la, lb), 1)) if y else 0)
            better = new < best[y:]
            best[y:][better] = new[better]
            kind[y:][better] = k
        alone = np.minimum.accumulate(best - slope) + slope  # sentences without a verse
        more = alone < best - 1e-9
        best[more], kind[more] = alone[more], lone
        return best, kind

    block = int((n + 1) ** 0.5) + 3
    kept: dict[int, list[np.ndarray]] = {}
    above: list[np.ndarray] = []
    for i in range(n + 1):
        if i % block == 0:
            kept[i] = list(above)
        above = [*above[-2:], row(i, above)[0]]
    out, i, j = [], n, m
    begin, rows = n + 1, {}
    while i or j:
        if i < begin:
            begin = i - i % block
            above, rows = list(kept[begin]), {begin - len(kept[begin]) + k: (x, None) for k, x in enumerate(kept[begin])}
            for r in range(begin, i + 1):
                rows[r] = row(r, above)
                above = [*above[-2:], rows[r][0]]
        x, y, _ = _BEADS[rows[i][1][j]]
        out.append((i - x, i, j - y, j, float(rows[i][0][j] - rows[i - x][0][j - y])))
        i, j = i - x, j - y
    return out[::-1]


def _tasks(df: DataFrame) -> int:
    """How many tasks the Python steps are spread over: their rows are few and heavy."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _chapters(verses: DataFrame, sentences: DataFrame) -> DataFrame:
    """A row for each chapter and rendition: its verses with their halves, its sentences with their stems, in order."""

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"ch": pdf.ch, "n": pdf.n, "id": pdf.id}).join(_lists(halves=[verse_halves(d, i) for d, i in zip(pdf.devanagari, pdf.iast)]))

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["ch", "rendition", "sent_no"]].join(_lists(size=[len(t or "") for t in pdf.text], words=[english_stems(t) for t in pdf.text]).astype({"size": "int64"}))

    one = verses.where("id is not null and ch is not null").groupBy("id").agg(F.min_by(F.struct("ch", "n", "devanagari", "iast"), F.struct(F.col("devanagari").isNull(), "row_id")).alias("v"))
    left = one.select("v.ch", F.coalesce("v.n", F.lit(0)).alias("n"), "id", "v.devanagari", "v.iast").mapInPandas(halves, "ch int, n int, id string, halves array<array<string>>")
    left = left.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("n", "id", "halves"))).alias("verses"))
    right = sentences.where("ch is not null and rendition is not null and sent_no is not null").select("ch", "rendition", "sent_no", "text").groupBy("ch", "rendition", "sent_no").agg(F.min("text").alias("text"))
    right = right.mapInPandas(stems, "ch int, rendition string, sent_no int, size int, words array<string>")
    right = right.groupBy("ch", "rendition").agg(F.array_sort(F.collect_list(F.struct("sent_no", "size", "words"))).alias("sentences"))
    return left.join(right, "ch").repartition(_tasks(verses), "ch", "rendition")


def _length_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        source, target = [], []
        for verses, sentences in zip(pdf.verses, pdf.sentences):
            stems = [[w for h in v["halves"] for w in h] for v in verses]
            for i, i2, j, j2, cost in length_beads([sum(len(w) + 2 for w in s) for s in stems], [int(s["size"]) for s in sentences]):
                if i2 > i and j2 > j and cost <= CONFIDENT:
                    source.append([w for s in stems[i:i2] for w in s])
                    target.append([w for s in sentences[j:j2] for w in s["words"]])
        yield _lists(source=source, target=target)


_NONE = np.array([NO_WORD], np.int64)


def _pair_counts(source: list[np.ndarray], target: list[np.ndarray], table: pd.DataFrame | None) -> pd.DataFrame:
    """Expected counts of one batch of beads, all pairs of its words at once; halved as long as its table of words is too wide."""
    ns, nt = np.array([len(x) + 1 for x in source]), np.array([len(x) for x in target])
    if not nt.sum():
        return pd.DataFrame({"e": [], "f": [], "c": []})
    stems, stem_names = pd.factorize(np.concatenate([w for x in source for w in (x, _NONE)]))
    words, word_names = pd.factorize(np.concatenate(target))
    wide = len(word_names)
    if len(source) > 1 and (len(stem_names) * wide > WIDEST or int((ns * nt).sum()) > WIDEST):
        k = len(source) // 2
        return pd.concat([_pair_counts(source[:k], target[:k], table), _pair_counts(source[k:], target[k:], table)])
    odds = np.full((len(stem_names), wide), 1.0 if table is None else 1e-7)
    if table is None:
        odds[pd.Index(stem_names).get_indexer(_NONE)[0]] = 0.3
    else:
        i, j = pd.Index(stem_names).get_indexer(table["e"]), pd.Index(word_names).get_indexer(table["f"])
        there = (i >= 0) & (j >= 0)
        odds[i[there], j[there]] = table["p"].to_numpy()[there]
    bead = np.repeat(np.arange(len(nt)), nt)
    blocks = ns[bead]
    begin = np.cumsum(blocks) - blocks
    first = (np.cumsum(ns) - ns)[bead]
    cell = stems[np.arange(blocks.sum()) - np.repeat(begin - first, blocks)] * wide + np.repeat(words, blocks)
    share = odds.ravel()[cell]
    share /= np.repeat(np.add.reduceat(share, begin), blocks)
    counts = np.bincount(cell, share, odds.size)
    kept = np.flatnonzero(counts)
    return pd.DataFrame({"e": stem_names[kept // wide], "f": word_names[kept % wide], "c": counts[kept]})


def _expected(beads: DataFrame, table: DataFrame | None) -> DataFrame:
    """(e, f, c): expected counts of word pairs under the table (the first time all as likely).

    The table travels to the Python workers only while its measured size is below the limit; a larger one is joined.
    """
    entries = table.count() if table is not None else 0
    if entries * 40 <= BROADCAST_BYTES:
        known = None if table is None else beads.sparkSession.sparkContext.broadcast(table.select("e", "f", "p").toPandas())

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for pdf in batches:
                held.append(_pair_counts(list(pdf.source), list(pdf.target), None if known is None else known.value))
                if sum(map(len, held)) > 2_000_000:
                    held = [pd.concat(held).groupby(["e", "f"], as_index=False)["c"].sum()]
            if held:
                yield pd.concat(held).groupby(["e", "f"], as_index=False)["c"].sum().astype({"e": "int64", "f": "int64", "c": "float64"})

        partial = beads.mapInPandas(expect, "e long, f long, c double")
    else:
        pairs = beads.select(F.monotonically_increasing_id().alias("bead"), F.array_append("source", F.lit(NO_WORD).cast("long")).alias("source"), F.posexplode("target").alias("at", "f"))
        pairs = pairs.select("bead", "at", "f", F.explode("source").alias("e")).join(table, ["e", "f"], "left").withColumn("o", F.coalesce("p", F.lit(1e-7)))
        sums = pairs.groupBy("bead", "at").agg(F.sum("o").alias("total"), F.collect_list(F.struct("e", "f", "o")).alias("all"))
        partial = sums.select("total", F.explode("all").alias("x")).select("x.e", "x.f", (F.col("x.o") / F.col("total")).alias("c"))
    return stored(partial.groupBy("e", "f").agg(F.sum("c").alias("c")).where(f"c > {LEAST}"))


def _train(beads: DataFrame) -> DataFrame:
    """(e, f, p, back): p(word | stem) and p(stem | word) after the last iteration; stem '' stands for no word at all.

    Words travel as 64-bit hashes through all iterations and get their letters back at the end.
    """
    code = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    coded = stored(beads.select(code("source").alias("source"), code("target").alias("target")))
    table = counts = None
    for _ in range(ITERATIONS):
        old, counts = counts, _expected(coded, table)
        rest = table
        table = stored(counts.join(counts.groupBy("e").agg(F.sum("c").alias("t")), "e").select("e", "f", (F.col("c") / F.col("t")).alias("p"), "c").where(f"p > {FLOOR}"))
        release(*(x for x in (old, rest) if x is not None))
    both = table.join(counts.groupBy("f").agg(F.sum("c").alias("t")), "f").select("e", "f", "p", (F.col("c") / F.col("t")).alias("back"))
    named = lambda c, code, word: beads.select(F.explode(c).alias(word)).distinct().select(F.xxhash64(word).alias(code), word)
    out = both.join(named("source", "e", "stem"), "e", "left").join(named("target", "f", "word"), "f")
    out = stored(out.where(f"stem is not null or e = {NO_WORD}").select(F.coalesce("stem", F.lit("")).alias("e"), F.col("word").alias("f"), "p", "back"))
    release(coded, counts, table)
    return out


def dictionary(table: DataFrame) -> DataFrame:
    """(e, f, q): entries that are likely both ways; q is the weight of a link."""
    return table.where(f"e <> '' and p >= {FORWARD} and back >= {BACKWARD}").select("e", "f", F.least(F.lit(1.0), (F.col("back") - 0.1) / 0.35).alias("q"))


def _best_path(gains: list[dict[int, float]], m: int) -> dict[int, int]:
    """Half to sentence: the monotone path of the greatest total, a half having at most one sentence.

    A prefix maximum over the sentences, kept as a tree of sums' kind, is asked and raised once for each gain: time and memory
    grow with the gains, not with halves times sentences.
    """
    tree: list[tuple[float, int]] = [(0.0, -1)] * (m + 1)
    nodes: list[tuple[int, int, int]] = []  # half, sentence, the node before

    def upto(j: int) -> tuple[float, int]:
        best = (0.0, -1)
        while j > 0:
            if tree[j][0] > best[0]:
                best = tree[j]
            j -= j & -j
        return best

    for i, row in enumerate(gains):
        fresh = []
        for j, g in row.items():
            (stay, one), (earlier, two) = upto(j + 1), upto(j)
            value, last = max((stay + g - RENDERED, one), (earlier + g - RENDERED + AHEAD, two), key=lambda x: x[0])
            if value > stay:
                fresh.append((value, j, last))
        for value, j, last in fresh:
            nodes.append((i, j, last))
            k = j + 1
            while k <= m:
                if value > tree[k][0]:
                    tree[k] = (value, len(nodes) - 1)
                k += k & -k
    path: dict[int, int] = {}
    at = upto(m)[1]
    while at >= 0:
        i, j, at = nodes[at]
        path[i] = j
    return path


def lexical_alignment(halves: list[list[str]], owners: list[int], sentences: list[list[str]], weight: dict[str, dict[str, float]]) -> list[tuple[int, int, float]]:
    """(half, sentence, share rendered): a monotone path of best total score, then what was moved or rendered twice.

    A half verse has at most one sentence on the path, a sentence any number of halves. A sentence's words that no half on
    the path accounts for are then offered to all halves of the chapter: those not yet rendered first, then near ones; any
    half may take several.
    """
    n, m = len(halves), len(sentences)
    holders: dict[str, list[int]] = defaultdict(list)
    for j, s in enumerate(sentences):
        for f in set(s):
            holders[f].append(j)
    rows: list[dict[int, dict[str, tuple[str, float]]]] = []  # of each half: by sentence, by stem, the best word
    for h in halves:
        row: dict[int, dict[str, tuple[str, float]]] = defaultdict(dict)
        for e in set(h):
            for f, q in weight.get(e, {}).items():
                for j in holders.get(f, ()):
                    if q > row[j].get(e, ("", 0.0))[1]:
                        row[j][e] = (f, q)
        rows.append(row)

    def score(i: int, links: dict[str, tuple[str, float]]) -> float:
        return sum(links[e][1] for e in set(halves[i]) if e in links) / max(2, len(set(halves[i])))

    gains = [{j: g for j, links in row.items() if len(links) > 1 and (g := score(i, links)) > RENDERED} for i, row in enumerate(rows)]
    path = _best_path(gains, m)
    found: list[tuple[int, int, float]] = []
    used: dict[int, set[str]] = defaultdict(set)
    for i, j in sorted(path.items(), key=lambda x: (-gains[x[0]][x[1]], x)):  # a word stands for one half only
        free = {e: (f, q) for e, (f, q) in rows[i][j].items() if f not in used[j]}
        if len(free) > 1 and score(i, free) > RENDERED:
            found.append((i, j, gains[i][j]))
            used[j].update(f for f, _ in free.values())
        else:
            del path[i]

    def near(i: int, j: int, g: float) -> float:
        return g - 0.1 * abs(i / max(1, n) - j / max(1, m))

    offers = [(-near(i, j, g) - 0.15 * (i not in path), -i, -j) for i in range(n) for j, g in gains[i].items() if path.get(i) != j]
    heapq.heapify(offers)
    rendered, late = set(path), {(i, j) for i in path for j in gains[i]}  # late: offers without the preference of an unrendered half
    while offers:
        value, i, j = heapq.heappop(offers)
        i, j = -i, -j
        if i in rendered and (i, j) not in late:
            late.add((i, j))
            heapq.heappush(offers, (value + 0.15, -i, -j))
            continue
        free = {e: (f, q) for e, (f, q) in rows[i][j].items() if f not in used[j]}
        share = score(i, free)
        if len(free) > 1 and share >= MOVED:
            found.append((i, j, share))
            used[j].update(f for f, _ in free.values())
            rendered.add(i)
    return found


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ch, rendition, verses, sentences, entries in zip(pdf.ch, pdf.rendition, pdf.verses, pdf.sentences, pdf.entries):
            weight: dict[str, dict[str, float]] = defaultdict(dict)
            for x in entries if entries is not None else ():
                weight[x["e"]][x["f"]] = x["q"]
            halves = [(list(h), v["id"], k) for k, v in enumerate(verses) for h in v["halves"]]
            words = [list(s["words"]) for s in sentences]
            for i, j, share in lexical_alignment([h for h, _, _ in halves], [k for _, _, k in halves], words, weight):
                rows.append((ch, rendition, halves[i][1], int(sentences[j]["sent_no"]), float(share), halves[i][0], words[j]))
        names = ["ch", "rendition", "verse_id", "sent_no", "share", "source", "target"]
        yield _lists(**{name: [r[k] for r in rows] for k, name in enumerate(names)}).astype({"ch": "int64", "sent_no": "int64", "share": "float64"})


def _realigned(chapters: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of half verses and sentences; each chapter gets just the dictionary entries of its own words by a join."""
    words = chapters.select("ch", "rendition", F.explode(F.array_distinct(F.flatten("sentences.words"))).alias("f"))
    stems = chapters.select("ch", "rendition", F.explode(F.array_distinct(F.flatten(F.flatten("verses.halves")))).alias("e"))
    own = words.join(entries, "f").join(stems, ["ch", "rendition", "e"]).groupBy("ch", "rendition").agg(F.collect_list(F.struct("e", "f", "q")).alias("entries"))
    ready = chapters.join(own, ["ch", "rendition"], "left").repartition(_tasks(chapters), "ch", "rendition")
    return ready.mapInPandas(_align, "ch int, rendition string, verse_id string, sent_no int, share double, source array<string>, target array<string>")


def _hints(verses: DataFrame, align: DataFrame, glossary: DataFrame) -> DataFrame:
    """Beads from the editors' anchors and the glossary; wrong ones are outvoted in training."""

    def lexicon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [(verse_halves(None, t), english_stems(r)) for t, r in zip(pdf.term, pdf.rendering) if t and r and not t.startswith("_")]
            yield _lists(source=[h[0] for h, _ in good if h for _ in range(3)], target=[r for h, r in good if h for _ in range(3)])

    def quoted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _lists(source=[[w for h in verse_halves(d, i) for w in h] for d, i in zip(pdf.devanagari, pdf.iast)], target=[[w for a in anchors for w in english_stems(a)] for anchors in pdf.anchors])

    schema = "source array<string>, target array<string>"
    spans = align.select(F.explode("records").alias("r")).select(F.col("r.id").alias("id"), F.flatten("r.telang.anchors").alias("anchors")).where("id is not null and size(anchors) > 0")
    text = verses.groupBy("id").agg(F.min_by(F.struct("devanagari", "iast"), "row_id").alias("v")).select("id", "v.*")
    return glossary.select("term", "rendering").mapInPandas(lexicon, schema).unionByName(spans.join(text, "id").select("devanagari", "iast", "anchors").mapInPandas(quoted, schema))


def aligned(verses: DataFrame, sentences: DataFrame, align: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (verse_id, rendition, sent_no, share), share being the most of a half verse that the sentence renders; and the dictionary (stem, word, weight).

    A verse with several rows counts once (its least row_id with Devanagari text). A chapter is one document: its verses
    and sentences are aligned in one task, chapters in parallel. Verses without text, sentences without words and chapters
    without the other side give no pairs; null ids, chapters or numbers are left out; of repeated sentences one counts.
    Training covers all confident pairs of all chapters. Empty align and glossary tables only take away their hints.
    """
    verses = verses.select("row_id", "id", F.col("ch").cast("int").alias("ch"), F.col("n").cast("int").alias("n"), "devanagari", "iast")
    sentences = sentences.select(F.col("ch").cast("int").alias("ch"), "rendition", F.col("sent_no").cast("int").alias("sent_no"), "text")
    chapters = stored(_chapters(verses, sentences))
    hints = stored(_hints(verses, align, glossary))
    beads = stored(chapters.mapInPandas(_length_pairs, "source array<string>, target array<string>").unionByName(hints).repartition(_tasks(verses)))
    entries = pairs = None
    for training in range(TRAININGS):
        if training:
            old = (beads, entries, pairs)
            beads = stored(pairs.where(f"share >= {MOVED}").select("source", "target").unionByName(hints).repartition(_tasks(verses)))
            release(*old)
        trained = _train(beads)
        entries = stored(dictionary(trained))
        release(trained)
        pairs = stored(_realigned(chapters, entries))
    release(beads, chapters, hints)
    out = pairs.groupBy("verse_id", "rendition", "sent_no").agg(F.max("share").alias("share"))
    return out, entries.select(F.col("e").alias("stem"), F.col("f").alias("word"), F.col("q").alias("weight"))
