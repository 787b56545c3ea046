"""Noise in text from scanned pages (problem 3): page matter, broken words and misrecognised characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.runtime import small, stored

# fixed values: what a scan shows in place of what was printed, as seen>printed
CONFUSIONS = (
    "c>e e>c f>t t>f b>h h>b q>g g>q v>y y>v i>r r>i n>u u>n l>i i>l 0>o 1>l 1>i 5>s 6>b 6>g 8>b 9>g 4>a "
    "ii>n ii>u cl>d d>cl vv>w rn>m m>rn m>in h>li li>h in>m ni>m nn>m tl>d fi>h iii>m"
)
_PAIRS = [tuple(x.split(">")) for x in CONFUSIONS.split()]
#: How many times as frequent a correction must be as the word it replaces.
RATIO = 5
_HYPHENS = "-¬‐‑\xad⁃"
_NUMERAL = re.compile(r"[IVXLCDMl1]+$")
_NUMBER = re.compile(r"(?=.*\d)[\dlIOoSB]+$")
_WORD = r"\p{L}+(?:['-]\p{L}+)*"
#: Occurrences in capital lines that make a word one of a running head; and the least share of its occurrences that such
#: lines (or, for a word that numbers follow, following numbers) must have for it to be told by that alone.
HEADS, SHARE = 2, 0.25


def fold(word: str) -> str:
    """Lower case without marks and ligatures."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(ch))


def _head_words(line: str) -> tuple[list[str], list[str]] | None:
    """Words of a line that may be page matter, and those of them that a running head must have; null for other lines.

    Every part of such a line is a number, a numeral, a single capital, a word all in capitals, or one in title case.
    """
    parts = re.findall(r"[^\W_]+", line)
    words = [p for p in parts if not _NUMBER.match(p) and not _NUMERAL.match(p) and len(p) > 1]
    titled = []
    for p in words:
        upper = sum(ch.isupper() for ch in p)
        if upper + sum(ch.isdigit() or ch == "l" for ch in p) == len(p) and upper >= 1:
            continue
        if not (p[0].isupper() or p[0].isdigit()):
            return None
        titled.append(fold(p))
    return (words, titled) if parts else None


def is_furniture(line: str, before: str, heads: set[str], telling: set[str], counted: set[str]) -> bool:
    """Whether a line is page matter: running head, page number or signature. before: the last word of the text so far.

    Words in title case must be head words, one of them a telling one. A lone number is text where a word that numbers
    follow comes before it. The sets hold words as they are read, misread ones with them.
    """
    found = _head_words(line)
    if found is None:
        return False
    words, titled = found
    if not words:
        parts = re.findall(r"[^\W_]+", line)
        if len(parts) == 1 and parts[0].isdigit() and fold(before) in counted:
            return False
        return any(ch.isdigit() for p in parts for ch in p) or all(p[0].isupper() for p in parts)
    return not titled or (all(w in heads for w in titled) and any(w in telling for w in titled))


def asked_words(text: str) -> set[tuple[str, str]]:
    """(kind, word) of what reading the paragraph will ask: 'head' for words in title case of lines that may be page matter,
    'lead' for words that may stand before a lone number."""
    out: set[tuple[str, str]] = set()
    lines = text.split("\n")
    for n, line in enumerate(lines):
        found = _head_words(line)
        if found is None:
            continue
        out.update(("head", w) for w in found[1])
        if not found[0]:
            for earlier in reversed(lines[:n]):  # up to the nearest line that is text for sure
                words = _parts(earlier)
                if words:
                    out.add(("lead", fold(words[-1][0])))
                if words and _head_words(earlier) is None:
                    break
    return out


def _parts(line: str) -> list[tuple[str, int]]:
    """Words of a line without outer punctuation, each with its place among the line's white-space tokens."""
    out = []
    for i, token in enumerate(line.split()):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", token)
        if word:
            out.append((word, i))
    return out


def read_paragraph(text: str, heads: set[str], telling: set[str], counted: set[str]) -> list[tuple[int, int, str, str, str, str]]:
    """(line, place, kind, raw, word, next): kind 'f' page matter, 'h' a break with its two parts, 'w' a whole word and its follower."""
    lines = text.split("\n")
    out: list[tuple[int, int, str, str, str, str]] = []
    broken: tuple[int, int, str] | None = None
    before = ""
    for n, line in enumerate(lines):
        if is_furniture(line, before, heads, telling, counted):
            out.append((n, -1, "f", "", "", ""))
            continue
        words = _parts(line)
        if not words:
            continue
        skip = None
        if broken is not None:
            at, place, first = broken
            out.append((at, place, "h", "", fold(first), fold(words[0][0])))
            skip, broken = words[0][1], None
        trail = line.rstrip()
        if trail[-1:] in _HYPHENS and words[-1][1] == len(line.split()) - 1 and not trail.endswith("--"):
            broken = (n, words[-1][1], words[-1][0])
            last = words[-1][1]
        else:
            last = None
        whole = [(w, i) for w, i in words if i != skip and i != last]
        for (w, i), (follower, j) in zip(whole, [*whole[1:], ("", -1)]):
            adjacent = j == i + 1 and not re.search(r"[\W_]$", line.split()[i])
            out.append((n, i, "w", w.lower(), fold(w), fold(follower) if adjacent else ""))
        before = words[-1][0]
    if broken is not None:  # a break at the paragraph's end has no second part: a plain word
        out.append((broken[0], broken[1], "w", broken[2].lower(), fold(broken[2]), ""))
    return out


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of a word's characters: equal for anagrams, and additive. Letters no confusion knows count as one."""
    powers = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.pow(F.least(F.ascii(c), F.lit(255)).cast("double"), F.lit(5)).cast("long"))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda a, b: a + b)


def _value(text: str) -> int:
    return sum(ord(ch) ** 5 for ch in text)


def explained(seen: str, printed: str, most: int = 2) -> int:
    """The least number of confusions, up to `most`, that turn the seen word into the printed one; 0 if none do."""
    states = {(seen, 0)}
    for step in range(1, most + 1):
        fresh = set()
        for word, start in states:
            for x, y in _PAIRS:
                at = word.find(x, start)
                while at >= 0:
                    if word[:at] == printed[:at]:
                        new = word[:at] + y + word[at + len(x) :]
                        if new == printed:
                            return step
                        fresh.add((new, at + len(y)))
                    at = word.find(x, at + 1)
        states = fresh
    return 0


def _alike(words: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, word, telling): words that are, but for a character or two misread, among the known ones of their kind.

    words(kind, word), known(kind, w, telling). Up to three letters must be equal, up to five may have one edit, longer ones
    two. A known word is cut into one part more than edits; a word that is alike has one of them whole, at most two places
    off: both meet on equal parts, then the distance decides.
    """
    parts = F.when(F.length("w") > 5, 3).when(F.length("w") > 3, 2).otherwise(1)
    cut = lambda i: F.floor(F.length("w") * i / F.col("parts")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(cut(i).alias("start"), F.substring("w", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    cuts = known.where("w <> ''").withColumn("parts", parts).select("kind", "w", "parts", "telling", F.inline(pieces))
    size = F.length("word")
    lengths = F.sequence(F.lit(1), F.greatest(F.least(size, F.lit(3)), F.ceil((size + 2) / 2).cast("int")))
    spots = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring("word", i, n).alias("piece")))))
    met = words.where("word <> ''").select("kind", "word", F.inline(spots)).distinct().join(cuts, ["kind", "piece"]).where(F.abs(F.col("at") - 1 - F.col("start")) < F.col("parts"))
    met = met.where(F.levenshtein("word", "w") < F.col("parts"))
    return met.groupBy("kind", "word").agg(F.max("telling").alias("telling"))


def _learnt(lines: DataFrame) -> DataFrame:
    """(kind, w, telling): words of running heads, from lines all in capitals, and words that numbers follow within lines.

    A word counts by its own occurrences alone, however many others there are. One that mostly stands elsewhere is no telling
    word of a head, and is none that numbers follow.
    """
    low = F.lower("text")
    every = lambda pattern, group=0, of="text": F.explode(F.regexp_extract_all(of, F.lit(pattern), F.lit(group))).alias("w")
    capital = lines.where(F.col("text").rlike(r"^[^\p{Ll}]*\p{Lu}{3,}[^\p{Ll}]*$"))
    heads = capital.select(every(r"\p{Lu}{2,}")).select(F.lit("head").alias("kind"), F.lower("w").alias("w"))
    leads = lines.select(every(r"(\p{Ll}{3,}) [0-9]+(?![0-9\p{Ll}])", 1)).select(F.lit("lead").alias("kind"), "w")
    counts = heads.unionByName(leads).groupBy("kind", "w").agg(F.count("*").alias("n")).where(f"n >= {HEADS}")
    everywhere = lines.select(low.alias("text")).select(every(r"\p{L}{2,}")).groupBy("w").agg(F.count("*").alias("of"))
    known = counts.join(everywhere, "w", "left").select("kind", "w", (F.col("n") >= SHARE * F.coalesce("of", "n")).alias("telling"))
    own = lines.sparkSession.createDataFrame([("head", "chapter", True)], "kind string, w string, telling boolean")
    return known.where("kind = 'head' or telling").unionByName(own)


def scan_findings(pages: DataFrame, clean: list[DataFrame], chapter_col: str = "chapter", paras_col: str = "telang_paras") -> DataFrame:
    """(chapter, para, line, place, kind, word), distinct: page matter, broken words and misread words with the right word.

    Running heads are learnt from all lines in capitals, each word by its own count, and a line in title case is page matter
    if its words are, but for a letter or two, such words. pages holds an array of struct<text, ...> for each chapter; each frame of `clean` has one string column of clean text
    in the same language, which with the scan's own words makes the frequency list. A word that clean text never has is
    joined, by anagram hash plus the difference of one known confusion of characters (of two where one explains nothing),
    with words at least RATIO times as frequent. The fewest confusions win, then the greater frequency, then the alphabet.
    Two neighbours on a line whose joining clean text has are a split word unless clean text has them side by side. The
    parts of a break are joined with or without the hyphen, whichever form the words' counts favour. place is the word's
    index among its line's tokens, -1 for page matter. Null and empty paragraphs or arrays give no rows, para counts them.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paras = pages.select(pages[chapter_col].cast("int").alias("chapter"), F.posexplode(pages[paras_col]).alias("para", "x")).select("chapter", "para", F.col("x.text").alias("text")).where("text is not null")
    paras = paras.repartition(parts, "chapter", "para").distinct()  # a fixed number: the reading below is the long part
    paras = stored(paras)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, p, *x) for c, p, t in zip(pdf.chapter, pdf.para, pdf.text) for x in asked_words(t)]
            yield pd.DataFrame(rows, columns=["chapter", "para", "kind", "word"])

    asked = stored(paras.mapInPandas(ask, "chapter int, para int, kind string, word string"))
    known = _alike(asked.select("kind", "word").distinct(), _learnt(paras.select(F.explode(F.split("text", "\n")).alias("text"))))
    set_of = lambda condition: F.collect_set(F.when(F.expr(condition), F.col("word")))
    told = asked.join(known, ["kind", "word"]).groupBy("chapter", "para").agg(set_of("kind = 'head'").alias("heads"), set_of("kind = 'head' and telling").alias("telling"), set_of("kind = 'lead'").alias("counted"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [[set(x) if x is not None else set() for x in pdf[name]] for name in ("heads", "telling", "counted")]
            rows = [(c, p, *x) for c, p, t, *own in zip(pdf.chapter, pdf.para, pdf.text, *sets) for x in read_paragraph(t, *own)]
            yield pd.DataFrame(rows, columns=["chapter", "para", "line", "place", "kind", "raw", "word", "next"])

    tokens = stored(paras.join(told, ["chapter", "para"], "left").repartition(parts).mapInPandas(read, "chapter int, para int, line int, place int, kind string, raw string, word string, next string"))
    words, breaks = tokens.where("kind = 'w'"), tokens.where("kind = 'h'")

    @F.pandas_udf("string")
    def folded(t: pd.Series) -> pd.Series:
        return t.map(lambda x: x.lower() if x.isascii() else fold(x))

    texts = None
    for one in clean:
        one = one.select(F.col(one.columns[0]).alias("as_is")).where("as_is is not null").select("as_is", folded("as_is").alias("t"))
        texts = one if texts is None else texts.unionByName(one)
    if texts is None:
        texts = tokens.select(F.col("word").alias("as_is"), F.col("word").alias("t")).limit(0)
    seen_clean = texts.select(F.explode(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("clean"))
    pairs_clean = texts.select(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)).alias("a")).where("size(a) > 1").select(F.explode(F.arrays_zip(F.expr("slice(a, 1, size(a) - 1)").alias("x"), F.expr("slice(a, 2, size(a) - 1)").alias("y"))).alias("p")).select("p.x", "p.y").distinct()
    # within the scan the same counts come from raw words without marks, so that a misread form never lends weight to itself
    seen_scan = words.where("raw = word").groupBy(F.col("word").alias("w")).agg(F.count("*").alias("scan"))
    counts = seen_clean.join(seen_scan, "w", "full").select("w", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("scan", F.lit(0)).alias("scan"))
    counts = stored(counts.withColumns({"n": F.col("clean") + F.col("scan"), "h": anagram_hash(F.col("w"))}))

    # the two ways to join a break, by counts
    both = breaks.select("word", "next").distinct().withColumns({"joined": F.concat("word", "next"), "kept": F.concat("word", F.lit("-"), "next")})
    n = small(counts.select("w", "n", "clean"))
    for form in ("joined", "kept", "word", "next"):
        both = both.join(n.select(F.col("w").alias(form), F.col("n").alias(f"n_{form}"), F.col("clean").alias(f"c_{form}")), form, "left")
    has = lambda c: F.coalesce(c, F.lit(0))
    keep = (has("n_kept") > has("n_joined")) | ((has("n_kept") == has("n_joined")) & (has("n_joined") == 0) & (has("c_word") > 0) & (has("c_next") > 0) & (F.length("word") > 2) & (F.length("next") > 2))
    both = stored(both.select("word", "next", F.when(keep, F.col("kept")).otherwise(F.col("joined")).alias("whole")))

    unknown = words.select("raw", "word").union(both.select("whole", "whole")).where("length(word) > 1 and word rlike '\\\\p{L}'").distinct()
    unknown = unknown.join(n, unknown["word"] == n["w"], "left").select("raw", "word", has("n").alias("own"), has("clean").alias("own_clean"))
    # marks on a word that clean text has only without them are the scan's
    own_marks = texts.where(F.col("as_is").rlike(r"[^\x00-\x7F]")).select(F.explode(F.regexp_extract_all(F.lower("as_is"), F.lit(_WORD), F.lit(0))).alias("raw")).distinct()
    marked = unknown.where("raw <> word and own_clean > 0").select("raw", F.col("word").alias("right")).join(own_marks, "raw", "left_anti")
    unknown = stored(unknown.where("own_clean = 0").withColumn("h", anagram_hash(F.col("word"))))

    single = F.lit(sorted({_value(y) - _value(x) for x, y in _PAIRS}))

    @F.pandas_udf("int")
    def steps(seen: pd.Series, printed: pd.Series) -> pd.Series:
        return pd.Series([explained(a, b) for a, b in zip(seen, printed)], dtype="int32")

    right = counts.where("n > 1 or clean > 0").select(F.col("w").alias("right"), F.col("n").alias("of"), "h")

    def corrected(rare: DataFrame, twice: bool = False) -> DataFrame:
        """The best word of a hash that differs by one confusion, or by two: then each side goes one of them towards the other."""
        away = F.explode(F.transform(single, lambda d: F.col("h") + d))
        other = right.withColumn("h", F.explode(F.transform(single, lambda d: F.col("h") - d))) if twice else right
        met = rare.withColumn("h", away).join(small(other), "h").where((F.col("of") >= RATIO * F.col("own")) & (F.abs(F.length("word") - F.length("right")) <= 4))
        met = met.select("raw", "word", "right", "of").distinct().withColumn("steps", steps("word", "right")).where("steps > 0")
        best = met.groupBy("raw").agg(F.min(F.struct("steps", (-F.col("of")).alias("of"), "right")).alias("b"))
        return best.select("raw", "b.right")

    once = stored(corrected(unknown))
    left = stored(unknown.where("length(word) > 4").join(once, "raw", "left_anti"))
    twice = corrected(left, twice=True)
    # an inflected form that neither text has right: its stem is looked up instead
    stems = left.where("word like '%s'").join(twice, "raw", "left_anti").select("raw", F.expr("substring(word, 1, length(word) - 1)").alias("word"), F.lit(0).alias("own"))
    stems = stems.join(n.select(F.col("w").alias("word")), "word", "left_anti").withColumn("h", anagram_hash(F.col("word")))
    stems = corrected(stems.select("raw", "word", "own", "h")).select("raw", F.concat("right", F.lit("s")).alias("right"))
    right_of = stored(once.unionByName(twice).unionByName(stems).unionByName(marked).groupBy("raw").agg(F.min("right").alias("right")))

    spot = ["chapter", "para", "line", "place"]
    joined = words.where("next <> ''").select(*spot, "word", "next", F.concat("word", "next").alias("whole"))
    joined = joined.join(n.where("clean > 0").select(F.col("w").alias("whole")), "whole").join(pairs_clean.select(F.col("x").alias("word"), F.col("y").alias("next")), ["word", "next"], "left_anti")
    joined = stored(joined.select(*spot, F.lit("misread").alias("kind"), F.col("whole").alias("right")))
    taken = joined.select(*spot).union(joined.select("chapter", "para", "line", F.col("place") + 1))
    wrong = words.join(small(right_of), "raw").select(*spot, F.lit("misread").alias("kind"), "right").join(taken, spot, "left_anti")
    fixed_breaks = breaks.join(both, ["word", "next"]).join(right_of.withColumnRenamed("raw", "whole"), "whole", "left")
    fixed_breaks = fixed_breaks.select(*spot, F.lit("hyphen").alias("kind"), F.coalesce("right", "whole").alias("right"))
    page = tokens.where("kind = 'f'").select(*spot, F.lit("furniture").alias("kind"), F.lit("").alias("right"))
    return page.unionByName(fixed_breaks).unionByName(wrong).unionByName(joined.select(*spot, "kind", "right")).withColumnRenamed("right", "word").distinct()


def _rebuild(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """One continuous paragraph: page matter dropped, breaks joined, words put right in the case and punctuation they stand in."""
    lines = text.split("\n")
    gone = {line for line, _, kind, _ in found if kind == "furniture"}
    fix = {(line, place): (kind, word) for line, place, kind, word in found if kind != "furniture"}
    out: list[str] = []
    pending: str | None = None
    for n, line in enumerate(lines):
        if n in gone:
            continue
        tokens = line.split()
        i = 0
        while i < len(tokens):
            token = tokens[i]
            if pending is not None:
                tail = re.search(r"[\W_]*$", token).group()
                out.append(pending + tail)
                pending = None
                i += 1
                continue
            kind, word = fix.get((n, i), ("", ""))
            if kind:
                bare = re.sub(r"^[\W_]+|[\W_]+$", "", token)
                word = word.capitalize() if bare[:1].isupper() else word
                front = re.match(r"[\W_]*", token).group()
                if kind == "hyphen":
                    pending = front + word
                else:
                    following = tokens[i + 1] if i + 1 < len(tokens) else ""
                    split = fold(bare) + fold(re.sub(r"^[\W_]+|[\W_]+$", "", following)) == word.lower()
                    out.append(front + word + re.search(r"[\W_]*$", following if split else token).group())
                    i += split
            else:
                out.append(token)
            i += 1
    if pending is not None:
        out.append(pending)
    return " ".join(out)


def repaired(pages: DataFrame, findings: DataFrame, chapter_col: str = "chapter", paras_col: str = "telang_paras") -> DataFrame:
    """(chapter, para, text): each paragraph as continuous text; paragraphs that were page matter only are left out.

    A paragraph's findings, no more than its words, travel with it; null paragraphs are left out, empty ones too.
    """
    paras = pages.select(pages[chapter_col].cast("int").alias("chapter"), F.posexplode(pages[paras_col]).alias("para", "x")).select("chapter", "para", F.col("x.text").alias("text")).where("text is not null").distinct()
    notes = findings.groupBy("chapter", "para").agg(F.collect_list(F.struct("line", "place", "kind", "word")).alias("found"))

    @F.pandas_udf("string")
    def rebuild(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_rebuild(t, [(x["line"], x["place"], x["kind"], x["word"]) for x in (f if f is not None else [])]) for t, f in zip(text, found)])

    return paras.join(notes, ["chapter", "para"], "left").select("chapter", "para", rebuild("text", "found").alias("text")).where("text <> ''")
