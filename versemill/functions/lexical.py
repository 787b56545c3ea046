"""Word normalization as column expressions: stems, negation roots and lemmas. The lexicon is a parameter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: function words
STOPWORDS = """a an the and or but of to in on at for with by from as is are was were be been being it its this that these those he
him his she her they them their we us our you your i my me mine thou thee thy thine ye hath doth dost ere unto upon into out up
down so such no not nor yet still even ever never always o oh ah alas lo behold saith shall will would should could may might must
can do does did done have has had having what which who whom whose where when why how there here then than too very much many more
most own same all both each every any some few one two first thus hence therefore wherefore nay yea neither either without whoever
whoso whatever whichever only merely solely whether alike plus non myself yourself himself herself itself ourselves themselves
oneself un re along""".split()
# fixed values: words no ending is taken from; roots that "dis" negates; words whose "un" is no negation
KEPT = ("nothing", "something", "everything", "anything")
DIS_ROOTS = ("like", "agree", "approve", "comfort", "trust", "honest", "loyal", "regard", "respect", "obey", "please", "appear")
UN_WORDS = ("until", "unless")
# fixed values: endings in the order they are tried, each with the least length of the word, the characters cut and what is put
# there; order and lengths must stay as they are for stems to equal those of other editions of a corpus
ENDINGS = (
    ("ies$", 5, 3, "i"), ("lves$", 7, 4, "lf"), ("ied$", 6, 3, "i"), ("sses$", 4, 2, ""), ("(sh|ch|x|z)es$", 3, 2, ""), ("es$", 5, 1, ""), ("[^s]s$", 4, 1, ""),
    ("[^aeiou]y$", 4, 1, "i"), ("^.{0,4}$", 0, 0, ""), ("eth$", 7, 3, ""), ("e$", 6, 1, ""), ("ingly$", 9, 5, ""), ("edly$", 8, 4, ""), ("ing$", 7, 3, ""), ("ed$", 6, 2, ""), ("es$", 6, 2, ""), ("ly$", 6, 2, ""),
)


# fixed values: other names of persons
ALIASES = dict(
    x.split(">")
    for x in """sanjaya>sanjaya sawaya>sanjaya sanjay>sanjaya dhritarashtra>dhritarashtra dhritarashtr>dhritarashtra krishna>krishna
madhusudan>krishna driver>krishna madhusudana>krishna janardana>krishna keshava>krishna kesava>krishna govinda>krishna
hrishikesha>krishna arjuna>arjuna partha>arjuna parantapa>arjuna scourge>arjuna dhananjaya>arjuna kaunteya>arjuna gudakesha>arjuna
bharata>arjuna bhishma>bhishma drona>drona""".split()
)
# fixed values: families of verbs; before the bar those inflected by rule, after it their other forms; a later family wins
FAMILIES = """say: say ask tell speak address answer reply utter declare | said told spoke spoken spake
see: see behold perceive look comprehend find grasp | saw seen beheld found
slay: slay kill smite | slew slain smote smitten
fight: fight battle | fought war
know: know understand | knew known understood knower knowers
do: do perform | does did done doing wrought
go: go repair proceed tread walk cease stop | goes went gone halt
come: come | came
think: think seem | thought
feel: feel | felt
give: give bestow renounce | gave given renunciation
take: take seek cast arise receive accept seize | took taken sought arose arisen
make: make | made maker makers
die: die perish | dying dead death mortal
live: live | alive
grieve: grieve mourn lament sorrow weep | wept
win: win conquer prevail obtain | won victory triumph conquest
hear: hear listen | heard hark
want: want desire wish crave covet long | ambitious aspirant
leave: leave abandon forsake relinquish drop desert resign submit yield | left abandonment forsook forsaken renounce quit refusal submitted
begin: begin commence start | began begun beginning"""
# fixed values: old words and what is said today
ARCHAIC = dict(
    x.split(">")
    for x in """assembled>gather assemble>gather desirous>eager rended>tear rent>torn resound>echo resounded>echo behest>command
vanquish>defeat vanquished>defeat verily>truly perchance>perhaps whence>where thither>there hither>here betwixt>between
amongst>among amidst>amid ere>before oft>often turbid>troubled dejected>despair overcome>overwhelm kinsmen>kin
lawlessness>lawless unrighteousness>lawless steadfast>steady discern>know felicity>happy blissful>happy wretched>miserable
sordid>miserable eschew>avoid shun>avoid fain>gladly anon>soon mantle>cloak vesture>garment raiment>garment smite>strike
smitten>strike wrought>do dight>adorn""".split()
)


def inflected(verb: str) -> list[str]:
    """The regular forms of a verb."""
    soft = bool(re.search("[^aeiou]y$", verb))
    short = bool(re.fullmatch("[^aeiou]*[aeiou][^aeiouwxy]", verb))
    s = verb[:-1] + "ies" if soft else verb + ("es" if re.search("(s|x|z|ch|sh)$", verb) else "s")
    ed = verb[:-1] + "ied" if soft else verb + "d" if verb.endswith("e") else verb + verb[-1] * short + "ed"
    ing = verb[:-1] + "ing" if re.search("[^e]e$", verb) else verb + verb[-1] * short + "ing"
    return [verb, s, ed, ing]


def family_forms(families: str = FAMILIES) -> dict[str, str]:
    """Form to the name of its family."""
    out: dict[str, str] = {}
    for line in families.splitlines():
        name, words = line.split(":")
        verbs, _, others = words.partition("|")
        out |= {form: name for verb in verbs.split() for form in inflected(verb)} | {form: name for form in others.split()}
    return out


@dataclass(frozen=True)
class Lexicon:
    """What a corpus brings along: other names, forms of words, and what stands for what; each may be replaced.

    concepts are sets of words that stand for each other, terms words of the other language with their glosses; both are long
    lists of an edition and come from a file (sources.readers.lexicon), none are built in.
    """

    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    forms: dict[str, str] = field(default_factory=family_forms)
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    archaic: dict[str, str] = field(default_factory=lambda: dict(ARCHAIC))
    concepts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    terms: dict[str, tuple[str, ...]] = field(default_factory=dict)


def stem(word: Column) -> Column:
    """The first ending that fits is cut (LX1); words of one letter give ''."""
    out = F.when(word.isin(*KEPT), word).when(F.length(word) <= 1, F.lit(""))
    for end, least, cut, put in ENDINGS:
        rest = F.substring(word, F.lit(1), F.length(word) - cut) if cut else word
        out = out.when((F.length(word) >= least) & word.rlike(end), F.concat(rest, F.lit(put)) if put else rest)
    return out.otherwise(word)


def negation_root(word: Column) -> Column:
    """What un or dis negates, or null (LX3)."""
    un = word.rlike("^un.{5,}$") & ~word.isin(*UN_WORDS) & ~word.rlike("^(under|univers)")
    rest = F.substring(word, F.lit(4), F.length(word))
    return F.when(un, F.substring(word, F.lit(3), F.length(word))).when(word.startswith("dis") & rest.isin(*DIS_ROOTS), rest)


def normalized(words: Column, lexicon: Lexicon) -> Column:
    """Each word with its negation replaced by the root, then its alias, its irregular form, its stem (LX2, LX4).

    One pass over the array for each step: within a lambda nothing is shared, so nested steps would be worked out anew for
    every ending that is tried.
    """
    words = F.transform(words, lambda w: F.coalesce(negation_root(w), w))
    for table in (lexicon.aliases, lexicon.forms):
        if table:
            words = _looked_up(words, table)
    return F.transform(words, stem)


def _looked_up(words: Column, table: dict[str, str]) -> Column:
    """The map is searched only for the few words that a hash set holds."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(words, lambda w: F.when(w.isin(*table), F.try_element_at(known, w)).otherwise(w))


def normalized_word(word: Column, lexicon: Lexicon) -> Column:
    """One word by the same path."""
    return normalized(F.array(word), lexicon)[0]


def plain_words(text: Column) -> Column:
    """Words of a to z in lower case; carets of scans are no break."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"\^", ""), "[^a-z ]", " "), " +"), lambda w: w != "")


def lemmas(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Distinct content lemmas; words in -ily also give the stem without ly (LX5). Null text gives null."""
    words = plain_words(text)
    main = normalized(F.filter(words, lambda w: ~w.isin(*lexicon.stopwords)), lexicon)
    adverbs = F.filter(words, lambda w: (F.length(w) > 5) & w.endswith("ily"))
    adverbs = F.transform(F.transform(adverbs, lambda w: F.substring(w, F.lit(1), F.length(w) - 2)), stem)
    return F.array_distinct(F.filter(F.concat(main, adverbs), lambda w: w != ""))


def stem_sql(word: str) -> str:
    """The endings as a CASE of standard SQL, for another engine."""
    arms = [f"WHEN {word} IN ({', '.join(repr(k) for k in KEPT)}) THEN {word}", f"WHEN length({word}) <= 1 THEN ''"]
    for end, least, cut, put in ENDINGS:
        rest = f"left({word}, length({word}) - {cut})" if cut else word
        arms.append(f"WHEN length({word}) >= {least} AND regexp_matches({word}, '{end}') THEN {rest} || '{put}'")
    return f"CASE {' '.join(arms)} ELSE {word} END"


def negation_sql(word: str) -> str:
    un = f"regexp_matches({word}, '^un.{{5,}}$') AND {word} NOT IN ({', '.join(map(repr, UN_WORDS))}) AND NOT regexp_matches({word}, '^(under|univers)')"
    return f"CASE WHEN {un} THEN substr({word}, 3) WHEN {word} LIKE 'dis%' AND substr({word}, 4) IN ({', '.join(map(repr, DIS_ROOTS))}) THEN substr({word}, 4) END"
