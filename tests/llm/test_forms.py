"""Plain coding of look-alike text."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versemill.llm import forms

DEVA, IAST = "ऐल्पते स्नौल्पालेन ।\nमील्पन्ताः", "ailpate snaulpālena |\nmīlpantāḥ ṁ"


@pytest.mark.parametrize("script, good, bad", [
    ("devanagari", DEVA, [DEVA.replace("।", x) for x in "|│ǀ｜"] + [DEVA.replace("ः", x) for x in ":：꞉"] + [DEVA.replace(" ", x) for x in "    　 "] + [DEVA[:3] + x + DEVA[3:] for x in "​­⁠﻿‎͏᠎"] + ["अा", "एे", "अो"]),
    ("latin", IAST, [unicodedata.normalize("NFD", IAST), IAST.replace("a", "а"), IAST.replace("p", "ｐ"), IAST.replace("|", "∣"), IAST.replace("|", "।"), IAST.replace(" ", " "), IAST + "​", IAST + "ν"]),
])
def test_dirt_is_found_and_undone(script, good, bad):
    assert forms.is_plain(good, script) and forms.plain(good, script) == good
    for text in bad:
        assert not forms.is_plain(text, script), ascii(text)
        assert forms.is_plain(forms.plain(text, script), script)


def test_plain_restores():
    assert forms.plain(unicodedata.normalize("NFD", IAST).replace("a", "\u0430").replace(" ", "\u00a0\u200b"), "latin") == IAST
    assert forms.plain(None, "latin") is None and forms.is_plain(None, "latin") and forms.is_plain("", "devanagari")


def test_letters_of_the_public_table():
    """Dotless i, small capitals, hooked letters, Cherokee and Lisu letters inside Latin words; capitals stay capitals."""
    for seen, printed in ("ıi", "ᴅd", "ɴn", "ꜱs", "ɾr", "ᎪA", "ꓮA", "ІI", "ΙI", "јj", "ɡg", "ｍm", "ԁd"):
        text = f"ma{seen}ta"
        assert not forms.is_plain(text, "latin") and forms.plain(text, "latin") == f"ma{printed}ta", seen
    assert not forms.is_plain("deʋa", "latin") and forms.is_plain(forms.plain("deʋa", "latin"), "latin")
    for text in ("rn vv 1lI0O m", "Śrī-kṛṣṇa's ḷ ṝ m̐"):
        assert forms.is_plain(text, "latin"), text
    assert forms.plain("૨૩", "devanagari") == "२३" and forms.plain("तુ", "devanagari") == "तु"
    assert not forms.is_plain("дa", "latin")  # a foreign letter without a look-alike


def test_groups_and_cases_agree(spark):
    rows = [(1, "mata"), (2, "mаta"), (3, "mat\u200ba"), (4, "mata"), (5, "other"), (6, "дa"), (7, "дa")]
    df = spark.createDataFrame(rows, "row_id long, iast string")
    got = [(g.variants, g.records, g.plain) for g in forms.lookalike_groups(forms.normal_forms(df, "row_id", {"iast": "latin"})).collect()]
    assert got == [(3, 4, "mata")]
    assert sorted(r.row_id for r in forms.not_plain(df, "row_id", {"iast": "latin"}).collect()) == [2, 3, 6, 7]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.sampled_from(["devanagari", "latin"]))
def test_plain_is_stable(text, script):
    once = forms.plain(text, script)
    assert forms.plain(once, script) == once and forms.skeleton(once, script) == forms.skeleton(text, script)


def test_frame(spark):
    rows = [(1, DEVA, IAST, "x"), (2, DEVA.replace("।", "|"), None, "x"), (3, DEVA, "", "x"), (3, DEVA, "", "x"), (4, "", "\uff41" * 5000, "x")]
    df = spark.createDataFrame(rows, "row_id long, devanagari string, iast string, field string")
    long = forms.normal_forms(df, "row_id", {"devanagari": "devanagari", "iast": "latin"})
    fields = {"devanagari": "devanagari", "iast": "latin"}
    assert sorted((r.row_id, r.field) for r in forms.not_plain(df, "row_id", fields).collect()) == [(2, "devanagari"), (4, "iast")]
    assert long.count() == 9 and forms.not_plain(df.limit(0), "row_id", fields).count() == 0
    groups = forms.lookalike_groups(long).collect()
    assert [(g.field, g.variants, g.records, g.plain) for g in groups] == [("devanagari", 2, 4, DEVA)]
    assert forms.normal_forms(df.limit(0), "row_id", {"iast": "latin"}).count() == 0
