"""Problem 5."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rankloom.llm import lookalike as L


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None),
        ("", ""),
        ("Plain text, as is.", "Plain text, as is."),
        ("Ａｂｃ　１２", "Abc 12"),
        ("café", "café"),
        ("e​́", "é"),
        ("ze​ro­ wi⁠dth﻿", "zero width"),
        ("a b c\td\r\ne", "a b c d e"),
        ("ﬁﬂﬀ", "fiflff"),
        ("Аpple οr Ѕtone ԁog һat ԛuiz ԝin", "Apple or Stone dog hat quiz win"),
        ("е́", "é"),
        ("ё", "ë"),
        ("ÅΩ", "ÅΩ"),
        ("ＡＡ̊", "AÅ"),
    ],
)
def test_form(text, want):
    assert L.form(text) == want


def test_visible_things_stay():
    for a, b in (("a", "A"), ("a", "á"), ("a b", "a  b"), ("a.", "a"), ("b a", "a b"), ("1", "l"), ("0", "O"), ("²", "2"), ("ß", "ss")):
        assert L.form(a) != L.form(b)


def test_every_character():
    """Over all code points: a second pass changes nothing, and all canonical writings have one form."""
    for cp in [*range(0xD800), *range(0xE000, 0x110000)]:
        ch = chr(cp)
        f = L.form(ch)
        assert L.form(f) == f == L.form(unicodedata.normalize("NFD", ch)) == L.form(unicodedata.normalize("NFC", ch)), hex(cp)


@pytest.mark.parametrize("a, b", [("가각", "가각"), ("ｶﾞﾊﾟ", "ガパ"), ("한글", "한글"), ("ᄀ\u200bᅡ", "가"), ("𝐀𝟙", "A1"), ("ǌ", "nj"), ("Ⅻ", "XII"), ("κ", "к"), ("Ꭺ", "A"), ("ſ", "s")])
def test_same_look(a, b):
    assert L.form(a) == L.form(b)


def test_classes(spark, collect):
    rows = [("k1", "Apple pie"), ("k2", "Аpple pie"), ("k3", "Apple pie"), ("k5", "apple pie"), ("k6", None), (None, "Apple pie"), ("k2", "Аpple pie")]
    df = spark.createDataFrame(rows, "k string, t string")
    assert collect(L.same_look_classes(df, "k", "t", "x")) == [("x", k, "k1", 3, 2) for k in ("k1", "k2", "k3")]
    many = spark.createDataFrame([(f"k{i:03}", "Аpple" if i % 2 else "Apple") for i in range(40)], "k string, t string")
    want = [("x", f"k{i:03}", f"k{j:03}") for i in range(40) for j in range(i + 1, 40) if (i + j) % 2]
    assert collect(L.same_look_pairs(many, "k", "t", "x", block=7)) == want
    assert collect(L.same_look_classes(df.limit(0), "k", "t", "x")) == []


@given(st.text(max_size=40))
def test_once_is_enough(text):
    once = L.form(text)
    assert L.form(once) == once


@given(st.text(alphabet="aeocAEОСаесéèöﬁＡ１́̈​  .", max_size=30))
def test_composition_does_not_matter(text):
    assert L.form(unicodedata.normalize("NFD", text)) == L.form(unicodedata.normalize("NFC", text))


def test_conflicts_are_refused(monkeypatch):
    for a, b in ("ab", "bc", "cd"):
        monkeypatch.setitem(L._IMAGE, a, b)
    with pytest.raises(ValueError, match="conflict"):
        L._compile()


def test_long_text():
    assert L.form("ａ" * 200_000) == "a" * 200_000


def test_pairs(spark, collect):
    rows = [("k1", "Apple pie", 1), ("k2", "Аpple pie", 2), ("k3", "Apple pie", 3), ("k4", "Apple pie", 4), ("k5", "apple pie", 5), ("k6", None, 6), (None, "Apple pie", 7), ("k2", "Аpple pie", 8), ("k7", "", 9), ("k8", "​", 10)]
    df = spark.createDataFrame(rows, "k string, t string, h int")
    got = collect(L.same_look_pairs(df, "k", "t", "x"))
    assert got == [("x", "k1", "k2"), ("x", "k1", "k3"), ("x", "k2", "k3"), ("x", "k2", "k4"), ("x", "k3", "k4"), ("x", "k7", "k8")]
    assert collect(L.same_look_pairs(df.limit(0), "k", "t", "x")) == []


def test_column_equals_function(spark):
    texts = ["plain", "Ａ", "a\tb", "", None, "café ﬁn"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["f"] for r in L.with_form(df, "t", "f").orderBy("i").collect()]
    assert got == [L.form(t) for t in texts]
