"""Problem 5: one form for texts that look the same.

A transducer over grapheme clusters. Its table is computed once, when the module is loaded, from
five rules: character width, ligatures and letters written as one sign, blanks and invisible
characters, composed accents, and look-alike letters. The table is checked for conflicts (two rules
disagreeing about one source, or an image that is itself a source) before it is compiled into one
pattern, which takes the longest match: a base character with all marks, conjoining letters and
invisible characters that follow it. Every text is rewritten in one pass from left to right; a second
pass changes nothing, and composed and separate writings have one form.

Letter case, punctuation, accents, word order and the number of blanks stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.runtime import written

# Letters of other scripts that are drawn like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Cyrillic small letters
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s",
    "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Letters and signs of other blocks
    "ɡ": "g", "ɑ": "a", "ı": "i", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K",
    "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O",
    "ꓴ": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y",
    "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T",
    "Ⲭ": "X", "Ⲩ": "Y", "Ⲍ": "Z", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # small letters that are drawn like each other but like no Latin letter in common use
    "κ": "к", "ĸ": "к", "ⲕ": "к",
}

# Signs with the format category that are drawn, and ignorable characters without it.
DRAWN_FORMAT_SCRIPTS = ("ARABIC", "SYRIAC", "KAITHI", "EGYPTIAN")
OTHER_IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


#: Blocks that hold letters, marks, blanks or format characters; unified ideographs, Hangul syllables, private use
#: and surrogates are left out, as no rule has them as a source.
ASSIGNED = [*range(0x3400), *range(0xA490, 0xAC00), *range(0xF900, 0x12000), *range(0x13430, 0x13460), *range(0x16100, 0x17000), *range(0x1BC00, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
#: Letters that join the one before them: vowels and finals of Hangul, and the voicing marks of half-width kana.
JOINING = [*range(0x1160, 0x1200), *range(0xD7B0, 0xD800), 0xFF9E, 0xFF9F]


def _rules() -> tuple[dict[str, str], frozenset[str], frozenset[str]]:
    """Single-character images of the width, ligature, blank and invisible rules; the invisible
    characters; the combining marks."""
    image: dict[str, str] = {}
    hidden, marks = {chr(c) for c in OTHER_IGNORABLE}, set()

    def put(ch: str, to: str) -> None:
        if image.setdefault(ch, to) != to:
            raise ValueError(f"conflict: {ch!r} to {image[ch]!r} and to {to!r}")

    for cp in ASSIGNED:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" and not unicodedata.name(ch, "").startswith(DRAWN_FORMAT_SCRIPTS):
            hidden.add(ch)
        elif kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
            if ch != " ":
                put(ch, " ")
        elif kind[0] == "M" and ch not in hidden:
            marks.add(ch)
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in ("<wide>", "<narrow>") and kind[0] != "Z" and ch not in hidden:
            put(ch, "".join(chr(int(x, 16)) for x in parts[1:]))
        name = unicodedata.name(ch, "")
        if parts and parts[0] == "<compat>" and "ARABIC" not in name and ("LIGATURE" in name or name.startswith(("LATIN", "ROMAN NUMERAL"))):
            put(ch, unicodedata.normalize("NFKC", ch))  # ligatures, two letters as one sign, long s, numerals of letters
        if parts and parts[0] == "<font>" and "ARABIC" not in name:
            put(ch, unicodedata.normalize("NFKC", ch))  # letters and digits of mathematics
    for ch in hidden:
        put(ch, "")
    for ch, to in LOOKALIKES.items():
        put(ch, to)
    return image, frozenset(hidden), frozenset(marks)


_IMAGE, _HIDDEN, _MARKS = _rules()


def _image(cluster: str) -> str:
    """What the rules make of one cluster: decompose, map every character, compose."""
    flat = unicodedata.normalize("NFD", cluster)
    for _ in range(3):  # the image of one rule may be the source of another, which maps in the next round
        flat = unicodedata.normalize("NFD", "".join(_IMAGE.get(ch, ch) for ch in flat))
    return unicodedata.normalize("NFC", flat)


def _compile() -> dict[str, str]:
    """The table: every character that changes alone, and every base with the marks it composes with."""
    table: dict[str, str] = {}
    for cp in ASSIGNED:
        ch = chr(cp)
        if ch not in _IMAGE and not unicodedata.decomposition(ch):
            continue
        to = _image(ch)
        if to != ch:
            table[ch] = to
        flat = unicodedata.normalize("NFD", ch)
        if len(flat) > 1 and flat != ch and all(x in _MARKS for x in flat[1:]):
            table[flat] = _image(flat)
    for source, to in table.items():  # no image may be rewritten again, else two passes would differ from one
        again = "".join(table.get(ch, ch) for ch in to)
        if unicodedata.normalize("NFC", again) != to:
            raise ValueError(f"conflict: {source!r} becomes {to!r}, which becomes {again!r}")
    return table


def _class(chars) -> str:
    """A character class as sorted ranges."""
    codes = sorted(map(ord, chars))
    out, start, last = [], None, None
    for c in codes + [None]:
        if start is not None and (c is None or c != last + 1):
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(last)) if last > start else ""))
            start = None
        if start is None:
            start = c
        last = c
    return "[" + "".join(out) + "]"


TABLE = _compile()
#: Keys a block of a form holds; a task's pairs of two blocks are at most this number squared.
BLOCK = 1000
_TAIL = _class(_MARKS | _HIDDEN | set(map(chr, JOINING)))
_ALONE = _class(k for k in TABLE if len(k) == 1)
_CLUSTER = re.compile(f"(?s:.){_TAIL}+|{_ALONE}")
_PLAIN = re.compile(r"[\t\n\r\v\f]")
#: What a comparison that ignores case adds: small letters whose capitals are one form, (letters, their images).
FOLD = {c.lower(): to.lower() for c, to in LOOKALIKES.items() if c.isupper() and len(c.lower()) == 1 and c.lower() not in _IMAGE}


def folded(form: Column) -> Column:
    """A text in one form in lower case, letters that look alike as capitals being one letter."""
    return F.translate(F.lower(form), "".join(FOLD), "".join(FOLD.values()))


@lru_cache(maxsize=1 << 16)
def _step(cluster: str) -> str:
    """One transition: the table's image of the cluster, or the rules' own for clusters it does not list."""
    return TABLE[cluster] if cluster in TABLE else _image(cluster)


def form(text: str | None) -> str | None:
    """The one form of a text; null stays null, an empty text stays empty. A carriage return with its
    line feed counts as one blank."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii():
        return _PLAIN.sub(" ", text)
    return _CLUSTER.sub(lambda m: _step(m[0]), text)


@F.pandas_udf(T.StringType())
def _form_udf(texts: pd.Series) -> pd.Series:
    return texts.map(form, na_action="ignore")


def one_form(col: Column | str) -> Column:
    """The transducer as a column. The Python worker gets the texts with other characters than ASCII; a null
    stands in for all others, whose blanks are replaced in the JVM."""
    c = F.col(col) if isinstance(col, str) else col
    plain = c.rlike(r"^\p{ASCII}*$")
    blanks = F.regexp_replace(c, r"\r\n|[\t\n\r\x0B\f]", " ")
    return F.when(plain, blanks).otherwise(_form_udf(F.when(~plain, c)))


def with_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """`df` with the column `out` holding the one form of `text`."""
    return df.withColumn(out, one_form(text))


def look_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, look, stored) of the rows with a key and a text, each once: 128-bit hashes of the one form and of the
    text as it is. No text is shuffled."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    return rows.select("k", F.md5(one_form("t")).alias("look"), F.md5("t").alias("stored")).distinct()


def look_classes(rows: DataFrame) -> DataFrame:
    """(look, n_keys, n_texts, class_id) of forms that occur in two different texts or more; class_id is the
    smallest key."""
    per = rows.groupBy("look", "stored").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    return per.groupBy("look").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"), F.min("least").alias("class_id")).filter("n_texts > 1")


def same_look_pairs(df: DataFrame, key: str, text: str, tbl: str, block: int = BLOCK) -> DataFrame:
    """Pairs of different keys whose stored texts differ but have one form: (tbl, key_a, key_b).

    Null keys and null texts give no pair; repeated rows count once; a key delivered with several
    texts is paired by each of them. Rows with the very same text are never paired with each other. The
    keys of a form are dealt into blocks of about `block`, and a pair of blocks is one key of the join, so a
    form that a third of all rows have is spread over many tasks. `same_look_classes` says the same in one row a key.
    """
    rows = written(look_rows(df, key, text), "looks")  # read three times below; the transducer runs once
    many = look_classes(rows).select("look", F.ceil(F.col("n_rows") / block).cast("int").alias("n"))
    at = lambda low: F.explode(F.sequence(low, F.col("n") - 1))
    met = many.withColumn("i", at(F.lit(0))).withColumn("j", at(F.col("i"))).select("look", "i", "j")
    dealt = rows.join(many, "look").select("look", "k", "stored", F.pmod(F.xxhash64("k"), F.col("n")).cast("int").alias("at"))
    left = met.join(dealt.select("look", F.col("at").alias("i"), F.col("k").alias("x"), F.col("stored").alias("sx")), ["look", "i"])
    right = dealt.select("look", F.col("at").alias("j"), F.col("k").alias("y"), F.col("stored").alias("sy"))
    pairs = left.join(right, ["look", "j"]).filter("x <> y and sx <> sy and (i <> j or x < y)")
    return pairs.select(F.lit(tbl).alias("tbl"), F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def same_look_classes(df: DataFrame, key: str, text: str, tbl: str) -> DataFrame:
    """One row per key that looks like a row stored otherwise: (tbl, key, class_id, n_keys, n_texts). class_id is
    the smallest key with that form; a key delivered with texts of several forms has a row for each."""
    rows = written(look_rows(df, key, text), "looks")
    keys = rows.select("look", "k").distinct()
    count = keys.groupBy("look").agg(F.count("*").alias("n_keys"))
    many = look_classes(rows).join(count, "look").select("look", "class_id", "n_keys", "n_texts")
    return keys.join(many, "look").select(F.lit(tbl).alias("tbl"), F.col("k").alias("key"), "class_id", "n_keys", "n_texts")
