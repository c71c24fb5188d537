"""Problem 6: evaluation texts leaking into training text, by template canonicalisation.

Both sides are read as words, case ignored, and every word becomes a template symbol: numbers, units
and names become typed placeholders, all other words stand for themselves. One lexicon is learnt from
all held-out items together: a word is a name if it stands with a capital inside a sentence more often
than in small letters. A document word the items do not know is taken for a name, as it can only fill a
slot. The symbol depends on nothing but the folded word, so equal words always have equal templates and
no verbatim leak is lost.

Windows of `width` template symbols are hash-joined with those of the items. Documents are read once: a
task passes on a window only if a sieve of the items' template hashes has it, which only overestimates,
so what is joined is a small part of the documents whatever their number. A joined window is checked slot
by slot: the same words throughout are a verbatim leak; a one-to-one replacement of slot values is a
re-parameterised one. The result does not depend on how items or documents lie in files or tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import _mix, _rolling
from rankloom.runtime import BROADCAST_ROWS, small, written

WIDTH = 12
#: Different words the items may have; the lexicon goes to every task.
VOCABULARY = 5_000_000
#: Slots of the sieve as a power of two: at most this many bits. A fuller sieve lets more windows through.
SIEVE_BITS = 27
#: Shares a template's windows are dealt into where the items' windows are too many to be broadcast.
SALTS = 16
#: Words of a re-parameterised window that must stand for themselves.
LITERALS = 6
#: Characters read at a time.
CHUNK = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_TERM = re.compile(r"\d+(?:[.,]\d+)*(?!\w)|[^\W_]+")
_OPENS = re.compile(r"(?:^|[.!?:\n\r\t|\"“«¿¡])[^\w]*$")
_GAP, _NUMBER, _UNIT, _NAME, _FIRST = 0, 1, 2, 3, 8

# Units of measure, folded.
UNITS = frozenset(
    "mm cm dm m km µm nm inch ft yd mi kg g mg µg t lb oz l ml cl dl hl gal s ms µs ns sec min h hr hz khz mhz ghz bit byte kb mb gb tb pb kib mib gib w kw mw gw wh kwh v kv mv a ma ah k "
    "pa kpa hpa bar mbar mol px pt dpi fps rpm ppm db eur usd gbp chf percent prozent ciento cent n kn j kj kcal cal".split()
)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower())


def terms(text: str) -> list[str]:
    """Words, but a number with points or commas inside is one of them."""
    return _TERM.findall(text.lower())


def kind(w: str) -> int:
    """The placeholder of a word that is a number or a unit wherever it stands, else 0."""
    return _NUMBER if w.replace(".", "").replace(",", "").isdecimal() else _UNIT if w in UNITS else 0


class Lexicon(dict):
    """Folded word -> number; the template symbol of a number is in `symbols`. Words of no item are
    numbers, units or names. known: (word, times in small letters, times with a capital inside a sentence)."""

    def __init__(self, known: list[tuple[str, int, int]]):
        super().__init__()
        symbols = list(range(_FIRST))
        for w, low, high in sorted(known):
            dict.__setitem__(self, w, len(symbols))
            symbols.append(kind(w) or (_NAME if high > low else len(symbols)))
        self.symbols = np.array(symbols, dtype=np.uint64)

    def __missing__(self, w: str) -> int:
        return kind(w) or _NAME

    def __reduce__(self):
        return (_restore, (dict(self), self.symbols))


def _restore(known: dict, symbols: np.ndarray) -> Lexicon:
    out = Lexicon.__new__(Lexicon)
    dict.update(out, known)
    out.symbols = symbols
    return out


def _spelt(split):
    """mapInPandas step: items to (word, times small, times with a capital inside a sentence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text in pdf["text"]:
                for w in split(text):
                    seen.setdefault(w, [0, 0])
                for m in _WORD.finditer(text):
                    if m[0][0].islower():
                        seen.setdefault(m[0].lower(), [0, 0])[0] += 1
                    elif m[0][0].isupper() and not _OPENS.search(text[max(0, m.start() - 8) : m.start()]):
                        seen.setdefault(m[0].lower(), [0, 0])[1] += 1
            if seen:
                yield pd.DataFrame({"w": list(seen), "low": [x[0] for x in seen.values()], "high": [x[1] for x in seen.values()]})

    return run


def lexicon(items: DataFrame, split=words) -> Lexicon:
    """The lexicon of all items; more than VOCABULARY different words are refused."""
    counts = items.mapInPandas(_spelt(split), "w string, low long, high long").groupBy("w").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    got = counts.limit(VOCABULARY + 1).collect()  # the vocabulary of the stated query set, of a checked size
    if len(got) > VOCABULARY:
        raise ValueError(f"the items have more than {VOCABULARY} different words")
    return Lexicon([(r["w"], r["low"], r["high"]) for r in got])


def windows(codes: np.ndarray, symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, position) of every window that crosses no gap."""
    if len(codes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = _mix(_rolling(symbols[codes], width, 0x9E3779B97F4A7C15), 0x5EED)
    gaps = np.cumsum(np.concatenate([[0], codes == _GAP]))
    at = np.nonzero(gaps[width:] == gaps[:-width])[0]
    return value[at], at


def _shape(said: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """A hash of which slots of a window have the same value: for each slot, the first one with its value."""
    n, width = said.shape
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        first = np.full(n, i)
        for j in range(i - 1, -1, -1):
            first = np.where(slot[:, i] & slot[:, j] & (said[:, i] == said[:, j]), j, first)
        out = _mix(out ^ np.where(slot[:, i], first + 1, 0).astype(np.uint64), i)
    return out


def _found(shared, sieve, split, width: int, replaced: bool, literals: int, key: str):
    """mapInPandas step: texts to (template, key, said, shape) of their windows; only those the sieve has, where
    there is one. said: a number for each word, negative for words of no item. A verbatim window has known words only,
    a re-parameterised one `literals` words or more that stand for themselves, on both sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Lexicon = shared.value
        code, span = known.__getitem__, np.arange(width)
        bits = sieve.value if sieve is not None else None
        for pdf in batches:
            texts, keys, begin = pdf["text"].tolist(), pdf["id"].to_numpy(), 0
            while begin < len(texts):
                end, codes, first, spoken, size = begin, [], [], [], 0
                while end < len(texts) and (end == begin or size < CHUNK):
                    w = split(texts[end])
                    first.append(len(codes))
                    codes += map(code, w)
                    codes.append(_GAP)
                    if replaced:
                        spoken += [*w, ""]
                    size += len(texts[end])
                    end += 1
                every, starts = np.array(codes, dtype=np.int64), np.array(first)
                value, at = windows(every, known.symbols, width)
                if bits is not None:
                    hit = _in_sieve(bits, value)
                    value, at = value[hit], at[hit]
                if not replaced:
                    strange = np.cumsum(np.concatenate([[0], every < _FIRST]))
                    good = strange[at + width] == strange[at]
                else:
                    slots = np.cumsum(np.concatenate([[0], known.symbols[every] < _FIRST]))
                    good = width - (slots[at + width] - slots[at]) >= literals
                value, at = value[good], at[good]
                if len(at):
                    said = every[at[:, None] + span]
                    shape = np.zeros(len(at), np.uint64)
                    if replaced:
                        slot = known.symbols[said] < _FIRST
                        new: dict[str, int] = {}
                        places = at[:, None] + span
                        rows, cols = np.nonzero(said < _FIRST)
                        said[rows, cols] = [-1 - new.setdefault(spoken[p], len(new)) for p in places[rows, cols].tolist()]
                        shape = _shape(said, slot)
                    owner = np.searchsorted(starts, at, "right") - 1 + begin
                    yield pd.DataFrame({"h": value.view(np.int64), key: keys[owner], "said": list(said.astype(np.int32)), "shape": shape.view(np.int64)})
                begin = end

    return run


def _in_sieve(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = (value >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _slots(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"slots": [np.unique(pdf["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint32).tobytes()]})

    return run


def _sieve_of(asked: DataFrame) -> np.ndarray:
    """A bit for every slot that the template of an item's window falls into."""
    size = max(20, min(SIEVE_BITS, (asked.count() * 16).bit_length()))
    bits = np.zeros(1 << size, dtype=bool)
    for r in asked.select("h").mapInPandas(_slots(size), "slots binary").toLocalIterator():
        bits[np.frombuffer(r["slots"], np.uint32)] = True
    return np.packbits(bits, bitorder="little")


def _leaks(docs: DataFrame, key: str, items: DataFrame, item: str, text: str, width: int, replaced: bool, literals: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    held = items.select(F.col(item).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct()
    split = terms if replaced else words
    shared = spark.sparkContext.broadcast(lexicon(held, split))
    out = lambda df, name: f"h long, {name} {df.schema['id'].dataType.simpleString()}, said array<int>, shape long"
    asked = written(held.mapInPandas(_found(shared, None, split, width, replaced, literals, "item"), out(held, "item")), "leak-items")
    sieve = spark.sparkContext.broadcast(_sieve_of(asked))
    told = rows.mapInPandas(_found(shared, sieve, split, width, replaced, literals, "id"), out(rows, "id"))
    theirs = asked.select("h", F.col("shape").alias("own_shape"), F.col("said").alias("own"), "item")
    if small(theirs, BROADCAST_ROWS):
        joined = told.join(F.broadcast(theirs), "h")
    else:
        salted = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = told.withColumn("salt", F.pmod(F.xxhash64("id", "said"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    same = F.col("said") == F.col("own")
    good = joined.filter(~same & (F.col("shape") == F.col("own_shape")) if replaced else same)
    return good.groupBy("id", "item").agg(F.count("*").alias("n_windows")).select(F.col("id").alias(key), F.col("item").alias(item), "n_windows")


def verbatim_leaks(docs: DataFrame, key: str, items: DataFrame, item: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, item, n_windows): documents and the items of which `width` consecutive words or more stand in
    them as consecutive words.

    Null keys and null texts are left out; items of fewer words than `width` cannot leak; repeated rows
    count once in the pairs and add up in n_windows. Punctuation, blanks, line ends and case do not
    matter. Texts are read whole, whatever their length.
    """
    return _leaks(docs, key, items, item, text, width, False, 0)


def reparameterised_leaks(docs: DataFrame, key: str, items: DataFrame, item: str, text: str = "text", width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """(key, item, n_windows): documents that repeat `width` terms of an item with numbers, names or units
    replaced one-to-one, at least `literals` of them standing for themselves. A number with points or commas
    inside is one term. Windows that are verbatim are not counted; other rules as for verbatim leaks."""
    return _leaks(docs, key, items, item, text, width, True, literals)
