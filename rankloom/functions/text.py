"""Text expressions, all of built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_BLANKS = r"(?U)^\s+|\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), _EDGE_BLANKS, "")


def title_text(title: Column | str, text: Column | str) -> Column:
    """Title and text with one blank between; null counts as empty."""
    return strip(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(text), F.lit(""))))


def slug(c: Column | str) -> Column:
    """A name fit for a file."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]", "_")


def short_name(c: Column | str) -> Column:
    """The part after the last slash, other characters as single dashes, none at the ends; null is empty."""
    last = F.substring_index(F.coalesce(col(c), F.lit("")), "/", -1)
    return F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def identity(*parts: Column | str, length: int = 12) -> Column:
    """A short hash of the parts joined by bars. A null part makes it null."""
    joined = [x for p in parts for x in (F.lit("|"), col(p).cast("string"))][1:]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, length)


def cut(text: Column | str, n: int) -> Column:
    """At most n characters, ending at a word and marked; a text that fits is unchanged. A head without
    a blank is cut inside its word; a head of blanks only stays as it is."""
    t = col(text)
    head = F.substring(t, 1, n)
    bare = F.regexp_replace(head, r"(?U)\s+$", "")
    inner = F.regexp_replace(bare, r"(?U)^\s+", "")
    worded = F.when(bare == "", head).when(~inner.rlike(r"(?U)\s"), inner).otherwise(F.regexp_replace(bare, r"(?U)\s+\S+$", ""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.when(F.instr(head, " ") > 0, worded).otherwise(head), F.lit("...")))


def numbered(texts: Column | str, n: int) -> Column:
    """One line a text, counted from 1, each cut to n characters; no text, no line."""
    return F.array_join(F.transform(col(texts), lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), cut(t, n))), "\n")


def snippets(texts: Column | str, n: int) -> Column:
    """Marked excerpts of the first n characters, a blank line between."""
    return F.array_join(F.transform(col(texts), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, n))), "\n\n")


def tokens(c: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1))


def all_tokens(c: Column | str) -> Column:
    """The same runs with repetitions, for term frequencies."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all of two token sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def query_ok(c: Column | str, low: int = 15, high: int = 240) -> Column:
    """long enough, not too long, three words or more, and a Latin letter."""
    t = col(c)
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.coalesce(F.length(t).between(low, high) & (blanks >= 2) & t.rlike("[A-Za-z]"), F.lit(False))


def winner(said: Column | str) -> Column:
    """A, B or tie as an answer means it; null where it means none of them."""
    t = F.lower(F.regexp_replace(strip(said), r"\.+$", ""))
    t = strip(F.regexp_replace(t, r"^system ", ""))
    return F.when(t == "a", "A").when(t == "b", "B").when(t == "tie", "tie")


def outcome(won: Column | str) -> Column:
    """1, 0.5 or 0 of a winner; an unreadable answer reads as a tie."""
    return F.when(col(won) == "A", 1.0).when(col(won) == "B", 0.0).otherwise(0.5)


def pair_score(first: Column | str, second: Column | str) -> Column:
    """The first system's score over both orders; in the second order the lists are swapped."""
    return (outcome(first) + 1 - outcome(second)) / 2


def joined_reasons(reasons: Column | str) -> Column:
    """The non-empty reasons, a bar between."""
    return F.array_join(F.filter(col(reasons), lambda r: r.isNotNull() & (r != "")), " | ")


def quality(c: Column | str) -> Column:
    """P20: an answer's score as a whole number: fractions are cut, numerals as text count, anything else is 3."""
    t = col(c)
    as_text = t.cast("string")
    whole = F.when(strip(as_text).rlike(r"^[+-]?\d+$"), strip(as_text)).when(as_text.rlike(r"^[+-]?\d+\.\d+([eE][+-]?\d+)?$"), F.floor(F.abs(as_text.try_cast("double"))) * F.signum(as_text.try_cast("double")))
    return F.coalesce(whole.try_cast("double").try_cast("int"), F.lit(3))


def elo(strength: Column | str, *, base: float = 1000.0, scale: float = 400.0, over=None) -> Column:
    """Strengths on the Elo scale, centred on `base` over the window."""
    r = F.lit(scale) * F.log10(F.greatest(col(strength), F.lit(1e-12)))
    return r - F.avg(r).over(over) + base


def half_width(low: Column | str, high: Column | str) -> Column:
    """Half the width of an interval."""
    return (col(high) - col(low)) / 2


def mock_hash(text: Column | str, seed: int = 0) -> Column:
    """The first eight hexadecimal digits of a seeded hash, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(text)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mock_answer(prompt: Column | str, seed: int = 0) -> Column:
    """The stand-in client's answer to a prompt, as JSON text."""
    p = col(prompt)
    h, low = mock_hash(p, seed), F.lower(p)
    score = F.concat(F.lit('{"score": '), (h % 5 + 1).cast("string"), F.lit(', "reason": "mock"}'))
    said = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (h % 3 + 1).cast("int"))
    judged = F.concat(F.lit('{"winner": "'), said, F.lit('", "confidence": "low", "reasoning": "mock"}'))
    at = F.instr(p, "[1] ")
    shown = F.when(at > 0, F.substring(p, at + 4, F.length(p))).otherwise(p)
    words = F.array_join(F.slice(F.regexp_extract_all(shown, F.lit("([A-Za-z]{4,})"), 1), 1, 6), " ")
    asked = F.when(words != "", words).otherwise(F.concat(F.lit("topic "), (h % 1000).cast("string")))
    query = F.concat(F.lit('{"query": "what is known about '), asked, F.lit('"}'))
    return F.when(F.contains(low, F.lit("rate the quality")), score).when(F.contains(low, F.lit("system a")), judged).otherwise(query)
