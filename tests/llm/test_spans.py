"""Problem 8."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import spans as S


def brute(texts, length):
    """{(key, start, end)} by comparing every window with every other record."""
    windows = {}
    for k, t in texts:
        for i in range(len(t) - length + 1):
            windows.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in dict(texts).items():
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if len(windows[t[i : i + length]]) > 1:
                cover[i : i + length] = True
        edge = np.diff(np.concatenate([[0], cover.astype(int)]))
        for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]):
            out.add((k, int(a), int(b)))
    return out


def quoted(seed, n=25):
    rng = random.Random(seed)
    letters = "abcdé \n😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(n)]
    for _ in range(n):
        src = rng.choice(texts)
        a = rng.randrange(len(src) + 1)
        i = rng.randrange(n)
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + src[a : a + rng.randint(5, 90)] + texts[i][at:]
    texts += ["ab" * 100, "xx" + "ab" * 60, "c" * 70, "c" * 45]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [0, 2, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, hot):
    data = quoted(seed)
    df = spark.createDataFrame(data, "id long, t string")
    got = {tuple(r) for r in S.shared_spans(df, "id", "t", length=30, sub=10, hot=hot, bits=12).collect()}
    assert got == brute(data, 30)


def test_a_full_sketch_loses_nothing(spark):
    data = quoted(3)
    df = spark.createDataFrame(data, "id long, t string")
    assert {tuple(r) for r in S.shared_spans(df, "id", "t", length=30, sub=10, bits=3).collect()} == brute(data, 30)


@pytest.mark.parametrize("hot", [2, 20_000])
def test_a_spread_sketch_equals_brute_force(spark, hot):
    """A sketch too wide to be sent stays spread; a key with two texts keeps their places apart."""
    data = quoted(4)
    df = spark.createDataFrame(data, "id long, t string")
    got = {tuple(r) for r in S.shared_spans(df, "id", "t", length=30, sub=10, bits=12, most_bits=5, hot=hot).collect()}
    assert got == brute(data, 30)
    twice = spark.createDataFrame([(1, "a" * 5 + "unlike any other text of this table"), (1, "zz" + "shared words, thirty of them or more"), (2, "shared words, thirty of them or more")], "id long, t string")
    for most in (5, 28):
        assert sorted(tuple(r) for r in S.shared_spans(twice, "id", "t", length=30, sub=10, bits=12, most_bits=most).collect()) == [(1, 2, 38), (2, 0, 36)]


def test_what_is_kept_does_not_grow_with_the_input(spark):
    """A spread sketch of a width that follows the input lets as few unique stretches through at ten times the load;
    one of a fixed width fills up."""
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2000))) for i in range(500)]

    def share(n, bits, most):
        rows = spark.createDataFrame(texts[:n], "id long, text string")
        return S.kept_stretches(rows, 300, 100, bits, most).count() / (n * 2000 / 100)

    assert share(50, 12, 5) < 0.1 and share(500, 12 + 4, 5) < 0.1
    assert share(500, 9, 28) > 0.5


@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_stretches_cover_every_window(texts):
    text, first, last, value = S.stretches(texts, 12, 4)
    seen = {}
    for t, a, b, v in zip(text, first, last, value):
        for s in range(a, b + 1):
            seen[(t, s)] = v
    assert set(seen) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 11)}
    by_text = {}
    for (i, s), v in seen.items():  # equal windows are filed alike
        assert by_text.setdefault(texts[i][s : s + 12], v) == v


def test_edge_cases(spark):
    long = "The quick brown fox jumps over the lazy dog. " * 9
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (None, long, "x"), (4, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, m string")
    assert S.shared_spans(df, "doc_id", "text").collect() == []
    more = df.unionByName(spark.createDataFrame([(5, "other words first " + long + "end", "y")], df.schema))
    assert sorted(tuple(r) for r in S.shared_spans(more, "doc_id", "text").collect()) == [(1, 0, 405), (5, 17, 423)]  # a blank stands before a sentence in both
    assert S.shared_spans(df.limit(0), "doc_id", "text").collect() == []
    shares = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["n_spans"], r["share"]) for r in S.shared_shares(more, "doc_id", "text").collect()}
    assert shares == {1: (405, 405, 1, 1.0), 2: (0, 0, 0, None), 3: (0, 0, 0, None), 4: (5, 0, 0, 0.0), 5: (426, 406, 1, 406 / 426)}


def test_text_keys_and_long_texts(spark):
    rng = random.Random(5)
    big = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    df = spark.createDataFrame([("a", big), ("b", "-" + big[300_000:300_400])], "k string, t string")
    assert sorted(tuple(r) for r in S.shared_spans(df, "k", "t").collect()) == [("a", 300_000, 300_400), ("b", 1, 401)]


def test_touching_spans_join(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 4), (1, 10, 12), (2, 3, 4)], "id int, span_start int, span_end int")
    assert sorted(tuple(r) for r in S.merge_spans(df).collect()) == [(1, 0, 9), (1, 10, 12), (2, 3, 4)]
