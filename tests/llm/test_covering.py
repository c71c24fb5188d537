"""Problem 4."""

import random
from itertools import combinations

import numpy as np
import pytest

from rankloom.llm import covering as C
from rankloom.llm.lookalike import form


def near(a, b, s=0.8):
    x = len(a & b)
    return x >= s * (len(a) + len(b) - x) - 1e-9


@pytest.mark.parametrize("q", [0, 1, 2, 3, 4])
def test_every_pair_within_the_radius_meets(q):
    rng = random.Random(q)
    for r in range(0, 9):
        for _ in range(30):
            base = rng.sample(range(1 << 60), 30)
            other = list(base)
            for _ in range(r):  # each change adds or removes a dimension
                if rng.random() < 0.5 and len(other) > 1:
                    other.remove(rng.choice([w for w in other if w in base]))
                else:
                    other.append(rng.randrange(1 << 60))
            assert len(set(base) ^ set(other)) <= r
            words = [np.array(base, np.int64), np.array(other, np.int64)]
            row, bucket = C.keys_of(words, np.array([r, r]), np.array([5, 5], np.uint64), 0, q)
            assert set(bucket[row == 0]) & set(bucket[row == 1])


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(vocabulary, rng.randint(1, 40))) for _ in range(n)]
    for _ in range(n):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rng.shuffle(words)
        texts.append(" ".join(words))
    return [(f"k{i:04}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_equals_brute_force(spark, hot):
    data = corpus(hot)
    df = spark.createDataFrame(data, "k string, t string")
    got = {tuple(r) for r in C.near_pairs(C.near_rows(df, "k", "t", "s"), hot=hot).collect()}
    sets = {k: frozenset(form(t).lower().split()) for k, t in data}
    assert got == {("s", a, b) for a, b in combinations(sorted(sets), 2) if near(sets[a], sets[b])}


def test_a_crowded_bucket_is_cut_into_blocks(spark):
    """Many sets within the radius of each other stay together in every family."""
    base = [f"w{i}" for i in range(40)]
    data = [(f"k{i:02}", " ".join(base[:i] + base[i + 1 :] + [f"x{i}"])) for i in range(40)]
    df = spark.createDataFrame(data, "k string, t string")
    sets = {k: frozenset(t.split()) for k, t in data}
    want = {("s", a, b) for a, b in combinations(sorted(sets), 2) if near(sets[a], sets[b])}
    rows = C.near_rows(df, "k", "t", "s")
    classes, members = C.word_classes(rows)
    for families in (0, 1):
        found = C.candidates(classes, hot=4, families=families).distinct()
        named = found.join(members.select(C.F.col("cls").alias("a"), C.F.col("key").alias("x")), "a").join(members.select(C.F.col("cls").alias("b"), C.F.col("key").alias("y")), "b")
        got = {("s", *sorted((r["x"], r["y"]))) for r in named.collect()}
        assert want <= got and len(want) == 40 * 39 // 2


def test_edge_cases(spark):
    rows = [("a", "One two"), ("b", "two, ONE!"), ("c", "Оne twо"), ("d", None), ("e", ""), ("f", "..."), (None, "one two"), ("a", "One two"), ("g", "one two three")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {tuple(r)[1:] for r in C.near_pairs(C.near_rows(df, "k", "t", "s")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert C.near_pairs(C.near_rows(df.limit(0), "k", "t", "s")).collect() == []


def test_spaces_do_not_meet(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", "x y z")], "k string, t string")
    both = C.near_rows(df.filter("k = 'a'"), "k", "t", "one").unionByName(C.near_rows(df.filter("k = 'b'"), "k", "t", "two"))
    assert C.near_pairs(both).collect() == []


def test_wide_classes_become_stars(spark):
    rows = [(f"k{i}", "same words here today") for i in range(6)] + [("z", "same words here today again")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = sorted(tuple(r)[1:] for r in C.near_pairs(C.near_rows(df, "k", "t", "s"), expand=3).collect())
    assert got == [("k0", f"k{i}") for i in range(1, 6)] + [("k0", "z")]


def test_groups(spark):
    base = [f"w{i}" for i in range(20)]
    texts = {"a": base, "b": base[::-1], "c": [*base[1:], "x"], "d": [*base[2:], "x", "y"], "e": ["lonely", "one"]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, t string")
    got = {r["key"]: (r["class_id"], r["n_copies"], r["n_links"], r["group_id"]) for r in C.near_groups(C.near_rows(df, "k", "t", "s")).collect()}
    assert got == {"a": ("a", 2, 2, "a"), "b": ("a", 2, 2, "a"), "c": ("c", 1, 2, "a"), "d": ("d", 1, 2, "a"), "e": ("e", 1, 0, "e")}


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(41)], "cls long")
    links = spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    got = {r["cls"]: r["root"] for r in C.components(nodes, links).collect()}
    assert got == {i: 0 for i in range(40)} | {40: 40}


def test_case_and_look_alike_capitals(spark):
    df = spark.createDataFrame([("a", "Вода Нет"), ("b", "вода нет")], "k string, t string")
    assert len(C.near_pairs(C.near_rows(df, "k", "t", "s")).collect()) == 1


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([("a", text), ("b", text + " more")], "k string, t string")
    assert len(C.near_pairs(C.near_rows(df, "k", "t", "s")).collect()) == 1


@pytest.mark.parametrize("block", [7, 1000])
def test_large_classes_give_all_pairs(spark, block):
    rows = [(f"a{i:03}", " ".join(["one two three four"] * (i + 1))) for i in range(300)]
    rows += [(f"b{i}", "five one two three four" + "!" * i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = C.near_pairs(C.near_rows(df, "k", "t", "s"), block=block)
    assert sorted(tuple(r)[1:] for r in got.collect()) == list(combinations(sorted(k for k, _ in rows), 2))


def test_only_exact_copies_become_a_star(spark):
    rows = [(f"k{i}", "same words here today") for i in range(5)] + [(f"m{i}", "today same words here" + "." * i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {tuple(r)[1:] for r in C.near_pairs(C.near_rows(df, "k", "t", "s"), expand=3).collect()}
    assert got == {("k0", f"k{i}") for i in range(1, 5)} | set(combinations(["k0", *[f"m{i}" for i in range(5)]], 2))
