"""Problems 6 and 7."""

import random

import numpy as np
import pytest

from rankloom.llm import leaks as K
from rankloom.llm import mixing as M

VOCABULARY = "the of river holds seven old maps near Berlin and Paris while 12 40 kg engines run from Monday Zed Anna until 1999".split()


def test_verbatim_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(3, 20)))) for i in range(20)]
    docs = []
    for d in range(60):
        text = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 40))]
        if d % 2:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w) - 1)
            text[5:5] = w[a : a + rng.randint(3, 20)]
        docs.append((d, rng.choice([" ", "\n", ", ", " -- "]).join(text).upper() if d % 3 else " ".join(text)))
    got = {(r["doc_id"], r["item_id"]) for r in K.verbatim_leaks(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", spark.createDataFrame(items, "item_id int, text string"), "item_id", width=5).collect()}
    grams = lambda t: {tuple(K.words(t)[i : i + 5]) for i in range(len(K.words(t)) - 4)}
    assert got == {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def test_ways_of_joining_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"one two three four {w} six seven") for i, w in enumerate("abcdefgh")], "item_id int, text string").repartition(5)
    docs = spark.createDataFrame([(1, "x one two three four c six seven y"), (2, "one two three four z six seven")], "doc_id int, text string")
    want = [(1, 2, 2)]
    assert [tuple(r) for r in K.verbatim_leaks(docs, "doc_id", items, "item_id", width=6).collect()] == want
    monkeypatch.setattr(K, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(K, "SIEVE_BITS", 20)
    assert [tuple(r) for r in K.verbatim_leaks(docs, "doc_id", items, "item_id", width=6).collect()] == want
    monkeypatch.setattr(K, "VOCABULARY", 3)
    with pytest.raises(ValueError, match="different words"):
        K.verbatim_leaks(docs, "doc_id", items, "item_id")


def test_an_unrelated_item_changes_nothing(spark):
    """One lexicon of all items, in which a single small spelling does not make a name a literal."""
    docs = spark.createDataFrame([(1, "In 1972 the engineers of Vienna moved 55 kg of copper to the station near Vienna")], "doc_id int, text string")
    more = [(100 + i, f"number {i} lies in berlin" if i == 3 else f"the item {i} has other words than the first one does") for i in range(40)]
    for rows in ([(7, ITEM)], [(7, ITEM), *more]):
        items = spark.createDataFrame(rows, "item_id int, text string").repartition(7)
        assert [(r["doc_id"], r["item_id"], r["n_windows"]) for r in K.reparameterised_leaks(docs, "doc_id", items, "item_id").collect()] == [(1, 7, 5)]


def test_planted_questions_with_other_values(spark):
    """Every planted question is found with decimals, names and units replaced, and no other document."""
    rng = random.Random(5)
    frames = ["a tank holds {n} {u} of water and {p} pours {m} {u} more into it before noon", "when {p} drove {n} {u} to the lake the meter showed that {m} {u} were still left"]
    fill = lambda f, names, units: f.format(n=rng.choice(["3.5", "12", "1,200"]), m=rng.choice(["7.25", "40", "9"]), p=rng.choice(names), u=rng.choice(units))
    items = [(i, fill(f, ["Anna", "Otto"], ["kg", "km"])) for i, f in enumerate(frames)]
    docs, want = [], set()
    for d in range(60):
        if d % 3 == 0:
            i = rng.randrange(2)
            docs.append((d, "Before. " + fill(frames[i], ["Mira", "Yusuf"], ["ml", "mi"]) + " After it all was well."))
            want.add((d, i))
        else:
            docs.append((d, " ".join(rng.choice(VOCABULARY) for _ in range(40))))
    got = K.reparameterised_leaks(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", spark.createDataFrame(items, "item_id int, text string"), "item_id")
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


ITEM = "In 1989 the engineers of Berlin moved 40 kg of copper to the station near Berlin"


@pytest.mark.parametrize(
    "text, verbatim, replaced",
    [
        (ITEM, True, False),
        ("so IN 1989, the engineers of berlin moved 40 kg of copper -- to the station", True, False),
        ("In 1972 the engineers of Vienna moved 55 kg of copper to the station near Vienna", False, True),
        ("In 1972 the engineers of Vienna moved 55 kg of copper to the station near Graz", False, True),  # twelve words without the clash
        ("In 1972 the bakers of Vienna ate 55 kg of bread at the station near Vienna", False, False),
        ("", False, False),
    ],
)
def test_slots(spark, text, verbatim, replaced):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "too short")], "item_id int, text string")
    assert bool(K.verbatim_leaks(docs, "doc_id", items, "item_id").collect()) == verbatim
    assert bool(K.reparameterised_leaks(docs, "doc_id", items, "item_id").collect()) == replaced


def test_slots_must_be_consistent(spark):
    docs = spark.createDataFrame([(1, "the train from Graz to Linz and back from Wien to Linz left at 10")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "the train from Bonn to Kiel and back from Bonn to Kiel left at 20")], "item_id int, text string")
    assert K.reparameterised_leaks(docs, "doc_id", items, "item_id", width=14).collect() == []


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, ITEM, 5), (2, ITEM, 5), (2, ITEM, 5), (3, "x " * 300_000 + ITEM, 5)], "doc_id int, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM), (9, None)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in K.verbatim_leaks(docs, "doc_id", items, "item_id").collect()}
    assert got == {(2, 7), (3, 7)}
    assert K.verbatim_leaks(docs.limit(0), "doc_id", items, "item_id").collect() == []
    assert K.verbatim_leaks(docs, "doc_id", items.limit(0), "item_id").collect() == []


def shelf(spark, seed=1):
    rng = random.Random(seed)
    topics = {"law": "court judge appeal ruling claim statute", "cook": "flour butter oven sugar salt bake", "code": "loop array index class return def"}
    rows = []
    for s, n in (("law", 120), ("cook", 60), ("code", 15)):
        for _ in range(n):
            words = [rng.choice(topics[s].split() + ["the", "and", "of"]) for _ in range(rng.randint(20, 60))]
            rows.append((len(rows), " ".join(words), rng.choice([s, s, s.upper(), f" {s} ", None if rng.random() < 0.3 else s])))
    return spark.createDataFrame(rows, "doc_id int, text string, source string")


def goals(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_are_reached(spark):
    got = M.mix(shelf(spark), goals(spark, [("law", 2.0, 1), ("Cook ", 1.0, 2), ("code", 1.0, 4), ("absent", 3.0, None)]))
    by = {r["source"]: r for r in got.sources.collect()}
    assert by["absent"]["expected_tokens"] == 0
    for s, share in (("law", 0.5), ("cook", 0.25), ("code", 0.25)):
        assert by[s]["expected_share"] == pytest.approx(share, abs=5e-3)
        assert by[s]["posterior_share"] == pytest.approx(share, abs=1e-5)
        assert by[s]["drawn_share"] == pytest.approx(share, abs=0.01)
    assert got.converged
    rows = got.documents.collect()
    cap = {"law": 1, "cook": 2, "code": 4}
    assert len(rows) == 195 and all(0 <= r["rate"] <= cap[r["source"]] + 1e-9 and r["copies"] <= cap[r["source"]] for r in rows)
    assert abs(sum(r["tokens"] * r["rate"] for r in rows if r["source"] == "law") - by["law"]["expected_tokens"]) < 1


def test_unlabelled_documents_are_filed_by_their_words(spark):
    got = M.mix(shelf(spark), goals(spark, [("law", 1.0, None), ("cook", 1.0, None), ("code", 1.0, None)])).documents
    names = ["law"] * 120 + ["cook"] * 60 + ["code"] * 15
    blank = [r for r in got.collect() if r["label"] is None]
    assert blank and np.mean([r["source"] == names[r["doc_id"]] for r in blank]) > 0.9


def test_a_total_beyond_reach_stays_within_caps(spark):
    got = M.mix(shelf(spark), goals(spark, [("law", 1.0, 1), ("code", 1.0, 2)]), total=1e7)
    assert all(r["rate"] <= {"law": 1, "code": 2}[r["source"]] for r in got.documents.collect())


def test_mix_edges(spark):
    empty = goals(spark, [])
    docs = spark.createDataFrame([(1, None, "law", 1), (2, "", "law", 1), (3, "text", None, 1), (None, "x", "law", 1)], "doc_id int, text string, source string, tokens int")
    assert {(r["doc_id"], r["rate"]) for r in M.mix(docs, empty).documents.collect()} == {(2, 0.0), (3, 0.0)}
    one = M.mix(docs, goals(spark, [("law", 1.0, 1), ("law", 9.0, 1), (None, 1.0, 1), ("bad", -1.0, 1)]))
    assert {r["doc_id"] for r in one.documents.collect()} == {2, 3}
    assert M.mix(docs.limit(0), goals(spark, [("law", 1.0, 1)])).documents.collect() == []


def test_sources_that_can_give_nothing_do_not_stop_the_mix(spark):
    docs = shelf(spark).unionByName(spark.createDataFrame([(1000, "", "hollow")], "doc_id int, text string, source string"))
    got = M.mix(docs, goals(spark, [("law", 1.0, None), ("cook", 1.0, 3), ("hollow", 5.0, 2), ("code", 2.0, 0)]))
    by = {r["source"]: r for r in got.sources.collect()}
    assert by["law"]["drawn_share"] == pytest.approx(0.5, abs=0.01) and by["cook"]["drawn_share"] == pytest.approx(0.5, abs=0.01)
    assert by["hollow"]["drawn_tokens"] == by["code"]["drawn_tokens"] == 0


def test_repeated_ids_and_targets(spark):
    docs = shelf(spark).filter("doc_id < 180")
    many = docs.unionByName(docs).withColumn("tokens", M.F.lit("clash"))
    got = M.mix(many, goals(spark, [("law", 2.0, 1), ("law", 1.0, 9), ("cook", 1.0, 2)]))
    by = {r["source"]: r for r in got.sources.collect()}
    assert got.documents.count() == 360 and by["law"]["weight"] == 2.0 and by["law"]["most_copies"] <= 1
    assert by["law"]["drawn_share"] == pytest.approx(2 / 3, abs=0.01)


def test_blocks_carry_their_errors(monkeypatch, spark):
    monkeypatch.setattr(M, "BLOCK", 25)
    got = M.mix(shelf(spark), goals(spark, [("law", 2.0, 1), ("cook", 1.0, 2), ("code", 1.0, 4)]))
    for r in got.sources.collect():
        assert r["drawn_share"] == pytest.approx(r["target_share"], abs=0.015)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + (r["rate"] % 1 > 0) for r in got.documents.collect())


def test_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"s{i % 60}w{rng.randint(0, 20)}" for _ in range(30)), f"s{i % 60}") for i in range(900)]
    got = M.mix(spark.createDataFrame(rows, "doc_id int, text string, source string"), goals(spark, [(f"s{j}", 1.0 + j % 3, 3) for j in range(60)]))
    assert got.converged
    for r in got.sources.collect():
        assert r["drawn_share"] == pytest.approx(r["target_share"], abs=0.01)
    with pytest.raises(ValueError, match="sources"):
        M.mix(spark.createDataFrame(rows, "doc_id int, text string, source string"), goals(spark, [(f"s{j}", 1.0, 3) for j in range(M.SOURCES + 1)]))


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_drawn_shares_of_the_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = M.mix(read("documents"), read("mix_targets"))
    assert got.converged and all(abs(r["drawn_share"] - r["target_share"]) < 0.01 for r in got.sources.collect())


@pytest.mark.parametrize("text", ["word " * 100_000, "a1'll  b\n\n c" * 40_000, "x" * 250_000 + " y", "один два\t" * 50_000, " \n" * 150_000 + "end"])
def test_long_texts_are_encoded_whole(text, monkeypatch):
    enc = M.encoder(M.TOKENIZER)
    want = enc.encode_ordinary(text)
    for piece in (1000, M.PIECE):
        monkeypatch.setattr(M, "PIECE", piece)
        assert M._tokens(enc, text) == want
