"""Sources, generation, retrieval, judging, the pipeline, publication and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom import cli, ident, storage
from rankloom.chat import MockClient
from rankloom.operators import dedup, generate, judge, metrics, publish, rank, results, retrieve, sampling
from rankloom.plans.pipeline import predict, run
from rankloom.schemas import QUERIES, VERDICTS
from rankloom.sources import corpus, logs, queries
from rankloom.streaming.verdicts import VerdictStream, windowed_outcomes

TOPICS = ["solar power storage", "medieval trade routes", "deep sea fish", "garden soil care"]


def library(spark, n=24):
    rows = [(f"D{i}", f"{TOPICS[i % 4]} note {i} explains how {TOPICS[i % 4]} works in region {i * 7} " + "with further detail " * (i % 5), i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, pos long")


def query_frame(spark, texts):
    return spark.createDataFrame([(f"q{i}", t, [], None, i) for i, t in enumerate(texts)], QUERIES)


# ------------------------------------------------------------ sources


def test_jsonl(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": 1, "text": "one"}\n\n  \n{"id": "b", "text": null, "title": "no"}\n{"id": 1, "text": "last"}\n')
    got = corpus.load(spark, p)
    assert [tuple(r) for r in got.docs.orderBy("pos").collect()] == [("1", "last", 0), ("b", "", 1)]
    assert got.source == "local" and got.id.startswith("local:c@")
    p.write_text('{"text": "no id"}\n')
    with pytest.raises(ValueError, match="without an id"):
        corpus.load(spark, p)


def test_folder(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte\r\nnext\rend")
    (tmp_path / "sub dir" / "a+ü.md").write_text("deep")
    (tmp_path / "c.TXT").write_text("no")
    got = corpus.load(spark, tmp_path)
    assert [tuple(r) for r in got.docs.orderBy("pos").collect()] == [("b.txt", "bad  byte\nnext\nend", 0), ("sub dir/a+ü.md", "deep", 1)]
    empty = tmp_path / "sub dir" / "none"
    empty.mkdir()
    with pytest.raises(ValueError, match="no documents"):
        corpus.load(spark, empty)
    with pytest.raises(ValueError, match="neither"):
        corpus.load(spark, tmp_path / "missing")


def test_digest_depends_on_order(spark):
    a = spark.createDataFrame([("1", "x", 0), ("2", "y", 1)], "doc_id string, text string, pos long")
    b = a.withColumn("pos", 1 - F.col("pos"))
    assert corpus.content_digest(a) != corpus.content_digest(b) and len(corpus.content_digest(a)) == 12


def test_tables(spark, tmp_path):
    spark.createDataFrame([("d1", None, "t", 0), ("d1", "T", "t", 1), ("d2", "  ", None, 2), (None, "x", "y", 3)], "doc_id string, title string, text string, pos long").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("q", "text")], "qid string, text string").write.parquet(str(tmp_path / "q"))
    got = corpus.load(spark, "toy", {"toy": {"corpus": str(tmp_path / "c"), "queries": str(tmp_path / "q"), "revision": "r"}})
    assert sorted(tuple(r) for r in got.docs.collect()) == [("d1", "T t", 0), ("d2", "", 2)]
    assert got.source == "table" and got.id.endswith("@r/default/test") and got.queries.count() == 1


def test_own_queries(spark, tmp_path):
    assert [r["qid"] for r in queries.own_queries(spark, ["a", "b"]).orderBy("pos").collect()] == ["q0", "q1"]
    p = tmp_path / "q.txt"
    p.write_text("\n first \n\nsecond\n")
    assert [(r["qid"], r["text"]) for r in queries.own_queries(spark, p).orderBy("pos").collect()] == [("q0", "first"), ("q1", "second")]
    j = tmp_path / "q.jsonl"
    j.write_text('{"text": "x"}\n{"id": "k", "text": "y"}\n{"id": "k", "text": "z"}\n')
    assert [(r["qid"], r["text"]) for r in queries.own_queries(spark, j).orderBy("pos").collect()] == [("0", "x"), ("k", "z")]
    j.write_text('{"id": "k"}\n')
    with pytest.raises(ValueError, match="no text"):
        queries.own_queries(spark, j)


def test_query_set_file(spark, tmp_path):
    path = tmp_path / "a" / "s.json"
    assert queries.read_query_set(spark, path) is None
    queries.write_query_set(path, query_frame(spark, ["one", "two"]), {"model": "m"}, 5)
    rows, n, settings = queries.read_query_set(spark, path)
    assert rows.count() == 2 and n == 5 and settings == {"model": "m"}
    path.write_text('{"queries": []}')
    assert queries.read_query_set(spark, path) is None


def test_prediction_file(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"default": {"test": {"q": {"d2": 1.0, "q": 9.0, "d1": 1.0}}}}))
    got = logs.prediction_hits(spark, str(p), "m", ignore_identical_ids=True)
    docs = spark.createDataFrame([(d, d.upper(), i) for i, d in enumerate(["d1", "d2", "q"])], "doc_id string, text string, pos long")
    lists = retrieve.top_k(got, query_frame(spark, ["t"]).withColumn("qid", F.lit("q")), docs, spark.createDataFrame([("m",)], "model string"))
    assert lists.first()["doc_ids"] == ["d2", "d1"]  # equal scores keep the file's order


def test_verdict_log(spark, tmp_path):
    good = {"qid": "q", "query": "t", "model_a": "a", "model_b": "b", "score_a": 1.0}
    lines = [json.dumps(good | {"raw": ["A", "B"], "parsed_ok": [True, True]}), json.dumps(good)[:20], "", json.dumps(good | {"extra": 1}), json.dumps({k: v for k, v in good.items() if k != "query"}), json.dumps(good | {"score_a": 0.0})]
    (tmp_path / "v").write_text("\n".join(lines))
    rows = logs.read_verdict_log(spark, str(tmp_path / "v")).orderBy("line_no").collect()
    assert [r["score_a"] for r in rows] == [1.0, 0.0] and rows[1]["raw"] == [] and rows[1]["reasoning"] == ""
    last = logs.latest(logs.read_verdict_log(spark, str(tmp_path / "v")), "qid").first()
    assert last["score_a"] == 0.0


def test_appended_verdicts_read_back(spark, tmp_path):
    row = ("q", None, "a", "b", 0.5, ["identical"], "", [], "t", "j", "s")
    df = spark.createDataFrame([row], VERDICTS)
    for _ in range(2):
        logs.append_verdicts(df, str(tmp_path / "log"))
    assert logs.read_verdict_log(spark, str(tmp_path / "log")).count() == 2


def test_the_newest_append_counts(spark, tmp_path):
    """Also where it is larger than an older one, and whatever order Spark packs the files in."""
    path = str(tmp_path / "log")
    row = lambda q, s, r="": (q, "query", "a", "b", s, ["A", "B"], r, [True, True], "t", "j", "s")
    log = lambda rows: spark.createDataFrame(rows, VERDICTS).withColumn("key", F.lit("k"))
    assert logs.append_verdicts(log([row(f"q{i}", 0.0) for i in range(3)]).coalesce(1), path) == 1
    assert logs.append_verdicts(log([row(f"q{i}", 1.0, "long " * 1000) for i in range(3)]).coalesce(1), path) == 2
    assert logs.append_verdicts(log([row("q0", 0.5)]).coalesce(1), path) == 3
    got = {r["qid"]: r["score_a"] for r in logs.latest(logs.read_verdict_log(spark, path), "key", "qid").collect()}
    assert got == {"q0": 0.5, "q1": 1.0, "q2": 1.0}


def test_a_killed_run_asks_for_the_rest_only(spark, tmp_path):
    """Verdicts are kept wave by wave; what is asked again after a crash is at most the wave that was under way."""
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    broken.write_text("")

    class Frail(Counting):
        def chat(self, messages):
            import os

            if os.path.exists(str(broken)) and "query 17" in messages[-1]["content"]:
                raise RuntimeError("line is dead")
            return super().chat(messages)

    met = judge.meetings(ranked(spark, 60), judge.model_pairs(spark, ["a", "b"]))
    keys = spark.createDataFrame([(0, "k0")], "pair int, key string")
    from rankloom.plans.pipeline import judged_once

    ask = lambda: judged_once(spark, str(tmp_path / "log"), met, keys, Frail(calls), {"workers": 2, "guard": False, "wave": 4}, {})
    with pytest.raises(Exception, match="line is dead"):
        ask().collect()
    kept = logs.read_verdict_log(spark, str(tmp_path / "log")).count() if storage.children(tmp_path / "log") else 0
    broken.unlink()
    before = len(calls.read_text())
    assert len({r["qid"] for r in ask().collect()}) == 60
    assert 0 < kept < 60 and len(calls.read_text()) - before == 2 * (60 - kept)
    before = len(calls.read_text())
    assert ask().count() == 60 and len(calls.read_text()) == before


def test_official_scores(spark):
    scores = spark.createDataFrame([("m", "t", "external", 0.5), ("m", "t", "r1", 0.61234), ("n", "t", "external", 0.4), ("o", "t", "old", 0.1)], "model string, task string, revision string, score double")
    pinned = spark.createDataFrame([("m", "r1"), ("n", "r9"), ("o", "r2"), ("p", "r3"), ("x", "r4")], "model string, revision string")
    picked = logs.pick_official(scores, pinned)
    assert {r["model"]: r["revision"] for r in picked.collect()} == {"m": "r1", "n": "external", "o": "old"}
    own = spark.createDataFrame([("p", 0.2)], "model string, score double")
    truth = {r["model"]: (r["score"], r["official"]) for r in logs.truth_for(pinned, picked, own).collect()}
    assert truth == {"m": (61.23, True), "n": (40.0, True), "o": (10.0, True), "p": (20.0, False)}


# ------------------------------------------------------------ sampling, generation, near duplicates


def test_samples_follow_the_seed(spark):
    own = query_frame(spark, [f"text {i}" for i in range(10)])
    got = [r["qid"] for r in sampling.sample_queries(own, 4, 1).orderBy("pos").collect()]
    keep = set(random.Random(1).sample(sorted(f"q{i}" for i in range(10)), 4))
    assert got == [f"q{i}" for i in range(10) if f"q{i}" in keep]
    assert sampling.sample_queries(own, 10, 0).count() == 10
    assert sampling.pair_subset(spark, 3, ["a"], None, 0) is None and sampling.pair_subset(spark, 3, ["a"], 3, 0) is None
    rng = random.Random(5)
    want = {(q, i) for q in ("b", "a") for i in rng.sample(range(6), 2)}
    assert {tuple(r) for r in sampling.pair_subset(spark, 6, ["b", "a"], 2, 5).collect()} == want


class Scripted:
    """Fails on some prompts; answers depend on the prompt alone."""

    model = "scripted"

    def chat(self, messages):
        h = MockClient()._hash(messages[-1]["content"])
        if "rate the quality" in messages[0]["content"].lower():
            return '{"score": "4.5x"}' if h % 3 == 0 else json.dumps({"score": h % 5 + 1})
        if "System A" in messages[-1]["content"]:
            return "nonsense" if h % 4 == 0 else json.dumps({"winner": ["A", "b.", "Tie"][h % 3], "reasoning": "r"})
        return "no json" if h % 3 == 0 else json.dumps({"query": f"what about number {h} here"})


def test_generation_is_the_same_for_any_number_of_workers(spark):
    s = generate.Settings(n_queries=10)
    a, b = ([tuple(r)[:2] for r in generate.generate(library(spark), Scripted(), s, w).orderBy("pos").collect()] for w in (1, 4))
    assert a == b and 0 < len(a) <= s.target == 16 and [x[0] for x in a] == [f"q{i}" for i in range(len(a))]


def test_filter_chain(spark):
    s = generate.Settings(n_queries=8)
    raw = generate.generate(library(spark), MockClient(), s)
    good, missed = generate.filtered(raw, MockClient(), s)
    rows = good.orderBy("pos").collect()
    assert missed == 0 and rows and len(rows) <= 8 and all(r["quality"] >= 3 for r in rows) and [r["qid"] for r in rows] == [f"q{i}" for i in range(len(rows))]
    _, missed = generate.rated(raw, Scripted())
    assert missed > 0
    assert generate.filtered(raw, MockClient(), generate.Settings(n_queries=2, filter=False))[0].count() == 2


def greedy(texts, threshold=0.8):
    import re

    kept = []
    for i, t in enumerate(texts):
        s = set(re.findall("[a-z0-9]+", t.lower()))
        if not any(s | k and len(s & k) / len(s | k) >= threshold for _, k in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_keep_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        base = rng.choice(texts).split() if texts and rng.random() < 0.7 else [f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 10))]
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        texts.append(" ".join(words))
    texts += ["", "!!", texts[0]]
    got = [r["pos"] for r in dedup.greedy_keep(query_frame(spark, texts)).orderBy("pos").collect()]
    assert got == greedy(texts)


def test_a_chain_keeps_both_ends(spark):
    words = [f"w{i}" for i in range(10)]
    chain = [" ".join(words), " ".join([*words[1:], "x"]), " ".join([*words[2:], "x", "y"])]
    assert [r["pos"] for r in dedup.greedy_keep(query_frame(spark, chain)).orderBy("pos").collect()] == [0, 2]


# ------------------------------------------------------------ retrieval and judging


def test_retrievers_find_their_topic(spark):
    docs, asked = library(spark), query_frame(spark, ["solar power region 28", "nothing matches zzz"])
    for name in retrieve.RETRIEVERS:
        got = retrieve.predict(docs, asked, name).orderBy("pos").collect()
        assert got[0]["doc_id"] == "D4" and {r["qid"] for r in got} == {"q0"}
    with pytest.raises(ValueError, match="unknown"):
        retrieve.predict(docs, asked, "none")


def test_late_interaction(spark):
    v = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 1.0]]), ("b", [[0.5, 0.5]])], "doc_id string, vec array<array<double>>")
    q = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 1.0]])], "qid string, vec array<array<double>>")
    assert {r["doc_id"]: r["score"] for r in retrieve.dense(v, q, "maxsim").collect()} == {"a": 2.0, "b": 1.0}


def test_dense_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v, q = rng.integers(-3, 4, (40, 5)).astype(float), rng.integers(-3, 4, (7, 5)).astype(float)
    docs = [(f"d{i:02}", x.tolist()) for i, x in enumerate(v)] + [("zero", [0.0] * 5), ("short", [1.0]), ("none", None)]
    vectors = spark.createDataFrame(docs, "doc_id string, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("d00", v[0].tolist()), ("qn", None)], "qid string, vec array<double>")
    score = {
        "dense_dot": lambda a, b: a @ b, "dense_cos": lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if (a @ a) * (b @ b) > 0 else None,
        "dense_l2": lambda a, b: -np.sqrt(((a - b) ** 2).sum()), "dense_sign": lambda a, b: float(((a >= 0) == (b >= 0)).sum()), "dense_trunc_16": lambda a, b: a @ b,
    }
    for how, f in score.items():
        got = {}
        for r in retrieve.dense(vectors, asked, how, k=6).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
        for name, x in [(f"q{i}", x) for i, x in enumerate(q)] + [("d00", v[0])]:
            every = [(d, f(np.array(x), np.array(w))) for d, w in docs if w is not None and len(w) == 5 and d != name]
            want = sorted(((d, round(s, 6) + 0.0) for d, s in every if s is not None), key=lambda z: (-z[1], z[0]))[:6]
            assert [(d, s) for _, d, s in sorted(got[name])] == want, how
    assert retrieve.dense(vectors, asked.limit(0)).collect() == []


def test_vectors_and_imported_predictions_in_a_run(spark, tmp_path):
    folder = make_folder(tmp_path)
    names = [f"D{i:02}.txt" for i in range(12)]
    table = lambda rows, s, p: spark.createDataFrame(rows, s).write.parquet(str(tmp_path / p)) or str(tmp_path / p)
    docs = table([(n, [float(i % 4 == j) for j in range(4)]) for i, n in enumerate(names)], "doc_id string, vec array<double>", "docs.vec")
    asked = table([("q0", [1.0, 0.0, 0.0, 0.0]), ("q1", [0.0, 0.0, 1.0, 0.0])], "qid string, vec array<double>", "asked.vec")
    (tmp_path / "pred.json").write_text(json.dumps({"default": {"test": {"q0": {"D00.txt": 2.0, "D04.txt": 1.0}, "q1": {"D02.txt": 1.0}, "other": {"D01.txt": 1.0}}}}))

    def encode(texts):
        return [[float(w in t) for w in ("solar", "trade", "fish", "garden")] for t in texts]

    models = [f"vectors:given={docs},{asked}", f"file:made={tmp_path / 'pred.json'}", retrieve.Vectors("coded", encode=encode, similarity="dense_dot"), "bm25"]
    r = run(spark, folder, models, MockClient(), queries=["solar power", "deep fish"], output_folder=tmp_path / "out", cache_folder=tmp_path / "cache", bootstrap=10)
    assert {x["model"] for x in r.record["ratings"]} <= {"given", "made", "coded", "bm25"} and r.record["config"]["model_revisions"]["made"] == "imported"
    hits = {m: spark.read.parquet(p) for m, p in zip(r.record["config"]["models"], ident.Layout(str(tmp_path / "cache")).of_record(r.record)["predictions"])}
    assert [x["doc_id"] for x in hits["given"].filter("qid = 'q0'").orderBy("pos").limit(3).collect()] == ["D00.txt", "D04.txt", "D08.txt"]
    assert [x["doc_id"] for x in hits["made"].filter("qid = 'q0'").orderBy("pos").collect()] == ["D00.txt", "D04.txt"] and hits["made"].select("qid").distinct().count() == 2
    assert hits["coded"].filter("qid = 'q1'").orderBy("pos").first()["doc_id"] == "D02.txt"
    late = retrieve.Vectors("late", encode=lambda ts: [[v, v] for v in encode(ts)], similarity="maxsim")
    assert predict(spark, folder, late, queries=["solar power"], cache_folder=tmp_path / "cache") != predict(spark, folder, "bm25", queries=["solar power"], cache_folder=tmp_path / "cache")
    for bad in ("nothing", "file:x", "vectors:x=a"):
        with pytest.raises(ValueError, match="unknown"):
            retrieve.resolve(bad)
    with pytest.raises(ValueError, match="one name"):
        run(spark, folder, ["bm25", "bm25"], MockClient())


def test_missing_hits_and_unknown_documents(spark):
    docs, asked = library(spark, 3), query_frame(spark, ["a", "b"])
    hits = spark.createDataFrame([("m", "q0", "D1", 1.0, 0), ("m", "q0", "gone", 2.0, 1)], "model string, qid string, doc_id string, score double, pos long")
    roster = spark.createDataFrame([("m",)], "model string")
    with pytest.raises(KeyError):
        retrieve.top_k(hits, asked, docs, roster)
    got = {r["qid"]: r["doc_ids"] for r in retrieve.top_k(hits, asked, docs, roster, strict=False).collect()}
    assert got == {"q0": ["D1"], "q1": []}


def test_ndcg_by_hand(spark):
    import math

    hits = spark.createDataFrame([("m", "q", d, s, 0) for d, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "model string, qid string, doc_id string, score double, pos long")
    labels = spark.createDataFrame([("q", "b", 1), ("q", "z", 1), ("r", "a", 1)], "qid string, doc_id string, rel int")
    want = (1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2
    assert metrics.ndcg(hits, labels).first()["ndcg"] == pytest.approx(want)
    assert metrics.precision(hits, labels).first()["precision"] == pytest.approx(0.05)
    assert metrics.labels_for(query_frame(spark, ["x"]), None) is None


def ranked(spark, n, same=False):
    rows = [(m, f"q{i}", f"query {i}", [f"{'x' if same else m}{i}"], [f"text of {'x' if same else m} {i}"], i) for m in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "model string, qid string, query string, doc_ids array<string>, doc_texts array<string>, pos long")


def test_judging_does_not_depend_on_workers(spark):
    met = judge.meetings(ranked(spark, 8), judge.model_pairs(spark, ["a", "b"]))
    a, b = (sorted((r["qid"], r["score_a"], r["raw"], r["parsed_ok"], r["reasoning"]) for r in judge.judge_all(met, Scripted(), workers=w).collect()) for w in (1, 4))
    assert a == b and len(a) == 8 and any(False in x[3] for x in a) and all(x[1] in (0, 0.25, 0.5, 0.75, 1) for x in a)


def test_mock_column_and_mock_client_agree(spark):
    met = judge.meetings(ranked(spark, 5), judge.model_pairs(spark, ["a", "b"]))

    class Plain(MockClient):
        model = "plain"

    a, b = (sorted((r["qid"], r["raw"]) for r in judge.judge_all(met, c).collect()) for c in (MockClient(), Plain()))
    assert a == b


def test_identical_lists_are_not_asked_about(spark):
    class Never:
        model = "never"

        def chat(self, messages):
            raise AssertionError

    met = judge.meetings(ranked(spark, 3, same=True), judge.model_pairs(spark, ["a", "b"]))
    got = judge.judge_all(met, Never()).collect()
    assert all(r["score_a"] == 0.5 and r["raw"] == ["identical"] and r["parsed_ok"] == [] for r in got) and len(got) == 3


def test_guard(spark):
    class Dead:
        model = "dead"

        def chat(self, messages):
            return "?"

    pairs = judge.model_pairs(spark, ["a", "b"])
    with pytest.raises(RuntimeError, match="parse-failure"):
        judge.judge_all(judge.meetings(ranked(spark, 30), pairs), Dead())
    with pytest.raises(RuntimeError, match="identical"):
        judge.judge_all(judge.meetings(ranked(spark, 31, same=True), pairs), Dead())
    got = judge.judge_all(judge.meetings(ranked(spark, 29), pairs), Dead()).collect()  # too few to tell
    assert all(r["parsed_ok"] == [False, False] and r["score_a"] == 0.5 for r in got)


def test_log_joins(spark):
    pairs = judge.model_pairs(spark, ["a", "b"])
    met = judge.meetings(ranked(spark, 3), pairs)
    log = spark.createDataFrame([("q1", "a", "b", 0.0), ("q9", "a", "b", 1.0)], "qid string, model_a string, model_b string, score_a double")
    todo = judge.still_to_judge(met, log)
    assert sorted(r["qid"] for r in todo.collect()) == ["q0", "q2"]
    new = judge.judge_all(todo)
    every = judge.merged(log, new)
    assert every.count() == 4 and judge.in_request_order(every, met).count() == 3
    chosen = spark.createDataFrame([("q2", 0)], "qid string, pair int")
    assert [r["qid"] for r in judge.meetings(ranked(spark, 3), pairs, chosen).collect()] == ["q2"]


# ------------------------------------------------------------ the whole


def make_folder(tmp_path):
    d = tmp_path / "lib"
    d.mkdir()
    for i in range(12):
        (d / f"D{i:02}.txt").write_text(f"{TOPICS[i % 4]} note {i} explains how {TOPICS[i % 4]} works in region {i * 7}")
    return d


class Counting(Scripted):
    model = "counting"
    log = None

    def __init__(self, path):
        self.path = str(path)

    def chat(self, messages):
        with open(self.path, "a") as f:
            f.write("x")
        return super().chat(messages)


def test_run_twice_asks_once(spark, tmp_path):
    calls = tmp_path / "calls"
    args = dict(queries=["solar power", "deep fish", "garden soil region"], output_folder=tmp_path / "out", cache_folder=tmp_path / "cache", bootstrap=20)
    r = run(spark, make_folder(tmp_path), ["bm25", "tfidf", "jaccard"], Counting(calls), **args)
    n = len(calls.read_text())
    assert r.path.exists() and r.record["config"]["arm"] == "own" and len(r.record["ratings"]) <= 3 and r.record["diagnostics"]["n_comparisons"] == 9
    assert r.record["diagnostics"]["judge_calls"] == n and r.record["labels"] is None
    again = run(spark, tmp_path / "lib", ["bm25", "tfidf", "jaccard"], Counting(calls), **args)
    assert len(calls.read_text()) == n and again.record == r.record
    more = run(spark, tmp_path / "lib", ["bm25", "tfidf"], Counting(calls), **(args | {"top_k": 3}))
    assert len(calls.read_text()) > n and more.path != r.path  # another key
    files = [p for g in ident.Layout(str(tmp_path / "cache")).of_record(r.record).values() for p in g]
    assert len(files) == 6 and publish.present_files(files) == files
    log = logs.read_verdict_log(spark, str(tmp_path / "cache" / "verdicts" / "corpus=lib"))
    assert log.select("key").distinct().count() == 4  # one log: three pairs, and one of the run with another depth
    assert results.load_results(tmp_path / "out").to_dataframe(spark).count() == results.records_frame(spark, tmp_path / "out").count()
    assert r.agreement() == {"error": "local corpus: no official scores to compare with"}
    out = publish.prepare(spark, tmp_path / "out", tmp_path / "cache", tmp_path / "clone")
    assert len(out["records"]) == 2 and out["branch"].startswith("submit-")
    assert publish.prepare(spark, tmp_path / "out", tmp_path / "cache", tmp_path / "clone") == {"records": [], "files": []}


def test_synthetic_run_and_predict(spark, tmp_path):
    folder = make_folder(tmp_path)
    args = dict(n_queries=4, cache_folder=tmp_path / "cache")
    path = predict(spark, folder, "bm25", generator=MockClient(), **args)
    assert (path / "_SUCCESS").exists()
    stamp = (path / "_SUCCESS").stat().st_mtime_ns
    r = run(spark, folder, ["bm25", "jaccard"], MockClient(), output_folder=tmp_path / "out", pairs_per_query=1, bootstrap=10, **args)
    assert (path / "_SUCCESS").stat().st_mtime_ns == stamp and r.record["config"]["arm"] == "synthetic" and r.record["labels"] == "seed_documents"
    assert all(x["ndcg_at_10"] is not None for x in r.record["ratings"]) and "bm25" in r.leaderboard
    with pytest.raises(ValueError, match="generator"):
        predict(spark, folder, "bm25")
    with pytest.raises(ValueError, match="no models"):
        run(spark, folder, [], MockClient())
    with pytest.raises(ValueError, match="no queries"):
        run(spark, folder, ["bm25"], MockClient(), queries="original", cache_folder=tmp_path / "c2")


def test_agreement_is_written_into_the_record(tmp_path):
    rows = [{"model": f"m{i}", "rating": float(i), "ndcg_at_10": i / 10} for i in range(5)]
    r = results.Result({"source": "table", "ratings": rows, "labels": "dataset"})
    r.path = tmp_path / "records" / "x.json"
    got = r.agreement({f"m{i}": float(i) for i in range(5)}, {"m0": {"official": True}}, bootstrap=20)
    assert got["spearman_rho"] == pytest.approx(1) and got["labels_baseline"]["labels"] == "dataset"
    assert results.load_results(tmp_path).results[0].record["agreement"]["kendall_tau"] == pytest.approx(1)


def test_record_paths(tmp_path):
    for p in ("records/a.json", "T/T__j__g__q.json", "T/U__x.json", "other.json"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("{}")
    assert [str(p.relative_to(tmp_path)) for p in logs.record_paths(tmp_path)] == ["T/T__j__g__q.json", "records/a.json"]


def test_identities():
    assert ident.config_hash({"a": 1, "b": [2]}) == ident.config_hash({"b": [2], "a": 1, "config_hash": "x"}) != ident.config_hash({"a": "1", "b": [2]})
    assert ident.slug("a/b@c") == "a_b_c" and ident.short_name("org/x y") == "x-y" and ident.short_name(None) == ""

    class C:
        model, max_tokens, extra_body, temperature = "m", None, None, None

    assert ident.client_id(C()) == "m"
    C.temperature = 0.0
    assert ident.client_id(C()).startswith("m+")
    contest = ident.Contest("j", "s", 10, 2000, "q")
    assert contest.key("x@r", "y@r") != contest.key("y@r", "x@r") and contest.key("x@r", "y@r") == ident.Contest("j", "s", 10, 2000, "q").key("x@r", "y@r")
    e = {"generator_model": "o/gen x", "judge_model": "j", "arm": "synthetic", "n_queries": 5, "seed": 0, "config_hash": "h"}
    assert str(ident.record_path("out", "T", e)) == "out/T/T__j__gen-x__5q__seed0__h.json"
    assert ident.record_path("s3a://out", "T", e | {"arm": "own"}) == "s3a://out/T/T__j__own__5q__seed0__h.json"
    assert ident.package_version("pyspark") and ident.package_version("no-such-package") is None and ident.git_revision("/") is None


def test_files_of_a_folder(spark, tmp_path):
    storage.write_text(tmp_path / "a" / "x.json", "é")
    storage.write_text(tmp_path / "a" / "x.json", "é2")
    storage.write_text(str(tmp_path / "a-b" / "y.json"), "2")
    assert storage.read_text(tmp_path / "a" / "x.json") == "é2" and storage.files(tmp_path, ".json") == ["a/x.json", "a-b/y.json"]
    assert storage.children(tmp_path) == ["a", "a-b"] and storage.children(tmp_path / "none") == [] and not storage.exists(tmp_path / "none")
    assert storage.files(tmp_path / "none") == [] and not storage.complete(tmp_path)


def test_publication_is_refused_when_files_are_missing(spark, tmp_path):
    config = {"judge_model": "j", "judge_system": "s", "top_k": 1, "doc_chars": 9, "query_set": "qs", "arm": "synthetic", "models": ["a", "b"], "model_revisions": {"a": "1", "b": "1"}}
    logs.write_record({"task_name": "T", "config": config}, tmp_path / "res" / "T" / "T__x.json")
    with pytest.raises(FileNotFoundError):
        publish.prepare(spark, tmp_path / "res", tmp_path / "cache", tmp_path / "clone")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    folder = make_folder(tmp_path)
    common = ["--corpus", str(folder), "--n-queries", "3", "--cache-folder", str(tmp_path / "cache"), "--no-filter"]
    cli.main(["predict", *common, "--model", "bm25", "--generator", "mock"])
    cli.main(["run", *common, "--models", "bm25", "tfidf", "--judge", "mock", "--output-folder", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "predictions:" in said and "record:" in said and "Rank" in said
    with pytest.raises(SystemExit):
        cli.main([])


# ------------------------------------------------------------ the stream


def test_stream_state(spark, tmp_path):
    schema = "line_no long, qid string, judge string, query_set string, model_a string, model_b string, score_a double, parsed_ok array<boolean>"
    part = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    row = lambda n, q, s, ok=(True,): (n, q, "j", "s", "a", "b", s, list(ok))
    part([row(1, "q1", 1.0), row(2, "q2", 0.0)])
    s = VerdictStream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema, str(tmp_path / "state"), str(tmp_path / "check"))
    with pytest.raises(ValueError, match="nothing"):
        s.current()
    s.run_available()
    s = VerdictStream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema, str(tmp_path / "state"), str(tmp_path / "check"))
    s.run_available()  # a restart without a new file finds the state
    assert s.current().count() == 2
    part([row(4, "q2", 1.0), row(3, "q2", 0.5), row(5, "q3", 1.0, (False,))])
    s.run_available()
    assert {r["qid"]: r["line_no"] for r in s.current().collect()} == {"q1": 1, "q2": 4, "q3": 5}
    assert {(r["i"], r["j"]): r["w"] for r in s.wins().collect()} == {("a", "b"): 2.0, ("b", "a"): 0.0}


def test_windows(spark):
    df = spark.sql("select timestamp'2025-01-01 10:00:00' judged_at, 'j' judge, 0.5D score_a, array(true, false) parsed_ok union all select timestamp'2025-01-01 23:00:00', 'j', 1.0D, array()")
    r = windowed_outcomes(df).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["ties"], r[0]["failed"]) == (2, 1, 1)


def test_win_loss_tie(spark):
    df = spark.createDataFrame([("a", "b", 0.75), ("b", "a", 0.5)], "model_a string, model_b string, score_a double")
    assert {r["model"]: (r["wins"], r["losses"], r["ties"], r["n"]) for r in rank.win_loss_tie(df).collect()} == {"a": (1, 0, 1, 2), "b": (0, 1, 1, 2)}
