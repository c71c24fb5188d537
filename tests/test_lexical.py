"""Lexical retrievers against brute force on odd inputs, and what they shuffle."""

import math
import re
from collections import Counter

import pytest

from rankloom.operators import retrieve

SCORES = [retrieve.bm25, retrieve.jaccard, retrieve.tfidf]
WORDS = ["solar", "tide", "moss", "rail", "yeast", "1763"]


def texts(n):
    """Documents with equal scores, copies, and some without a token; ids do not follow the order of rows."""
    some = {"d3": "", "d31": "... !", "d5": "the Solar solar SOLAR tide", "d50": "the Solar solar SOLAR tide"}
    return {f"d{i * 7919 % n}": " ".join(["the", *(w for j, w in enumerate(WORDS) if i % (j + 2) == 0), *["long"] * (i % 4)]) for i in range(n)} | some


ASKED = {"q1": "the solar tide", "q2": "moss moss rail nowhere", "q3": "the", "q4": "?!", "q5": "nowhere", "q6": "Yeast 1763 the of"}


def split(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute(score, docs, asked, k):
    docs, got = {d: Counter(split(t)) for d, t in docs.items()}, set()
    df, n, mean = Counter(w for c in docs.values() for w in c), len(docs), sum(c.total() for c in docs.values()) / len(docs)
    for q, text in asked.items():
        words, found = set(split(text)), []
        for d, c in docs.items():
            both = words & set(c)
            if not both:
                continue
            if score is retrieve.bm25:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in both)
            elif score is retrieve.tfidf:
                long, wide = (math.sqrt(sum(x * x for x in v)) for v in ([(1 + math.log(c[w])) * math.log(n / df[w]) for w in c], [math.log(n / df[w]) for w in words if df[w]]))
                if not long * wide:
                    continue
                s = sum((1 + math.log(c[w])) * math.log(n / df[w]) ** 2 for w in both) / long / wide
            else:
                s = len(both) / len(words | set(c))
            found.append((-math.floor(s * 1e6 + 0.5) / 1e6, d))
        got |= {(q, d, round(-s, 6), r) for r, (s, d) in enumerate(sorted(found)[:k], 1)}
    return got


def frames(spark, docs, asked, parts=3):
    return spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(parts), spark.createDataFrame(list(asked.items()), "qid string, text string")


@pytest.mark.parametrize("score", SCORES)
@pytest.mark.parametrize("every", [False, True])
def test_equals_brute_force(spark, monkeypatch, score, every):
    docs = texts(120)
    if every:  # a token of all documents
        docs = {d: "the " + t for d, t in docs.items()}
    monkeypatch.setattr(retrieve, "BLOCK_TOKENS", 4)  # several blocks of queries
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # several batches a task
    try:
        for k in (1, 3, 200):
            got = score(*frames(spark, docs, ASKED), k=k).select("qid", "doc_id", "score", "rank").collect()
            assert {tuple(r) for r in got} == brute(score, docs, ASKED, k) and len(got) == len({(r["qid"], r["doc_id"]) for r in got})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("score", SCORES)
def test_nothing_to_find(spark, score):
    docs, asked = frames(spark, texts(60), {"q": "nowhere"})
    assert score(docs, asked, k=3).collect() == [] and score(docs, asked.limit(0), k=3).collect() == [] and score(docs.limit(0), asked, k=3).collect() == []


def shuffled(spark):
    """Rows that stages of this session wrote for a shuffle."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("score", SCORES)
def test_pairs_are_not_shuffled(spark, score):
    docs, asked = frames(spark, texts(3000), {f"q{i}": f"the {WORDS[i % 6]}" for i in range(60)})
    before = shuffled(spark)
    assert score(docs, asked, k=3).count() == 180
    assert shuffled(spark) - before < 30_000  # 180,000 pairs share a word
