"""Text, prompt, JSON and client expressions against plain Python."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.chat import HttpClient, HttpError, MockClient, answered, client_settings
from rankloom.functions import jsonx, prompts, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


@given(st.lists(st.text(alphabet="ab é  \t", max_size=30), min_size=1, max_size=30))
@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_cut(spark, texts):
    def plain(t):
        if len(t) <= 9:
            return t
        head = t[:9]
        if " " not in head:
            return head + "..."
        words = head.split()
        if not words:
            return head + "..."
        bare = head.rstrip()
        return (bare.lstrip() if len(words) == 1 else bare[: len(bare) - len(words[-1])].rstrip()) + "..."

    assert column(spark, texts, lambda x: text.cut(x, 9)) == [plain(t) for t in texts]


@pytest.mark.parametrize("t, n, want", [("one two three four five", 12, "one two..."), ("short", 12, "short"), ("onetwothreefour", 5, "onetw..."), ("one two three", 8, "one..."), ("", 3, ""), (None, 3, None)])
def test_cut_cases(spark, t, n, want):
    assert one(spark, t, lambda x: text.cut(x, n)) == want


def test_lists_and_snippets(spark):
    df = spark.createDataFrame([(["one two three", "b"], [])], "a array<string>, e array<string>")
    got = df.select(text.numbered("a", 8), text.numbered("e", 8), text.snippets("a", 3)).first()
    assert tuple(got) == ("  1. one...\n  2. b", "", "[1] one\n\n[2] b")


def test_names(spark):
    assert column(spark, ["a/b c.d-e_f", "é"], text.slug) == ["a_b_c.d-e_f", "_"]
    assert column(spark, ["org/My model!", "--x--", None, "a//"], text.short_name) == ["My-model", "x", "", ""]
    got = spark.createDataFrame([("a", 1)], "a string, b int").select(text.identity("a", "b")).first()[0]
    assert got == hashlib.sha256(b"a|1").hexdigest()[:12]


def test_tokens_and_jaccard(spark):
    assert column(spark, ["A b, a-B c3 É", ""], text.tokens) == [["a", "b", "c3"], []]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard("a", "b")).collect()] == [pytest.approx(1 / 3), None]


@pytest.mark.parametrize("t, ok", [("what is this thing", True), ("twowords only.....", False), ("short a b", False), ("1234 5678 9012 3456", False), ("x" * 300 + " a b", False), (None, False), ("", False), ("a" * 236 + " b c", True), ("a" * 237 + " b c", True), ("a" * 238 + " b c", False)])
def test_query_heuristics(spark, t, ok):
    ok = ok and (t is None or 15 <= len(t) <= 240)
    assert one(spark, t, text.query_ok) is ok


@pytest.mark.parametrize("said, want", [("a", "A"), ("Tie", "tie"), ("B.", "B"), ("System A", "A"), (" system b.. ", "B"), ("C", None), ("", None), (None, None), ("system  a", "A"), ("A and B", None)])
def test_winner(spark, said, want):
    assert one(spark, said, text.winner) == want


def test_scores(spark):
    df = spark.createDataFrame([("A", "B"), ("A", "A"), ("tie", "B"), ("tie", "tie"), ("B", "A"), (None, "A")], "x string, y string")
    assert [r[0] for r in df.select(text.pair_score("x", "y")).collect()] == [1.0, 0.5, 0.75, 0.5, 0.0, 0.25]


@pytest.mark.parametrize("said, want", [("4", 4), (" 4 ", 4), ("4.7", 4), ("-1.5", -1), ("4.5x", 3), ("", 3), (None, 3), ("null", 3), ("9", 9), ("Infinity", 3), ("1e1", 3)])
def test_quality(spark, said, want):
    assert one(spark, said, text.quality) == want


def test_elo_scale(spark):
    from pyspark.sql import Window

    got = spark.createDataFrame([(1.0,), (10.0,)], "p double").select(text.elo("p", over=Window.partitionBy())).collect()
    assert sorted(r[0] for r in got) == [800.0, 1200.0]


ANSWERS = [
    ('{"winner": "A"}', {"winner": "A"}), ('I think.\n```json\n{"winner": "B", "n": 1}\n```', {"winner": "B", "n": "1"}), ('{"a": 1} then {"b": {"c": 2}}', {"b": '{"c": 2}'}),
    ("no object", {}), (None, {}), ("", {}), ('{broken {"x": null}', {"x": None}), ('{"s": "\\ud83d"}', {"s": "�"}), ('{"s": "\\ud83d\\ude00"}', {"s": "😀"}), ('{"a": true} {not}', {"a": "true"}),
    ('{"t": "brace } in { text"}', {"t": "brace } in { text"}), ("[1, 2]", {}), ('[{"a": "in a list"}]', {"a": "in a list"}), ('{"k": "v", }', {}), ("{}", {}),
]


def test_last_object(spark):
    assert column(spark, [a for a, _ in ANSWERS], jsonx.answer_fields) == [w for _, w in ANSWERS]
    assert jsonx.last_object("{" * 5000) == {}


@given(st.lists(st.dictionaries(st.text(max_size=4), st.one_of(st.text(max_size=6), st.integers(-9, 9), st.booleans(), st.none(), st.lists(st.integers(0, 3), max_size=2)), max_size=3), min_size=1, max_size=3), st.text(alphabet="ab `\n", max_size=6))
@settings(max_examples=100, deadline=None)
def test_last_object_of_any_prose(objects, prose):
    answer = prose + prose.join(json.dumps(o) for o in objects) + prose
    assert jsonx.last_object(answer) == objects[-1]


PROMPTS = ["hello [1] some longer words here again and yet more of them", "Rate the quality please: system a", "System A results", "no words 1 2 3", "x [1] ab cd [1] then", ""]


def test_mock_column_equals_client(spark):
    for seed in (0, 1):
        client = MockClient(seed)
        want = [client.chat([{"role": "user", "content": p}]) for p in PROMPTS]
        assert column(spark, PROMPTS, lambda x: text.mock_answer(x, seed)) == want
        assert column(spark, PROMPTS, lambda x: text.mock_hash(x, seed)) == [int(hashlib.sha256(f"{seed}:{p}".encode()).hexdigest()[:8], 16) for p in PROMPTS]


def test_prompts(spark):
    with_task, without = prompts.judge_system("Find laws."), prompts.judge_system()
    assert with_task.replace("The retrieval task is: Find laws.\n", "") == without
    told = lambda given, prompt: prompts.resolve_task(given, prompt)[0]
    assert told(None, {"query": " q "}) == "q" and told(None, "  ") is None and told(None, None) is None and told(None, {"passage": "p"}) is None and told("", "x") == ""
    assert prompts.resolve_task("", "p") == ("", "config:task_description") and prompts.resolve_task(None, "p") == ("p", "corpus:task_prompt") and prompts.resolve_task(None, None) == (None, None)
    df = spark.createDataFrame([("q?", ["one"], ["two"])], "q string, a array<string>, b array<string>")
    assert df.select(prompts.judge_user("q", "a", "b", 5)).first()[0] == "Query: q?\n\nSystem A results:\n  1. one\n\nSystem B results:\n  1. two\n\nReply as JSON."


def test_answered_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "s", "system a"), (2, "s", None)], "i int, system string, user string")
    got = {r["i"]: r["answer"] for r in answered(df, MockClient).collect()}
    assert json.loads(got[1])["winner"] in ("A", "B", "tie") and got[2] is None


def test_http_client_drops_refused_parameters_and_retries():
    seen = []

    def send(url, key, body, timeout):
        seen.append(body)
        if "temperature" in body:
            raise HttpError(400, "temperature is not supported")
        if len(seen) == 2:
            raise HttpError(503, "busy")
        return {"model": "m-1", "choices": [{"message": {"content": "hi"}}]}

    c = HttpClient("m", base_url="http://x/v1", temperature=0.5, max_tokens=9, send=send)
    assert c.chat([]) == "hi" and c.chat([]) == "hi"
    assert "temperature" not in seen[-1] and seen[-1]["max_completion_tokens"] == 9
    assert client_settings(c) == {"model": "m", "base_url": "http://x/v1", "served_model": "m-1", "temperature": 0.5, "max_completion_tokens": 9, "refused": ["temperature"]}


def test_http_client_raises_what_it_cannot_mend(monkeypatch):
    def send(*_):
        raise HttpError(401, "key")

    with pytest.raises(HttpError):
        HttpClient("m", base_url="http://x", send=send).chat([])
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    monkeypatch.delenv("OPENAI_BASE_URL", raising=False)
    with pytest.raises(ValueError, match="no key"):
        HttpClient("m")
