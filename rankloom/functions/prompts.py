"""What the query writer, the query rater and the judge are told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import col, numbered, snippets

# Prompt wording. A mock answer is a hash of the prompt, so results depend on every character.
WRITER_ROLE = "You write realistic search queries for evaluating retrieval systems.\n"
WRITER_TASK = "The retrieval task is: {task}\nEvery query must express that kind of need.\n"
WRITER_BODY = (
    "Given a few documents from a corpus, produce ONE natural query a real user "
    "might type that is answerable using the corpus but is NOT a restatement of "
    "any single shown document. Vary phrasing and specificity. "
    'Reply with strict JSON: {"query": "..."}'
)
WRITER_USER = "Documents:\n{documents}\n\nWrite one query as JSON."
WRITER_CHARS = 600
RATER_SYSTEM = (
    "You rate the quality of search queries for benchmarking retrieval models. "
    "A 5 is a clear, specific, genuinely answerable information need that would "
    "separate good retrievers from bad ones. A 1 is vague, trivial, malformed, "
    "or answerable by exact keyword match. "
    'Reply with strict JSON: {"score": 1-5, "reason": "..."}'
)
RATER_USER = "Query: {query}\nReply as JSON."
JUDGE_ROLE = "You compare two retrieval systems.\n"
JUDGE_TASK = "The retrieval task is: {task}\n"
JUDGE_BODY = (
    "Given a query and two ranked result sets (System A and System B), decide which set "
    "better satisfies the query, judging relevance, coverage of the information need, and "
    "ranking quality. "
)
JUDGE_TAIL = (
    'Answer "tie" when the two sets are equally useful. '
    "Reply with strict JSON, reasoning first: "
    '{"reasoning": "one sentence", "winner": "A"|"B"|"tie"}'
)
IDENTICAL_REASON = "identical result sets; tied without judging"


def writer_system(task: str | None = None) -> str:
    """P11."""
    return WRITER_ROLE + (WRITER_TASK.replace("{task}", task) if task else "") + WRITER_BODY


def judge_system(task: str | None = None) -> str:
    """With and without a task the wording is the same but for its sentence."""
    return JUDGE_ROLE + (JUDGE_TASK.replace("{task}", task) if task else "") + JUDGE_BODY + JUDGE_TAIL


#: P10: where a criterion may come from.
GIVEN, OF_THE_TASK = "config:task_description", "corpus:task_prompt"


def resolve_task(given: str | None, prompt: str | dict | None) -> tuple[str | None, str | None]:
    """P10: the sentence and where it is from: the given one, also where it is empty; else the task's prompt, or that
    prompt's entry for queries, without blanks around it; else none."""
    offers = [(given, GIVEN)]
    if isinstance(prompt, dict):
        prompt = prompt.get("query")
    if prompt and prompt.strip():
        offers.append((prompt.strip(), OF_THE_TASK))
    return next(((text, source) for text, source in offers if text is not None), (None, None))


def _filled(template: str, name: str, value: Column) -> Column:
    before, after = template.split("{" + name + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def writer_user(texts: Column | str) -> Column:
    """P11."""
    return _filled(WRITER_USER, "documents", snippets(texts, WRITER_CHARS))


def rater_user(query: Column | str) -> Column:
    return _filled(RATER_USER, "query", col(query))


def judge_user(query: Column | str, first: Column | str, second: Column | str, doc_chars: int = 2000) -> Column:
    """P13."""
    return F.concat(
        F.lit("Query: "), col(query), F.lit("\n\nSystem A results:\n"), numbered(first, doc_chars), F.lit("\n\nSystem B results:\n"), numbered(second, doc_chars), F.lit("\n\nReply as JSON.")
    )
