"""Pairwise judging in both presentation orders: J03-J06, F10, D07-D09, A11, U01, U02."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.chat import answered
from rankloom.functions.jsonx import answer_fields
from rankloom.functions.prompts import IDENTICAL_REASON, judge_system, judge_user
from rankloom.functions.text import joined_reasons, mock_answer, pair_score, winner
from rankloom.runtime import Written, small, written

#: Verdicts of a pair that are looked at, and the shares above which judging stops.
GUARD_AFTER, GUARD_FAILED, GUARD_IDENTICAL = 30, 0.5, 0.95


def model_pairs(spark: SparkSession, models: list[str]) -> DataFrame:
    """(pair, model_a, model_b): every two models, in roster order."""
    pairs = [(a, b) for k, a in enumerate(models) for b in models[k + 1 :]]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, model_a string, model_b string")


def meetings(ranked: DataFrame, pairs: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(pair, model_a, model_b, qid, query, ids_a, texts_a, ids_b, texts_b, pos): queries both models
    of a pair have a list for, perhaps only the chosen (qid, pair). pos: pair by pair, in the first
    model's query order."""
    roster = F.broadcast(pairs) if small(pairs) else pairs
    a = ranked.select(F.col("model").alias("model_a"), "qid", "query", F.col("doc_ids").alias("ids_a"), F.col("doc_texts").alias("texts_a"), F.col("pos").alias("qpos"))
    b = ranked.select(F.col("model").alias("model_b"), "qid", F.col("doc_ids").alias("ids_b"), F.col("doc_texts").alias("texts_b"))
    met = a.join(b, "qid").join(roster, ["model_a", "model_b"])  # lists are shuffled once, not once a pair
    if chosen is not None:
        met = met.join(chosen, ["qid", "pair"], "left_semi")
    return met.withColumn("pos", F.struct("pair", "qpos")).drop("qpos")


def identical(met: DataFrame) -> Column:
    """the same documents with the same texts in the same order; two empty lists too."""
    del met
    return (F.col("ids_a") == F.col("ids_b")) & (F.col("texts_a") == F.col("texts_b"))


def judge_prompts(met: DataFrame, doc_chars: int = 2000) -> DataFrame:
    """Two rows a meeting: `turn` 1 with model_a first, 2 with model_b first."""
    turns = F.explode(F.array(F.lit(1), F.lit(2))).alias("turn")
    rows = met.select("pair", "qid", "query", "texts_a", "texts_b", turns)
    first, second = F.when(F.col("turn") == 1, F.col("texts_a")).otherwise(F.col("texts_b")), F.when(F.col("turn") == 1, F.col("texts_b")).otherwise(F.col("texts_a"))
    return rows.select("pair", "qid", "turn", judge_user("query", first, second, doc_chars).alias("user"))


def read_answers(answers: DataFrame) -> DataFrame:
    """(pair, qid, turn, winner, ok, reason) of (pair, qid, turn, answer). Unreadable reads as a tie."""
    got = answers.withColumn("f", answer_fields("answer"))
    said = winner(F.try_element_at("f", F.lit("winner")))
    return got.select("pair", "qid", "turn", F.coalesce(said, F.lit("tie")).alias("winner"), said.isNotNull().alias("ok"), F.coalesce(F.try_element_at("f", F.lit("reasoning")), F.lit("")).alias("reason"))


def mock_answers(prompts: DataFrame, system: str, seed: int = 0) -> DataFrame:
    """The stand-in judge as a column; no Python process is started."""
    whole = F.concat(F.lit(system + " "), F.col("user"))
    return prompts.select("pair", "qid", "turn", mock_answer(whole, seed).alias("answer"))


def assemble(met: DataFrame, read: DataFrame, task: str = "", judge: str = "", query_set: str = "") -> DataFrame:
    """Verdicts of judged meetings, and of identical ones without an answer."""
    order = F.array_sort(F.collect_list(F.struct("turn", "winner", "ok", "reason")))  # two rows at most
    both = read.groupBy("pair", "qid").agg(order.alias("t"))
    joined = met.withColumn("same", identical(met)).join(both, ["pair", "qid"], "left")
    turn = lambda k, f: F.col("t").getItem(k).getField(f)
    ready = joined.filter(F.col("same") | F.col("t").isNotNull())
    pick = lambda same, else_: F.when(F.col("same"), same).otherwise(else_)
    return ready.select(
        "qid", "query", "model_a", "model_b",
        pick(F.lit(0.5), pair_score(turn(0, "winner"), turn(1, "winner"))).alias("score_a"),
        pick(F.array(F.lit("identical")), F.transform("t", lambda x: x["winner"])).alias("raw"),
        pick(F.lit(IDENTICAL_REASON), joined_reasons(F.transform("t", lambda x: x["reason"]))).alias("reasoning"),
        pick(F.array().cast("array<boolean>"), F.transform("t", lambda x: x["ok"])).alias("parsed_ok"),
        F.lit(task).alias("task"), F.lit(judge).alias("judge"), F.lit(query_set).alias("query_set"), "pair", "pos",
    )


#: Meetings of one wave for each worker; what was answered before a crash is kept wave by wave.
WAVE = 32


def judge_all(met: DataFrame, client=None, *, seed: int = 0, instruction: str | None = None, doc_chars: int = 2000, workers: int = 8, guard: bool = True, on_verdicts: Callable[[DataFrame], None] | None = None, wave: int = WAVE, **stamp: str) -> DataFrame:
    """Verdicts of all meetings. Without a client, or with the mock client, answers are a column.
    Otherwise every meeting is asked about twice, `workers` tasks at a time and `wave` meetings a task, and a wave's
    answers are written before use, so none is paid for again. A11: the first 30 of each pair are judged, written and
    looked at before the rest is asked. Y05: `on_verdicts` is called with the written verdicts of each wave as soon as
    they are there, so that whoever keeps them has lost no more than a wave when a run dies."""
    system = judge_system(instruction)
    mock = client is None or getattr(client, "model", None) == "mock"
    if mock:
        ask = lambda rows: mock_answers(judge_prompts(rows.filter(~identical(rows)), doc_chars), system, getattr(client, "seed", seed))
    else:

        def ask(rows: DataFrame) -> DataFrame:
            prompts = judge_prompts(rows.filter(~identical(rows)), doc_chars).withColumn("system", F.lit(system)).repartition(workers)
            return written(answered(prompts, client).select("pair", "qid", "turn", "answer"), "answers")

    judged = lambda rows: assemble(rows, read_answers(ask(rows)), **stamp)
    if mock and not guard and on_verdicts is None:
        return judged(met)
    total = met.count()
    waves = 1 if mock else max(1, -(-total // (wave * workers)))
    place = F.row_number().over(Window.partitionBy("pair").orderBy("pos"))  # the optimiser has no limit here: places of all meetings are needed
    early = place <= GUARD_AFTER if guard else F.lit(False)
    dealt = F.when(early, 0).otherwise(1 + F.pmod(F.xxhash64("pair", "qid"), F.lit(waves)).cast("int"))
    table = Written(met.withColumn("wave", dealt), "meetings", by="wave").df
    done = None
    for k in range(0 if guard else 1, waves + 1):
        some = written(judged(table.filter(F.col("wave") == k).drop("wave")), "verdicts")
        if k == 0:
            check_guard(some)
        if on_verdicts is not None:
            on_verdicts(some)
        done = some if done is None else done.unionByName(some)
    return done


def guard_counts(verdicts: DataFrame, by: str = "pair") -> DataFrame:
    """(by, done, failed, identical): failed means both orders asked and neither read."""
    asked_in_vain = (F.size("parsed_ok") > 0) & ~F.exists("parsed_ok", lambda ok: ok)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return verdicts.groupBy(by).agg(F.count("*").alias("done"), count(asked_in_vain).alias("failed"), count(F.col("raw") == F.array(F.lit("identical"))).alias("identical"))


def check_guard(early: DataFrame) -> None:
    """Refuses a dead judge or an empty corpus, once a pair has its 30 verdicts."""
    bad = guard_counts(early).filter((F.col("done") == GUARD_AFTER) & ((F.col("failed") > GUARD_FAILED * F.col("done")) | (F.col("identical") > GUARD_IDENTICAL * F.col("done")))).first()
    if bad is None:
        return
    if bad["failed"] > GUARD_FAILED * bad["done"]:
        raise RuntimeError(f"parse-failure rate {bad['failed'] / bad['done']:.0%} over the first {bad['done']} verdicts of a pair: the judge is likely unreachable or its key wrong")
    raise RuntimeError(f"{bad['identical'] / bad['done']:.0%} of the first {bad['done']} verdicts of a pair had identical lists: the corpus is likely empty or smaller than top_k")


def still_to_judge(met: DataFrame, log: DataFrame) -> DataFrame:
    """Meetings without a verdict in the log(qid, model_a, model_b)."""
    return met.join(log.select("qid", "model_a", "model_b").distinct(), ["qid", "model_a", "model_b"], "left_anti")


def merged(log: DataFrame, new: DataFrame) -> DataFrame:
    """Logged and new verdicts; a new one replaces the logged one of its query and pair."""
    kept = log.join(new.select("qid", "model_a", "model_b"), ["qid", "model_a", "model_b"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def in_request_order(verdicts: DataFrame, met: DataFrame) -> DataFrame:
    """Verdicts of the requested meetings only, with their place."""
    want = met.select("qid", "model_a", "model_b", "pair", "pos")
    return verdicts.drop("pair", "pos").join(want, ["qid", "model_a", "model_b"])
