"""Queries of the arena's operators over the driver's tables. plans/oracle.py holds their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.chat import MockClient
from rankloom.functions import jsonx, prompts, text
from rankloom.ident import slug as text_slug
from rankloom.operators import agreement, dedup, generate, judge, metrics, publish, rank, results, retrieve, sampling
from rankloom.plans.oracle import oracle_sql  # noqa: F401
from rankloom.runtime import shared_dir, written
from rankloom.schemas import VERDICTS
from rankloom.sources import corpus, logs
from rankloom.sources import queries as queries_source
from rankloom.streaming import verdicts as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    return corpus.table_docs(_t(spark, sf, "corpus"))


def _asked(spark, sf) -> DataFrame:
    """The query table, one row an id, placed by the number in the id."""
    rows = _t(spark, sf, "queries").filter("qid is not null")
    last = F.max_by(F.struct("text", "seed_doc_ids", "quality"), F.struct("created_at", "text"))
    one = rows.groupBy("qid").agg(last.alias("r")).select("qid", "r.*")
    return one.withColumn("pos", F.substring("qid", 2, 20).try_cast("long"))


def _search(spark, sf) -> DataFrame:
    """The stated query set of a search: every query whose number is divisible by 50, against all documents."""
    return _asked(spark, sf).filter("pos % 50 = 0 and text is not null")


def _hits(spark, sf) -> DataFrame:
    """Hits of the delivered lists; pos by shard, then place."""
    return logs.list_hits(_t(spark, sf, "ranked"))


def _named(log: DataFrame) -> DataFrame:
    return log.withColumns({c: text.strip(c) for c in ("model_a", "model_b")})


def _verdicts(spark, sf) -> DataFrame:
    return _named(_t(spark, sf, "verdicts"))


def _models(spark, sf) -> list[str]:
    found = [r[0] for r in _t(spark, sf, "ranked").select("model").distinct().limit(ROSTER + 1).collect()]
    if len(found) > ROSTER:
        raise ValueError(f"more than {ROSTER} models in the roster")
    return sorted(found)


#: Models a roster may have.
ROSTER = 10_000


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------------------ scans, projections, filters


@query
def corpus_scan(spark, sf):
    return _docs(spark, sf)


@query
def title_text_concat(spark, sf):
    return _t(spark, sf, "corpus").select("pos", text.title_text("title", "text").alias("full_text"))


@query
def corpus_last_wins(spark, sf):
    return corpus.last_wins(_t(spark, sf, "corpus").filter("doc_id is not null").select("doc_id", "title", "corpus_id", "pos"), "doc_id")


@query
def query_heuristics(spark, sf):
    return _asked(spark, sf).select("qid", text.query_ok("text").alias("ok"))


@query
def query_quality_filter(spark, sf):
    return generate.good_quality(_asked(spark, sf)).select("qid", "quality")


@query
def query_renumber_limit(spark, sf):
    good = generate.good_quality(_asked(spark, sf).filter(text.query_ok("text")))
    return generate.renumbered(good, 100).select("qid", "text", "pos")


@query
def token_sets(spark, sf):
    rows = _docs(spark, sf).select("doc_id", text.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query
def jaccard_pairs(spark, sf):
    seeds = metrics.seed_labels(_asked(spark, sf)).join(_asked(spark, sf).select("qid", F.col("text").alias("q")), "qid")
    met = seeds.join(_docs(spark, sf).select("doc_id", "text"), "doc_id").filter("q is not null")
    return met.select("qid", "doc_id", _r(text.jaccard(text.tokens("q"), text.tokens("text"))).alias("jaccard"))


@query
def near_dup_edges(spark, sf):
    """Positions of near-duplicate queries; equal token sets are one node."""
    return dedup.near_edges(_asked(spark, sf).filter("text is not null"))


@query
def greedy_dedup(spark, sf):
    return dedup.greedy_keep(_asked(spark, sf).filter("text is not null")).select("qid", "pos")


@query
def truncate_words(spark, sf):
    return _t(spark, sf, "documents").filter("text is not null").select("doc_id", text.cut("text", 60).alias("head"), F.length(text.cut("text", 2000)).alias("shown"))


@query
def slugs(spark, sf):
    names = rank.model_names(_t(spark, sf, "verdicts"))
    return names.select("model", text.slug("model").alias("slug"), text.short_name("model").alias("short"))


@query
def identity_hash(spark, sf):
    return _t(spark, sf, "verdicts").select("line_no", text.identity("judge", "query_set", "model_a", "model_b").alias("id"))


@query
def writer_prompt(spark, sf):
    """The generator's prompt for the seed documents of every query, hashed, and the mock client's query."""
    seeds = _asked(spark, sf).select("qid", F.posexplode("seed_doc_ids").alias("at", "doc_id"))
    shown = seeds.join(_docs(spark, sf).select("doc_id", "text"), "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"))
    user = shown.select("qid", prompts.writer_user(F.transform("l", lambda x: x["text"])).alias("user"))
    answer = text.mock_answer(F.concat(F.lit(prompts.writer_system() + " "), F.col("user")))
    said = F.try_element_at(jsonx.answer_fields(answer), F.lit("query"))
    return user.select("qid", F.sha2("user", 256).alias("prompt_hash"), said.alias("written"))


@query
def mock_quality(spark, sf):
    asked = _asked(spark, sf).filter("text is not null")
    answer = text.mock_answer(F.concat(F.lit(prompts.RATER_SYSTEM + " "), prompts.rater_user("text")))
    return asked.select("qid", text.quality(F.try_element_at(jsonx.answer_fields(answer), F.lit("score"))).alias("quality"))


@query
def extract_json(spark, sf):
    """The last object of answers with prose and fences around it."""
    rows = _t(spark, sf, "events").select("event_id", F.concat(F.lit("I think {not json} so:\n```json\n{\"old\": 1}\n"), F.col("props"), F.lit("\n``` as said.")).alias("answer"))
    got = rows.select("event_id", F.array_sort(F.map_entries(jsonx.answer_fields("answer"))).alias("e"))
    return got.select("event_id", F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("members"))


# ------------------------------------------------------------ retrieval


def _top(scored: DataFrame) -> DataFrame:
    return retrieve.ranked_hits(scored, 10).select("qid", "doc_id", F.col("rank").cast("int").alias("rank"), "score")


@query
def bm25_topk(spark, sf):
    docs = _docs(spark, sf)
    return _top(retrieve.bm25(docs, _search(spark, sf), retrieve.shared_tokens(docs), 10).drop("rank"))


@query
def tfidf_topk(spark, sf):
    docs = _docs(spark, sf)
    return _top(retrieve.tfidf(docs, _search(spark, sf), retrieve.shared_tokens(docs), 10).drop("rank"))


@query
def jaccard_topk(spark, sf):
    docs = _docs(spark, sf)
    return _top(retrieve.jaccard(docs, _search(spark, sf), retrieve.shared_tokens(docs), 10).drop("rank"))


def _dense(how: str):
    def run(spark, sf):
        vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
        asked = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vec")
        return _top(retrieve.dense(vectors, asked, how, k=10).drop("rank"))

    return run


for _how in ("dense_cos", "dense_dot", "dense_l2", "dense_trunc_16", "dense_sign"):
    QUERIES[f"{_how}_topk"] = _dense(_how)


@query
def self_match_drop(spark, sf):
    """F03 where queries are documents: the nearest ones without the query itself."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asked = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vec")
    return logs.drop_self(retrieve.dense(vectors, asked, "dense_cos", drop_self=False, k=10)).select("qid", "doc_id", "score")


@query
def ranked_lists(spark, sf):
    roster = spark.createDataFrame([(m,) for m in _models(spark, sf)], "model string")
    lists = retrieve.top_k(_hits(spark, sf), _asked(spark, sf), _docs(spark, sf), roster, 10, strict=False)
    return lists.select("model", "qid", F.array_join("doc_ids", ",").alias("docs"), F.aggregate("doc_texts", F.lit(0), lambda n, t: n + F.length(t)).alias("chars"))


@query
def missing_hits_left_join(spark, sf):
    roster = spark.createDataFrame([(m,) for m in _models(spark, sf)], "model string")
    lists = retrieve.top_k(_hits(spark, sf), _asked(spark, sf), _docs(spark, sf), roster, 10, strict=False)
    return lists.groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.size("doc_ids") == 0, 1)).alias("empty"))


@query
def hits_outside_corpus(spark, sf):
    """Hits that lie outside the part of the corpus with long texts."""
    best = retrieve.ranked_hits(_hits(spark, sf), 10, ("model", "qid"), "pos")
    return best.join(_docs(spark, sf).filter(F.length("text") >= 300).select("doc_id"), "doc_id", "left_anti").groupBy("model").agg(F.count("*").alias("n"))


@query
def ndcg_at_10(spark, sf):
    return metrics.ndcg(_hits(spark, sf), metrics.seed_labels(_asked(spark, sf))).select("model", _r("ndcg").alias("ndcg"))


@query
def precision_at_10(spark, sf):
    return metrics.precision(_hits(spark, sf), metrics.seed_labels(_asked(spark, sf))).select("model", _r("precision").alias("precision"))


# ------------------------------------------------------------ judging


def _meetings(spark, sf) -> DataFrame:
    """Every two models' lists for every query with a text."""
    models = _models(spark, sf)
    roster = spark.createDataFrame([(m,) for m in models], "model string")
    asked = _asked(spark, sf).filter("text is not null")
    lists = written(retrieve.top_k(_hits(spark, sf), asked, _docs(spark, sf), roster, 10, strict=False), "ranked")
    return judge.meetings(lists, judge.model_pairs(spark, models))


@query
def model_pairs(spark, sf):
    return judge.model_pairs(spark, _models(spark, sf))


@query
def pairs_by_query(spark, sf):
    """How many delivered lists of two models meet on a query."""
    lists = _t(spark, sf, "ranked").select("model", "qid").distinct()
    a, b = lists.select(F.col("model").alias("model_a"), "qid"), lists.select(F.col("model").alias("model_b"), "qid")
    return a.join(b, "qid").filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("n"))


@query
def pair_subset_semi(spark, sf):
    pairs = judge.model_pairs(spark, _models(spark, sf))
    asked = _asked(spark, sf)
    chosen = sampling.pair_subset(spark, pairs.count(), sampling.ids(asked, "qid", "pos"), 5, 0)
    return asked.select("qid").join(F.broadcast(pairs)).join(chosen, ["qid", "pair"], "left_semi").groupBy("model_a", "model_b").agg(F.count("*").alias("n"))


@query
def sampled_queries(spark, sf):
    return sampling.sample_queries(_asked(spark, sf), 100, 0).select("qid", "text")


@query
def identical_retrieval(spark, sf):
    met = _meetings(spark, sf)
    return met.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.count(F.when(judge.identical(met), 1)).alias("same"))


@query
def judge_prompt(spark, sf):
    rows = judge.judge_prompts(_meetings(spark, sf))
    return rows.select("pair", "qid", "turn", F.sha2("user", 256).alias("prompt_hash"), F.length("user").alias("n_chars"))


@query
def mock_judge_raw(spark, sf):
    met = _meetings(spark, sf)
    rows = judge.mock_answers(judge.judge_prompts(met.filter(~judge.identical(met))), prompts.judge_system())
    return judge.read_answers(rows).select("pair", "qid", "turn", "winner", "ok")


@query
def judged_verdicts(spark, sf):
    done = judge.judge_all(_meetings(spark, sf), guard=False)
    return done.select("qid", "model_a", "model_b", "score_a", F.array_join("raw", ",").alias("raw"), "reasoning", F.size("parsed_ok").alias("orders"))


@query
def winner_normalise(spark, sf):
    said = _t(spark, sf, "verdicts").select(F.explode("raw").alias("said"))
    return said.select("said", text.winner("said").alias("winner")).groupBy("said", "winner").agg(F.count("*").alias("n"))


@query
def verdict_scores(spark, sf):
    two = _t(spark, sf, "verdicts").filter(F.size("raw") == 2)
    w = [text.winner(F.col("raw")[k]) for k in (0, 1)]
    return two.select("line_no", text.pair_score(w[0], w[1]).alias("score"), w[0].isNotNull().alias("ok_1"), w[1].isNotNull().alias("ok_2"))


@query
def reasons_joined(spark, sf):
    parts = F.split(F.coalesce("reasoning", F.lit("")), r" \| ")
    return _t(spark, sf, "verdicts").select("line_no", text.joined_reasons(F.concat(parts, F.array(F.lit("")))).alias("reason"))


@query
def verdict_last_wins(spark, sf):
    cols = ["query_set", "qid", "judge", "model_a", "model_b"]
    return logs.latest(_verdicts(spark, sf).select(*cols, "line_no", "score_a"), *cols)


@query
def verdict_todo_anti(spark, sf):
    return judge.still_to_judge(_named(_t(spark, sf, "panel")).select("qid", "model_a", "model_b").distinct(), _verdicts(spark, sf))


@query
def verdict_union(spark, sf):
    cols = ["qid", "model_a", "model_b"]
    one = lambda t: logs.latest(_named(_t(spark, sf, t)).select(*cols, "line_no", "score_a"), *cols)
    return judge.merged(one("verdicts"), one("panel")).groupBy("model_a", "model_b").agg(F.count("*").alias("n"), _r(F.avg("score_a")).alias("mean_score"))


@query
def judge_guard_counts(spark, sf):
    by = ["model_a", "model_b"]
    order = Window.partitionBy(*by).orderBy("line_no")
    early = _verdicts(spark, sf).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= judge.GUARD_AFTER)
    keyed = early.withColumn("pair", F.concat_ws("|", *by))
    return judge.guard_counts(keyed)


@query
def judge_diagnostics(spark, sf):
    found = results.diagnostics(_t(spark, sf, "verdicts"), ["judge"])
    return found.select("judge", "judge_calls", "n_comparisons", *[_r(c).alias(c) for c in found.columns if c.endswith("_rate")])


@query
def judge_diagnostics_total(spark, sf):
    found = results.diagnostics(_t(spark, sf, "verdicts"))
    return found.select("judge_calls", "n_comparisons", *[_r(c).alias(c) for c in found.columns if c.endswith("_rate")])


# ------------------------------------------------------------ ratings


@query
def model_names(spark, sf):
    return rank.model_names(_verdicts(spark, sf))


@query
def win_matrix(spark, sf):
    return rank.win_matrix(rank.usable(_verdicts(spark, sf))).select("i", "j", _r("w").alias("w"))


@query
def win_loss_tie(spark, sf):
    return rank.win_loss_tie(rank.usable(_verdicts(spark, sf)))


@query
def bt_rating_2(spark, sf):
    """The closed form for every two models on their own."""
    w = rank.win_matrix(rank.usable(_verdicts(spark, sf))).withColumn("w", F.col("w") + rank.SMOOTHING)
    back = w.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("v"))
    p = w.join(back, ["i", "j"]).withColumn("p", F.sqrt(F.col("w") / F.col("v"))).withColumn("pair", F.concat_ws("|", F.least("i", "j"), F.greatest("i", "j")))
    return p.select("i", "j", _r(text.elo("p", over=Window.partitionBy("pair"))).alias("rating"))


@query
def bt_rating_all(spark, sf):
    return rank.point_ratings(rank.usable(_verdicts(spark, sf))).select("model", _r("rating").alias("rating"))


@query
def rating_bootstrap_ci(spark, sf):
    good = _verdicts(spark, sf).withColumn("pos", F.col("line_no"))
    found = rank.rate(good)
    return found.select("name", *[_r(c).alias(c) for c in ("rating", "ci_low", "ci_high")], "wins", "losses", "ties", "n")


@query
def percentile_ci(spark, sf):
    found = rank.interval(_t(spark, sf, "documents").filter("lang is not null").select("lang", F.col("n_chars").cast("double").alias("n")), "lang", "n")
    return found.select("lang", _r("ci_low").alias("ci_low"), _r("ci_high").alias("ci_high"))


def _means(log: DataFrame, *by: str) -> DataFrame:
    sides = log.select(*by, F.explode(F.array(F.struct(F.col("model_a").alias("m"), F.col("score_a").alias("s")), F.struct(F.col("model_b").alias("m"), (1 - F.col("score_a")).alias("s")))).alias("x"))
    return sides.groupBy(*by, F.col("x.m").alias("model")).agg(_r(F.avg("x.s"), 9).alias("score"))


def _agreeing(spark, sf) -> DataFrame:
    """(task, model, g, t): mean scores by task in the verdict log against those of the whole panel."""
    return agreement.shared_scores(_means(rank.usable(_verdicts(spark, sf)), "task"), _means(rank.usable(_named(_t(spark, sf, "panel")))), ("task",))


@query
def agreement_join(spark, sf):
    return _agreeing(spark, sf)


@query
def spearman(spark, sf):
    return agreement.spearman_df(_agreeing(spark, sf), ["task"]).select("task", "n", _r("rho").alias("rho"))


@query
def kendall(spark, sf):
    return agreement.kendall_df(_agreeing(spark, sf), ["task"]).select("task", _r("tau").alias("tau"))


@query
def tau_ap(spark, sf):
    return agreement.tau_ap_df(_agreeing(spark, sf), ["task"]).select("task", _r("tau_ap").alias("tau_ap"))


@query
def spearman_top10(spark, sf):
    return agreement.spearman_df(agreement.top_by_truth(_agreeing(spark, sf), ["task"]), ["task"]).select("task", "n", _r("rho").alias("rho"))


@query
def official_score_pick(spark, sf):
    scores = _means(rank.usable(_verdicts(spark, sf)), "task", "judge").withColumnRenamed("judge", "revision")
    pinned = scores.groupBy("model").agg(F.min("revision").alias("revision"))
    return logs.pick_official(scores, pinned)


@query
def truth_assembly(spark, sf):
    """Official scores of every task, and the panel's for models that have none there."""
    scores = _means(rank.usable(_verdicts(spark, sf)), "task", "judge").withColumnRenamed("judge", "revision")
    official = logs.pick_official(scores, scores.groupBy("model").agg(F.min("revision").alias("revision")))
    tasks = scores.select("task").distinct()
    models = rank.model_names(_verdicts(spark, sf)).withColumn("revision", F.lit("r1")).join(F.broadcast(tasks))
    return logs.truth_for(models, official, _means(rank.usable(_named(_t(spark, sf, "panel")))))


@query
def leaderboard(spark, sf):
    scored = _means(rank.usable(_verdicts(spark, sf))).select(F.col("model").alias("name"), F.col("score").alias("rating"))
    best = rank.leaderboard(scored)
    return best.select("name", "rating")


@query
def record_explode(spark, sf):
    stats = rank.win_loss_tie(rank.usable(_verdicts(spark, sf)))
    row = F.struct("model", F.lit("r1").alias("revision"), "wins", "losses", "ties", F.col("n").cast("long").alias("n"))
    rows = stats.agg(F.array_sort(F.collect_list(row)).alias("ratings"))  # a record: one row a model
    head = F.struct(F.lit("mock").alias("judge_model"), F.lit(None).cast("string").alias("generator_model"), F.lit("own").alias("arm"), F.lit(100).cast("long").alias("n_queries"))
    flat = results.explode_records(rows.select(F.lit("arena").alias("task_name"), head.alias("config"), "ratings"))
    return flat.drop("generator")


@query
def distinct_files(spark, sf):
    lists = _t(spark, sf, "verdicts").select(F.array(F.concat(F.lit("queries/"), F.col("query_set"), F.lit(".json")), F.concat_ws("/", F.lit("verdicts"), "task", text.slug("judge"))).alias("files"))
    return publish.distinct_files(lists)


# ------------------------------------------------------------ files: written from the tables, read by the sources


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/rankloom/{name}-{uuid.uuid4().hex}"


@query
def jsonl_corpus(spark, sf):
    """S03 of the corpus written as lines of JSON."""
    path = _fresh(spark, "corpus.jsonl")
    _docs(spark, sf).select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("value")).write.text(path)
    return corpus.read_jsonl(spark, path).select("doc_id", "text")


@query
def corpus_digest(spark, sf):
    """P02 of the passage table."""
    return spark.createDataFrame([(corpus.content_digest(_docs(spark, sf)),)], "digest string")


@query
def own_queries_txt(spark, sf):
    """Query texts as lines, blank ones dropped."""
    path = _fresh(spark, "own.txt")
    _asked(spark, sf).select(F.regexp_replace(F.coalesce("text", F.lit("  ")), r"[\r\n\x0B\f\x{85}\x{2028}\x{2029}]", " ").alias("value")).write.text(path)
    return queries_source.own_queries(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query
def own_queries_jsonl(spark, sf):
    """S08."""
    path = _fresh(spark, "own") + ".jsonl"
    _asked(spark, sf).filter("text is not null").select(F.to_json(F.struct(F.col("qid").alias("id"), "text")).alias("value")).write.text(path)
    return queries_source.own_queries(spark, path).select("qid", "text")


@query
def query_set_file(spark, sf):
    """A query set written and read back."""
    path = _fresh(spark, "set") + ".json"
    good = generate.renumbered(generate.good_quality(_asked(spark, sf).filter(text.query_ok("text"))), 100)
    queries_source.write_query_set(path, good, {"model": "mock"}, 160)
    rows, n, _ = queries_source.read_query_set(spark, path)
    return rows.select("qid", "text", "quality", F.size("seed_doc_ids").alias("n_seeds"), F.lit(n).alias("n_generated"))


@query
def prediction_file_hits(spark, sf):
    """A prediction file of one model for the stated queries."""
    path = _fresh(spark, "predictions") + ".json"
    first = _models(spark, sf)[0]
    mine = _hits(spark, sf).filter(F.col("model") == first).join(_search(spark, sf).select("qid"), "qid", "left_semi")
    per = mine.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "score"))).alias("docs"))  # one result list
    tree = per.agg(F.map_from_entries(F.collect_list(F.struct("qid", "docs"))).alias("test"))  # a prediction file is one document
    tree.select(F.to_json(F.struct(F.struct("test").alias("default"))).alias("value")).coalesce(1).write.text(path)
    return logs.prediction_hits(spark, path, first).select("model", "qid", "doc_id", "score")


_COMPARISON = ("query_set", "qid", "judge", "model_a", "model_b")


@query
def verdict_log_appends(spark, sf):
    """Every comparison written twice, first with another outcome; the newer append counts."""
    path, rows = _fresh(spark, "log"), logs.latest(_verdicts(spark, sf), *_COMPARISON)
    logs.append_verdicts(rows.withColumn("score_a", 1 - F.col("score_a")).withColumn("reasoning", F.lit("older")), path)
    logs.append_verdicts(rows, path)
    newest = logs.latest(logs.read_verdict_log(spark, path), *_COMPARISON)
    return newest.select(*_COMPARISON, "score_a", F.array_join("raw", ",", "-").alias("raw"), F.size("parsed_ok").alias("orders"))


@query
def corrupt_verdict_lines(spark, sf):
    """whole lines among broken ones, lines without a required field and lines with an unknown one."""
    good = F.struct(*[F.col(c) for c in VERDICTS.fieldNames()])
    line = F.to_json(good, {"ignoreNullFields": "false"})
    short = F.to_json(F.struct("qid", "model_a"))
    more = F.concat(F.lit('{"extra": 1, '), F.substring(line, 2, 1 << 30))
    lines = _t(spark, sf, "verdicts").select("line_no", F.explode(F.array(line, F.substring(line, 1, 40), short, more, F.lit("[]"), F.lit(""))).alias("value"))
    return logs.verdict_lines(lines).groupBy("judge").agg(F.count("*").alias("n"), _r(F.sum("score_a"), 2).alias("score"))


def _task_ratings(spark, sf) -> DataFrame:
    good = rank.usable(_verdicts(spark, sf))
    sides = good.select("task", F.explode(F.array(F.struct(F.col("model_a").alias("m"), F.col("score_a").alias("s")), F.struct(F.col("model_b").alias("m"), (1 - F.col("score_a")).alias("s")))).alias("x"))
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return sides.groupBy("task", F.col("x.m").alias("name")).agg(_r(1000 * F.avg("x.s"), 3).alias("rating"), one(F.col("x.s") > 0.5).alias("wins"), one(F.col("x.s") < 0.5).alias("losses"), one(F.col("x.s") == 0.5).alias("ties"), F.count("*").alias("n"))


@query
def record_files(spark, sf):
    """A record of every task, written, found below a folder and read as rows."""
    root = _fresh(spark, "results")
    by: dict[str, list] = {}
    for r in _task_ratings(spark, sf).orderBy("task", F.desc("rating"), "name").collect():  # a row a task and model
        by.setdefault(r["task"], []).append(r.asDict() | {"ci_low": r["rating"], "ci_high": r["rating"]})
    for task, rows in by.items():
        about = corpus.Corpus(task, f"{task}@r1/default/test", None)
        experiment = {"judge_model": "mock", "generator_model": None, "arm": "own", "n_queries": 10}
        record = results.build_record(about, experiment, rows, {}, 1.0, {r["name"]: "r1" for r in rows}, ndcg={r["name"]: 0.5 for r in rows})
        logs.write_record(record, f"{root}/{text_slug(task)}/{text_slug(task)}__mock.json")
        logs.write_record(record, f"{root}/elsewhere/{text_slug(task)}__mock.json")  # no record's place
    return results.records_frame(spark, root).select("task", "arm", "model", "revision", "rating", "wins", "losses", "ties", "n", "ndcg_at_10")


@query
def leaderboard_text(spark, sf):
    """The printed table, line by line."""
    rows = [r.asDict() | {"ci_low": 0.0, "ci_high": r["n"]} for r in _task_ratings(spark, sf).groupBy("name").agg(F.sum("rating").alias("rating"), *[F.sum(c).alias(c) for c in ("wins", "losses", "ties")], F.sum("n").cast("double").alias("n")).orderBy(F.desc("rating"), "name").collect()]
    printed = rank.format_leaderboard(rows).split("\n")
    return spark.createDataFrame([(i, x) for i, x in enumerate(printed)], "line int, printed string")


# ------------------------------------------------------------ more expressions and joins


@query
def extract_json_shapes(spark, sf):
    """An answer without an object, one inside another, a broken start, several in a row, and fences twice."""
    p = F.col("props")
    shapes = [F.lit("no object at all"), F.concat(F.lit('x {"outer": '), p, F.lit("} y")), F.concat(F.lit('{"a": '), p), F.concat(F.lit('{"first": 1} then '), p, F.lit(" }}")), F.concat(F.lit("```\n"), p, F.lit("\n```\n```json\n{\"last\": 2}\n```"))]
    rows = _t(spark, sf, "events").select("event_id", F.posexplode(F.array(*shapes)).alias("shape", "answer"))
    got = rows.select("event_id", "shape", F.array_sort(F.map_keys(jsonx.answer_fields("answer"))).alias("k"))
    return got.select("event_id", "shape", F.array_join("k", ",").alias("members"))


@query
def quality_shapes(spark, sf):
    """P20: scores as answers spell them."""
    q = F.col("quality").cast("string")
    said = F.posexplode(F.array(q, F.concat(q, F.lit(".7")), F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit("x"), q), F.concat(F.lit("-"), q, F.lit(".5")), F.lit("NaN"))).alias("shape", "said")
    return _asked(spark, sf).filter("quality is not null").select("qid", said).select("qid", "shape", text.quality("said").alias("quality"))


@query
def rated_queries(spark, sf):
    """Ratings of the mock client and how many were unreadable."""
    scored, missed = generate.rated(_asked(spark, sf).filter("text is not null"), MockClient())
    return scored.select("qid", "quality", F.lit(missed).alias("unreadable"))


@query
def ci_half_width(spark, sf):
    """P24, A06."""
    found = rank.interval(_t(spark, sf, "documents").filter("lang is not null").select("lang", F.col("n_chars").cast("double").alias("n")), "lang", "n")
    return found.select("lang", _r(text.half_width("ci_low", "ci_high")).alias("half"))


@query
def requested_verdicts(spark, sf):
    """Of the log, the comparisons that are asked for."""
    cols = ["qid", "model_a", "model_b"]
    asked = _named(_t(spark, sf, "panel")).select(*cols).distinct().withColumn("pair", F.concat_ws("|", "model_a", "model_b")).withColumn("pos", F.col("qid"))
    log = logs.latest(_verdicts(spark, sf).select(*cols, "line_no", "score_a"), *cols)
    return judge.in_request_order(log, asked).select(*cols, "pair", "score_a")


def _listing(spark, sf, table: str) -> DataFrame:
    return _t(spark, sf, table).select(F.concat(text.slug("judge"), F.lit("/"), F.col("query_set")).alias("path"), F.sha2("task", 256).alias("sha")).distinct()


@query
def new_files(spark, sf):
    """Files whose name and content the other side has not."""
    return publish.new_files(_listing(spark, sf, "panel"), _listing(spark, sf, "verdicts"))


@query
def missing_files(spark, sf):
    """J14."""
    return publish.missing_files(_listing(spark, sf, "panel").select("path").distinct(), _listing(spark, sf, "verdicts").select("path").distinct())


@query
def strict_lists(spark, sf):
    """Lists of which every hit must be in the corpus."""
    docs = _docs(spark, sf).filter(F.length("text") >= 300)
    roster = spark.createDataFrame([(m,) for m in _models(spark, sf)], "model string")
    inside = _hits(spark, sf).join(docs.select("doc_id"), "doc_id", "left_semi")
    lists = retrieve.top_k(inside, _asked(spark, sf), docs, roster, 10, strict=True)
    return lists.select("model", "qid", F.array_join("doc_ids", ",").alias("docs"))


@query
def logs_union(spark, sf):
    """Logs of different columns in one frame."""
    both = agreement.union_all([_named(_t(spark, sf, "panel")).drop("logged_at"), _verdicts(spark, sf)])
    return both.groupBy("judge").agg(F.count("*").alias("n"), F.count("logged_at").alias("logged"))


@query
def maxsim_topk(spark, sf):
    """D06, late interaction: vectors read as four parts each."""
    part = lambda k: F.slice("embedding", 16 * k + 1, 16)
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(*[part(k) for k in range(4)]).alias("vec"))
    asked = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vec")
    return _top(retrieve.dense(vectors, asked, retrieve.LATE, k=10).drop("rank"))


@query
def generated_queries(spark, sf):
    """Generation waves of the mock client over the corpus."""
    made = generate.generate(written(_docs(spark, sf), "docs"), MockClient(), generate.Settings(n_queries=40, filter=False))
    return made.select("qid", "text", F.size("seed_doc_ids").alias("n_seeds"))


@query
def correlations(spark, sf):
    """Agreement of every task's ranking with the panel's, with p-values and intervals."""
    by: dict[str, list] = {}
    for r in _agreeing(spark, sf).orderBy("task", "model").collect():  # a row a task and model
        by.setdefault(r["task"], []).append(r)
    rows = []
    for task, some in by.items():
        c = agreement.correlate({r["model"]: r["g"] for r in some}, {r["model"]: r["t"] for r in some}, 200)
        if "error" not in c:
            rows.append((task, c["n_models"], *(round(float(x), 6) for x in (c["spearman_rho"], c["spearman_p"], c["kendall_tau"], c["kendall_p"], c["kendall_ap"], *c["spearman_ci95"]))))
    return spark.createDataFrame(rows, "task string, n int, rho double, rho_p double, tau double, tau_p double, tau_ap double, low double, high double")


# ------------------------------------------------------------ streaming


@query
def windowed_outcomes(spark, sf):
    return streaming.windowed_outcomes(_t(spark, sf, "verdicts"))


@query
def stream_win_matrix(spark, sf):
    """The win matrix of a standing state fed by a file stream over the log."""
    table = _t(spark, sf, "verdicts")
    # a pattern, as the source takes a single file only by one
    base = _fresh(spark, "stream")
    s = streaming.VerdictStream(spark, f"{sf}/verdicts.parque[t]", table.schema, f"{base}/state", f"{base}/checkpoint")
    s.run_available()
    return s.wins().select("i", "j", _r("w").alias("w"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three lexical retrievers wins on the queries over the corpus, by the mock judge in both
    orders: rated with a bootstrap over queries."""
    docs = written(_docs(spark, sf), "docs")
    asked = written(_asked(spark, sf).filter("text is not null").select("qid", "text", "pos"), "asked")
    models, tokens = ["bm25", "jaccard", "tfidf"], retrieve.shared_tokens(docs)
    hits = agreement.union_all([retrieve.predict(docs, asked, m, tokens=tokens) for m in models])
    lists = written(retrieve.top_k(hits, asked, docs, spark.createDataFrame([(m,) for m in models], "model string"), 10), "ranked")
    verdicts = judge.judge_all(judge.meetings(lists, judge.model_pairs(spark, models)))
    return rank.leaderboard(rank.rate(verdicts, bootstrap=200))
