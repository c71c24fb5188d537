"""The pipeline: corpus, queries, retrieval, judging in both orders, ratings, record."""

from __future__ import annotations

import os
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.chat import client_settings
from rankloom.functions.prompts import judge_system, resolve_task
from rankloom.ident import Contest, Layout, client_id, config_hash, record_path
from rankloom.operators import judge as judging
from rankloom.operators import metrics, rank, retrieve
from rankloom.operators.generate import QuerySet, Settings, resolve_queries
from rankloom.operators.results import Result, build_record, diagnostics
from rankloom.operators.sampling import ids as sampling_ids
from rankloom.operators.sampling import pair_subset
from rankloom.runtime import ship, written
from rankloom.schemas import HITS
from rankloom.sources import corpus as corpora
from rankloom.sources.logs import append_verdicts, latest, read_verdict_log


def default_cache(spark: SparkSession) -> str:
    """$RANKLOOM_CACHE; else, on one machine, a folder of the user's; a cluster needs a place all executors see."""
    given = os.environ.get("RANKLOOM_CACHE")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, pass cache_folder or set RANKLOOM_CACHE to a folder that all executors share")
    return given or str(Path.home() / ".cache" / "rankloom")


def _versioned(model) -> str:
    return f"{model.name}@{model.revision}"


def predicted(cache: Layout, corpus: corpora.Corpus, qset: QuerySet, model, tokens: DataFrame | None = None) -> str:
    """Hits of one model for one query set, computed unless they were written whole before."""
    path = cache.hits(corpus.name, qset.id, _versioned(model))
    if not storage.complete(path):
        retrieve.predict(corpus.docs, qset.texts, model, tokens=tokens).write.mode("overwrite").parquet(path)
    return path


def _open(spark, corpus, queries, generator, description, n_queries, seed, filter_queries, cache, workers, tasks):
    corp = corpora.load(spark, corpus, tasks)
    task, origin = resolve_task(description, corp.prompt)
    settings = Settings(task_description=task, n_queries=n_queries, seed=seed, filter=filter_queries)
    return corp, task, origin, settings, resolve_queries(corp, cache, queries, generator, settings, workers)


def predict(
    spark: SparkSession, corpus, model, *, generator=None, queries="synthetic", task_description: str | None = None, n_queries: int = 100, seed: int = 0,
    filter_queries: bool = True, cache_folder: str | Path | None = None, batch_size: int = 32, workers: int = 8, tasks: dict | None = None,
) -> str | Path:
    """One model's hits. Generated queries need the generator that a later run will use, as it is part of
    their name."""
    del batch_size  # Arrow sets the batches
    ship(spark)
    if isinstance(queries, str) and queries == "synthetic" and generator is None:
        raise ValueError("predict() needs the generator that run() will use, as generated queries are named by it; or pass queries=")
    cache = str(cache_folder) if cache_folder is not None else default_cache(spark)
    corp, _, _, _, qset = _open(spark, corpus, queries, generator, task_description, n_queries, seed, filter_queries, cache, workers, tasks)
    return storage.tidy(predicted(Layout(cache), corp, qset, retrieve.resolve(model)))


def judged_once(spark: SparkSession, log: str, met: DataFrame, keys: DataFrame, client, options: dict, stamp: dict) -> DataFrame:
    """Verdicts of all requested meetings: those in the log under their pair's key, and new ones for the rest, which
    are appended to it wave by wave. keys(pair, key). One log for all pairs, read in one scan; nothing is judged twice, and
    of several lines for a key and query the newest counts."""
    place = met.select("pair", "qid", "pos")
    logged = None
    if storage.children(log):
        known = read_verdict_log(spark, log).join(F.broadcast(keys), "key")  # a key a pair of the roster
        logged = written(latest(known, "pair", "qid").drop("line_no", "key"), "verdict-log")
        met = met.join(logged.select("pair", "qid"), ["pair", "qid"], "left_anti")
    todo = written(met, "todo")
    keep = lambda new: append_verdicts(new.join(F.broadcast(keys), "pair"), log)
    if todo.isEmpty():
        return logged.join(place, ["pair", "qid"])
    new = judging.judge_all(todo, client, on_verdicts=keep, **options, **stamp).drop("pos")
    every = new if logged is None else logged.unionByName(new)
    return every.join(place, ["pair", "qid"])


def run(
    spark: SparkSession, corpus, models: list, judge, generator=None, *, queries="synthetic", task_description: str | None = None, n_queries: int = 100,
    top_k: int = 10, doc_chars: int = 2000, pairs_per_query: int | None = None, seed: int = 0, filter_queries: bool = True, output_folder: str | Path = "results",
    cache_folder: str | Path | None = None, batch_size: int = 32, workers: int = 8, tasks: dict | None = None, bootstrap: int = rank.REPLICATES,
) -> Result:
    """Rank `models` on `corpus` with a judge; every stage that was written before is read back.

    corpus: a folder of .txt and .md files, a .jsonl, a task name of `tasks`, or a Corpus. models: retrievers (lexical,
    over vectors, imported prediction files) or what names them, as `retrieve.resolve`. queries: "synthetic", "original", a file, or a list of texts."""
    del batch_size
    ship(spark)
    started, roster_ = time.time(), [retrieve.resolve(m) for m in models]
    models = [m.name for m in roster_]
    if not models:
        raise ValueError("no models given")
    if len(set(models)) < len(models):
        raise ValueError("two models have one name")
    cache = str(cache_folder) if cache_folder is not None else default_cache(spark)
    layout = Layout(cache)
    writer = generator if generator is not None else judge
    corp, task, origin, settings, qset = _open(spark, corpus, queries, writer, task_description, n_queries, seed, filter_queries, cache, workers, tasks)
    revisions = {m.name: m.revision for m in roster_}

    corp.docs = written(corp.docs, "docs")
    lexical = [m for m in roster_ if isinstance(m, retrieve.Lexical) and not storage.complete(layout.hits(corp.name, qset.id, _versioned(m)))]
    tokens = retrieve.shared_tokens(corp.docs) if lexical else None
    paths = [predicted(layout, corp, qset, m, tokens) for m in roster_]
    hits = spark.read.schema(HITS).parquet(*paths)
    if corp.ignore_identical_ids:
        hits = hits.filter("doc_id <> qid")
    labels = metrics.labels_for(qset.queries, corp.qrels)
    ndcg = {r["model"]: r["ndcg"] for r in metrics.ndcg(hits, labels).collect()} if labels is not None else {}
    roster = spark.createDataFrame([(m,) for m in models], "model string")
    ranked = written(retrieve.top_k(hits, qset.texts, corp.docs, roster, top_k), "ranked")

    pairs = judging.model_pairs(spark, models)
    listed = [(r["pair"], r["model_a"], r["model_b"]) for r in pairs.orderBy("pair").collect()]
    qids = sampling_ids(qset.texts, "qid", "pos") if pairs_per_query is not None else []
    chosen = pair_subset(spark, len(listed), qids, pairs_per_query, seed)
    met = written(judging.meetings(ranked, pairs, chosen), "meetings")
    told, judge_name = judge_system(task), client_id(judge)
    contest, full = Contest(judge_name, told, top_k, doc_chars, qset.id), {m.name: _versioned(m) for m in roster_}
    keys = spark.createDataFrame([(i, contest.key(full[a], full[b])) for i, a, b in listed], "pair int, key string")
    options = {"instruction": task, "doc_chars": doc_chars, "workers": workers}
    stamp = {"task": corp.name, "judge": judge_name, "query_set": qset.id}
    verdicts = written(judged_once(spark, layout.verdicts(corp.name), met, keys, judge, options, stamp), "verdicts")

    ratings = [r.asDict() for r in rank.leaderboard(rank.rate(verdicts, bootstrap, seed)).collect()]  # one row a model
    experiment = {
        "corpus_id": corp.id, "query_set": qset.id, "arm": qset.arm, "judge_model": judge_name, "generator_model": client_id(writer) if qset.arm == "synthetic" else None,
        "task_description": task, "task_description_source": origin, "judge_system": told, "n_queries_generated": qset.n_generated, "n_queries": qset.texts.count(),
        "top_k": top_k, "doc_chars": doc_chars, "pairs_per_query": pairs_per_query, "seed": seed,
        **({f"gen_{k}": v for k, v in asdict(settings).items()} if qset.arm == "synthetic" else {}), "models": models, "model_revisions": revisions,
    }
    experiment["config_hash"] = config_hash(experiment)
    path = record_path(output_folder, corp.name, experiment)
    if storage.exists(path):  # K05: the same run was recorded; its record stands, with what was added to it
        return Result.from_disk(path)
    figures = diagnostics(verdicts).first().asDict()
    llms = {"judge": client_settings(judge), "generator": qset.generator}
    source = "dataset" if qset.arm == "original" else "seed_documents" if labels is not None else None
    result = Result(build_record(corp, experiment, ratings, figures, time.time() - started, revisions, llms, ndcg, source), path)
    result.to_disk()
    return result
