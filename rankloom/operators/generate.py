"""Query generation and filtering."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.chat import answered, client_settings
from rankloom.functions import prompts
from rankloom.functions.jsonx import answer_fields
from rankloom.functions.text import mock_answer, quality, query_ok, strip
from rankloom.ident import Key, Layout, client_id, slug
from rankloom.operators.dedup import greedy_keep
from rankloom.operators.sampling import SeedDraw, sample_queries
from rankloom.runtime import written
from rankloom.schemas import QUERIES
from rankloom.sources.corpus import Corpus, content_digest, numbered
from rankloom.sources.queries import own_queries, read_query_set, write_query_set


@dataclass
class Settings:
    """All that decides which queries come out."""

    task_description: str | None = None
    n_queries: int = 100
    seed: int = 0
    filter: bool = True
    docs_per_query: int = 3
    overshoot: float = 1.6
    min_chars: int = 15
    max_chars: int = 240
    min_score: int = 3
    dedup: float = 0.8

    @property
    def target(self) -> int:
        return int(self.n_queries * (self.overshoot if self.filter else 1.0))


def ask(rows: DataFrame, client, system: str, workers: int) -> DataFrame:
    """`rows` with column `user` answered; mock answers are a column, others are written at once."""
    if getattr(client, "model", None) == "mock":
        return rows.withColumn("answer", mock_answer(F.concat(F.lit(system + " "), F.col("user")), getattr(client, "seed", 0)))
    return written(answered(rows.withColumn("system", F.lit(system)).repartition(workers), client).drop("system"), "answers")


def wave_prompts(spark: SparkSession, docs: DataFrame, seeds: list[list[str]], base: int) -> DataFrame:
    """(attempt, seed_doc_ids, user) of one wave; texts are cut before they are joined."""
    plan = spark.createDataFrame([(base + k, ids) for k, ids in enumerate(seeds)], "attempt long, seed_doc_ids array<string>")
    shown = docs.select("doc_id", F.substring("text", 1, prompts.WRITER_CHARS).alias("text"))
    rows = plan.select("attempt", "seed_doc_ids", F.posexplode("seed_doc_ids").alias("at", "doc_id"))
    found = shown.join(F.broadcast(rows), "doc_id").groupBy("attempt").agg(F.first("seed_doc_ids").alias("seed_doc_ids"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"))
    return found.select("attempt", "seed_doc_ids", prompts.writer_user(F.transform("l", lambda x: x["text"])).alias("user"))


def generate(docs: DataFrame, client, s: Settings, workers: int = 8) -> DataFrame:
    """Up to s.target queries. Waves of as many attempts as are missing, three times the target at most;
    every attempt draws fresh documents; answers that are blank (F05) or fail the heuristics (F01) are
    missing again. Accepted in the order of attempts, so the number of workers changes nothing."""
    spark = docs.sparkSession
    draw, system = SeedDraw(docs, s.seed, s.docs_per_query), prompts.writer_system(s.task_description)
    out: list[tuple] = []
    attempts, cap = 0, 3 * s.target
    while len(out) < s.target and attempts < cap:
        n = min(s.target - len(out), cap - attempts)
        asked = wave_prompts(spark, docs, draw.wave(n), attempts)
        said = ask(asked, client, system, workers).select("attempt", "seed_doc_ids", strip(F.try_element_at(answer_fields("answer"), F.lit("query"))).alias("text"))
        for r in said.filter(query_ok("text", s.min_chars, s.max_chars)).orderBy("attempt").collect():  # a wave is at most the target
            out.append((f"q{len(out)}", r["text"], r["seed_doc_ids"], None, len(out)))
        attempts += n
    return spark.createDataFrame(out, QUERIES)


def rated(queries: DataFrame, client, workers: int = 8) -> tuple[DataFrame, int]:
    """Queries with their quality, and how many scores were defaulted to 3."""
    answers = ask(queries.withColumn("user", prompts.rater_user("text")), client, prompts.RATER_SYSTEM, workers)
    got = written(answers.withColumn("_s", F.try_element_at(answer_fields("answer"), F.lit("score"))).withColumn("quality", quality("_s")), "rated")
    known = strip("_s").rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
    missed = got.filter(~F.coalesce(known, F.lit(False))).count()
    return got.select(*queries.columns), missed


def renumbered(queries: DataFrame, n: int | None = None) -> DataFrame:
    """The first n in order, named q0, q1, ... in that order. Query sets are as small as asked for."""
    some = queries.orderBy("pos") if n is None else queries.orderBy("pos").limit(n).coalesce(1)
    sorted_ = written(some.withColumn("_at", F.monotonically_increasing_id()), "renumbered")
    placed = numbered(sorted_.drop("pos"), "_at").drop("_at")
    return placed.withColumn("qid", F.concat(F.lit("q"), F.col("pos").cast("string"))).select(*queries.columns)


def good_quality(queries: DataFrame, least: int = 3) -> DataFrame:
    """a null quality counts as 0."""
    return queries.filter(F.coalesce("quality", F.lit(0)) >= least)


def filtered(queries: DataFrame, client, s: Settings, workers: int = 8) -> tuple[DataFrame, int]:
    """Rating, threshold, near-duplicate removal, limit, new names; without filtering only the limit."""
    if not s.filter:
        return queries.orderBy("pos").limit(s.n_queries), 0
    scored, missed = rated(queries, client, workers)
    return renumbered(greedy_keep(good_quality(scored, s.min_score), s.dedup), s.n_queries), missed


@dataclass
class QuerySet:
    """The queries of a run and how they were obtained. `queries` is none where they are the task's own."""

    id: str
    texts: DataFrame
    queries: DataFrame | None
    arm: str
    n_generated: int | None = None
    generator: dict | None = None
    notes: dict = field(default_factory=dict)


def synthetic_id(corpus: Corpus, client, s: Settings) -> str:
    told = (prompts.writer_system(s.task_description), prompts.WRITER_USER, prompts.WRITER_CHARS, prompts.RATER_SYSTEM, prompts.RATER_USER)
    return f"{slug(corpus.id)}-{slug(client_id(client))}-{Key.of('queries', **asdict(s), told=told).digest()}"


def resolve_queries(corpus: Corpus, cache: str | Path, queries, client, s: Settings, workers: int = 8) -> QuerySet:
    """D04: "synthetic" (generated, or read back from the cache), "original" (the task's own, sampled), or
    your own."""
    spark = corpus.docs.sparkSession
    if isinstance(queries, str) and queries == "synthetic":
        name = synthetic_id(corpus, client, s)
        path = Layout(str(cache)).query_set(corpus.name, name)
        kept = read_query_set(spark, path)
        if kept is None:
            raw = written(generate(corpus.docs, client, s, workers), "generated")
            good, _ = filtered(raw, client, s, workers)
            good = written(good, "query-set")
            if good.isEmpty():
                raise RuntimeError("no query was kept: answers were not readable or the filter rejected all of them")
            write_query_set(path, good, client_settings(client), raw.count())
            kept = read_query_set(spark, path)
        rows, n, settings = kept
        return QuerySet(name, rows.select("qid", "text", "pos"), rows, "synthetic", n, settings or client_settings(client))
    if isinstance(queries, str) and queries == "original":
        if corpus.queries is None or corpus.queries.isEmpty():
            raise ValueError(f"{corpus.name} has no queries of its own")
        texts = written(sample_queries(corpus.queries, s.n_queries, s.seed).select("qid", "text", "pos"), "original")
        return QuerySet(f"{slug(corpus.id)}-original-n{texts.count()}-s{s.seed}", texts, None, "original")
    rows = written(own_queries(spark, queries), "own")
    digest = content_digest(rows.select(F.col("qid").alias("doc_id"), "text", "pos"))
    return QuerySet(f"{slug(corpus.id)}-own-{digest}", rows.select("qid", "text", "pos"), rows, "own")
