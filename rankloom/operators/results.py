"""Diagnostics, records and collections of records."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import __version__
from rankloom.ident import git_revision, package_version
from rankloom.operators.agreement import record_agreement
from rankloom.operators.rank import format_leaderboard
from rankloom.sources.logs import read_record, record_paths, write_record
from rankloom.storage import tidy


def diagnostics(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Seven figures of a verdict log, perhaps by group. Identical and failed comparisons with score 0.5
    count as ties; a rate over nothing is null."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    is_ = lambda *said: F.aggregate("raw", F.lit(0), lambda n, w: n + F.when(w.isin(*said), 1).otherwise(0))
    failed = F.aggregate("parsed_ok", F.lit(0), lambda n, ok: n + F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1))
    total = verdicts.groupBy(*(by or [])).agg(
        F.sum(F.greatest(F.size("parsed_ok"), F.lit(0))).alias("_asks"),
        F.count("*").alias("_n"),
        one(F.col("score_a") == 0.5).alias("_ties"),
        F.sum(is_("A")).alias("_first"),
        F.sum(is_("A", "B")).alias("_decisive"),
        F.sum(failed).alias("_failed"),
        one(F.col("raw") == F.array(F.lit("identical"))).alias("_same"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return total.select(
        *(by or []), zero(F.col("_asks")).alias("judge_calls"), F.col("_n").alias("n_comparisons"), F.try_divide(F.col("_n") - F.col("_ties"), F.col("_n")).alias("commit_rate"),
        rate("_ties", "_n").alias("tie_rate"), rate("_first", "_decisive").alias("a_first_rate"), rate("_failed", "_asks").alias("parse_failure_rate"), rate("_same", "_n").alias("identical_retrieval_rate"),
    )


def build_record(corpus, experiment: dict, ratings: list[dict], figures: dict, seconds: float, revisions: dict, llms: dict | None = None, ndcg: dict | None = None, labels: str | None = None) -> dict:
    """One run as a document. ratings: rows of rate() in leaderboard order."""
    keep = ("rating", "ci_low", "ci_high", "wins", "losses", "ties", "n")
    rows = [{"model": r["name"], "revision": revisions.get(r["name"])} | {k: r[k] for k in keep} | {"ndcg_at_10": (ndcg or {}).get(r["name"])} for r in ratings]
    return {
        "task_name": corpus.name, "source": corpus.source, "corpus_id": corpus.id,
        "dataset": {k: corpus.dataset.get(k) for k in ("path", "revision")},
        "engine_version": package_version("rankloom") or __version__, "engine_revision": git_revision(), "spark_version": package_version("pyspark"),
        "evaluation_time": float(seconds), "config": experiment, "llms": llms, "labels": labels, "diagnostics": figures, "ratings": rows,
    }


@dataclass
class Result:
    """One record and where it is kept."""

    record: dict
    path: str | Path | None = None

    @classmethod
    def from_disk(cls, path: str | Path) -> Result:
        return cls(read_record(path), tidy(path))

    def to_disk(self, path: str | Path | None = None) -> str | Path:
        self.path = write_record(self.record, path or self.path)
        return self.path

    @property
    def leaderboard(self) -> str:
        return format_leaderboard(self.record["ratings"])

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """A row a model, headed by task, judge, generator, arm and number of queries."""
        return ratings_frame(spark, [self.record])

    def agreement(self, truth: dict[str, float] | None = None, source: dict | None = None, *, bootstrap: int = 1000, seed: int = 0) -> dict:
        """Written into the record, and to its file if it has one."""
        self.record["agreement"] = record_agreement(self.record, truth, source, bootstrap, seed)
        if self.path:
            self.to_disk()
        return self.record["agreement"]


_ROW = (
    "task string, judge string, generator string, arm string, n_queries long, model string, revision string, rating double, "
    "ci_low double, ci_high double, wins double, losses double, ties double, n long, ndcg_at_10 double"
)


def ratings_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """K06, K07 of records already read."""
    rows = []
    for rec in records:
        c = rec["config"]
        for r in rec["ratings"]:
            rows.append((rec["task_name"], c["judge_model"], c.get("generator_model"), c["arm"], c["n_queries"], r["model"], r.get("revision"), *(r[k] for k in ("rating", "ci_low", "ci_high", "wins", "losses", "ties", "n")), r.get("ndcg_at_10")))
    return spark.createDataFrame(rows, _ROW)


def records_frame(spark: SparkSession, root: str | Path) -> DataFrame:
    """The ratings of all record files below a folder, read by Spark: one row a file and model."""
    paths = [str(p) for p in record_paths(root)]
    if not paths:
        raise ValueError(f"no records in {root}")
    return explode_records(spark.read.schema(_RECORD).option("multiLine", True).json(paths))


_RECORD = (
    "task_name string, config struct<judge_model:string,generator_model:string,arm:string,n_queries:bigint>, ratings array<struct<model:string,revision:string,"
    "rating:double,ci_low:double,ci_high:double,wins:double,losses:double,ties:double,n:bigint,ndcg_at_10:double>>"
)


def explode_records(records: DataFrame) -> DataFrame:
    """Records with nested config and ratings to flat rows."""
    head = {"task": "task_name", "judge": "config.judge_model", "generator": "config.generator_model", "arm": "config.arm", "n_queries": "config.n_queries"}
    return records.select(*[F.col(v).alias(k) for k, v in head.items()], F.explode("ratings").alias("r")).select(*head, "r.*")


@dataclass
class Results:
    """All records below a folder."""

    results: list[Result]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        if not self.results:
            raise ValueError("no records")
        return ratings_frame(spark, [r.record for r in self.results])

    def agreement(self, truths: dict[str, dict[str, float]] | None = None, **options) -> dict[str, dict]:
        """A20 for every record; truths by task."""
        return {str(r.path): r.agreement((truths or {}).get(r.record["task_name"]), **options) for r in self.results}


def load_results(root: str | Path) -> Results:
    """S14."""
    return Results([Result.from_disk(p) for p in record_paths(root)])
