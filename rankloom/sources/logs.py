"""Prediction files, verdict logs, records and official scores."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.schemas import VERDICT_REQUIRED, VERDICTS


def prediction_hits(spark: SparkSession, path: str, model: str, ignore_identical_ids: bool = False) -> DataFrame:
    """hits(model, qid, doc_id, score, pos) of a prediction file {"default":{"test":{qid:{doc:score}}}};
    pos is the place in the query's object. F03: a query that is itself a document is dropped from its
    own hits where asked."""
    text = spark.read.text(path, wholetext=True)
    tree = F.from_json("value", "struct<`default`:struct<test:map<string,map<string,double>>>>").getField("default").getField("test")
    per = text.select(F.explode(F.map_entries(tree)).alias("e")).select(F.col("e.key").alias("qid"), F.posexplode(F.map_entries("e.value")).alias("pos", "h"))
    rows = per.select(F.lit(model).alias("model"), "qid", F.col("h.key").alias("doc_id"), F.col("h.value").alias("score"), F.col("pos").cast("long").alias("pos"))
    return drop_self(rows) if ignore_identical_ids else rows


def drop_self(hits: DataFrame) -> DataFrame:
    """F03."""
    return hits.filter(F.col("doc_id") != F.col("qid"))


def list_hits(lists: DataFrame) -> DataFrame:
    """hits of result lists delivered as arrays: entries without a document or with a null or NaN score do
    not count; a document counts once a list set, with its highest score at its first place."""
    rows = lists.select("model", "qid", F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("pos", "e"))
    rows = rows.select("model", "qid", F.col("e.doc_ids").alias("doc_id"), F.col("e.scores").alias("score"), "pos")
    rows = rows.filter("doc_id is not null and score is not null and not isnan(score)")
    return rows.groupBy("model", "qid", "doc_id").agg(F.max("score").alias("score"), F.min("pos").cast("long").alias("pos"))


def verdict_lines(lines: DataFrame) -> DataFrame:
    """Verdicts and their line_no from lines(value, line_no). A line that is no object, lacks one
    of the five required fields or has an unknown one is skipped; missing fields get their defaults."""
    read = lines.withColumn("v", F.from_json("value", VERDICTS)).withColumn("keys", F.expr("json_object_keys(value)"))
    known = F.array(*map(F.lit, VERDICTS.fieldNames()))
    needed = F.array(*map(F.lit, VERDICT_REQUIRED))
    good = read.filter(F.col("keys").isNotNull() & (F.size(F.array_except("keys", known)) == 0) & (F.size(F.array_except(needed, F.col("keys"))) == 0))
    default = {"raw": F.array().cast("array<string>"), "reasoning": F.lit(""), "parsed_ok": F.array().cast("array<boolean>"), "task": F.lit(""), "judge": F.lit(""), "query_set": F.lit("")}
    cols = [F.coalesce(F.col(f"v.{c}"), default[c]).alias(c) if c in default else F.col(f"v.{c}").alias(c) for c in VERDICTS.fieldNames()]
    return good.select(*cols, *[c for c in lines.columns if c != "value"])


def read_verdict_log(spark: SparkSession, path: str) -> DataFrame:
    """All verdict lines of a file or folder with `line_no`, which orders them as they were written: by append
    (K03), for files without one by the time they were written, then by place. A column `key` says the pair of a
    log written by `append_verdicts`. A file without a final line end is read like any other."""
    lines = spark.read.text(path)
    here = lambda c: F.col(f"_metadata.{c}")
    parts = set(lines.columns)
    batch = F.col("batch").cast("long") if "batch" in parts else F.lit(0).cast("long")
    place = F.struct(batch.alias("batch"), here("file_modification_time").alias("written"), here("file_path").alias("file"), here("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    key = F.col("key").cast("string") if "key" in parts else F.lit(None).cast("string")
    return verdict_lines(lines.select("value", place.alias("line_no"), key.alias("key")))


def latest(verdicts: DataFrame, *keys: str, by: str = "line_no") -> DataFrame:
    """A13 for a log: of every key the row with the highest `by`. Aggregated before the shuffle; of rows with
    one number an arbitrary but single row stays."""
    rest = [c for c in verdicts.columns if c not in keys]
    kept = verdicts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def next_batch(path: str) -> int:
    """The number of a log's next append."""
    return 1 + max((int(name[6:]) for name in storage.children(path) if name.startswith("batch=") and name[6:].isdigit()), default=0)


def append_verdicts(verdicts: DataFrame, path: str, batch: int | None = None) -> int:
    """New verdicts as a further append to the log, one folder for all pairs: batch=<n>/key=<pair>. A column `key`
    tells the pair. An append is a set of whole files, so a crash leaves no half line; its number says that it
    is newer than those before. Returns the number. One writer at a time."""
    n = next_batch(path) if batch is None else batch
    keyed = verdicts if "key" in verdicts.columns else verdicts.withColumn("key", F.lit("all"))
    rows = keyed.select(*VERDICTS.fieldNames(), F.lit(n).alias("batch"), "key")
    rows.write.mode("append").partitionBy("batch", "key").json(path, ignoreNullFields=False)
    return n


def record_paths(root: str | Path) -> list[str | Path]:
    """Record files below a folder, in order: those in a folder `records`, or in a folder named
    as the file up to its first double underscore."""

    def kept(f: str) -> bool:
        *folders, name = f.split("/")
        return bool(folders) and folders[-1] in ("records", name.partition("__")[0])

    return [storage.tidy(storage.join(root, f)) for f in storage.files(root, ".json") if kept(f)]


def read_record(path: str | Path) -> dict:
    """S13."""
    return json.loads(storage.read_text(path))


def write_record(record: dict, path: str | Path) -> str | Path:
    """K04."""
    storage.write_text(path, json.dumps(record, indent=2))
    return storage.tidy(path)


def pick_official(scores: DataFrame, pinned: DataFrame) -> DataFrame:
    """One score a model and task: that of the pinned revision, else the one filed as "external", else
    the greatest revision. scores(model, task, revision, score), pinned(model, revision)."""
    p = pinned.select("model", F.col("revision").alias("pin"))
    rank = F.when(F.col("revision") == F.col("pin"), 0).when(F.col("revision") == "external", 1).otherwise(2)
    order = Window.partitionBy("model", "task").orderBy(rank, F.col("revision").desc_nulls_last(), F.col("score").desc())
    best = scores.join(p, "model", "left").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return best.select("model", "task", "revision", "score")


def truth_for(models: DataFrame, official: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """([task,] model, score, revision, official) of requested models([task,] model, revision): the official
    score times 100, rounded to 2; without one the own score(model, score), as `own` has it (the result of
    evaluating what is missing), else the model is left out. With a task, official scores are those of the task."""
    keys = [c for c in ("task", "model") if c in models.columns]
    base = models.select(*keys, F.col("revision").alias("pinned")).join(official.select(*keys, F.col("score").alias("o"), F.col("revision").alias("r")), keys, "left")
    if own is None:
        own = official.sparkSession.createDataFrame([], "model string, score double")
    joined = base.join(own.select("model", F.col("score").alias("w")), "model", "left")
    have = F.coalesce("o", "w")
    return joined.filter(have.isNotNull()).select(*keys, F.round(have * 100, 2).alias("score"), F.when(F.col("o").isNotNull(), F.col("r")).otherwise(F.col("pinned")).alias("revision"), F.col("o").isNotNull().alias("official"))
