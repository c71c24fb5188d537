"""Query sets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.schemas import QUERIES
from rankloom.sources.corpus import last_wins, read_lines


def _own(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "text", F.array().cast("array<string>").alias("seed_doc_ids"), F.lit(None).cast("int").alias("quality"), "pos")


def own_queries(spark: SparkSession, spec: str | Path | list | tuple) -> DataFrame:
    """queries(qid, text, seed_doc_ids, quality, pos) of your own: a list of texts, a .jsonl with text and
    perhaps id, or any other file with one query a line. Blank lines are dropped before numbering; a
    line of .jsonl without a text is refused; of a repeated id the last text counts."""
    if isinstance(spec, (list, tuple)):
        rows = [(f"q{i}", str(t), i) for i, t in enumerate(spec)]
        return _own(spark.createDataFrame(rows, "qid string, text string, pos long"))
    path = Path(spec)
    if not storage.exists(spec):
        raise FileNotFoundError(spec)
    lines = read_lines(spark, spec)
    if path.suffix != ".jsonl":
        text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
        return _own(lines.select(F.concat(F.lit("q"), F.col("pos").cast("string")).alias("qid"), text.alias("text"), "pos"))
    f = F.from_json("value", "struct<id:string,text:string>")
    rows = lines.select(F.coalesce(f.getField("id"), F.col("pos").cast("string")).alias("qid"), f.getField("text").alias("text"), "pos")
    if not rows.filter("text is null").isEmpty():
        raise ValueError(f"{path}: a line has no text")
    return _own(last_wins(rows, "qid"))


def write_query_set(path: str | Path, queries: DataFrame, generator: dict | None, n_generated: int | None) -> None:
    """A query set with the settings it was written with. Query sets are as large as asked for, so
    one document."""
    rows = [{"qid": r["qid"], "text": r["text"], "seed_doc_ids": list(r["seed_doc_ids"] or []), "quality": r["quality"]} for r in queries.orderBy("pos").toLocalIterator()]
    storage.write_text(path, json.dumps({"generator": generator, "n_generated": n_generated, "queries": rows}, indent=2))


def read_query_set(spark: SparkSession, path: str | Path) -> tuple[DataFrame, int | None, dict | None] | None:
    """A written query set; none where the file is missing or holds no query (left by a crash)."""
    if not storage.exists(path):
        return None
    data = json.loads(storage.read_text(path))
    if not data["queries"]:
        return None
    rows = [(q["qid"], q["text"], q["seed_doc_ids"], q.get("quality"), i) for i, q in enumerate(data["queries"])]
    return spark.createDataFrame(rows, QUERIES), data.get("n_generated"), data.get("generator")
