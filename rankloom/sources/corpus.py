"""Corpora as tables or local files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import storage
from rankloom.functions.text import title_text
from rankloom.runtime import written


@dataclass
class Corpus:
    """docs(doc_id, text, pos), and, where a task supplies them, queries(qid, text, pos) and
    qrels(qid, doc_id, rel)."""

    name: str
    id: str
    docs: DataFrame
    queries: DataFrame | None = None
    qrels: DataFrame | None = None
    prompt: str | dict | None = None
    ignore_identical_ids: bool = False
    dataset: dict = field(default_factory=dict)

    @property
    def source(self) -> str:
        return "local" if self.id.startswith("local:") else "table"


def last_wins(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key: the last one's values at the first one's position. Null keys are one key. An
    aggregation, so it combines before the shuffle and a key of any size is spread."""
    rest = [c for c in rows.columns if c not in (key, pos)]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_last"), F.min(pos).alias(pos))
    return kept.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest], pos)


def last_texts(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """A13 where rows are wide: the winning places are found first, from keys and places alone, and only the winners'
    other columns are joined, so a text is shuffled once. Places are unique; null keys are one key."""
    ends = rows.groupBy(key).agg(F.max(pos).alias("_last"), F.min(pos).alias("_first"))
    won = rows.join(ends.select("_last", "_first"), rows[pos] == F.col("_last"))
    rest = [c for c in rows.columns if c not in (key, pos)]
    return won.select(key, *rest, F.col("_first").alias(pos))


def table_docs(rows: DataFrame, key: str = "doc_id", title: str | None = "title", text: str = "text", pos: str = "pos") -> DataFrame:
    """(doc_id, text, pos) of a delivered passage table. Passages without a key are left out; a
    passage delivered again keeps its place."""
    shown = title_text(title, text) if title else F.coalesce(F.col(text), F.lit(""))
    return last_texts(rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("doc_id"), shown.alias("text"), F.col(pos).cast("long").alias("pos")), "doc_id")


def load_tables(spark: SparkSession, name: str, corpus: str, queries: str | None = None, qrels: str | None = None, *, revision: str | None = None, subset: str = "default", split: str = "test", prompt=None, ignore_identical_ids: bool = False) -> Corpus:
    """A task whose tables lie at the given paths (parquet)."""
    docs = table_docs(spark.read.parquet(corpus))
    asked = last_wins(numbered_rows(spark.read.parquet(queries).select(F.col("qid").cast("string").alias("qid"), "text")), "qid") if queries else None
    labels = spark.read.parquet(qrels).select("qid", "doc_id", F.col("rel").cast("int").alias("rel")) if qrels else None
    if docs.isEmpty():
        raise ValueError(f"no documents in {corpus}")
    return Corpus(name, f"{corpus}@{revision}/{subset}/{split}", docs, asked, labels, prompt, ignore_identical_ids, {"path": corpus, "revision": revision})


def numbered_rows(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows with their place in the files: the file's path, then the row within it. Comparable within one
    reading only; not consecutive."""
    return rows.withColumn(pos, F.monotonically_increasing_id())


def numbered(rows: DataFrame, at: str, pos: str = "pos") -> DataFrame:
    """`rows` with their place in the order of `at`, a monotonically increasing id of the same partitions, counted from
    0 without gaps: rows are numbered within partitions and shifted by those before, so no task holds all."""
    rows = rows.withColumn("_block", F.shiftright(at, 33))
    sizes = sorted((r["_block"], r["n"]) for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect())  # one row a partition
    shift, before = [], 0
    for block, n in sizes:
        shift.append((block, before))
        before += n
    if not shift:
        return rows.drop("_block").withColumn(pos, F.lit(0).cast("long"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(at)) - 1
    placed = rows.withColumn("_inner", inner).join(F.broadcast(rows.sparkSession.createDataFrame(shift, "_block long, _shift long")), "_block")
    return placed.withColumn(pos, (F.col("_inner") + F.col("_shift")).cast("long")).drop("_block", "_inner", "_shift")


def read_lines(spark: SparkSession, path: str | Path) -> DataFrame:
    """(pos, value): the lines of one file that are not blank, pos counted from 0 over those kept."""
    rows = spark.read.text(str(path)).filter(F.col("value").rlike(r"(?U)\S")).withColumn("at", F.monotonically_increasing_id())
    return numbered(rows, "at").select("pos", "value")


def read_jsonl(spark: SparkSession, path: str | Path) -> DataFrame:
    """(doc_id, text, pos) of a file of objects with id and text. A line that is no object or has no id
    is refused; a null text is empty; a repeated id keeps its first place and its last text."""
    lines = read_lines(spark, path)
    fields = F.from_json("value", "struct<id:string,text:string>")
    rows = lines.select(fields.getField("id").alias("doc_id"), F.coalesce(fields.getField("text"), F.lit("")).alias("text"), "pos")
    bad = rows.filter("doc_id is null").first()
    if bad is not None:
        raise ValueError(f"{path}: line without an id (line {bad['pos'] + 1} of those not blank)")
    return last_wins(rows, "doc_id")


def read_folder(spark: SparkSession, root: str | Path) -> DataFrame:
    """(doc_id, text, pos) of all .txt and .md files below a folder; the id is the path from
    the folder. Bytes that are no UTF-8 are dropped; line ends become one character; files are ordered
    by the parts of their paths, in a distributed sort of the paths alone."""
    base = str(root) if "://" in str(root) else str(Path(root).resolve())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(base)
    plain = F.url_decode(F.regexp_replace(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")), "^file:/*", "/"))
    place = F.regexp_replace(plain, "^" + _quoted(base.rstrip("/")) + "/", "")
    text = F.regexp_replace(F.regexp_replace(_utf8("content"), "\r\n", "\n"), "\r", "\n")
    sorted_ = written(files.select(place.alias("doc_id")).orderBy(F.split("doc_id", "/")).withColumn("at", F.monotonically_increasing_id()), "folder")
    order = numbered(sorted_, "at").select("doc_id", "pos")
    return files.select(place.alias("doc_id"), text.alias("text")).join(order, "doc_id")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


@F.pandas_udf(T.StringType())
def _utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def content_digest(docs: DataFrame) -> str:
    """A hash of all ids and texts in order. Every document is hashed where it lies, together with its place, and
    the hashes are summed up as 64-bit numbers, so neither texts nor hashes pass the driver."""
    told = F.sha2(F.concat_ws("\x1f", F.col("pos").cast("string"), "doc_id", "text"), 256)
    words = [F.conv(F.substring(told, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    r = docs.agg(F.count("*").alias("n"), *[F.sum(w).alias(f"s{k}") for k, w in enumerate(words)]).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()[:12]


def load_local(spark: SparkSession, path: str | Path) -> Corpus:
    """A .jsonl file or a folder; nothing found is refused."""
    p = Path(path)
    docs = read_jsonl(spark, path) if p.suffix == ".jsonl" else read_folder(spark, path) if storage.children(path) else None
    if docs is None or docs.isEmpty():
        raise ValueError(f"no documents found in {path}")
    docs = written(docs, "corpus")
    digest = content_digest(docs)
    return Corpus(p.stem, f"local:{p.stem}@{digest}", docs, dataset={"path": str(p), "revision": digest})


def load(spark: SparkSession, spec: str | Path | Corpus, tasks: dict[str, dict] | None = None) -> Corpus:
    """An existing path, else the name of a task in `tasks` (arguments of load_tables)."""
    if isinstance(spec, Corpus):
        return spec
    if storage.exists(spec):
        return load_local(spark, spec)
    if tasks and str(spec) in tasks:
        return load_tables(spark, str(spec), **tasks[str(spec)])
    raise ValueError(f"{spec} is neither a path nor a known task")
