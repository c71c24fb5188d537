"""What a publication of records consists of. Sending it anywhere is not
part of the engine."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.ident import Layout
from rankloom.sources.logs import read_record, record_paths


def file_table(spark: SparkSession, paths: dict[str, str | Path]) -> DataFrame:
    """(path, sha): content hashes of files by the name they are compared under."""
    rows = [(name, hashlib.sha256(storage.read_bytes(p)).hexdigest()) for name, p in paths.items()]
    return spark.createDataFrame(rows, "path string, sha string")


def new_files(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Files the other side lacks or has with other bytes."""
    return mine.join(theirs, ["path", "sha"], "left_anti")


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that are wanted but not there."""
    return wanted.join(present, "path", "left_anti")


def branch_name(paths: list[str]) -> str:
    """The name of a submission: a hash of its sorted paths."""
    return "submit-" + hashlib.sha256("".join(sorted(paths)).encode()).hexdigest()[:10]


def present_files(wanted: list[str]) -> list[str]:
    """Those that are there. A verdict log is named with the key of a pair (log#key) and is there if an append has it."""
    keys: dict[str, set[str]] = {}
    out = []
    for f in wanted:
        log, _, key = f.partition("#")
        if key and log not in keys:
            keys[log] = {name[4:] for batch in storage.children(log) if batch.startswith("batch=") for name in storage.children(storage.join(log, batch)) if name.startswith("key=")}
        if key in keys[log] if key else storage.exists(log):
            out.append(f)
    return out


def prepare(spark: SparkSession, results: str | Path, cache: str | Path, clone: str | Path) -> dict:
    """Copies new records into a local clone's results folder and lists the cached files they were computed
    from. Refused when one of them is missing."""
    target, layout = storage.join(clone, "results"), Layout(str(cache))
    place = lambda p: "/".join(str(p).split("/")[-2:])
    mine = {f"{read_record(p)['task_name']}/{str(p).split('/')[-1]}": p for p in record_paths(results)}
    theirs = file_table(spark, {place(p): p for p in record_paths(target)})
    new = sorted(r["path"] for r in new_files(file_table(spark, mine), theirs).collect())  # records, of which there are few
    if not new:
        return {"records": [], "files": []}
    files = sorted({f for k in new for part in layout.of_record(read_record(mine[k])).values() for f in part})
    table = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    lost = missing_files(table(files), table(present_files(files))).orderBy("path").take(3)
    if lost:
        raise FileNotFoundError(f"files the records were computed from are missing: {[r['path'] for r in lost]}")
    for k in new:
        storage.write_text(storage.join(target, k), storage.read_text(mine[k]))
    return {"records": [f"results/{k}" for k in new], "files": files, "clone": storage.tidy(clone), "branch": branch_name([f"results/{k}" for k in new])}


def distinct_files(lists: DataFrame, col: str = "files") -> DataFrame:
    """Every file once, in order."""
    return lists.select(F.explode(col).alias("path")).distinct().orderBy("path")
