"""Session settings, lineage cuts and size checks shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Conservative defaults for a fresh session; an existing session keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
}

#: A side is broadcast only when it was counted and found to have at most this many rows.
BROADCAST_ROWS = 200_000


def session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults. `master=None` leaves the cluster's own setting."""
    builder = SparkSession.builder.appName("rankloom")
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers. They inherit PYTHONPATH, and in local mode the working
    folder; where neither has the package, it is sent to them, once a session."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parents[1]
    local = sc.master == "local" or sc.master.startswith("local[")
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) + ([os.getcwd()] if local else [])
    if sc.master.startswith("local") and any(p and Path(p).resolve() == home for p in known):
        return
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="rankloom-")) / "rankloom.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((home / "rankloom").rglob("*.py")):
            z.write(f, f.relative_to(home))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir` of the session. Where it is unset, a
    local session gets a temporary folder; a cluster session is refused."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="rankloom-")
    sc.setCheckpointDir(made)
    return "file://" + made


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        drop_path(spark, path)
    _written.clear()


atexit.register(_remove_written)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system holds it."""
    try:
        jvm, hconf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hconf).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is already gone at interpreter exit
        pass


class Written:
    """A DataFrame cut from its lineage: written to the shared folder and read back."""

    def __init__(self, df: DataFrame, name: str = "table", by: str | None = None):
        """by: a column with few values, a folder for each, so that a filter on it reads only its own."""
        self.spark = df.sparkSession
        self.path = os.path.join(shared_dir(self.spark), "rankloom", f"{name}-{uuid.uuid4().hex}")
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables nothing later reads."""
        drop_path(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back. Survives the loss of executors."""
    return Written(df, name).df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows, found by reading no more than that many."""
    return df.limit(rows + 1).count() <= rows


def release() -> None:
    """Delete every table `written` so far. Only when no DataFrame built on them is read any more; it also
    happens when the interpreter ends."""
    _remove_written()
