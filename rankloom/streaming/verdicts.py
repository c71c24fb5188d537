"""Standing ratings over a growing verdict log, with Structured Streaming.

A file source reads new parts of the log. Each micro-batch is reduced to one row a query, pair and key
and merged into a written state by the highest line number, so repeated and late lines change nothing
they should not; win matrix and diagnostics are computed from the state on demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.rank import usable, win_matrix
from rankloom.runtime import drop_path
from rankloom.sources.logs import latest
from rankloom.storage import children, complete

KEY = ("query_set", "qid", "judge", "model_a", "model_b")


class VerdictStream:
    """Keeps the last verdict of every comparison of a log folder under `state`. Versions of the state are whole
    folders named by batch, so a batch that is run again after a failure gives the same version."""

    def __init__(self, spark: SparkSession, log: str, schema: T.StructType, state: str, checkpoint: str, fmt: str = "parquet"):
        self.spark, self.state, self.checkpoint = spark, state.rstrip("/"), checkpoint
        self.source = spark.readStream.schema(schema).format(fmt).load(log)

    def _path(self, batch: int) -> str:
        return f"{self.state}/batch={batch}"

    def _read(self, path: str) -> DataFrame | None:
        return self.spark.read.parquet(path) if complete(path) else None

    def _merge(self, rows: DataFrame, batch: int) -> None:
        new = latest(rows, *KEY)
        old = self._read(self._path(batch - 1)) if batch else None
        both = new if old is None else latest(old.unionByName(new), *KEY)
        both.write.mode("overwrite").parquet(self._path(batch))
        if batch >= 2:
            drop_path(self.spark, self._path(batch - 2))

    def _newest(self) -> int | None:
        """The last version that was written whole; found on disk, so it is known after a restart as well."""
        made = sorted((int(n[6:]) for n in children(self.state) if n.startswith("batch=")), reverse=True)
        return next((n for n in made if complete(self._path(n))), None)

    def run_available(self) -> None:
        """Reads everything that is there and stops."""
        q = self.source.writeStream.foreachBatch(self._merge).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    def current(self) -> DataFrame:
        """The last verdict of every comparison."""
        newest = self._newest()
        if newest is None:
            raise ValueError("nothing was read yet")
        return self.spark.read.parquet(self._path(newest))

    def wins(self) -> DataFrame:
        """A01 over the current state."""
        return win_matrix(usable(self.current()))


def windowed_outcomes(verdicts: DataFrame, late: str = "3 days", width: str = "1 day") -> DataFrame:
    """Counts of verdicts, ties and unreadable ones by judge and day of judging, for a stream or a table; lines
    later than `late` behind the newest are left out of a stream's closed windows."""
    rows = verdicts.withWatermark("judged_at", late) if verdicts.isStreaming else verdicts
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(F.window("judged_at", width), "judge").agg(F.count("*").alias("n"), one(F.col("score_a") == 0.5).alias("ties"), one(F.exists("parsed_ok", lambda ok: ~ok)).alias("failed"))
    return out.select(F.col("window.start").alias("day"), "judge", "n", "ties", "failed")
