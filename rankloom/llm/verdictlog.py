"""Reading verdict lines: names, answers and which line counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(col: Column | str) -> Column:
    """A name without the blanks around it."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", "")


def answer(col: Column) -> Column:
    """`A`, `B` or `tie` as an answer was meant; null where it is unreadable. Blanks, full stops at the
    end, letter case and a leading "system" do not matter."""
    said = F.lower(F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), r"\.+$", ""))
    said = F.trim(F.regexp_replace(said, r"^system ", ""))
    return F.when(said == "a", "A").when(said == "b", "B").when(said == "tie", "tie")


def outcome(col: Column) -> Column:
    """A win of the first list 1, a tie 0.5, a loss 0; null where unreadable."""
    said = answer(col)
    return F.when(said == "A", 1.0).when(said == "tie", 0.5).when(said == "B", 0.0)


def readable(parsed_ok: Column | str) -> Column:
    """Whether no order failed to parse. An empty or null list has no failure; a null entry is one."""
    c = F.col(parsed_ok) if isinstance(parsed_ok, str) else parsed_ok
    return F.coalesce(F.forall(c, lambda x: F.coalesce(x, F.lit(False))), F.lit(True))


def comparisons(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., lo, hi, score, ok): the last line of every unordered pair of names within `keys`; score
    is that of lo, the smaller name. Lines with a null name or one name on both sides are no
    comparison; null keys are a value of their own; of lines with one number the greater score counts.
    """
    a, b = bare("model_a"), bare("model_b")
    rows = log.select(*keys, "line_no", a.alias("a"), b.alias("b"), F.col("score_a").alias("s"), readable("parsed_ok").alias("ok")).filter("a <> b")
    turned = rows.select(
        *keys,
        F.least("a", "b").alias("lo"),
        F.greatest("a", "b").alias("hi"),
        F.struct("line_no", F.when(F.col("a") < F.col("b"), F.col("s")).otherwise(1 - F.col("s")).alias("score"), "ok").alias("line"),
    )
    last = turned.groupBy(*keys, "lo", "hi").agg(F.max("line").alias("line"))
    return last.select(*keys, "lo", "hi", "line.score", "line.ok")
