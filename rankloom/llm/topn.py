"""Problem 3: the N highest-scoring items of every group, with one tie rule.

`row_number` over score and identifier with a filter on the rank: the optimiser adds a group limit
before and after the shuffle, so a group of any size sends at most N rows from each task. Items that
occur more than once are reduced to their highest score first, by an aggregation on group and item,
which spreads a large group over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N = 10


def exploded(lists: DataFrame, group: list[str], items: str = "doc_ids", scores: str = "scores") -> DataFrame:
    """(group..., item, score): one row an entry. Entries with a null item, or a null or NaN score, do not
    count; of lists of different length the entries without a partner do not count."""
    entry = F.explode(F.arrays_zip(F.col(items).alias("item"), F.col(scores).alias("score"))).alias("e")
    rows = lists.select(*group, entry).select(*group, F.col("e.item").alias("item"), F.col("e.score").cast("double").alias("score"))
    # adding zero turns a negative zero into zero, so that the two tie
    return rows.filter(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))


def top_n(rows: DataFrame, group: list[str], n: int = N) -> DataFrame:
    """(group..., rank_no, item, score): up to n distinct items of every group, rank from 1, equal scores
    by the smaller item. Null group values are groups of their own. n below 1 gives no rows."""
    best = rows.groupBy(*group, "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("item"))
    return best.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= n).select(*group, "rank_no", "item", "score")


def top_documents(ranked: DataFrame, n: int = N) -> DataFrame:
    """(model, qid, rank_no, doc_id) of result lists delivered in pieces."""
    top = top_n(exploded(ranked, ["model", "qid"]), ["model", "qid"], n)
    return top.select("model", "qid", "rank_no", F.col("item").alias("doc_id"))
