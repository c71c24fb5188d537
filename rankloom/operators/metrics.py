"""Labels and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.retrieve import ranked_hits


def seed_labels(queries: DataFrame) -> DataFrame:
    """qrels(qid, doc_id, rel) of the documents each query was written from; queries without seeds
    have none."""
    return queries.filter(F.size("seed_doc_ids") > 0).select("qid", F.explode("seed_doc_ids").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("rel", F.lit(1))


def labels_for(queries: DataFrame | None, qrels: DataFrame | None) -> DataFrame | None:
    """The task's own labels for its own queries, else the seeds; none where there is nothing."""
    found = qrels if queries is None else seed_labels(queries)
    return None if found is None or found.isEmpty() else found


def ndcg(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(model, ndcg): the mean over labelled queries of sum(rel / log2(rank + 1)) over the first k, over
    that of the ideal order. A labelled query without hits counts as 0; equal scores by document."""
    best = ranked_hits(hits, k, ("model", "qid"))
    got = best.join(qrels, ["qid", "doc_id"]).groupBy("model", "qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = ranked_hits(qrels.withColumn("score", F.col("rel")), k).groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("best")).filter("best > 0")
    every = ideal.join(F.broadcast(hits.select("model").distinct()))
    return every.join(got, ["model", "qid"], "left").groupBy("model").agg(F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("best")).alias("ndcg"))


def precision(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(model, precision): the mean share of relevant documents among the first k, over labelled queries."""
    best = ranked_hits(hits, k, ("model", "qid"))
    got = best.join(qrels.filter("rel > 0"), ["qid", "doc_id"]).groupBy("model", "qid").agg((F.count("*") / k).alias("p"))
    every = qrels.filter("rel > 0").select("qid").distinct().join(F.broadcast(hits.select("model").distinct()))
    return every.join(got, ["model", "qid"], "left").groupBy("model").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"))
