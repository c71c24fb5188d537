"""Seeded plans. Drawn on the driver in a fixed order, as the streams of random numbers are
sequential; only ids and counts travel."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import BROADCAST_ROWS, small

#: Ids a plan may hold on the driver.
PLAN_IDS = 5_000_000


def ids(df: DataFrame, key: str, order: str) -> list[str]:
    if not small(df.select(key), PLAN_IDS):
        raise ValueError(f"more than {PLAN_IDS} ids to draw from")
    return [r[0] for r in df.orderBy(order).select(key).collect()]


class SeedDraw:
    """Wave after wave of document samples from one stream. Each attempt draws up to `size` different
    ids from all ids in their order."""

    def __init__(self, docs: DataFrame, seed: int, size: int = 3):
        self.ids, self.rng, self.size = ids(docs, "doc_id", "pos"), random.Random(seed), size

    def wave(self, n: int) -> list[list[str]]:
        k = min(self.size, len(self.ids))
        return [self.rng.sample(self.ids, k) for _ in range(n)]


def sample_queries(queries: DataFrame, n: int, seed: int) -> DataFrame:
    """N of the queries, drawn from their sorted ids; all of them if there are no more. Order stays."""
    known = sorted(ids(queries, "qid", "qid"))
    if len(known) <= n:
        return queries
    chosen = queries.sparkSession.createDataFrame([(q,) for q in random.Random(seed).sample(known, n)], "qid string")
    return queries.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, "qid", "left_semi")


def pair_subset(spark, n_pairs: int, qids: list[str], k: int | None, seed: int) -> DataFrame | None:
    """(qid, pair): k of the pairs for each query, in the queries' order; none where that is all pairs."""
    if k is None or k >= n_pairs:
        return None
    rng = random.Random(seed)
    return spark.createDataFrame([(q, i) for q in qids for i in sorted(rng.sample(range(n_pairs), k))], "qid string, pair int")


def bootstrap_counts(n: int, replicates: int, seed: int) -> np.ndarray:
    """How often each of n units is drawn in each replicate, (replicates, n)."""
    rng = np.random.default_rng(seed)
    out = np.zeros((replicates, n), dtype=np.int32)
    for r in range(replicates):
        out[r] = np.bincount(rng.integers(0, n, n), minlength=n)
    return out


def count_blocks(n: int, replicates: int, seed: int, size: int) -> Iterator[np.ndarray]:
    """The rows of `bootstrap_counts`, `size` at a time, a byte a count."""
    rng = np.random.default_rng(seed)
    for begin in range(0, replicates, size):
        out = np.zeros((min(size, replicates - begin), n), dtype=np.uint8)
        for r in range(len(out)):
            drawn = np.bincount(rng.integers(0, n, n), minlength=n)
            if n and drawn.max() > 255:
                raise OverflowError("a count beyond a byte")
            out[r] = drawn
        yield out
