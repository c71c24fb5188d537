"""Ratings from verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import elo
from rankloom.operators.sampling import count_blocks
from rankloom.runtime import Written, small, written

BASE, SCALE, REPLICATES = 1000.0, 400.0, 1000
SWEEPS, TOLERANCE, SMOOTHING = 200, 1e-9, 0.1
#: Models a dense fit may have; its matrix has this number squared.
MODELS = 2000
#: Bytes of replicate counts that are sent to the tasks at once.
COUNT_BYTES = 64_000_000


def usable(verdicts: DataFrame) -> DataFrame:
    """without comparisons of which an order failed to parse. An empty list has no failure."""
    return verdicts.filter(F.coalesce(F.forall("parsed_ok", lambda ok: F.coalesce(ok, F.lit(False))), F.lit(True)) & F.col("score_a").isNotNull())


def win_matrix(verdicts: DataFrame) -> DataFrame:
    """wins(i, j, w): the fraction of comparisons i won over j, summed, in both directions. A row
    for every ordered pair that met."""
    there = verdicts.select(F.col("model_a").alias("i"), F.col("model_b").alias("j"), F.col("score_a").alias("w"))
    back = verdicts.select(F.col("model_b").alias("i"), F.col("model_a").alias("j"), (1 - F.col("score_a")).alias("w"))
    return there.unionByName(back).groupBy("i", "j").agg(F.sum("w").alias("w"))


def model_names(verdicts: DataFrame) -> DataFrame:
    """A10: distinct names of both sides."""
    return verdicts.select(F.col("model_a").alias("model")).unionByName(verdicts.select(F.col("model_b").alias("model"))).distinct()


def win_loss_tie(verdicts: DataFrame) -> DataFrame:
    """(model, wins, losses, ties, n)."""
    sides = verdicts.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("score_a").alias("s")), F.struct(F.col("model_b").alias("model"), (1 - F.col("score_a")).alias("s")))).alias("x"))
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    s = F.col("x.s")
    return sides.groupBy(F.col("x.model").alias("model")).agg(one(s > 0.5).alias("wins"), one(s < 0.5).alias("losses"), one(s == 0.5).alias("ties"), F.count("*").cast("int").alias("n"))


def fit(wins: np.ndarray, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, smoothing: float = SMOOTHING) -> np.ndarray:
    """Bradley-Terry strengths of a stack of win matrices (r, n, n), by minorisation-maximisation.

    A sweep updates the strengths one after the other, in the order of the matrix, each from those
    already updated; then they are scaled to a geometric mean of 1. A matrix is done when no strength
    moved by the tolerance, or after the last sweep. All matrices of the stack are swept together."""
    r, n, _ = wins.shape
    full = wins + smoothing * (1.0 - np.eye(n))
    won, met = full.sum(2), full + full.transpose(0, 2, 1)
    met[:, np.arange(n), np.arange(n)] = 0.0
    strength, live = np.ones((r, n)), np.arange(r)
    for _ in range(sweeps):
        p, w, g = strength[live], won[live], met[live]
        start = p.copy()
        for i in range(n):
            load = (g[:, i, :] / (p[:, i : i + 1] + p)).sum(1)
            p[:, i] = np.where(load > 0, w[:, i] / np.where(load > 0, load, 1.0), p[:, i])
        p /= np.exp(np.log(np.clip(p, 1e-12, None)).mean(1, keepdims=True))
        strength[live] = p
        live = live[np.abs(p - start).max(1) >= tolerance]
        if not len(live):
            break
    return strength


def on_elo(strength: np.ndarray) -> np.ndarray:
    """P23."""
    x = SCALE * np.log10(np.clip(strength, 1e-12, None))
    return x - x.mean(-1, keepdims=True) + BASE


def _names(verdicts: DataFrame) -> list[str]:
    names = sorted(r[0] for r in model_names(verdicts).limit(MODELS + 1).collect())
    if len(names) > MODELS:
        raise ValueError(f"more than {MODELS} models for a dense fit")
    return names


def point_ratings(verdicts: DataFrame) -> DataFrame:
    """(model, rating) of all verdicts given; the n by n matrix is fitted on the driver."""
    names = _names(verdicts)
    spark = verdicts.sparkSession
    if not names:
        return spark.createDataFrame([], "model string, rating double")
    at = {m: k for k, m in enumerate(names)}
    w = np.zeros((1, len(names), len(names)))
    for i, j, x in win_matrix(verdicts).collect():
        w[0, at[i], at[j]] = x
    rating = on_elo(fit(w))[0]
    return spark.createDataFrame([(m, float(x)) for m, x in zip(names, rating)], "model string, rating double")


def _partial(names: list[str], replicates: int, counts, seed: int):
    """mapInPandas step: this task's verdicts to one flat win matrix a replicate."""
    n = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {m: k for k, m in enumerate(names)}
        total = np.zeros((replicates, n * n))
        drawn = counts.value if counts is not None else None
        any_ = False
        for pdf in batches:
            if not len(pdf):
                continue
            any_ = True
            a, b, s = pdf["model_a"].map(at).to_numpy(), pdf["model_b"].map(at).to_numpy(), pdf["score_a"].to_numpy()
            unit, back = np.unique(pdf["unit"].to_numpy(), return_inverse=True)
            for c in range(0, len(unit), 512):
                some = (back >= c) & (back < c + 512)
                cell = np.zeros((min(512, len(unit) - c), n * n))
                np.add.at(cell, (back[some] - c, a[some] * n + b[some]), s[some])
                np.add.at(cell, (back[some] - c, b[some] * n + a[some]), 1 - s[some])
                if drawn is not None:
                    times = drawn[:, unit[c : c + 512]].astype(np.float64)
                else:
                    own = lambda u: np.random.Generator(np.random.Philox(key=[seed, int(u) & (2**63 - 1)]))
                    times = np.stack([own(u).poisson(1.0, replicates) for u in unit[c : c + 512]], 1)
                total += times @ cell
        if any_:
            yield pd.DataFrame({"rep": np.arange(replicates), "cells": list(total)})

    return run


def _fitted(names: list[str]):
    """mapInPandas step over flat matrices partitioned by replicate: summed as they come, then fitted together."""
    n = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, np.ndarray] = {}
        for pdf in batches:
            for rep, cells in zip(pdf["rep"], pdf["cells"]):
                have[rep] = have[rep] + cells if rep in have else np.array(cells)
        if have:
            rating = on_elo(fit(np.stack(list(have.values())).reshape(-1, n, n)))
            yield pd.DataFrame({"rep": np.repeat(list(have), n), "model": names * len(have), "rating": rating.ravel()})

    return run


def _numbered(order: DataFrame) -> tuple[DataFrame, int]:
    """order(qid, first) to (q, unit) and their number: unit is the place by first appearance. Ids stay off the driver."""
    placed = written(order.orderBy("first", "qid").select(F.col("qid").alias("q"), F.monotonically_increasing_id().alias("m")), "units")
    part = F.shiftright("m", 33)
    begin, n = [], 0
    for p, held in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*")).collect()):  # one row a partition
        begin.append((p, n))
        n += held
    starts = order.sparkSession.createDataFrame(begin, "p long, start long")
    units = placed.join(F.broadcast(starts), part == F.col("p")).select("q", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("unit"))
    return units, n


def bootstrap_ratings(verdicts: DataFrame, replicates: int = REPLICATES, seed: int = 0, pos: str = "pos", exact: int | None = None, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """(rep, model, rating) over resampled queries: a query's verdicts are drawn together.

    At every size the draws are one seeded stream over the queries in order of appearance, made replicate by
    replicate and sent to the tasks in blocks of replicates of about `count_bytes`. Only if `exact` is given and
    there are more queries, every query draws its own number of uses from a Poisson distribution seeded by
    its id. Each task sums its verdicts to one matrix a replicate before anything is shuffled."""
    spark = verdicts.sparkSession
    names = _names(verdicts)
    order = verdicts.groupBy("qid").agg(F.min(pos).alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "rep int, model string, rating double"

    def fitted(rows: DataFrame, counts, n: int) -> DataFrame:
        partial = rows.mapInPandas(_partial(names, n, counts, seed), "rep int, cells array<double>")
        return partial.repartition(parts, "rep").mapInPandas(_fitted(names), shape)

    if exact is not None and order.limit(exact + 1).count() > exact:
        return fitted(verdicts.select(F.xxhash64("qid").alias("unit"), "model_a", "model_b", "score_a"), None, replicates)
    units, n = _numbered(order)
    rows = verdicts.join(F.broadcast(units) if small(units) else units, verdicts["qid"].eqNullSafe(F.col("q"))).select("unit", "model_a", "model_b", "score_a")
    size = max(1, count_bytes // max(1, n))
    if size >= replicates:
        return fitted(rows, spark.sparkContext.broadcast(next(count_blocks(n, replicates, seed, replicates))), replicates)
    rows, done, first = written(rows, "units-verdicts"), None, 0
    for block in count_blocks(n, replicates, seed, size):
        sent = spark.sparkContext.broadcast(block)
        out = Written(fitted(rows, sent, len(block)), "replicates").df.withColumn("rep", F.col("rep") + first)
        sent.destroy()
        done, first = out if done is None else done.unionByName(out), first + len(block)
    return done


def interval(draws: DataFrame, by: str = "model", value: str = "rating") -> DataFrame:
    """(by, ci_low, ci_high): exact 2.5 and 97.5 percentiles, linearly interpolated."""
    return draws.groupBy(by).agg(F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))


def rate(verdicts: DataFrame, bootstrap: int = REPLICATES, seed: int = 0, pos: str = "pos") -> DataFrame:
    """(name, rating, ci_low, ci_high, wins, losses, ties, n), in no order; empty without usable verdicts.
    Without a bootstrap, or with a single verdict, the interval is the point."""
    good = written(usable(verdicts).select("qid", "model_a", "model_b", "score_a", pos), "usable")
    point = point_ratings(good)
    if bootstrap and good.limit(2).count() > 1:
        ci = interval(bootstrap_ratings(good, bootstrap, seed, pos))
    else:
        ci = point.select("model", F.col("rating").alias("ci_low"), F.col("rating").alias("ci_high"))
    return point.join(ci, "model").join(win_loss_tie(good), "model").select(F.col("model").alias("name"), "rating", "ci_low", "ci_high", "wins", "losses", "ties", "n")


def two_model_rating(wins: DataFrame) -> DataFrame:
    """A02 in closed form where only two models met: (model, rating)."""
    w = wins.select("i", "j", (F.col("w") + SMOOTHING).alias("w"))
    back = w.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("v"))
    ratio = w.join(back, ["i", "j"]).select(F.col("i").alias("model"), F.sqrt(F.col("w") / F.col("v")).alias("p"))
    return ratio.select("model", elo("p", over=Window.partitionBy()).alias("rating"))


def leaderboard(ratings: DataFrame) -> DataFrame:
    """Highest rating first, equal ones by name."""
    return ratings.orderBy(F.desc("rating"), "name")


def format_leaderboard(rows: list[dict]) -> str:
    """A table of fixed width from rating rows with `model` or `name`."""
    rule = lambda ch: ch * 78
    head = "Rank".ljust(5) + "Model".ljust(38) + "Rating".rjust(8) + "CI±".rjust(7) + "".join(x.rjust(5) for x in "WLT")
    body = []
    for place, r in enumerate(rows, 1):
        name = (r.get("model") or r["name"]).rsplit("/", 1)[-1][:36]
        numbers = [(r["rating"], 8), ((r["ci_high"] - r["ci_low"]) / 2, 7), (r["wins"], 5), (r["losses"], 5), (r["ties"], 5)]
        body.append(f"{place:<5}{name:<38}" + "".join(f"{x:.0f}".rjust(w) for x, w in numbers))
    return "\n".join([rule("="), head, rule("-"), *body, rule("=")])
