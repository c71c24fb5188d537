"""Agreement of two rankings, without SciPy."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- as DataFrames


def shared_scores(own: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., model, g, t) of models both have; `by` are columns of own scores."""
    return own.select(*by, "model", F.col("score").alias("g")).join(truth.select("model", F.col("score").alias("t")), "model").select(*by, "model", "g", "t")


def average_rank(col: str, by: list[str] | None = None):
    """Rank from 1, equal values sharing the mean of their places."""
    w = Window.partitionBy(*(by or []))
    return F.rank().over(w.orderBy(col)) + (F.count("*").over(Window.partitionBy(*(by or []), col)) - 1) / 2


def spearman_df(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, rho); null where one side has one value only."""
    ranked = pairs.withColumn("rg", average_rank("g", by)).withColumn("rt", average_rank("t", by))
    rho = F.try_divide(F.covar_pop("rg", "rt"), F.stddev_pop("rg") * F.stddev_pop("rt"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))


def concordance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., g and t of both models) for every two models of a group; as many rows as pairs of models."""
    a = pairs.select(*by, F.col("model").alias("m1"), F.col("g").alias("g1"), F.col("t").alias("t1"))
    b = pairs.select(*by, F.col("model").alias("m2"), F.col("g").alias("g2"), F.col("t").alias("t2"))
    return a.join(b, by).filter("m1 < m2")


def kendall_df(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tau): tau-b."""
    s = concordance(pairs, by).withColumn("x", F.signum(F.col("g1") - F.col("g2"))).withColumn("y", F.signum(F.col("t1") - F.col("t2")))
    num, gx, ty = F.sum(F.col("x") * F.col("y")), F.sum(F.abs("x")), F.sum(F.abs("y"))
    return s.groupBy(*by).agg(F.try_divide(num, F.sqrt(gx * ty)).alias("tau"))


def tau_ap_df(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tau_ap): of the models before each one in the true order, the share that also has a strictly
    greater g; its mean, stretched to [-1, 1]. Equal truths stand in the order of names."""
    placed = pairs.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), "model")))
    a, b = placed.select(*by, F.col("i").alias("i1"), F.col("g").alias("g1")), placed.select(*by, F.col("i").alias("i2"), F.col("g").alias("g2"))
    share = a.join(b, by).filter("i1 < i2").groupBy(*by, "i2").agg(F.avg(F.when(F.col("g1") > F.col("g2"), 1.0).otherwise(0.0)).alias("s"))
    return share.groupBy(*by).agg((2 * F.avg("s") - 1).alias("tau_ap"))


def top_by_truth(pairs: DataFrame, by: list[str], n: int = 10, least: int = 12) -> DataFrame:
    """The n best by truth of groups with `least` models or more."""
    w = Window.partitionBy(*by)
    kept = pairs.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.desc("t"), "model")))
    return kept.filter((F.col("_n") >= least) & (F.col("_i") <= n)).drop("_n", "_i")


# ---------------------------------------------------------------- on the driver, for one pair of rankings


def _ranks(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    end = np.cumsum(n)
    return (end - (n - 1) / 2)[back]


def spearman(g: np.ndarray, t: np.ndarray) -> float:
    a, b = _ranks(g) - (len(g) + 1) / 2, _ranks(t) - (len(t) + 1) / 2
    scale = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / scale if scale else math.nan


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def spearman_p(rho: float, n: int) -> float:
    """Two-sided, by Student's t with n - 2 degrees of freedom."""
    if math.isnan(rho) or n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    f = n - 2
    t2 = rho * rho * f / (1 - rho * rho)
    return _beta_tail(f / 2, 0.5, f / (f + t2))


def _kendall_parts(g: np.ndarray, t: np.ndarray) -> tuple[float, int, int, int]:
    x, y = np.sign(g[:, None] - g[None, :]), np.sign(t[:, None] - t[None, :])
    up = np.triu_indices(len(g), 1)
    x, y = x[up], y[up]
    return float((x * y).sum()), int((x == 0).sum()), int((y == 0).sum()), len(x)


def kendall(g: np.ndarray, t: np.ndarray) -> float:
    """Tau-b."""
    s, tx, ty, n = _kendall_parts(g, t)
    scale = math.sqrt((n - tx) * (n - ty))
    return s / scale if scale else math.nan


def kendall_p(g: np.ndarray, t: np.ndarray) -> float:
    """Two-sided: exact by counting permutations for up to 33 values, or few discordances, without ties; else by
    the normal approximation with tie corrections."""
    n = len(g)
    s, tx, ty, total = _kendall_parts(g, t)
    if total == tx or total == ty:
        return math.nan
    apart = int(round((total - s) / 2))
    few = min(apart, total - apart)
    if tx == ty == 0 and (n <= 33 or few <= 1):
        ways = [1]
        for k in range(2, n + 1):  # permutations of k values by their number of inversions
            run, grown = 0, []
            for i in range(len(ways) + k - 1):
                run += ways[i] if i < len(ways) else 0
                run -= ways[i - k] if i >= k and i - k < len(ways) else 0
                grown.append(run)
            ways = grown
        return min(1.0, 2 * sum(ways[: few + 1]) / math.factorial(n)) if 2 * few != total else 1.0
    ties = lambda v: np.unique(v, return_counts=True)[1].astype(float)
    a, b = ties(g), ties(t)
    m = n * (n - 1.0)
    pair = lambda v: (v * (v - 1)).sum()
    trio = lambda v: (v * (v - 1) * (v - 2)).sum()
    wide = lambda v: (v * (v - 1) * (2 * v + 5)).sum()
    var = (m * (2 * n + 5) - wide(a) - wide(b)) / 18 + pair(a) * pair(b) / (2 * m) + (trio(a) * trio(b) / (9 * m * (n - 2)) if n > 2 else 0.0)
    return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2))


def tau_ap(g: np.ndarray, t: np.ndarray) -> float:
    """A16; W09: equal truths stay in the given order."""
    o = g[np.argsort(-t, kind="stable")]
    above = [float(np.mean(o[:i] > o[i])) for i in range(1, len(o))]
    return 2 * sum(above) / len(above) - 1


def _ranks_of_rows(x: np.ndarray) -> np.ndarray:
    """Average ranks within every row of a matrix."""
    below = (x[:, None, :] < x[:, :, None]).sum(2)
    equal = (x[:, None, :] == x[:, :, None]).sum(2)
    return below + (equal + 1) / 2


def resampled_spearman(g: np.ndarray, t: np.ndarray, draws: np.ndarray, block: int = 200) -> np.ndarray:
    """Rank correlations of resampled models, one a row of `draws`. Draws of fewer than three different
    models, and those in which a side has one value only, give none."""
    out = []
    for at in range(0, len(draws), block):
        some = draws[at : at + block]
        some = some[(np.diff(np.sort(some, 1), axis=1) > 0).sum(1) >= 2]
        a, b = (r - r.mean(1, keepdims=True) for r in (_ranks_of_rows(g[some]), _ranks_of_rows(t[some])))
        scale = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        out.append((a * b).sum(1)[scale > 0] / scale[scale > 0])
    return np.concatenate(out) if out else np.zeros(0)


#: Models a comparison needs at least, and those from which the ten best are compared as well.
FEWEST, MANY, BEST = 3, 12, 10


def correlate(own: dict[str, float], truth: dict[str, float], bootstrap: int = 1000, seed: int = 0) -> dict:
    """Agreement over the models both have, W04 with both orders. Rankings have as many entries as
    models, so this is driver work; agreement of many records maps it over them."""
    scores = np.array([(own[m], truth[m]) for m in own if m in truth], float).reshape(-1, 2)
    models = [m for m in own if m in truth]
    if len(models) < FEWEST:
        return {"error": f"need >={FEWEST} shared models, have {len(models)}", "shared": models}
    g, t = scores.T
    draws = np.random.default_rng(seed).integers(0, len(models), (bootstrap, len(models)))
    sampled = resampled_spearman(g, t, draws)
    top = np.argsort(-t, kind="stable")[:BEST]
    among_best = spearman(g[top], t[top]) if len(models) >= MANY else math.nan
    out = {"n_models": len(models), "models": models}
    out["spearman_rho"] = spearman(g, t)
    out["spearman_p"] = spearman_p(out["spearman_rho"], len(models))
    out["spearman_ci95"] = np.percentile(sampled, [2.5, 97.5]).tolist() if len(sampled) else [None, None]
    out["spearman_top10"] = None if math.isnan(among_best) else among_best
    out["kendall_tau"], out["kendall_p"], out["kendall_ap"] = kendall(g, t), kendall_p(g, t), tau_ap(g, t)
    for name, column in (("own_ranking", g), ("truth_ranking", t)):
        out[name] = [models[i] for i in np.argsort(-column, kind="stable")]
    return out


def record_agreement(record: dict, truth: dict[str, float] | None, source: dict | None = None, bootstrap: int = 1000, seed: int = 0) -> dict:
    """A record's agreement with official scores, and that of its label baseline. A local corpus has none."""
    if record["source"] == "local" or truth is None:
        return {"error": "local corpus: no official scores to compare with"}
    column = lambda name: {r["model"]: r[name] for r in record["ratings"] if r.get(name) is not None}
    out = {**correlate(column("rating"), truth, bootstrap, seed), "truth_source": source or {}}
    if labelled := column("ndcg_at_10"):
        out["labels_baseline"] = {"labels": record.get("labels"), **correlate(labelled, truth, bootstrap, seed)}
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U04."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
