"""Ratings, diagnostics and agreement."""

import math
import random

import numpy as np
import pytest

from rankloom.operators import agreement as A
from rankloom.operators import rank as R
from rankloom.operators import results as res
from rankloom.operators.sampling import bootstrap_counts, count_blocks

SCHEMA = "qid string, model_a string, model_b string, score_a double, parsed_ok array<boolean>, raw array<string>, pos long"


def league(n=20, models=("mid", "top", "low"), order=("top", "mid", "low"), flip=0.0, seed=0):
    rng, rows = random.Random(seed), []
    for q in range(n):
        for i, a in enumerate(models):
            for b in models[i + 1 :]:
                s = 1.0 if order.index(a) < order.index(b) else 0.0
                rows.append((f"q{q}", a, b, 1 - s if rng.random() < flip else s, [True, True], ["A", "B"], len(rows)))
    return rows


def one_by_one(w, sweeps=200, tolerance=1e-9, smoothing=0.1):
    """A straight statement of the rule for one matrix."""
    n = len(w)
    w = [[w[i][j] + (smoothing if i != j else 0) for j in range(n)] for i in range(n)]
    p = [1.0] * n
    for _ in range(sweeps):
        old = list(p)
        for i in range(n):
            load = sum((w[i][j] + w[j][i]) / (p[i] + p[j]) for j in range(n) if j != i)
            if load > 0:
                p[i] = sum(w[i]) / load
        mean = math.exp(sum(math.log(max(x, 1e-12)) for x in p) / n)
        p = [x / mean for x in p]
        if max(abs(x - y) for x, y in zip(p, old)) < tolerance:
            break
    return p


def test_fit_equals_the_rule_also_when_the_cap_binds():
    rng = np.random.default_rng(0)
    stack = np.stack([rng.integers(0, 50, (6, 6)) * (1 - np.eye(6)), np.triu(np.full((6, 6), 400.0), 1), np.zeros((6, 6))])
    got = R.fit(stack.astype(float))
    for k in range(3):
        assert np.allclose(got[k], one_by_one(stack[k].tolist()), rtol=1e-9)


def test_fit_is_scale_free_and_finite():
    w = np.array([[[0, 3.0, 0], [1, 0, 2], [0, 0, 0]]])
    p = R.fit(w)
    assert np.isfinite(p).all() and abs(np.log(p).mean()) < 1e-9 and p[0, 2] == p.min()


def test_order_intervals_and_counts(spark):
    df = spark.createDataFrame(league(flip=0.15), SCHEMA)
    got = R.leaderboard(R.rate(df, bootstrap=100)).collect()
    assert [r["name"] for r in got] == ["top", "mid", "low"]
    assert all(r["ci_low"] <= r["rating"] + 1e-6 <= r["ci_high"] + 2e-6 and r["n"] == 40 and r["wins"] + r["losses"] + r["ties"] == 40 for r in got)
    assert got[1]["rating"] - got[2]["rating"] > 50 and abs(sum(r["rating"] for r in got) / 3 - 1000) < 1e-6
    text = R.format_leaderboard([r.asDict() for r in got])
    assert len(text.splitlines()) == 7 and {len(x) for x in text.splitlines()} == {73, 78}


def test_bootstrap_equals_resampling_by_hand(spark):
    rows = league(n=12, flip=0.3)
    got = {(r["rep"], r["model"]): r["rating"] for r in R.bootstrap_ratings(spark.createDataFrame(rows, SCHEMA), 20, 3).collect()}
    rng = np.random.default_rng(3)
    names, qids = ["low", "mid", "top"], [f"q{i}" for i in range(12)]
    for rep in range(20):
        w = np.zeros((3, 3))
        for q in rng.choice(np.array(qids, dtype=object), 12, replace=True):
            for r in rows:
                if r[0] == q:
                    w[names.index(r[1]), names.index(r[2])] += r[3]
                    w[names.index(r[2]), names.index(r[1])] += 1 - r[3]
        want = R.on_elo(R.fit(w[None]))[0]
        for m, x in zip(names, want):
            assert got[(rep, m)] == pytest.approx(x, abs=1e-6)


def test_poisson_bootstrap_is_close(spark):
    df = spark.createDataFrame(league(n=200, flip=0.2), SCHEMA)
    exact = {r["model"]: r for r in R.interval(R.bootstrap_ratings(df, 200, 0)).collect()}
    free = {r["model"]: r for r in R.interval(R.bootstrap_ratings(df, 200, 0, exact=10)).collect()}
    for m, r in exact.items():
        assert abs(r["ci_low"] - free[m]["ci_low"]) < 25 and abs(r["ci_high"] - free[m]["ci_high"]) < 25


def test_unreadable_comparisons_are_left_out(spark):
    rows = league(n=6)
    bad = [(q, b, a, 1.0, [True, False], ["A", "?"], 99) for q, a, b, *_ in rows]
    same = {r["name"]: r["rating"] for r in R.rate(spark.createDataFrame(rows, SCHEMA), 0).collect()}
    assert {r["name"]: r["rating"] for r in R.rate(spark.createDataFrame(rows + bad, SCHEMA), 0).collect()} == same
    assert R.rate(spark.createDataFrame(bad, SCHEMA), 10).collect() == []


def test_one_verdict_has_a_point_for_an_interval(spark):
    got = R.rate(spark.createDataFrame([("q", "a", "b", 1.0, [], ["identical"], 0)], SCHEMA)).collect()
    assert all(r["ci_low"] == r["rating"] == r["ci_high"] for r in got) and len(got) == 2


def test_two_models_closed_form(spark):
    df = spark.createDataFrame(league(models=("a", "b"), order=("a", "b"), flip=0.3), SCHEMA)
    want = {r["model"]: r["rating"] for r in R.point_ratings(df).collect()}
    got = {r["model"]: r["rating"] for r in R.two_model_rating(R.win_matrix(df)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def test_bootstrap_counts():
    counts = bootstrap_counts(7, 50, 1)
    rng = np.random.default_rng(1)
    assert (counts.sum(1) == 7).all()
    assert all((counts[r] == np.bincount(rng.integers(0, 7, 7), minlength=7)).all() for r in range(50))


def test_diagnostics_by_hand(spark):
    rows = [("q", "a", "b", 1.0, [True, True], ["A", "B"], 1), ("q", "a", "b", 0.5, [], ["identical"], 2), ("q", "a", "b", 0.75, [True, False], ["A", "tie"], 3)]
    got = res.diagnostics(spark.createDataFrame(rows, SCHEMA)).first().asDict()
    assert got == {"judge_calls": 4, "n_comparisons": 3, "commit_rate": 2 / 3, "tie_rate": 1 / 3, "a_first_rate": 2 / 3, "parse_failure_rate": 0.25, "identical_retrieval_rate": 1 / 3}
    empty = res.diagnostics(spark.createDataFrame([], SCHEMA)).first().asDict()
    assert empty == {"judge_calls": 0, "n_comparisons": 0} | {k: None for k in got if k.endswith("_rate")}


def test_correlations_by_hand():
    g, t = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 1, 4, 3, 5])
    assert A.spearman(g, t) == pytest.approx(0.8) and A.kendall(g, t) == pytest.approx(0.6)
    assert A.spearman_p(0.8, 5) == pytest.approx(0.1040880, abs=1e-6)
    assert A.kendall_p(g, t) == pytest.approx(0.2333333, abs=1e-6)
    assert A.tau_ap(t, t) == 1 and A.tau_ap(-t, t) == -1
    assert math.isnan(A.spearman(np.ones(4), np.arange(4.0)))
    assert A.kendall_p(np.arange(4.0), np.arange(4.0)) == pytest.approx(2 / 24)


def test_correlate_document():
    names = [f"m{i}" for i in range(25)]
    ours = {m: float(i) for i, m in enumerate(names)}
    got = A.correlate(ours, ours | {"other": 1.0}, bootstrap=50)
    assert got["n_models"] == 25 and got["spearman_rho"] == pytest.approx(1) and got["spearman_top10"] == pytest.approx(1) and got["kendall_ap"] == 1
    assert got["own_ranking"] == names[::-1] and got["spearman_ci95"][0] == pytest.approx(1)
    assert A.correlate({"a": 1.0, "b": 2.0}, ours)["error"].startswith("need >=3")
    five = dict(zip("abcde", [1.0, 2, 3, 4, 5]))
    assert A.correlate(five, five)["spearman_top10"] is None


def test_resamples_equal_one_stream_drawn_one_by_one():
    import math

    rng = np.random.default_rng(3)
    g, t = rng.integers(0, 4, 7).astype(float), rng.integers(0, 5, 7).astype(float)
    one, want = np.random.default_rng(9), []
    for _ in range(300):
        pick = one.integers(0, 7, 7)
        if len(set(pick)) >= 3 and not math.isnan(r := A.spearman(g[pick], t[pick])):
            want.append(r)
    got = A.resampled_spearman(g, t, np.random.default_rng(9).integers(0, 7, (300, 7)), block=64)
    assert np.allclose(got, want)


def test_frames_equal_driver_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"m{i}", float(rng.integers(0, 6)), float(rng.integers(0, 6))) for k in "xy" for i in range(14)]
    df = spark.createDataFrame(rows, "k string, model string, g double, t double")
    rho = {r["k"]: r["rho"] for r in A.spearman_df(df, ["k"]).collect()}
    tau = {r["k"]: r["tau"] for r in A.kendall_df(df, ["k"]).collect()}
    ap = {r["k"]: r["tau_ap"] for r in A.tau_ap_df(df, ["k"]).collect()}
    for k in "xy":
        some = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        g, t = np.array([r[2] for r in some]), np.array([r[3] for r in some])
        assert rho[k] == pytest.approx(A.spearman(g, t)) and tau[k] == pytest.approx(A.kendall(g, t)) and ap[k] == pytest.approx(A.tau_ap(g, t))
    assert A.top_by_truth(df, ["k"]).count() == 20


def test_blocks_of_replicates_are_one_stream_at_every_size(spark):
    some = spark.createDataFrame(league(n=12, flip=0.3), SCHEMA)
    whole, parts = ({(r["rep"], r["model"]): r["rating"] for r in R.bootstrap_ratings(some, 20, 3, count_bytes=b).collect()} for b in (10_000, 84))
    assert whole.keys() == parts.keys() and all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())
    counts = np.concatenate(list(count_blocks(20_001, 3, 0, 2)))
    assert (counts == bootstrap_counts(20_001, 3, 0)).all()
    many = spark.range(20_001).selectExpr("concat('q', id) as qid", "'a' as model_a", "'b' as model_b", "cast(id % 3 = 0 as double) as score_a", "id as pos")
    got = {(r["rep"], r["model"]): r["rating"] for r in R.bootstrap_ratings(many, 3).collect()}
    won = counts[:, ::3].sum(1, dtype=float)
    for rep in range(3):
        want = R.on_elo(R.fit(np.array([[[0, won[rep]], [20_001 - won[rep], 0]]])))[0]
        assert [got[(rep, m)] for m in "ab"] == pytest.approx(list(want), abs=1e-6)
