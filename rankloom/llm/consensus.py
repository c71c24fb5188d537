"""Problem 2: consensus, agreement and reliability from several annotators' labels.

Latent ability-difficulty model (Whitehill et al. 2009). An annotator of ability a gives an item of
easiness b its true label with probability s(a b), s the logistic function, and any other label
equally often else. Expectation-maximisation with gradient steps: the E-step computes every item's label
posterior, the M-step moves abilities and log-easinesses along the gradient of the expected
log-likelihood, scaled by its expected curvature, with normal priors on both.

Everything is an aggregation. Items with the same set of (annotator, label) follow the same path, so
they are one pattern with a weight; a pattern is recognised by two commutative hash sums, which
aggregate map-side. The votes of an item are never collected, and an item or an annotator with a
third of all votes is pre-aggregated before each shuffle. The votes are laid out by pattern once, in memory
or on disk, a pattern of very many votes in shares; an iteration is two jobs, which read them where
they lie and move only one row a pattern and one an annotator. A fit says whether it has converged.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rankloom.llm.verdictlog import bare, outcome, readable
from rankloom.runtime import Written, small

LABELS = ("A", "B", "tie")
ITERATIONS = 300
TOLERANCE = 1e-3
PRIOR_ABILITY, PRIOR_SPREAD = 1.0, 1.0
#: Abilities and log-easinesses stay within these bounds; beyond them nothing changes a probability visibly.
MOST_ABILITY, MOST_EASINESS = 6.0, 4.0
#: Votes of one pattern that lie together, and votes a task is given.
SHARE, TASK = 100_000, 50_000


def votes_of(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A panel log to items(qid, model_a, model_b) and votes(qid, model_a, model_b, judge, label), model_a
    being the smaller name.

    Lines with a null model or one model on both sides belong to no item. A line with an order that
    did not parse, or with neither a score nor two readable answers, is no vote; of a judge's votes on
    an item the one with the highest line number counts. A null judge is one judge, a null query one
    query.
    """
    a, b = bare("model_a"), bare("model_b")
    derived = (outcome(F.try_element_at("raw", F.lit(1))) + 1 - outcome(F.try_element_at("raw", F.lit(2)))) / 2
    score = F.coalesce(F.when(~F.isnan("score_a"), F.col("score_a")), derived)
    rows = log.select("qid", "judge", "line_no", a.alias("a"), b.alias("b"), F.when(readable("parsed_ok"), score).alias("s")).filter("a <> b")
    turned = rows.select(
        "qid", "judge", "line_no", F.least("a", "b").alias("model_a"), F.greatest("a", "b").alias("model_b"), F.when(F.col("a") < F.col("b"), F.col("s")).otherwise(1 - F.col("s")).alias("s")
    )
    items = turned.select("qid", "model_a", "model_b").distinct()
    last = turned.filter(F.col("s").isNotNull()).groupBy("qid", "model_a", "model_b", "judge").agg(F.max(F.struct("line_no", "s")).alias("line"))
    label = F.when(F.col("line.s") > 0.5, 0).when(F.col("line.s") < 0.5, 1).otherwise(2)
    return items, last.select("qid", "model_a", "model_b", "judge", label.alias("label"))


def patterns_of(votes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """votes to keyed items (qid, model_a, model_b, k1, k2), patterns(k1, k2, weight) and pattern
    votes(k1, k2, judge, label)."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "judge", "label").cast("decimal(20,0)"))
    item = ["qid", "model_a", "model_b"]
    keyed = Written(votes.groupBy(*item).agg(F.pmod(wide(1), F.lit(2**61 - 1)).cast("long").alias("k1"), F.pmod(wide(2), F.lit(2**61 - 1)).cast("long").alias("k2")), "panel-items").df
    shape = keyed.groupBy("k1", "k2").agg(F.count("*").cast("double").alias("weight"), F.min(F.struct(*item)).alias("one"))
    shape = Written(shape.select("k1", "k2", "weight", "one.*"), "panel-patterns").df
    same = [votes[c].eqNullSafe(shape[c]) for c in item]
    chosen = votes.join(shape, same[0] & same[1] & same[2]).select("k1", "k2", "judge", "label")
    return keyed, shape.select("k1", "k2", "weight"), Written(chosen, "panel-votes").df


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


@dataclass
class Fit:
    """posteriors(k1, k2, p0, p1, p2, log_easiness), abilities(judge, ability, n_votes, agreement), the iterations made,
    the last step of an ability, and whether the steps were within the tolerance twice running."""

    posteriors: DataFrame
    abilities: DataFrame
    iterations: int
    step: float
    converged: bool


def ability_difficulty(votes: DataFrame, patterns: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, share: int = SHARE) -> Fit:
    """Pattern votes and patterns to a fit. Stops when no ability moves by `tolerance` in two
    iterations running, and warns where the last iteration comes first."""
    k, n = ["k1", "k2"], len(LABELS)
    weighted = Written(votes.join(patterns, k), "panel-weighted").df
    size = weighted.groupBy(*k).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    parts = max(1, min(int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size["all"] or 0) // TASK + 1))
    at = k
    if (size["most"] or 0) > share:  # a pattern of very many votes lies in shares
        at = [*k, "share"]
        shares = weighted.groupBy(*k).agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
        weighted = weighted.join(shares, k).withColumn("share", F.pmod(F.xxhash64("judge"), F.col("shares")).cast("int"))
    laid = weighted.repartition(parts, *at).sortWithinPartitions(*at).persist()

    def spread(state: DataFrame, *cols: Column) -> DataFrame:
        """One row a pattern to one row a share of it."""
        rows = state.select(*k, *cols)
        return rows if at == k else rows.join(shares, k).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    ability = Written(weighted.groupBy("judge").agg(F.sum("weight").alias("n_votes")).withColumn("ability", F.lit(PRIOR_ABILITY)), "panel-abilities")
    few = small(ability.df)
    state: Written | None = None
    prior = [1.0 / n] * n
    before = step_now = float("inf")
    made, converged = 0, False
    bounded = lambda c, most: F.least(F.greatest(c, F.lit(-most)), F.lit(most))
    sure = lambda c: F.least(F.greatest(_logistic(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    for made in range(1, iterations + 1):
        seen = ability.df.select(F.col("judge").alias("who"), "ability")
        rows = laid.join(F.broadcast(seen) if few else seen, laid["judge"].eqNullSafe(F.col("who"))).drop("who")
        old = F.lit(0.0) if state is None else F.col("log_easiness")
        voted = rows if state is None else rows.join(spread(state.df, F.col("log_easiness")), at)
        voted = voted.withColumn("right", sure(F.col("ability") * F.exp(old)))
        gain = F.log("right") - F.log((1 - F.col("right")) / (n - 1))
        parts_of = [
            old.alias("b"),
            *[F.when(F.col("label") == z, gain).otherwise(0.0).alias(f"g{z}") for z in range(n)],
            *[F.when(F.col("label") == z, F.col("ability")).otherwise(0.0).alias(f"a{z}") for z in range(n)],
            (F.col("ability") * F.col("right")).alias("expected"),
            (F.col("ability") ** 2 * F.col("right") * (1 - F.col("right"))).alias("curve"),
        ]
        added = [c for z in range(n) for c in (f"g{z}", f"a{z}")] + ["expected", "curve"]
        total = lambda df, by: df.groupBy(*by).agg(F.first("b").alias("b"), *[F.sum(c).alias(c) for c in added])
        sums = total(voted.select(*at, *parts_of), at)
        sums = sums if at == k else total(sums, k)
        scored = [F.col(f"g{z}") + F.log(F.lit(prior[z])) for z in range(n)]
        top = F.greatest(*scored)
        parts_ = [F.exp(s - top) for s in scored]
        whole = parts_[0] + parts_[1] + parts_[2]
        b = F.exp("b")
        slope = b * (sum((F.col(f"p{z}") * F.col(f"a{z}") for z in range(n)), F.lit(0.0)) - F.col("expected")) - F.col("b")
        moved = F.col("b") + slope / (b * b * F.col("curve") + 1)
        posterior = sums.select("*", *[(p / whole).alias(f"p{z}") for z, p in enumerate(parts_)])
        last, state = state, Written(posterior.select(*k, *[f"p{z}" for z in range(n)], bounded(moved, MOST_EASINESS).alias("log_easiness")), "panel-posteriors")
        own = F.element_at(F.array(*[F.col(f"p{z}") for z in range(n)]), F.col("label") + 1)
        easy = F.exp("log_easiness")
        judged = rows.join(spread(state.df, F.col("log_easiness"), *[F.col(f"p{z}") for z in range(n)]), at).withColumn("right", sure(F.col("ability") * easy))
        per = judged.groupBy("judge").agg(
            F.first("ability").alias("ability"),
            F.sum("weight").alias("n_votes"),
            F.sum(F.col("weight") * own).alias("agreed"),
            F.sum(F.col("weight") * easy * (own - F.col("right"))).alias("slope"),
            F.sum(F.col("weight") * easy * easy * F.col("right") * (1 - F.col("right"))).alias("curve"),
        )
        tight = 1 / PRIOR_SPREAD**2
        step = (F.col("slope") - tight * (F.col("ability") - PRIOR_ABILITY)) / (F.col("curve") + tight)
        moves = Observation()
        new = per.select("judge", "n_votes", (F.col("agreed") / F.col("n_votes")).alias("agreement"), bounded(F.col("ability") + step, MOST_ABILITY).alias("ability"), F.col("ability").alias("was"))
        gone, ability = ability, Written(new.observe(moves, F.max(F.abs(F.col("ability") - F.col("was"))).alias("step")), "panel-abilities")
        gone.drop()
        if last is not None:
            last.drop()
        before, step_now = step_now, moves.get["step"] or 0.0
        converged = max(before, step_now) < tolerance
        if converged:
            break
    laid.unpersist()
    if not converged:
        warnings.warn(f"abilities still move by {step_now:.2g} after {made} iterations", RuntimeWarning, stacklevel=2)
    return Fit(state.df, ability.df, made, step_now, converged)


def consensus(log: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A panel log to (winners, annotators, votes).

    winners(qid, model_a, model_b, winner, confidence): the label with the highest posterior; if the
    two models have the same posterior and it is the highest, the item is a tie. An item without a vote
    is a tie with null confidence. annotators(judge, n_votes, ability, agreement, converged): agreement is the mean
    posterior of the labels the annotator gave; converged says whether the fit had settled.
    """
    items, votes = votes_of(log)
    items, votes = Written(items, "panel-all").df, Written(votes, "panel-lines").df
    keyed, patterns, shapes = patterns_of(votes)
    fit = ability_difficulty(shapes, patterns, iterations)
    posterior = fit.posteriors
    best = F.greatest("p0", "p1", "p2")
    said = F.when(F.abs(F.col("p0") - F.col("p1")) < 1e-9, F.lit("tie")).when(F.col("p0") == best, "A").when(F.col("p1") == best, "B").otherwise("tie")
    shown = posterior.select("k1", "k2", said.alias("winner"), best.alias("confidence"))
    found = keyed.join(shown, ["k1", "k2"]).select(*[F.col(c).alias(f"_{c}") for c in ("qid", "model_a", "model_b")], "winner", "confidence")
    same = items["qid"].eqNullSafe(F.col("_qid")) & (items["model_a"] == F.col("_model_a")) & (items["model_b"] == F.col("_model_b"))
    winners = items.join(found, same, "left").select("qid", "model_a", "model_b", F.coalesce("winner", F.lit("tie")).alias("winner"), "confidence")
    return winners, fit.abilities.select("judge", F.col("n_votes").cast("long").alias("n_votes"), "ability", "agreement", F.lit(fit.converged).alias("converged")), votes


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row (n_items, n_votes, observed, expected, alpha): Krippendorff's nominal alpha over items with
    two votes or more; nulls where nothing can be paired or only one label occurs."""
    per = votes.groupBy("qid", "model_a", "model_b").agg(F.count("*").alias("m"), *[F.count(F.when(F.col("label") == z, 1)).alias(f"n{z}") for z in range(3)]).filter("m > 1")
    apart = (F.col("m") * F.col("m") - sum((F.col(f"n{z}") * F.col(f"n{z}") for z in range(3)), F.lit(0))) / (F.col("m") - 1)
    total = per.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_votes"), F.sum(apart).alias("apart"), *[F.sum(f"n{z}").cast("double").alias(f"t{z}") for z in range(3)])
    n = F.col("n_votes").cast("double")
    chance = F.try_divide(n * n - sum((F.col(f"t{z}") * F.col(f"t{z}") for z in range(3)), F.lit(0.0)), n * (n - 1))
    seen = total.select("n_items", "n_votes", F.try_divide(F.col("apart"), n).alias("observed"), chance.alias("expected"))
    return seen.select("n_items", "n_votes", "observed", "expected", (1 - F.try_divide(F.col("observed"), F.col("expected"))).alias("alpha"))
