"""Problem 1: one global ranking from pairwise comparisons, by spring energy.

Every comparison is a spring between two items that is at rest when the winner stands one unit
above the loser (De Bacco, Larremore and Moore 2018). A comparison with score s counts s times for
one direction and 1 - s times for the other. Setting the gradient of the energy to zero gives one
sparse linear system

    (diag(games + alpha) - G) x = wins - losses,    G[i, j] = games between i and j

which is symmetric and positive definite for alpha > 0, so items nobody compares with the rest still
have a strength. It is solved by conjugate gradients with the Jacobi preconditioner: each iteration
is one join of the edge table with the vector and one aggregation, and its dot products are
observed while it is written, so an iteration is one job and only three numbers reach the driver
(the form of Chronopoulos and Gear 1989). The comparisons themselves are aggregated to edges once.
It iterates until the residual meets the tolerance and fails where it cannot; a solution says how many
iterations it took and what residual is left.

The edges of an item that met a great many others are dealt into shares of a bounded number, and its
entry of the vector goes to each, so that no task holds all edges of a hub.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankloom.llm.verdictlog import comparisons
from rankloom.runtime import Written

ALPHA = 0.1
TOLERANCE = 1e-10
#: Edges of one item that one task is given.
SHARE = 100_000


def edges_of(games: DataFrame) -> DataFrame:
    """(lo, hi, score) to (i, j, games, net): both directions of every pair; net is wins minus losses
    of i against j."""
    pair = games.groupBy("lo", "hi").agg(F.count("score").cast("double").alias("games"), F.sum(2 * F.col("score") - 1).alias("net"))
    there = pair.select(F.col("lo").alias("i"), F.col("hi").alias("j"), "games", "net")
    back = pair.select(F.col("hi").alias("i"), F.col("lo").alias("j"), "games", (-F.col("net")).alias("net"))
    return there.unionByName(back)


def _parts(df: DataFrame) -> int:
    """Partitions of the vector: one for each 100,000 edges, as the system is much smaller than its log."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n, df.count() // 100_000))


@dataclass
class Solution:
    """strengths(item, strength, games), the iterations it took, and the residual over the right-hand side."""

    strengths: DataFrame
    iterations: int
    residual: float


def solve(edges: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE, iterations: int | None = None, share: int = SHARE) -> Solution:
    """edges(i, j, games, net) to strengths. Converged when the residual is `tolerance` times the right-hand side;
    where that takes more than `iterations` (by default three times the number of items and 200, exact
    arithmetic needing at most one an item) it is an ArithmeticError. Without edges there are no rows. Items in different
    components are each centred on zero by the regulariser."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    kept = Written(edges, "spring-edges")
    n = _parts(kept.df)
    node = kept.df.groupBy("i").agg(F.sum("games").alias("games"), F.sum("net").alias("r"), F.ceil(F.count("*") / share).cast("int").alias("shares")).coalesce(n)
    zero = F.lit(0.0)
    scale = F.col("games") + F.lit(alpha)
    start = Written(node.select("i", "games", "shares", zero.alias("x"), "r", zero.alias("p"), zero.alias("s"), (F.col("r") / scale).alias("u")), "spring-vector")
    size = start.df.agg(F.count("*").alias("n"), F.max("shares").alias("most")).first()
    graph = kept.df.select("i", "j", "games").join(start.df.select(F.col("i").alias("j"), "shares"), "j")
    graph = graph.select("i", "j", F.pmod(F.xxhash64("i"), F.col("shares")).cast("int").alias("k"), "games").repartition(n, "j", "k").persist()
    limit = 3 * size["n"] + 200 if iterations is None else iterations
    written, state = start, start.df
    before, step, goal, left, done = 0.0, 1.0, None, 0.0, 0
    for done in range(limit + 1):
        # one job an iteration: the product A u, written together with the three dot products it needs
        source = state.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("k"), F.col("u").alias("uj"))
        if size["most"] == 1:  # no hub: spares the explosion
            source = state.select(F.col("i").alias("j"), F.lit(0).alias("k"), F.col("u").alias("uj"))
        pulled = graph.join(source, ["j", "k"]).groupBy(F.col("i").alias("at")).agg(F.sum(F.col("games") * F.col("uj")).alias("gu"))
        full = state.join(pulled, state["i"] == F.col("at"), "left").withColumn("w", scale * F.col("u") - F.coalesce("gu", zero)).drop("at", "gu").coalesce(n)
        dots = Observation()
        old, written = written, Written(
            full.observe(dots, F.sum(F.col("r") * F.col("u")).alias("ru"), F.sum(F.col("w") * F.col("u")).alias("wu"), F.sum(F.col("r") * F.col("r")).alias("rr")), "spring-vector"
        )
        if done:  # the first vector is still read by the graph
            old.drop()
        got = dots.get
        ru, wu, rr = (got[c] or 0.0 for c in ("ru", "wu", "rr"))
        goal = rr if goal is None else goal
        left = (rr / goal) ** 0.5 if goal else 0.0
        if left <= tolerance or ru == 0:
            break
        turn = ru / before if before else 0.0
        step = ru / (wu - turn * ru / step)
        before = ru
        p, s_ = F.col("u") + F.lit(turn) * F.col("p"), F.col("w") + F.lit(turn) * F.col("s")
        moved = written.df.select("i", "games", "shares", "x", "r", p.alias("p"), s_.alias("s"))
        moved = moved.select("i", "games", "shares", (F.col("x") + F.lit(step) * F.col("p")).alias("x"), (F.col("r") - F.lit(step) * F.col("s")).alias("r"), "p", "s")
        state = moved.withColumn("u", F.col("r") / scale)
    else:
        raise ArithmeticError(f"a residual of {left:.2g} is left after {limit} iterations")
    graph.unpersist()
    return Solution(written.df.select(F.col("i").alias("item"), F.col("x").alias("strength"), F.col("games").cast("long").alias("games")), done, left)


def spring_rank(edges: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE, iterations: int | None = None) -> DataFrame:
    """edges(i, j, games, net) to (item, strength, games), as `solve`."""
    return solve(edges, alpha, tolerance, iterations).strengths


def ranked(strengths: DataFrame, parts: int = 1) -> DataFrame:
    """(rank_no, item, strength, games): 1 is the strongest, equal strengths by the smaller name.

    Ranks are counted from range-partitioned blocks: the rows of each block are numbered on their own
    and the sizes of the blocks before it are added, so no task sorts everything."""
    spark = strengths.sparkSession
    order = [F.col("strength").desc(), F.col("item")]
    block = Written(strengths.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()), "spring-blocks").df
    sizes = sorted((r["block"], r["n"]) for r in block.groupBy("block").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for b, m in sizes:
        offsets.append((b, before))
        before += m
    shift = spark.createDataFrame(offsets, "block int, shift long")
    inner = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    numbered = block.withColumn("inner", inner).join(F.broadcast(shift), "block")
    return numbered.select((F.col("inner") + F.col("shift")).cast("int").alias("rank_no"), "item", "strength", "games")


def rank_models(log: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(rank_no, model, strength, games) of every model of a verdict log.

    One comparison is a query set, query, judge and unordered pair; its last line counts. Comparisons
    with an unreadable order or without a score are left out, a model that has no other is ranked with
    strength 0. Lines with a null model, or with one model on both sides, are no comparison.
    """
    games = comparisons(log, ["query_set", "qid", "judge"])
    pairs = games.groupBy("lo", "hi").agg(
        F.count(F.when(F.col("ok"), F.col("score"))).cast("double").alias("games"), F.coalesce(F.sum(F.when(F.col("ok"), 2 * F.col("score") - 1)), F.lit(0.0)).alias("net")
    )
    pairs = Written(pairs, "spring-pairs").df
    back = pairs.select(F.col("hi").alias("i"), F.col("lo").alias("j"), "games", (-F.col("net")).alias("net"))
    edges = pairs.select(F.col("lo").alias("i"), F.col("hi").alias("j"), "games", "net").unionByName(back)
    return ranked(spring_rank(edges, alpha), _parts(edges)).withColumnRenamed("item", "model")
