"""Near-duplicate queries, kept greedily in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.runtime import Written, written


def token_sets(queries: DataFrame) -> DataFrame:
    """(qid, pos, toks)."""
    return queries.select("qid", "pos", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("toks"))


def near_edges(queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """edges(early, late) of positions whose token sets have a Jaccard similarity of at least `threshold`.

    Equal sets are one node. Of two similar sets the prefixes, rarest tokens first, share a token
    (Chaudhuri et al. 2006), so only prefixes are joined, and only sets of similar size; candidates
    are checked exactly. Empty sets are similar to nothing."""
    sets = token_sets(queries).filter(F.size("toks") > 0)
    nodes = written(sets.groupBy(F.array_sort("toks").alias("toks")).agg(F.min("pos").alias("node")), "dedup-nodes")
    df = nodes.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    size = F.size("toks")
    rows = nodes.select("node", size.alias("n"), F.explode("toks").alias("t")).join(df, "t")
    order = F.array_sort(F.collect_list(F.struct("df", "t")))  # one set's own tokens
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = rows.groupBy("node", "n").agg(order.alias("o")).select("node", "n", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p")).select("node", "n", F.col("p.t").alias("t"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    x, y = nodes.select(F.col("node").alias("x"), F.col("toks").alias("tx")), nodes.select(F.col("node").alias("y"), F.col("toks").alias("ty"))
    shared = F.size(F.array_intersect("tx", "ty"))
    return pairs.join(x, "x").join(y, "y").filter(shared >= threshold * (F.size("tx") + F.size("ty") - shared) - 1e-9).select(F.col("x").alias("early"), F.col("y").alias("late"))


def greedy_keep(queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Queries kept when none of the kept earlier ones is similar; so of a ~ b ~ c with a and c apart,
    a and c stay. Equal token sets keep the first; empty sets are all kept.

    Rounds: a node is kept once all its earlier neighbours are dropped, and dropped once one of them is
    kept. Every round settles at least the earliest open node of each group, and rounds go on until no pair is open."""
    sets = token_sets(queries)
    firsts = sets.filter(F.size("toks") > 0).groupBy(F.array_sort("toks").alias("toks")).agg(F.min("pos").alias("pos")).select("pos")
    state = Written(near_edges(queries, threshold).select("early", "late"), "dedup-edges")
    dropped = Written(queries.sparkSession.createDataFrame([], "pos long"), "dedup-out")
    while True:
        late = state.df.select(F.col("late").alias("early")).distinct()
        kept = state.df.select("early").distinct().join(late, "early", "left_anti")
        out = Written(state.df.join(kept, "early", "left_semi").select(F.col("late").alias("pos")).distinct(), "dedup-round")
        if out.df.isEmpty():
            break
        gone_early = state.df.join(out.df.select(F.col("pos").alias("early")), "early", "left_anti")
        rest = gone_early.join(out.df.select(F.col("pos").alias("late")), "late", "left_anti").join(kept, "early", "left_anti")
        rest = Written(rest.select("early", "late"), "dedup-edges")
        all_out = Written(dropped.df.unionByName(out.df), "dedup-out")
        state.drop(), dropped.drop()
        state, dropped = rest, all_out
    alive = firsts.join(dropped.df, "pos", "left_anti").unionByName(sets.filter(F.size("toks") == 0).select("pos"))
    return queries.join(alive, "pos", "left_semi")
