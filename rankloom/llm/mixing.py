"""Problem 7: mixing sources to target weights by soft membership.

Sizes are tokens of a public tokenizer. A softmax classifier, fitted on a bounded number of labelled
documents of every source and calibrated on a held-out part of them, gives each document a likelihood
of every source. With the sources' own frequencies, and with the label where there is one, it becomes a
posterior: a label is right with probability `trust`, so a labelled document belongs mostly, and an
unlabelled one as far as its words say so, to a source. Every document then gets a nonnegative rate, the
expected number of times it is used, such that the expected token totals by posterior match the targets
in the least-squares sense. The rates are found by projected gradient steps, preconditioned by the
totals' own Hessian over documents that are not at a bound. A step is one Arrow stage over a compact
table of sizes and posteriors, of which each task returns its totals and its k by k part of the Hessian; a
document's rate is replayed from the steps so far and never stored in between.

Rates become whole copies by carrying the rounding error from document to document, longest first, within
a block of a source. What a block misses is then about half of its shortest document, so the tokens
that are drawn reach the targets and not only their expectation.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.runtime import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Labelled documents of every source that the classifier is fitted on, at most.
SAMPLE = 200
FEATURES = 1024
#: Probability that a label is right; the rest is left to the words.
LABEL_TRUST = 0.99
#: Steps at most. The least-squares optimum may miss targets that caps and posteriors do not allow; `Mix` says so.
STEPS = 60
#: Part of the largest possible mix that is asked for by default, so that rates can differ within a source.
SLACK = 0.95
#: Largest missing part of the mix at which the steps end.
TOLERANCE = 1e-6
#: Sources at most; totals and Hessian grow with their number.
SOURCES = 200
#: Characters encoded at a time, and more up to the next boundary between two pieces of the tokenizer.
PIECE = 200_000
#: Documents of a source whose rounding errors are carried along in one task.
BLOCK = 50_000

# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A place where a piece of that pattern ends in every text: before a blank that follows a letter or digit.
_BOUNDARY = re.compile(r"(?<=[^\W_])(?=[ \n])")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer at `path`, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> str:
    """Sends the tokenizer's file to the executors, once a session; its name there."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(at)
    return Path(path).name


def source_name(col: Column | str) -> Column:
    """A source as it is meant: without blanks around it, in lower case; empty is null."""
    c = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def _tokens(enc, text: str) -> list[int]:
    """The text's tokens; a long text is encoded in parts that end where a piece of the tokenizer does, so the
    tokens are those of the whole."""
    out, at = [], 0
    while len(text) - at > PIECE and (cut := _BOUNDARY.search(text, at + PIECE)):
        out += enc.encode_ordinary(text[at : cut.start()])
        at = cut.start()
    return out + enc.encode_ordinary(text[at:] if at else text)


def _features(enc, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts, and square-rooted, normalised counts in FEATURES bins."""
    ids = [_tokens(enc, t) for t in texts]
    n = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter((t for x in ids for t in x), dtype=np.int64, count=int(n.sum()))
    cell = np.repeat(np.arange(len(ids)), n) * FEATURES + (flat * 2654435761 >> 7) % FEATURES
    x = np.sqrt(np.bincount(cell, minlength=len(ids) * FEATURES).reshape(-1, FEATURES)).astype(np.float32)
    return n, x / np.maximum(1e-6, np.sqrt((x * x).sum(1, keepdims=True)))


def _vectors(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for pdf in batches:
            if len(pdf):
                _, x = _features(enc, pdf["text"].tolist())
                yield pd.DataFrame({"label": pdf["label"], "x": [v.tobytes() for v in x]})

    return run


def _sizes(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": [len(_tokens(enc, t)) for t in pdf["text"]]})

    return run


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression by accelerated gradient; classes weigh the same. Returns (FEATURES + 1, classes)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = (1.0 / np.maximum(1, np.bincount(y, minlength=classes)))[y]
    weight = (weight / weight.sum()).astype(np.float32)
    w = z = np.zeros((x.shape[1], classes), np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    for k in range(rounds):
        s = x @ z
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = z - 8.0 * (x.T @ ((p - target) * weight[:, None]) + ridge * z)
        z, w = new + (k / (k + 3.0)) * (new - w), new
    return w


def sharpness(x: np.ndarray, y: np.ndarray, classes: int) -> float:
    """The factor of the scores at which held-out documents (every fifth) are likeliest; 1 where none is held out."""
    out = np.arange(len(y)) % 5 == 4
    if not out.any() or len(np.unique(y[~out])) < classes:
        return 1.0
    w = fit(x[~out], y[~out], classes)
    s = x[out] @ w[:-1] + w[-1]
    weight = (1.0 / np.bincount(y[out], minlength=classes).clip(1))[y[out]]

    def loss(b: float) -> float:
        z = b * (s - s.max(1, keepdims=True))
        return float((weight * (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y[out]])).sum())

    return min((float(b) for b in 2.0 ** np.arange(-2, 5.25, 0.25)), key=loss)


def posteriors(scores: np.ndarray, label: np.ndarray, prior: np.ndarray, sharp: float, trust: float) -> np.ndarray:
    """Rows of source probabilities from classifier scores and labels (-1: none)."""
    k = len(prior)
    p = np.exp(sharp * (scores - scores.max(1, keepdims=True))) * prior + 1e-12
    if k > 1:
        known = np.nonzero(label >= 0)[0]
        seen = np.full((len(known), k), (1 - trust) / (k - 1))
        seen[np.arange(len(known)), label[known]] = trust
        p[known] *= seen
    return p / p.sum(1, keepdims=True)


def _members(shared, name: str, sources: list[str], trust: float):
    """mapInPandas step: documents to sizes and posteriors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, (w, prior, sharp) = encoder(SparkFiles.get(name)), shared.value
        at = {s: i for i, s in enumerate(sources)}
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                some = pdf.iloc[a : a + 256]
                n, x = _features(enc, some["text"].tolist())
                label = np.array([at.get(v, -1) for v in some["label"]])
                p = posteriors(x @ w[:-1] + w[-1], label, prior, sharp, trust).astype(np.float32)
                filed = np.where(label >= 0, label, p.argmax(1))
                yield pd.DataFrame({"id": some["id"].to_numpy(), "filed": filed.astype(np.int32), "labelled": label >= 0, "tokens": n, "post": [v.tobytes() for v in p]})

    return run


def _rates(plan, filed: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Rates replayed from the steps so far; a step moves a rate by the product with its posterior, within its bounds."""
    begin, caps, steps = plan
    x, cap = begin[filed], caps[filed]
    for s in steps:
        x = np.clip(x - post @ s, 0.0, cap)
    return x


def _posts(pdf: pd.DataFrame, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["post"]), np.float32).reshape(-1, k).astype(np.float64)


def _totals(plan, k: int):
    """mapInPandas step: this task's token totals by posterior (row k) and by filed source (row k + 1), and its part
    of the Hessian (rows below k)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 2, k))
        for pdf in batches:
            if not len(pdf):
                continue
            filed, tokens, post = pdf["filed"].to_numpy(), pdf["tokens"].to_numpy().astype(np.float64), _posts(pdf, k)
            x = _rates(plan, filed, post)
            free = np.where((x > 0) & (x < plan[1][filed]), tokens, 0.0)
            total[:k] += (post * free[:, None]).T @ post
            total[k] += (x * tokens) @ post
            total[k + 1] += np.bincount(filed, x * tokens, minlength=k)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    return run


def _rated(plan, k: int):
    """mapInPandas step: documents with their rates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                filed = pdf["filed"].to_numpy()
                yield pdf[["id", "filed", "labelled", "tokens"]].assign(rate=np.round(_rates(plan, filed, _posts(pdf, k)), 9))

    return run


def _rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas step over documents sorted by source, block and falling size: whole copies, each rate rounded up or
    down. `owed` is what the documents of the block so far should have given and did not; a document is rounded
    up where at least half of it is owed."""
    block, owed = None, 0.0
    for pdf in batches:
        copies = np.floor(pdf["rate"].to_numpy()).astype(np.int64)
        keys, sizes, rates = list(zip(pdf["filed"].tolist(), pdf["block"].tolist())), pdf["tokens"].tolist(), pdf["rate"].tolist()
        for i, (key, t, x) in enumerate(zip(keys, sizes, rates)):
            if key != block:
                block, owed = key, 0.0
            part = x - int(copies[i])
            if part > 0:
                owed += part * t
                if t and owed >= t / 2:
                    copies[i] += 1
                    owed -= t
        yield pdf[["id", "filed", "labelled", "tokens", "rate"]].assign(copies=copies)


class Mix:
    """The result: `documents` (key, label, source, tokens, rate, copies), `sources`, one row a target, the steps that
    were made, the largest part of the mix by which an expected total misses its target, and whether that is
    within the tolerance."""

    def __init__(self, documents: DataFrame, sources: DataFrame, steps: int = 0, miss: float = 0.0):
        self.documents, self.sources, self.steps, self.miss = documents, sources, steps, miss
        self.converged = miss <= TOLERANCE


def _targets(targets: DataFrame) -> dict[str, dict]:
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("double").alias("cap"))
    one = wanted.filter("source is not null and weight > 0 and weight < double('infinity')").groupBy("source").agg(F.max(F.struct("weight", "cap")).alias("t"))
    rows = one.orderBy("source").limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    return {r["source"]: {"weight": r["t"]["weight"], "cap": np.inf if r["t"]["cap"] is None else max(0.0, r["t"]["cap"])} for r in rows}


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, path: str = TOKENIZER, trust: float = LABEL_TRUST) -> Mix:
    """Rates for all documents with a key and a text, null and unknown sources included.

    targets(source, weight, max_repeats): weights of zero or less and null sources are left out, of
    repeated sources the greatest weight counts; a null max_repeats is no cap. `total` is the size of the
    mix in tokens; by default SLACK times the largest at which every source that can give
    anything reaches its share. A target without documents, with empty texts only or with a cap of zero gets nothing and its
    share is spread over the others. A document is never used more often than the max_repeats of the source it is
    filed under: its label, or its likeliest source if it has none. Without a labelled document or
    a usable target all rates are zero. Of documents with one key each counts.
    """
    spark = docs.sparkSession
    goal = _targets(targets)
    names, file = list(goal), send(spark, path)
    known = F.when(source_name(source).isin(names), source_name(source)) if names else F.lit(None).cast("string")
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), known.alias("label")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    id_type = base.schema["id"].dataType.simpleString()

    by_hash = lambda *more: Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", *more)
    ids = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), known.alias("label")).filter("id is not null and label is not null")
    drawn: list = []
    if names:  # ids first, so that no text is sorted; at most SAMPLE texts a source, also where ids repeat
        chosen = ids.withColumn("r", F.row_number().over(by_hash())).filter(F.col("r") <= SAMPLE).select("id").distinct()
        train = base.join(F.broadcast(chosen), "id").filter("label is not null").withColumn("r", F.row_number().over(by_hash(F.xxhash64("text")))).filter(F.col("r") <= SAMPLE)
        drawn = train.select("label", "text").mapInPandas(_vectors(file), "label string, x binary").collect()
    present = sorted({r["label"] for r in drawn})
    k = len(present)
    if k == 0:
        sized = base.mapInPandas(_sizes(file), f"id {id_type}, tokens long")
        none_used = sized.select(F.col("id").alias(key), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("source"), "tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
        return Mix(none_used, spark.createDataFrame([_none(n, goal) for n in names], _REPORT))
    at = {n: i for i, n in enumerate(present)}
    drawn.sort(key=lambda r: (r["label"], bytes(r["x"])))
    vectors, y = np.stack([np.frombuffer(r["x"], np.float32) for r in drawn]), np.array([at[r["label"]] for r in drawn])
    turn = np.argsort(np.arange(len(y)) % 7, kind="stable")  # every fifth of this order is held out, from every source
    labels = docs.select(known.alias("label"), F.col(key).alias("id")).filter("id is not null and label is not null")  # no text is read for the frequencies
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a source
    prior = np.array([counts.get(n, 0) + 1.0 for n in present])
    shared = spark.sparkContext.broadcast((fit(vectors, y, k), prior / prior.sum(), sharpness(vectors[turn], y[turn], k)))
    table = written(base.mapInPandas(_members(shared, file, present, trust), f"id {id_type}, filed int, labelled boolean, tokens long, post binary"), "mix-members")

    caps = np.array([goal[n]["cap"] for n in present])
    held = {r["filed"]: r.asDict() for r in table.groupBy("filed").agg(F.count("*").alias("docs"), F.sum("tokens").cast("double").alias("tokens")).collect()}  # one row a source
    have = np.array([held[j]["tokens"] if j in held else 0.0 for j in range(k)])
    able = (have > 0) & (caps > 0)
    share = np.where(able, [goal[n]["weight"] for n in present], 0.0)
    share = share / (share.sum() or 1.0)
    reach = np.where(able, have * np.where(np.isfinite(caps), caps, 1.0), 0.0)
    bound = able & np.isfinite(caps)
    size = float(total) if total is not None else SLACK * float(min([*(reach[bound] / share[bound]), have[able].sum()]))
    want = share * size
    begin = np.minimum(np.divide(want, have, out=np.zeros(k), where=have > 0), caps)

    small, steps, since = table.select("filed", "tokens", "post"), [], 0
    best: tuple[float, int, np.ndarray] | None = None
    while True:
        sums = small.mapInPandas(_totals((begin, caps, list(steps)), k), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        got = np.zeros((k + 2, k))
        for i, j, v in sums.collect():  # k + 2 rows of k numbers
            got[i, j] = v
        miss = got[k] - want
        error = float(np.abs(miss).max()) / max(size, 1.0)
        since = 0 if best is None or error < 0.99 * best[0] else since + 1
        if best is None or error < best[0]:
            best = (error, len(steps), got[k:])
        if error <= TOLERANCE or since >= 5 or len(steps) == STEPS:
            break
        h = got[:k]
        steps.append(np.linalg.solve(h + 1e-6 * max(np.trace(h) / k, 1.0) * np.eye(k), miss))
    plan = (begin, caps, steps[: best[1]])

    blocks = F.element_at(F.array(*[F.lit(-(-held[j]["docs"] // BLOCK) if j in held else 1) for j in range(k)]), F.col("filed") + 1)
    rated = table.mapInPandas(_rated(plan, k), f"id {id_type}, filed int, labelled boolean, tokens long, rate double")
    dealt = rated.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "filed", "block").sortWithinPartitions("filed", "block", F.desc("tokens"), F.xxhash64("id"), "id")
    final = written(sorted_.mapInPandas(_rounded, f"id {id_type}, filed int, labelled boolean, tokens long, rate double, copies long"), "mix-rates")
    name = F.element_at(F.array(*map(F.lit, present)), F.col("filed") + 1)
    documents = final.select(F.col("id").alias(key), F.when(F.col("labelled"), name).alias("label"), name.alias("source"), "tokens", "rate", "copies")
    taken = {r["filed"]: r for r in final.groupBy("filed").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most")).collect()}  # one row a source
    soft, used = best[2]
    whole, drawn_all = used.sum() or 1.0, sum(r["drawn"] for r in taken.values()) or 1
    out = []
    for s in names:
        j = at.get(s)
        if j is None or j not in held:
            out.append(_none(s, goal))
            continue
        r = taken[j]
        out.append((s, goal[s]["weight"], float(share[j]), held[j]["docs"], int(have[j]), float(used[j]), float(used[j] / whole), float(soft[j] / whole), r["drawn"], r["drawn"] / drawn_all, r["most"]))
    return Mix(documents, spark.createDataFrame(out, _REPORT), best[1], best[0])


def _none(name: str, goal: dict) -> tuple:
    return (name, goal[name]["weight"], 0.0, 0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0)


_REPORT = "source string, weight double, target_share double, n_docs long, tokens long, expected_tokens double, expected_share double, posterior_share double, drawn_tokens long, drawn_share double, most_copies long"
