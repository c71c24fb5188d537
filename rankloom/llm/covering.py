"""Problem 4: near duplicates by covering locality-sensitive hashing.

A text is the set of its distinct words in the one form of problem 5. Two sets A and B with a
Jaccard similarity of at least J differ in at most (|A| + |B|) (1 - J) / (1 + J) words. Words are
the dimensions of a binary vector, so this is a Hamming radius r, and the construction of Pagh
(2016) applies: every dimension gets a random vector f(w) of q + 1 bits, and for every non-zero
mask v of q + 1 bits, table v hashes the words with an odd product f(w)·v. At most q differing
dimensions span at most q of the q + 1 directions, so some v is orthogonal to all of them and the
two sets agree in table v. A radius above q is split: the dimensions are dealt into
ceil((r + 1) / (q + 1)) parts, of which one has at most q differing words. No pair within the
radius is lost; every candidate is then checked exactly.

Sets are banded by size so that each band has its own radius. Equal sets are one class and enter
once. Rows carry 64 parity bits of their set, whose distance never exceeds the
sets' own, so most pairs of a bucket are dismissed on the spot. Buckets that stay large are dealt again
by a second, independent family, which is covering as well, so the candidates within the radius stay
complete while the bucket falls apart. What is still large after the last family is cut into blocks, and
every two blocks are compared in a task's bounded share of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.lookalike import folded, one_form
from rankloom.runtime import Written, written

SIMILARITY = 0.8
#: Radius covered by one part's masks; 2 ** (q + 1) - 1 tables a part.
Q = 2
#: Buckets with more classes than this are dealt again by a further family.
HOT_BUCKET = 256
#: Families applied one after the other to buckets that stay hot.
FAMILIES = 3
#: Keys a block of a class holds; a task's pairs of two blocks are at most this number squared.
BLOCK = 1000


def words_of(form: Column) -> Column:
    """The distinct words of a text in one form, case ignored: maximal runs of letters and digits.
    Letters that look alike as capitals are one letter, as case is ignored."""
    return F.array_distinct(F.regexp_extract_all(folded(form), F.lit(r"([\p{L}\p{N}]+)"), 1))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), salted."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bands(similarity: float, most: int = 1 << 40) -> list[int]:
    """Lower ends of size bands; a set can only pair with sets of its own or a neighbouring band."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / similarity)))
    return out


def keys_of(words: list[np.ndarray], radius: np.ndarray, group: np.ndarray, family: int, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every table of every set. radius and group: by row. Sets with the same group
    share their tables."""
    n = np.array([len(w) for w in words])
    flat = np.concatenate(words).astype(np.int64).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(words)), n)
    parts = np.maximum(1, -(-(radius + 1) // (q + 1)))
    base = _mix(flat, 7 * family) ^ _mix(group[row].astype(np.uint64), 7 * family + 1)
    base = _mix(base, 7 * family + 2)
    part = ((base >> np.uint64(32)) % parts[row].astype(np.uint64)).astype(np.int64)
    vector = base & np.uint64((1 << (q + 1)) - 1)
    value = _mix(flat, 7 * family + 3)
    first = np.concatenate([[0], np.cumsum(parts)])
    slot = first[row] + part
    order = np.argsort(slot, kind="stable")
    slot, vector, value = slot[order], vector[order], value[order]
    slots = int(first[-1])
    start = np.searchsorted(slot, np.arange(slots))
    owner = np.repeat(np.arange(len(words)), parts)
    rows, out = [], []
    with np.errstate(over="ignore"):
        for v in range(1, 1 << (q + 1)):
            bits = vector & np.uint64(v)
            odd = np.bitwise_count(bits) & 1
            kept = np.where(odd == 1, value, np.uint64(0))
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept, dtype=np.uint64)])
            end = np.append(start[1:], len(kept))
            sums = run[end] - run[start]
            table = (np.arange(slots) - first[owner]).astype(np.uint64) * np.uint64(1 << (q + 1)) + np.uint64(v)
            out.append(_mix(sums ^ _mix(table, 7 * family + 4) ^ _mix(group[owner].astype(np.uint64), 7 * family + 5), 7 * family + 6))
            rows.append(owner)
    return (np.concatenate(rows), np.concatenate(out).view(np.int64)) if rows else (np.zeros(0, int), np.zeros(0, np.int64))


def _parity(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """64 parity bits a set: every word flips one. Two sets that differ in d words differ in at most d bits."""
    bit = (_mix(flat, 11) >> np.uint64(58)).astype(np.int64)
    odd = np.bincount(row * 64 + bit, minlength=n * 64).reshape(n, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _emit(similarity: float, family: int, hashed: str):
    """mapInPandas step: (cls, words, space hash[, bucket, low]) to one row a set and table. low: the set is in
    the lower band of the group. A given bucket is dealt again: the new one lies within it."""
    ends = bands(similarity)
    slack = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            words = [np.asarray(w, dtype=np.int64) for w in pdf["words"]]
            n = np.array([len(w) for w in words])
            parity = _parity(np.concatenate(words).view(np.uint64), np.repeat(np.arange(len(n)), n), len(n)).view(np.int64)
            space, cls = pdf[hashed].to_numpy(dtype=np.int64), pdf["cls"].to_numpy()
            own = np.searchsorted(ends, n, side="right") - 1
            for up in (False, True):
                pick = np.nonzero(pdf["low"].to_numpy() == up)[0] if "low" in pdf else np.arange(len(words))
                if not len(pick):
                    continue
                top = own[pick] + up
                largest = np.array([ends[t + 1] - 1 for t in top])
                # one radius a group, so that all its sets share their tables
                radius = np.floor(2 * largest * slack + 1e-9).astype(np.int64)
                group = _mix(space[pick], 1) ^ _mix(top.astype(np.uint64), 2)
                row, bucket = keys_of([words[i] for i in pick], radius, group, family)
                at = pick[row]
                if "bucket" in pdf:
                    bucket = _mix(bucket ^ pdf["bucket"].to_numpy(dtype=np.int64)[at], 3).view(np.int64)
                yield pd.DataFrame({"bucket": bucket, "low": np.full(len(row), up), "cls": cls[at], "size": n[at].astype(np.int32), "parity": parity[at]})

    return run


_EMITTED = "bucket long, low boolean, cls long, size int, parity long"
_MATCHED = "bucket long, low boolean, a long, b long, size int, parity long"


def _match(similarity: float, hot: int | None):
    """mapInPandas step over rows sorted by bucket: pairs (a, b) of each bucket that sizes and parities allow;
    rows of buckets with more than `hot` sets are passed on as (bucket, low, a, null, size, parity). At most one
    bucket of `hot` rows is carried from batch to batch. Without `hot` every bucket is compared."""
    slack = (1 - similarity) / (1 + similarity)

    def pairs(x: dict) -> pd.DataFrame:
        i, d, found_a, found_b = np.arange(len(x["bucket"]) - 1), 1, [], []
        while len(i := i[i + d < len(x["bucket"])]):
            i = i[x["bucket"][i] == x["bucket"][i + d]]
            j = i + d
            small_, large = np.minimum(x["size"][i], x["size"][j]), np.maximum(x["size"][i], x["size"][j])
            far = np.bitwise_count((x["parity"][i] ^ x["parity"][j]).view(np.uint64))
            good = (small_ + 1e-9 >= similarity * large) & (far <= (small_ + large) * slack + 1e-9) & ~(x["low"][i] & x["low"][j]) & (x["cls"][i] != x["cls"][j])
            found_a.append(np.minimum(x["cls"][i[good]], x["cls"][j[good]]))
            found_b.append(np.maximum(x["cls"][i[good]], x["cls"][j[good]]))
            d += 1
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        both = np.unique(np.stack([a, np.concatenate(found_b) if found_b else a], 1), axis=0)
        none = np.zeros(len(both), np.int64)
        return pd.DataFrame({"bucket": none, "low": none > 0, "a": both[:, 0], "b": pd.array(both[:, 1], dtype="Int64"), "size": none.astype(np.int32), "parity": none})

    def passed(x: dict, keep: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bucket": x["bucket"][keep], "low": x["low"][keep], "a": x["cls"][keep], "b": pd.array([None] * int(keep.sum()), dtype="Int64"), "size": x["size"][keep], "parity": x["parity"][keep]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict | None = None
        crowded: int | None = None  # the bucket being passed on
        for pdf in batches:
            x = {c: pdf[c].to_numpy() for c in ("bucket", "low", "cls", "size", "parity")}
            if crowded is not None:
                more = x["bucket"] == crowded
                if more.any():
                    yield passed(x, more)
                    x = {c: v[~more] for c, v in x.items()}
            if not len(x["bucket"]):
                continue
            crowded = None
            if rest is not None:
                x = {c: np.concatenate([rest[c], v]) for c, v in x.items()}
            head = np.concatenate([[True], x["bucket"][1:] != x["bucket"][:-1]])
            size = np.diff(np.append(np.nonzero(head)[0], len(head)))
            of = np.repeat(size, size)
            wide = of > hot if hot is not None else np.zeros(len(of), bool)
            last = x["bucket"] == x["bucket"][-1]
            if wide.any():
                yield passed(x, wide)
                if wide[-1]:
                    crowded = x["bucket"][-1]
            done = ~wide & ~last & (of > 1)
            if done.any():
                yield pairs({c: v[done] for c, v in x.items()})
            rest = {c: v[last] for c, v in x.items()} if crowded is None else None
        if rest is not None:
            yield pairs(rest)

    return run


def word_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(space, key, words array<string>) to classes(space, cls, words array<long>, n) and
    members(space, cls, key, stored). A class is one set of words; rows without words are left out."""
    hashed = (
        rows.filter(F.size("words") > 0)
        .select("space", "key", "stored", F.array_sort(F.transform("words", lambda w: F.xxhash64(w))).alias("words"))
        .select("space", "key", "stored", F.xxhash64("space", "words").alias("cls"), "words")
    )
    keep = Written(hashed, "near-rows").df
    members = keep.select("space", "cls", "key", "stored").distinct()
    classes = keep.groupBy("cls").agg(F.first("space").alias("space"), F.first("words").alias("words"))
    return classes, members


def _blocks(crowded: DataFrame, hot: int) -> DataFrame:
    """Rows of buckets that are still large, once for every pair of blocks of about `hot` rows that theirs is in;
    a pair of blocks is a bucket of its own."""
    sized = crowded.groupBy("bucket").agg(F.ceil(F.count("*") / hot).cast("int").alias("n"))
    rows = crowded.join(sized, "bucket").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return met.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "low", "cls", "size", "parity")


def candidates(classes: DataFrame, similarity: float = SIMILARITY, hot: int = HOT_BUCKET, families: int = FAMILIES) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that share a bucket of the covering family and whose sizes and parity
    bits do not rule the similarity out; a superset of the pairs within it. Repeated across tables. Rows are
    shuffled once a family, by bucket. A bucket of more than `hot` sets is dealt again by up to `families`
    further families, then cut into blocks, so no task compares more than a few times `hot` rows at once."""
    base = classes.select("cls", "words", F.xxhash64("space").alias("space_h"))
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted, found, cut = base.mapInPandas(_emit(similarity, 0, "space_h"), _EMITTED), None, False
    for family in range(families + 2):
        sorted_ = emitted.repartition(n, "bucket").sortWithinPartitions("bucket")
        table = Written(sorted_.mapInPandas(_match(similarity, None if cut else hot), _MATCHED), "near-matches").df
        pairs = table.filter("b is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = table.filter("b is null").select("bucket", "low", F.col("a").alias("cls"), "size", "parity")
        if cut or crowded.isEmpty():
            break
        cut = family == families
        emitted = _blocks(crowded, hot) if cut else crowded.select("bucket", "low", "cls").join(base, "cls").mapInPandas(_emit(similarity, family + 1, "space_h"), _EMITTED)
    return found


def class_links(classes: DataFrame, similarity: float = SIMILARITY, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs of different classes with a Jaccard similarity of at least `similarity`, checked exactly."""
    pairs = candidates(classes, similarity, hot).distinct()
    a = classes.select(F.col("cls").alias("a"), F.col("words").alias("wa"))
    b = classes.select(F.col("cls").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    union = F.size("wa") + F.size("wb") - shared
    return pairs.join(a, "a").join(b, "b").filter(shared >= F.lit(similarity) * union - 1e-9).select("a", "b")


def near_rows(df: DataFrame, key: str, text: str, space: str) -> DataFrame:
    """(space, key, stored, words) of the rows with a key and a text, stored being a hash of the text as it is. A
    key delivered again with the same text is dropped later, by its class, so no text is shuffled."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")).filter(F.col("key").isNotNull() & F.col("t").isNotNull())
    return rows.select(F.lit(space).alias("space"), "key", F.md5("t").alias("stored"), words_of(one_form("t")).alias("words"))


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY, hot: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(space, key, stored, words) to classes, members and links between classes (a, b)."""
    classes, members = word_classes(rows)
    classes = written(classes, "near-classes")
    return classes, members, written(class_links(classes, similarity, hot), "near-links")


def near_pairs(rows: DataFrame, similarity: float = SIMILARITY, hot: int = HOT_BUCKET, expand: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of keys (space, key_a, key_b), key_a < key_b, of rows whose word sets reach the similarity.

    Null keys, null texts and texts without words give no pair. Equal word sets under different keys
    are pairs. All pairs are given, unless `expand` is: then more than so many keys of exactly the same stored
    text are a star, their smallest key with every other one, and it alone stands for that text in other pairs.
    Keys of a class are dealt into blocks of about `block`; a pair of blocks is one key of the join.
    """
    _, members, links = near_duplicates(rows, similarity, hot)
    star = None
    if expand is not None:
        copies = members.groupBy("cls", "stored").agg(F.count("*").alias("n"), F.min("key").alias("rep")).filter(F.col("n") > expand)
        m = members.join(copies, ["cls", "stored"], "left")
        star = m.filter(F.col("key") != F.col("rep")).select("space", F.col("rep").alias("x"), F.col("key").alias("y"))
        members = m.filter(F.col("rep").isNull() | (F.col("key") == F.col("rep")))
    keys = members.select("space", "cls", "key").distinct()
    sized = keys.groupBy("cls").agg(F.count("*").alias("size")).withColumn("n", F.ceil(F.col("size") / block).cast("int"))
    own = sized.filter("size > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    n_a, n_b = sized.select(F.col("cls").alias("a"), F.col("n").alias("n_a")), sized.select(F.col("cls").alias("b"), F.col("n").alias("n_b"))
    met = links.select("a", "b").unionByName(own).join(n_a, "a").join(n_b, "b")
    at = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = met.withColumn("i", at("n_a")).withColumn("j", at("n_b")).filter("a <> b or i <= j").select("a", "i", "b", "j")
    dealt = keys.join(sized, "cls").select("space", "cls", F.pmod(F.xxhash64("key"), F.col("n")).cast("int").alias("k"), "key")
    left = met.join(dealt.select("space", F.col("cls").alias("a"), F.col("k").alias("i"), F.col("key").alias("x")), ["a", "i"])
    right = met.join(dealt.select(F.col("cls").alias("b"), F.col("k").alias("j"), F.col("key").alias("y")), ["b", "j"])
    pairs = left.join(right, ["a", "i", "b", "j"]).filter("x <> y and (a <> b or i <> j or x < y)").select("space", "x", "y")
    pairs = pairs if star is None else pairs.unionByName(star)
    return pairs.select("space", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 1000) -> DataFrame:
    """(cls, root): the smallest class id of every connected component, by alternating large-star and
    small-star steps (Kiveris et al. 2014) on written tables, until nothing changes; about the square of the
    logarithm of the number of classes. More than `rounds` steps are an error. No link reaches the driver."""
    edges = Written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "near-edges")
    before = None
    for _ in range(rounds):
        both = edges.df.select("u", "v").unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = Written(step, "near-edges")
        state = new.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        edges.drop()
        edges = new
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    root = edges.df.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("cls").join(root, nodes["cls"] == root["u"], "left").select("cls", F.coalesce("root", "cls").alias("root"))


def near_groups(rows: DataFrame, similarity: float = SIMILARITY, hot: int = HOT_BUCKET) -> DataFrame:
    """One row per key with words: (space, key, class_id, n_copies, n_links, group_id).

    class_id: the smallest key of the rows with the same word set; n_copies: how many keys it has;
    n_links: other classes within the similarity; group_id: the smallest key of the connected group.
    """
    classes, members, links = near_duplicates(rows, similarity, hot)
    members = members.select("space", "cls", "key").distinct()
    sized = members.groupBy("space", "cls").agg(F.count("*").alias("n_copies"), F.min("key").alias("class_id"))
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    degree = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    info = sized.join(components(classes, links), "cls").join(degree, "cls", "left")
    root = info.groupBy("space", "root").agg(F.min("class_id").alias("group_id"))
    full = info.join(root, ["space", "root"]).select("cls", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id")
    return members.join(full, "cls").select("space", "key", "class_id", "n_copies", "n_links", "group_id")
