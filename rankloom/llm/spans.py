"""Problem 8: long exact spans shared between records, with a count-min prefilter.

A character is shared if a window of `length` characters around it stands verbatim in another
record. Three steps:

1. Every window is filed under its smallest hashed sub-window of `sub` characters (winnowing,
   Schleimer et al. 2003). Equal windows have equal smallest sub-windows, so counting those loses
   nothing, and there is about one for every hundred characters. Each task counts them in a
   count-min sketch saturated at two; the sketches are merged block by block.
2. A second pass over the texts keeps the stretches whose sub-window the sketch estimates at two
   records or more. The sketch only overestimates, so no repeated window is lost.
3. The kept stretches are grouped by sub-window and their windows compared exactly, by a second
   hash over all `length` characters; a window counts if two different records have it. Sub-windows
   with very many stretches (boilerplate in a third of all records) take another way to the same
   result: their windows become rows and are counted with map-side aggregation, so that no task
   ever holds such a group.

The width of the sketch follows the input, so the part of the stretches that it lets through by mistake does
not grow. Up to `MOST_BITS` counters a row the merged sketch is small enough to be sent to every task. A
wider one stays spread over the cluster: each task's counts are merged by slot in a shuffle, the stretches
are filtered by a join on the slot, and only texts with a kept stretch are read once more. Both ways
keep every repeated window, so the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.runtime import small, written

LENGTH = 300
SUB = 100
DEPTH = 3
#: Counters in a row of the sketch, as a power of two: the least, and the most that are sent to every task.
LEAST_BITS, MOST_BITS = 20, 28
#: The sketch that stays spread has a single row, wider by this power of two.
WIDER = 3
#: Shares the windows of a hot sub-window are dealt into where they are joined.
SALTS = 16
BLOCK = 1 << 16
#: Sub-windows with more stretches than this are counted as rows.
HOT = 20_000
#: Characters hashed at a time.
CHUNK = 1 << 18
#: Starts in one stretch at most; longer ones (periodic text) are cut.
STRETCH = 1024

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = z ^ np.uint64(salt)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        n = max(n, CHUNK * 2)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + 1, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def _rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every run of `width` codes; the same for equal runs wherever they stand."""
    n = len(codes)
    p, inverse = _power(base, n)
    with np.errstate(over="ignore"):
        terms = (codes + np.uint64(base >> 17)) * np.uint64(0xD6E8FEB86659FD93)
        terms *= p[:n]
        prefix = np.empty(n + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(terms, out=prefix[1:])
        out = prefix[width:] - prefix[:-width]
        out *= inverse[: len(out)]
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def stretches(texts: list[str], length: int = LENGTH, sub: int = SUB) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, sub-window) of every run of windows with one smallest sub-window."""
    found = []
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    usable = np.nonzero(sizes >= length)[0]
    begin = 0
    while begin < len(usable):
        end, total = begin, 0
        while end < len(usable) and (end == begin or total + sizes[usable[end]] <= CHUNK):
            total += sizes[usable[end]]
            end += 1
        some = usable[begin:end]
        begin = end
        codes = _codes("".join(texts[i] for i in some))
        least = _least(_mix(_rolling(codes, sub, _B1)), length - sub + 1)
        offset = np.concatenate([[0], np.cumsum(sizes[some])])
        valid = np.zeros(len(least) + 1, dtype=bool)
        for a, b in zip(offset[:-1], offset[1:]):
            valid[a : b - length + 1] = True
        starts = np.zeros(len(least), dtype=bool)
        starts[0] = True
        starts[1:] = least[1:] != least[:-1]
        starts[offset[:-1][offset[:-1] < len(least)]] = True
        starts &= valid[:-1]
        s = np.nonzero(starts)[0]
        owner = np.searchsorted(offset, s, side="right") - 1
        last = np.minimum(np.append(s[1:] - 1, len(least) - 1), offset[owner + 1] - length)
        found.append((some[owner], s - offset[owner], last - offset[owner], least[s]))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    text, first, last, value = (np.concatenate(x) for x in zip(*found))
    while len(first) and (long := last - first >= STRETCH).any():
        cut_t, cut_f, cut_l, cut_v = text[long], first[long] + STRETCH, last[long], value[long]
        last = np.where(long, first + STRETCH - 1, last)
        text, first, last, value = (np.concatenate(x) for x in ((text, cut_t), (first, cut_f), (last, cut_l), (value, cut_v)))
    return text, first, last, value


def _slots(value: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(value, 0xA5A5 + 977 * d) >> np.uint64(64 - bits)).astype(np.int64) for d in range(DEPTH)]


def _added(slots: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots with counts saturated at two, after `more` slots."""
    every = np.concatenate([slots, *more])
    weight = np.concatenate([counts, *[np.ones(len(x), np.uint8) for x in more]])
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    head = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0] if len(every) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    return every[head], np.minimum(total, 2).astype(np.uint8)


def _sketch(length: int, sub: int, bits: int):
    """mapInPandas step: texts to the blocks of this task's sketch, as two bit planes. The task holds its own
    counters only, not the whole width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = [(np.zeros(0, np.int64), np.zeros(0, np.uint8)) for _ in range(DEPTH)]
        waiting: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        size = 0
        for pdf in batches:
            text, _, _, value = stretches(pdf["text"].tolist(), length, sub)
            if not len(value):
                continue
            order = np.lexsort((value, text))
            new = np.ones(len(order), dtype=bool)  # a record counts once for a sub-window
            new[1:] = (value[order][1:] != value[order][:-1]) | (text[order][1:] != text[order][:-1])
            for d, slot in enumerate(_slots(value[order][new], bits)):
                waiting[d].append(slot)
            size += int(new.sum())
            if size > 1 << 20:
                have = [_added(*h, w) for h, w in zip(have, waiting)]
                waiting, size = [[] for _ in range(DEPTH)], 0
        block = min(BLOCK, 1 << bits)
        for d, (slots, counts) in enumerate(_added(*h, w) for h, w in zip(have, waiting)):
            edges = np.nonzero(np.concatenate([[True], slots[1:] // block != slots[:-1] // block]))[0] if len(slots) else []
            for a, z in zip(edges, [*edges[1:], len(slots)]):
                planes = np.zeros((2, block), dtype=bool)
                at = slots[a:z] % block
                planes[0, at] = True
                planes[1, at] = counts[a:z] > 1
                yield pd.DataFrame({"row": [d], "block": [int(slots[a] // block)], "planes": [zlib.compress(np.packbits(planes, axis=1).tobytes(), 1)]})

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas step over blocks partitioned by (row, block): merges as they come, so it holds one
    pair of planes a block and not the blocks of all tasks."""
    have: dict[tuple[int, int], list[np.ndarray]] = {}
    for pdf in batches:
        for d, b, planes in pdf.itertuples(index=False):
            once, twice = np.frombuffer(zlib.decompress(planes), dtype=np.uint8).reshape(2, -1)
            old = have.get((d, b))
            if old is None:
                have[(d, b)] = [once.copy(), twice.copy()]
            else:
                old[1] |= twice | (old[0] & once)
                old[0] |= once
    for (d, b), (_, twice) in have.items():
        if twice.any():
            yield pd.DataFrame({"row": [d], "block": [b], "planes": [zlib.compress(twice.tobytes(), 1)]})


_PLANES = "row int, block int, planes binary"


def repeated_sketch(texts: DataFrame, bits: int, length: int = LENGTH, sub: int = SUB) -> list[np.ndarray]:
    """The merged sketch as a bit set a row: set where two records or more were counted. Its size is
    DEPTH * 2 ** bits / 8 bytes whatever the input."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.mapInPandas(_sketch(length, sub, bits), _PLANES).repartition(min(n, DEPTH * max(1, (1 << bits) // BLOCK)), "row", "block")
    planes = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(DEPTH)]
    size = min(BLOCK, 1 << bits) // 8
    for d, b, data in blocks.mapInPandas(_merge, _PLANES).toLocalIterator():
        planes[d][b * size : (b + 1) * size] = np.frombuffer(zlib.decompress(bytes(data)), dtype=np.uint8)
    return planes


def _estimated(planes: list[np.ndarray], value: np.ndarray, bits: int) -> np.ndarray:
    keep = np.ones(len(value), dtype=bool)
    for plane, slot in zip(planes, _slots(value, bits)):
        keep &= (plane[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return keep


def _keep(shared, length: int, sub: int, bits: int):
    """mapInPandas step: texts to the stretches estimated repeated, with their characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = shared.value
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["id"].to_numpy()
            text, first, last, value = stretches(texts, length, sub)
            keep = _estimated(planes, value, bits)
            text, first, last, value = text[keep], first[keep], last[keep], value[keep]
            if len(text):
                part = [texts[t][a : b + length] for t, a, b in zip(text.tolist(), first.tolist(), last.tolist())]
                yield pd.DataFrame({"m": value.view(np.int64), "id": ids[text], "first": first, "part": part})

    return run


def _slot(value: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(value, 0xA5A5) >> np.uint64(64 - bits)).astype(np.int64)


def _local_counts(length: int, sub: int, bits: int):
    """mapInPandas step: texts to the counters this batch sets in a sketch of one row: (slot, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, _, _, value = stretches(pdf["text"].tolist(), length, sub)
            if len(value):
                pair = np.unique(np.stack([text, _slot(value, bits)], 1), axis=0)  # a record counts once
                slot, n = np.unique(pair[:, 1], return_counts=True)
                yield pd.DataFrame({"slot": slot, "n": np.minimum(n, 2)})

    return run


def _places(length: int, sub: int, bits: int):
    """mapInPandas step: texts to the places of their stretches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, first, last, value = stretches(pdf["text"].tolist(), length, sub)
            if len(text):
                yield pd.DataFrame({"slot": _slot(value, bits), "m": value.view(np.int64), "id": pdf["id"].to_numpy()[text], "t": pdf["t"].to_numpy()[text], "first": first, "last": last})

    return run


def _cut(length: int):
    """mapInPandas step: texts with the places of their kept stretches to those stretches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p["m"], i, p["first"], text[p["first"] : p["last"] + length]) for i, text, places in zip(pdf["id"], pdf["text"], pdf["places"]) for p in places]
            if rows:
                yield pd.DataFrame(rows, columns=["m", "id", "first", "part"])

    return run


def _kept_wide(rows: DataFrame, bits: int, length: int, sub: int, kind: str) -> DataFrame:
    """The stretches a sketch of 2 ** bits counters estimates repeated, the sketch staying spread over the cluster."""
    counts = rows.select("text").mapInPandas(_local_counts(length, sub, bits), "slot long, n long")
    many = written(counts.groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").select("slot"), "span-slots")
    known = rows.select("id", F.xxhash64("text").alias("t"), "text")
    places = known.mapInPandas(_places(length, sub, bits), f"slot long, m long, id {kind}, t long, first int, last int").join(many, "slot", "left_semi")
    own = places.groupBy("id", "t").agg(F.array_distinct(F.collect_list(F.struct("m", "first", "last"))).alias("places"))  # a text's own stretches
    return known.join(own, ["id", "t"]).mapInPandas(_cut(length), f"m long, id {kind}, first int, part string")


def _windows(parts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start in it, hash) of every window of `length` characters."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    rows, at, out = [], [], []
    begin = 0
    while begin < len(parts):
        end, total = begin, 0
        while end < len(parts) and (end == begin or total + sizes[end] <= CHUNK):
            total += sizes[end]
            end += 1
        value = _rolling(_codes("".join(parts[begin:end])), length, _B2)
        offset = np.concatenate([[0], np.cumsum(sizes[begin:end])])
        n = sizes[begin:end] - length + 1
        row = np.repeat(np.arange(end - begin), n)
        start = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        rows.append(row + begin)
        at.append(start)
        out.append(value[offset[row] + start])
        begin = end
    return np.concatenate(rows), np.concatenate(at), np.concatenate(out)


def _compare(length: int):
    """mapInPandas step over stretches sorted by sub-window: the intervals of characters that another
    record has as well. Only the last, unfinished group is carried over."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame | None:
        row, at, value = _windows(pdf["part"].tolist(), length)
        with np.errstate(over="ignore"):
            value = _mix(value ^ _mix(pdf["m"].to_numpy().view(np.uint64), 77)[row])
        doc = pd.factorize(pdf["id"])[0][row]
        order = np.argsort(value, kind="stable")
        head = np.ones(len(order), dtype=bool)
        head[1:] = value[order][1:] != value[order][:-1]
        start = np.nonzero(head)[0]
        many = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
        good = np.zeros(len(order), dtype=bool)
        good[order] = np.repeat(many, np.diff(np.append(start, len(order))))
        if not good.any():
            return None
        edge = np.ones(len(good) + 1, dtype=bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (good[1:] != good[:-1])
        cut = np.nonzero(edge)[0]
        a, b = cut[:-1], cut[1:] - 1
        a, b = a[good[a]], b[good[a]]
        base = pdf["first"].to_numpy()[row[a]]
        return pd.DataFrame({"id": pdf["id"].to_numpy()[row[a]], "span_start": base + at[a], "span_end": base + at[b] + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["m"].iloc[-1]
            done = pdf[pdf["m"] != last]
            if len(done) and (out := solve(pd.concat([*rest, done], ignore_index=True))) is not None:
                yield out
            rest = [pdf[pdf["m"] == last]] if len(done) else [*rest, pdf]
            if not len(done) and len(rest) > 1 and rest[0]["m"].iloc[-1] != last:
                if (out := solve(pd.concat(rest[:-1], ignore_index=True))) is not None:
                    yield out
                rest = rest[-1:]
        if rest and (out := solve(pd.concat(rest, ignore_index=True))) is not None:
            yield out

    return run


def _as_rows(length: int):
    """mapInPandas step: stretches to one row a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                some = pdf.iloc[a : a + 200]
                row, at, value = _windows(some["part"].tolist(), length)
                yield pd.DataFrame({"h": value.view(np.int64), "id": some["id"].to_numpy()[row], "span_start": some["first"].to_numpy()[row] + at})

    return run


def sketch_bits(df: DataFrame) -> int:
    """Counters in a row of the sketch, from the size Spark estimates for the input's files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(60 - WIDER, max(LEAST_BITS, (size // 16).bit_length())))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching intervals (id, span_start, span_end) joined into maximal ones."""
    order = Window.partitionBy("id").orderBy("span_start", "span_end")
    before = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("span_start") <= before, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("run")


def kept_stretches(rows: DataFrame, length: int = LENGTH, sub: int = SUB, bits: int | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """rows(id, text) to the stretches (m, id, first, part) estimated repeated, written."""
    bits = sketch_bits(rows) if bits is None else bits
    kind = rows.schema["id"].dataType.simpleString()
    if bits > most_bits:
        return written(_kept_wide(rows, bits + WIDER, length, sub, kind), "span-stretches")
    planes = rows.sparkSession.sparkContext.broadcast(repeated_sketch(rows.select("text"), bits, length, sub))
    return written(rows.mapInPandas(_keep(planes, length, sub, bits), f"m long, id {kind}, first int, part string"), "span-stretches")


def shared_spans(df: DataFrame, key: str, text: str, length: int = LENGTH, sub: int = SUB, hot: int = HOT, bits: int | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, span_start, span_end): maximal runs of shared characters, from 0, end exclusive.

    Rows with a null key or a null text are left out; texts shorter than `length` share nothing; a
    record delivered twice under one key is one record and shares nothing with itself. Positions are
    code points. A text of any length is read whole.
    """
    if not 0 < sub <= length:
        raise ValueError("sub must be between 1 and length")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= length))
    kind = rows.schema["id"].dataType.simpleString()
    kept = kept_stretches(rows, length, sub, bits, most_bits)
    stats = written(kept.groupBy("m").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("m", "n"), "span-groups")
    crowd = stats.filter(F.col("n") > hot).select("m")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = f"id {kind}, span_start int, span_end int"
    if crowd.isEmpty():
        calm, crowded = kept, None
    else:
        few = F.broadcast(crowd) if small(crowd) else crowd
        calm = kept.join(few, "m", "left_anti")  # what is shuffled by sub-window below is at most `hot` rows a key
        windows = kept.join(few, "m", "left_semi").mapInPandas(_as_rows(length), f"h long, id {kind}, span_start int")
        many = windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi")
        many = many.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = windows.withColumn("salt", F.pmod(F.xxhash64("id", "span_start"), F.lit(SALTS)).cast("int"))
        crowded = salted.join(many, ["h", "salt"]).select("id", "span_start", (F.col("span_start") + length).alias("span_end"))
    some = calm.join(stats.filter(F.col("n") <= hot).select("m"), "m")
    cold = some.select("m", "id", "first", "part").repartition(n, "m").sortWithinPartitions("m").mapInPandas(_compare(length), out)
    spans = merge_spans(cold if crowded is None else cold.unionByName(crowded))
    return spans.select(F.col("id").alias(key), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


def shared_shares(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row a key: (key, n_chars, shared_chars, n_spans, share). A null text has no characters; the
    share of an empty text is null. A key with several texts counts its longest."""
    spans = written(shared_spans(df, key, text, **options), "spans")
    total = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars"))
    zero = F.lit(0).cast("long")
    return sizes.join(total, key, "left").select(
        key, "n_chars", F.coalesce("shared_chars", zero).alias("shared_chars"), F.coalesce("n_spans", zero).alias("n_spans"), F.try_divide(F.coalesce("shared_chars", zero), F.col("n_chars")).alias("share")
    )
