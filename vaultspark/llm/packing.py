"""Filling fixed-capacity containers (problem 8) by linear grouping.

Sizes are whole numbers up to the capacity, so a histogram of sizes has at most `capacity` rows whatever the number of
items. Everything that needs a global view is planned on that histogram; items then find their container by their rank
among the items of their size, which is computed in parallel. Neither items nor containers ever meet on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vaultspark.llm.tokenizer import VOCABULARY, token_count
from vaultspark.session import cut

CAPACITY = 2048
#: Large sizes are rounded up within so many groups of equal cardinality; the plan with the fewest containers counts.
GROUPS = (48, 64, 80)
#: Items up to capacity / SMALL are small: they are filled in by best fit.
SMALL = 3


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of greatest total value that fits: (value, number of each size). Unbounded knapsack."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for w in range(int(s[0]), capacity + 1):
        best[w] = best[w - 1]
        fits = int(np.searchsorted(s, w, "right"))
        total = best[w - s[:fits]] + v[:fits]
        k = int(total.argmax())
        if total[k] > best[w] + 1e-12:
            best[w], choice[w] = total[k], k
    counts, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[order[choice[w]]] += 1
            w -= int(s[choice[w]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns with multiplicities that cover the demand of a few sizes: column generation, rounded down, rest by first fit."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # a pattern per column
    cost = np.ones(k)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, cost)
        value, pattern = best_pattern(dual, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    x = np.linalg.solve(basis, demand.astype(float))
    left, chosen = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // pattern[used]).min()))
        if times > 0:
            chosen.append((pattern, times))
            left -= pattern * times
    rest: list[tuple[int, np.ndarray]] = []  # the few items that rounding down left over: space and pattern per container
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            for n, (space, pattern) in enumerate(rest):
                if space >= sizes[i]:
                    pattern[i] += 1
                    rest[n] = (space - int(sizes[i]), pattern)
                    break
            else:
                pattern = np.zeros(k, np.int64)
                pattern[i] = 1
                rest.append((capacity - int(sizes[i]), pattern))
    return chosen + [(pattern, 1) for _, pattern in rest]


def plan(histogram: dict[int, int], capacity: int, groups: int, small: int | None = None) -> np.ndarray:
    """Rows (size, rank, n, container, place, offset): the items of that size with ranks rank .. rank + n - 1 go, one each, into
    the containers container .. container + n - 1, as number place, at that offset. Sorted by size and rank; every rank of
    every size is covered once. The number of rows depends on the capacity and the groups, not on the number of items.
    """
    small = capacity // SMALL if small is None else small
    hist = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        hist[s] = n
    rows: list[tuple[int, int, int, int, int, int]] = []
    container = 0
    if hist[capacity]:
        rows.append((capacity, 0, int(hist[capacity]), 0, 0, 0))
        container = int(hist[capacity])
    free: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by space: (first container, n, items inside)

    large = [s for s in range(capacity - 1, small, -1) if hist[s]]
    if large:
        ends = np.cumsum(hist[large])  # of each size in the order of falling sizes
        starts = ends - hist[large]
        total = int(ends[-1])
        size_at = lambda r: large[int(np.searchsorted(ends, r, "right"))]
        cuts = sorted({total * g // groups for g in range(groups)})
        cuts = [c for i, c in enumerate(cuts) if i == 0 or size_at(c) < size_at(cuts[i - 1])]  # a size that fills groups is one group
        bounds = [*cuts, total]
        g_size = np.array([size_at(b) for b in bounds[:-1]])
        g_n = np.diff(bounds)
        taken = np.array(bounds[:-1], np.int64)
        for pattern, times in configurations(g_size, g_n, capacity):
            slots = [(g, j) for g in range(len(g_n)) for j in range(int(pattern[g]))]
            begin = []
            for g, _ in slots:
                begin.append(int(taken[g]))
                taken[g] += times
            # Between the ranks where some slot's size changes, all containers of the pattern look alike.
            steps = {0, times}
            for b in begin:
                i, j = np.searchsorted(ends, b, "right"), np.searchsorted(ends, b + times, "left")
                steps |= {int(e) - b for e in ends[i:j]}
            marks = sorted(t for t in steps if 0 <= t <= times)
            for t, u in zip(marks, marks[1:]):
                offset = 0
                for place, b in enumerate(begin):
                    k = int(np.searchsorted(ends, b + t, "right"))
                    rows.append((large[k], b + t - int(starts[k]), u - t, container + t, place, offset))
                    offset += large[k]
                free[capacity - offset].append((container + t, u - t, len(begin)))
            container += times

    left = [(s, int(hist[s])) for s in range(small, 0, -1) if hist[s]]
    volume = sum(s * n for s, n in left)
    spaces = {s for s in range(capacity + 1) if free[s]}
    for size, n in left:
        rank = 0
        while n:
            fitting = [s for s in spaces if s >= size]
            if not fitting:
                fresh = -(-volume // capacity)
                free[capacity].append((container, fresh, 0))
                spaces.add(capacity)
                container += fresh
                continue
            space = min(fitting)
            first, m, inside = free[space].pop()
            if not free[space]:
                spaces.discard(space)
            use = min(m, n)
            rows.append((size, rank, use, first, inside, capacity - space))
            if m > use:
                free[space].append((first + use, m - use, inside))
                spaces.add(space)
            free[space - size].append((first, use, inside + 1))
            spaces.add(space - size)
            rank, n, volume = rank + use, n - use, volume - use * size
    out = np.array(rows, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_start, size) of texts (doc_id, n_tokens); only a text above the capacity has several pieces."""
    n = F.coalesce("n_tokens", F.lit(0))
    count = F.ceil(n / F.lit(capacity)).cast("int")
    # No filter on n_tokens: it would be pushed below the projection that counts tokens, and count them twice.
    cut_up = sized.select("doc_id", "n_tokens", F.explode(F.when(n > 0, F.sequence(F.lit(0), count - 1))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut_up.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("size"))


def ranked(items: DataFrame, buckets: int) -> DataFrame:
    """rank: the number of each item among those of its size, from 0, without one task per size.

    A size may hold any share of all items. Items are numbered within (size, bucket), and each bucket's start comes from
    the buckets' counts, of which there are at most capacity * buckets.
    """
    salted = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    numbered = salted.withColumn("rn", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")))
    return numbered.join(starts, ["size", "bucket"]).withColumn("rank", F.col("start") + F.col("rn") - 1).drop("bucket", "rn", "start")


def pack_sizes(sized: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container, place, offset) of texts (doc_id, n_tokens).

    token_start and n_tokens say which tokens of the text the piece holds; place is its number and offset its first
    position in the container. Texts without tokens (null, empty) are in no container. Containers are numbered from 0.
    Repeated doc_ids are items of their own. The sizes are read twice, so they are cut first; the driver gets the histogram
    (capacity rows at most) and sends back the plan, which is bounded by the capacity as well.
    """
    spark = sized.sparkSession
    items = cut(pieces(sized.select("doc_id", "n_tokens"), capacity))
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    p = min((plan(histogram, capacity, g) for g in groups), key=lambda rows: int((rows[:, 2] + rows[:, 3]).max(initial=0)))
    span = 1 << (62 - capacity.bit_length())  # ranks of one size; size and rank are one 63-bit key
    if max(histogram.values(), default=0) >= span:
        raise ValueError(f"more than {span} items of one size at capacity {capacity}")
    keys, rank0 = p[:, 0] * span + p[:, 1], p[:, 1]
    target = StructType([StructField(n, LongType()) for n in ("container", "place", "offset")])

    def locate(size: pa.Array, rank: pa.Array) -> pa.Array:
        s, r = size.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, s * span + r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(p[at, 3] + r - rank0[at]), pa.array(p[at, 4]), pa.array(p[at, 5])], names=["container", "place", "offset"])

    found = F.arrow_udf(locate, target)(F.col("size"), F.col("rank"))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = ranked(items, buckets).select("doc_id", "piece", "token_start", F.col("size").cast("long").alias("n_tokens"), found.alias("at"))
    return out.select("doc_id", "piece", "token_start", "n_tokens", "at.container", "at.place", "at.offset")


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """pack_sizes of documents.text, measured in tokens of the vocabulary."""
    return pack_sizes(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens")), capacity, groups)


def facts(sized: DataFrame, packed: DataFrame, capacity: int = CAPACITY, slack: float = 0.01) -> DataFrame:
    """(fact, n): what can be said of a packing (pack_sizes) of texts (doc_id, n_tokens; unique ids). All but the first two are 0 in a
    right one; 'containers above the bound' counts those beyond the least possible number and a share `slack` (one at least)."""
    place = Window.partitionBy("container").orderBy("place")
    piece = Window.partitionBy("doc_id").orderBy("piece")
    p = packed.select(
        "*", F.row_number().over(place).alias("_nth"), F.coalesce(F.lag(F.col("offset") + F.col("n_tokens")).over(place), F.lit(0)).alias("_from"),
        F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(piece), F.lit(0)).alias("_start"), F.count("*").over(Window.partitionBy("doc_id")).alias("_pieces"),
    )
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    per_doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"))
    docs = sized.join(per_doc, "doc_id", "left").agg(
        n(F.col("placed") > 0).alias("a"), n(F.coalesce("n_tokens", F.lit(0)) == 0).alias("b"), n(F.coalesce("placed", F.lit(0)) != F.coalesce("n_tokens", F.lit(0))).alias("c"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    rows = p.agg(
        n((F.col("_pieces") > 1) & (F.col("_pieces") > F.ceil((F.col("token_start") + F.col("n_tokens")) / capacity)) & (F.col("piece") == F.col("_pieces") - 1)).alias("d"), n(F.col("offset") + F.col("n_tokens") > capacity).alias("e"),
        n(F.col("offset") != F.col("_from")).alias("f"), n(F.col("token_start") != F.col("_start")).alias("g"), n(F.col("place") != F.col("_nth") - 1).alias("h"), F.countDistinct("container").alias("containers"), F.coalesce(F.max("container") + 1, F.lit(0)).alias("last"))
    j = docs.crossJoin(rows)  # one row each
    least = F.ceil(F.col("total") / capacity)
    bound = least + F.greatest(F.lit(1), F.ceil(least * slack))
    named = {"texts in containers": F.col("a"), "texts without tokens": F.col("b"), "pieces of texts that fit cut up": F.col("d"), "pieces beyond the capacity": F.col("e"), "pieces that overlap or leave a gap": F.col("f"), "tokens missing or twice": F.col("c") + F.col("g"), "places not in order": F.col("h") + F.col("last") - F.col("containers"), "containers above the bound": F.greatest(F.lit(0), F.col("containers") - bound)}
    return j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.cast("long").alias("n")) for k, v in named.items()])).alias("x")).select("x.*")
