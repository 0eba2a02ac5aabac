"""Filling containers of fixed capacity with items of varying length.

Method: the histogram of lengths is packed, not the items.  Shallow combinations of
lengths that fill a window just below the capacity are enumerated; non-negative least
squares finds how often to repeat each so that the histogram is used up; the repeat
counts are rounded down, and what remains is packed greedily, fullest first.  The
plan depends on the capacity only; the items are then matched to its places by their
rank among the items of their length.

Only the histogram reaches the driver: at most `capacity` counts.  Ranks are counted
within (length, shard), so that a length that a third of all items share is spread.

Defined results: an item longer than the capacity is cut into pieces, all but the last
full; items with a null key are left out; a null or non-positive size counts as 0 and
goes into container 0, for it needs no space; repeated rows give one row.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import buckets_for

CAPACITY = 2048
#: Unused space that a combination may leave.
WINDOW = 4
#: Items of a combination.
DEPTH = 4
#: Combinations given to the solver.
MAX_COMBINATIONS = 12_000
#: Shards of the ranking, at least, and the items of a shard beyond that: a length that a third of all items share is spread over them.
SHARDS, SHARD_ITEMS = 64, 500_000


def combinations(lengths: list[int], counts: dict[int, int], capacity: int = CAPACITY, window: int = WINDOW, depth: int = DEPTH, most: int = MAX_COMBINATIONS) -> list[tuple[int, ...]]:
    """Combinations (descending) of up to `depth` lengths whose sum lies in [capacity - window, capacity].

    For each length, taken as the largest, partners are drawn at even steps over the
    lengths, so that every length gets combinations however many there are.
    """
    lengths = sorted(lengths)
    each = max(2, most // max(1, len(lengths)))
    found: dict[tuple[int, ...], None] = {}

    def partners(rest: int, limit: int, left: int, want: int) -> list[tuple[int, ...]]:
        """Up to `want` descending tuples of at most `left` lengths <= limit that sum to [rest - window, rest]."""
        if rest <= window:
            return [()]
        if not left or limit <= 0:
            return []
        out = []
        hi = bisect_right(lengths, min(rest, limit))
        if left == 1:
            lo = bisect_right(lengths, max(0, rest - window - 1))
            return [(x,) for x in reversed(lengths[lo:hi])][:want]
        lo = bisect_right(lengths, max(0, -(-(rest - window) // left) - 1))
        places = range(hi - 1, lo - 1, -max(1, (hi - lo) // (3 * want)))
        for i in places:
            share = partners(rest - lengths[i], lengths[i], left - 1, 1)
            out += [(lengths[i], *p) for p in share]
            if len(out) >= want:
                break
        return out

    for x in lengths:
        for size in range(1, depth + 1):
            for rest in partners(capacity - x, x, size - 1, -(-each // depth)):
                found[(x, *rest)] = None
    return list(found)


def solve_nnls(patterns: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts of the patterns that fit the histogram in the least-squares sense.

    Accelerated projected gradient on the sparse matrix; lengths are weighted alike.
    """
    at = {x: i for i, x in enumerate(sorted(counts))}
    target = np.array([counts[x] for x in sorted(counts)], dtype=float)
    row = np.array([at[x] for p in patterns for x in p])
    col = np.array([k for k, p in enumerate(patterns) for _ in p])
    apply = lambda v: np.bincount(row, weights=v[col], minlength=len(target))
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(apply(v))), 1e-9)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def greedy_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): each container takes the largest length left that fits, as often as
    the counts allow the same combination again."""
    left = dict(counts)
    lengths = sorted(x for x, n in left.items() if n)
    bins = []
    while lengths:
        space, combo, used = capacity, [], {}
        hi = len(lengths)
        while hi:
            hi = bisect_right(lengths, space, 0, hi)
            if not hi:
                break
            x = lengths[hi - 1]
            if used.get(x, 0) < left[x]:
                used[x] = used.get(x, 0) + 1
                combo.append(x)
                space -= x
            else:
                hi -= 1
        repeats = min(left[x] // n for x, n in used.items())
        bins.append((tuple(combo), repeats))
        for x, n in used.items():
            left[x] -= n * repeats
        lengths = [x for x in lengths if left[x]]
    return bins


def plan(counts: dict[int, int], capacity: int = CAPACITY, window: int = WINDOW, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that together use up the histogram, no combination above the capacity."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    chosen: list[tuple[tuple[int, ...], int]] = []
    left = dict(counts)
    patterns = combinations(sorted(counts), counts, capacity, window, depth)
    if patterns:
        x = solve_nnls(patterns, counts)
        for k in np.argsort(-x, kind="stable"):
            need: dict[int, int] = {}
            for s in patterns[k]:
                need[s] = need.get(s, 0) + 1
            # rounding down; on a histogram of ones a half counts as a whole
            repeats = min([int(np.floor(x[k] + 0.5)), *(left[s] // n for s, n in need.items())])
            if repeats > 0:
                chosen.append((patterns[k], repeats))
                for s, n in need.items():
                    left[s] -= n * repeats
    return chosen + greedy_bins({s: n for s, n in left.items() if n}, capacity)


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """length -> (first rank of each run, first container, items of this length in a container of the run)."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    nxt: dict[int, int] = {}
    first = 0
    for combo, repeats in chosen:
        for s in set(combo):
            n = combo.count(s)
            starts, containers, each = runs.setdefault(s, ([], [], []))
            starts.append(nxt.get(s, 0))
            containers.append(first)
            each.append(n)
            nxt[s] = nxt.get(s, 0) + n * repeats
        first += repeats
    return runs


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items(key, size) -> key, piece, size; items above the capacity as pieces of it."""
    size = F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0))
    cut = items.filter("key is not null").groupBy("key").agg(F.max(size).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")
    numbered = cut.select("key", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return numbered.select("key", "piece", F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))


def pack(items: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, depth: int = DEPTH, shards: int | None = None) -> DataFrame:
    """items(key, size) -> key, piece, size, container; the sizes in a container never exceed the capacity."""
    spark = items.sparkSession
    shards = shards or buckets_for(items.count(), SHARD_ITEMS, SHARDS)
    sharded = pieces(items, capacity).withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    # the ranking window and this join are partitioned alike, so the items are shuffled once
    counted = sharded.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = counted.select("size", "shard", before.alias("offset"))
    histogram = {r["size"]: r["n"] for r in counted.filter("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity, window, depth)))

    @F.pandas_udf(T.LongType())
    def container(size: pd.Series, index: pd.Series) -> pd.Series:
        runs, out = shared.value, np.zeros(len(size), dtype=np.int64)
        sizes, index = size.to_numpy(), index.to_numpy()
        for s in np.unique(sizes[sizes > 0]):
            at = sizes == s
            starts, containers, each = (np.asarray(x) for x in runs[int(s)])
            k = np.searchsorted(starts, index[at], side="right") - 1
            out[at] = containers[k] + (index[at] - starts[k]) // each[k]
        return pd.Series(out)

    rank = F.row_number().over(Window.partitionBy("size", "shard").orderBy("key", "piece")) - 1
    ranked = sharded.withColumn("rank", rank).join(offsets, ["size", "shard"])
    return ranked.select("key", "piece", "size", container("size", F.col("rank") + F.col("offset")).alias("container"))
