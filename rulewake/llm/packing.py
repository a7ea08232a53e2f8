"""Containers of fixed capacity filled with items of varying length.

Plan: item lengths are rounded up to a grid and all shallow combinations of grid lengths that fill a container are
listed. Non-negative least squares gives each combination the number of times it is repeated so that together they use
up the histogram. The numbers are rounded down, drawn from the exact lengths, and what is left over is put greedily into
the smallest space that takes it. All of this works on the histogram, whose size is bounded by the capacity, never on items.

Placement: an item's rank among the items of its length decides its container, so one shuffle of (id, length) suffices.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewake.llm import byte_bpe
from rulewake.session import stored

CAPACITY = 2048
#: Cells of the grid on which combinations are listed, and the most distinct lengths in one with single and with repeated use.
GRID, SHALLOW, REPEATED = 256, 3, 2
#: Items that one task sorts at once; lengths with more are split over several tasks.
BUCKET_ROWS = 100_000


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """The x >= 0 with the least |ax - b|, by an active set: free the column of largest gradient, solve, step back to the border."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(steps):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        if not len(gradient) or gradient.max() <= small:
            break
        free[int(gradient.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if not (negative := free & (s <= 1e-12)).any():
                x = s
                break
            step = (x[negative] / np.maximum(x[negative] - s[negative], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(window: int, lengths: Iterable[int]) -> list[dict[int, int]]:
    """Multisets of grid lengths that fill the window: up to SHALLOW lengths once each, or up to REPEATED lengths any number of times."""
    have = sorted({n for n in lengths if 0 < n <= window})
    known, found = set(have), set()
    for i in have:
        if window % i == 0:
            found.add(((i, window // i),))
        for j in have:
            if j <= i:
                continue
            for times in range(1, window // i + 1):
                if (rest := window - times * i) > 0 and rest % j == 0:
                    found.add(((i, times), (j, rest // j)))
            if SHALLOW > 2 and (k := window - i - j) > j and k in known:
                found.add(((i, 1), (j, 1), (k, 1)))
    return [dict(f) for f in sorted(found)]


@dataclass
class Plan:
    """Runs of ranks: items of length size from rank start on fill the containers from base on, times to each."""

    size: np.ndarray
    start: np.ndarray
    base: np.ndarray
    times: np.ndarray
    containers: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> Plan:
    """Containers for a histogram of lengths in 1..capacity. Deterministic; an empty histogram gives no containers."""
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    grid = min(grid, capacity)
    cell = -(-capacity // grid)
    window = capacity // cell
    by_cell: dict[int, list[int]] = {}
    for s in left:
        by_cell.setdefault(-(-s // cell), []).append(s)
    groups: list[list] = []  # [count, Counter of lengths, space]

    combos = combinations(window, by_cell)
    if combos:
        rows = sorted(by_cell)
        at = {c: i for i, c in enumerate(rows)}
        a = np.zeros((len(rows), len(combos)))
        for j, combo in enumerate(combos):
            for c, times in combo.items():
                a[at[c], j] = times
        have = np.array([sum(left[s] for s in by_cell[c]) for c in rows], dtype=float)
        for j, repeat in enumerate(np.floor(nnls(a, have) + 1e-6).astype(np.int64)):
            combo = combos[j]
            todo = min([int(repeat), *(sum(left.get(s, 0) for s in by_cell[c]) // t for c, t in combo.items())])
            while todo > 0:  # exact lengths: from each cell in turn the longest and the shortest, as many at once as there are
                taken: Counter = Counter()
                for k, (c, times) in enumerate(sorted(combo.items(), reverse=True)):
                    for _ in range(times):
                        own = [s for s in by_cell[c] if left.get(s, 0) - taken[s] > 0]
                        taken[own[-1] if k % 2 == 0 else own[0]] += 1
                many = min([todo, *(left[s] // t for s, t in taken.items())])
                for s, t in taken.items():
                    left[s] -= many * t
                groups.append([many, taken, capacity - sum(s * t for s, t in taken.items())])
                todo -= many

    spaces: dict[int, list[list]] = {}
    for g in groups:
        spaces.setdefault(g[2], []).append(g)
    order = sorted(spaces)
    for s in sorted(left, reverse=True):
        while (n := left[s]) > 0:
            i = bisect.bisect_left(order, s)
            if i == len(order):  # a new container takes as many of this length as fit
                per = min(capacity // s, n)
                g = [n // per, Counter({s: per}), capacity - per * s]
                left[s] -= g[0] * per
            else:
                space = order[i]
                old = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space]
                    order.pop(i)
                per = min(space // s, n)
                many = min(old[0], n // per)
                if old[0] > many:
                    old[0] -= many
                    if space not in spaces:
                        bisect.insort(order, space)
                    spaces.setdefault(space, []).append(old)
                g = [many, old[1] + Counter({s: per}), space - per * s]
                left[s] -= many * per
            if g[2] not in spaces:
                bisect.insort(order, g[2])
            spaces.setdefault(g[2], []).append(g)

    used: Counter = Counter()
    runs, base = [], 0
    for space in sorted(spaces):
        for count, taken, _ in spaces[space]:
            for s, times in sorted(taken.items()):
                runs.append((s, used[s], base, times))
                used[s] += count * times
            base += count
    runs.sort()
    size, start, first, times = (np.array(c, dtype=np.int64) for c in (zip(*runs) if runs else ((), (), (), ())))
    return Plan(size, start, first, times, base)


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens): only items beyond the capacity are split, into full containers and a rest."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)) - 1
    return sizes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"), F.col("n_tokens").alias("whole")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity).cast("bigint")).alias("n_tokens")
    )


def ranked(items: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank, 0, 1, ... among the items of one length.

    A length of more than BUCKET_ROWS items is split into hashed buckets, so that no task sorts all of them. What each bucket
    is preceded by is a table of one row per bucket: at most rows / BUCKET_ROWS + one per length.
    """
    # the lengths with more than one bucket, as one fixed-size array: the capacity bounds its size
    buckets = F.array(*(F.lit(max(1, -(-histogram.get(size, 0) // BUCKET_ROWS))) for size in range(max(histogram, default=0) + 1)))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.get(buckets, F.col("n_tokens").cast("int"))).cast("int"))
    counts = items.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = counts.select(
        "n_tokens", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1
    return items.withColumn("inside", inside).join(before, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("before") + F.col("inside")).alias("rank"))


def placed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id) for (doc_id, n_tokens), where doc_id is unique.

    Every item comes out; no container holds more than the capacity; only items longer than it are split (piece 0, 1, ...).
    Items of length 0 take no space and are spread over all containers by a hash; without any container they are in 0.
    """
    sizes = stored(sizes, "item-sizes")
    items = pieces(sizes, capacity)
    histogram = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    made = plan(histogram, capacity)
    key = made.size * (1 << 44) + made.start

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(key, size.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        return pd.Series(made.base[at] + (rank.to_numpy() - made.start[at]) // made.times[at])

    filled = ranked(items.filter("n_tokens > 0"), histogram).select("doc_id", "piece", "n_tokens", container("n_tokens", "rank").alias("container_id"))
    if not empty:
        return filled
    return filled.unionByName(items.filter("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, made.containers))).cast("bigint").alias("container_id")))


def packed(df: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", folder: str = byte_bpe.TOKENIZERS) -> DataFrame:
    """Containers of a table of texts, with sizes in tokens of the public tokenizer."""
    return placed(byte_bpe.measured(df, id_column, text_column, folder), capacity)


def fill(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens in them, share of the space used, most tokens in one container."""
    each = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return each.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.round(F.try_divide(F.sum("n"), F.count("*") * capacity), 4).alias("fill"), F.max("n").alias("largest")
    )
