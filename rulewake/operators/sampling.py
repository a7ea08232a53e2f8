"""Samples that are the same on every run: rows are ordered by a hash of seed and id, never by a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int | str, *ids: str) -> Column:
    """The digest by which rows are drawn; another seed gives another order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)).cast("binary"))


def ranked(df: DataFrame, strata: list[str], seed: int | str, *ids: str) -> DataFrame:
    """Adds draw_rank, 1, 2, ... within each stratum in hash order, with the stratum split by the beginning of the hash, so that no task sorts all of a large one.

    The rank is what the beginnings before hold, at most 4,096 counts a stratum, and the place within the own beginning.
    """
    key = order_key(seed, *ids)
    rows = df.withColumn("_part", F.substring(key, 1, 3))
    for i, c in enumerate(strata):  # null strata are strata too, and meet in joins as such
        rows = rows.withColumn(f"_s{i}", F.coalesce(F.col(c).cast("string"), F.lit("\u0000")))
    own = [f"_s{i}" for i in range(len(strata))]
    counts = rows.groupBy(*own, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(*own, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*own)).alias("stratum_size"))
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*own, "_part").orderBy(key, *ids)))
    return inside.join(before, [*own, "_part"]).withColumn("draw_rank", F.col("_before") + F.col("_inside")).drop(*own, "_part", "_before", "_inside")


def simple(df: DataFrame, n: int, seed: int | str, *ids: str) -> DataFrame:
    """n rows; all of them if there are fewer. Ties of the digest are settled by the ids."""
    return df.orderBy(order_key(seed, *ids), *ids).limit(n)


def per_stratum(df: DataFrame, strata: list[str], n: int, seed: int | str, *ids: str) -> DataFrame:
    """Up to n rows of each stratum, with draw_rank; the group limit works before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(order_key(seed, *ids), *ids)
    return df.withColumn("draw_rank", F.row_number().over(w)).filter(F.col("draw_rank") <= n)


def shortfalls(df: DataFrame, strata: list[str], n: int) -> DataFrame:
    """(strata, pool_size, drawn, shortfall) of per_stratum()."""
    g = df.groupBy(*strata).agg(F.count("*").alias("pool_size"))
    return g.select(*strata, "pool_size", F.least("pool_size", F.lit(n).cast("bigint")).alias("drawn"), F.greatest(F.lit(n) - F.col("pool_size"), F.lit(0).cast("bigint")).alias("shortfall"))


def quotas(n: int, mix: dict[str, float]) -> dict[str, int]:
    """Whole numbers near share * n that sum to n; the largest gives or takes what rounding leaves."""
    out = {k: round(v * n) for k, v in mix.items()}
    while (gap := n - sum(out.values())) != 0:
        out[max(out, key=out.get)] += 1 if gap > 0 else -1
    return out


def by_quota(df: DataFrame, stratum: str, n: int, mix: dict[str, float], seed: int | str, *ids: str) -> DataFrame:
    """n rows with a quota per stratum; what some strata can't fill is drawn from the rest of any stratum. Adds sample_index.

    The covered rows are taken by their rank, which limits every stratum before the shuffle; of the others only the first n in
    hash order can be drawn. A table of n rows or fewer comes out whole. Ids must be unique.
    """
    quota = quotas(n, mix)
    limit = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in quota.items() for x in (F.lit(k), F.lit(v)))), F.coalesce(F.col(stratum), F.lit(""))), F.lit(0))
    key = order_key(seed, *ids)
    most = max(quota.values(), default=0)
    covered = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(key, *ids))).filter(F.col("_r") <= most).filter(F.col("_r") <= limit).drop("_r").withColumn("_covered", F.lit(True))
    first = df.orderBy(key, *ids).limit(2 * n)  # at most n of them are covered
    rest = first.join(covered.select(*ids), list(ids), "left_anti").select(*df.columns).withColumn("_covered", F.lit(False))
    best = covered.unionByName(rest).orderBy(F.desc("_covered"), key, *ids).limit(n)  # bounded by n, so one task can number them
    return best.withColumn("sample_index", F.row_number().over(Window.orderBy(F.desc("_covered"), key, *ids)) - 1).drop("_covered")


def capped_cells(df: DataFrame, cells: list[str], cap: int, total: int, seed: int | str, *ids: str) -> DataFrame:
    """Up to cap rows of each cell; if that is less than total, every cell beyond the cap gives the same number more, the whole
    quotient of what is missing by the number of such cells; more than total are cut in hash order.

    What is missing follows from the sizes of the cells, of which one row of sums is gathered.
    """
    sizes = df.groupBy(*cells).agg(F.count("*").alias("n"))
    row = sizes.agg(F.sum(F.least("n", F.lit(cap))).alias("first"), F.count_if(F.col("n") > cap).alias("beyond")).first()
    missing = max(0, total - (row["first"] or 0))
    most = cap + (missing // row["beyond"] if row["beyond"] else 0)
    key = order_key(seed, *ids)
    return per_stratum(df, cells, most, seed, *ids).drop("draw_rank").orderBy(key, *ids).limit(total)


def fraction_per_stratum(df: DataFrame, stratum: str, share: float, seed: int | str, *ids: str) -> DataFrame:
    """max(1, n * share) rows of each stratum of n, halves rounded to even."""
    own = ranked(df, [stratum], seed, *ids)
    return own.filter(F.col("draw_rank") <= F.greatest(F.bround(F.col("stratum_size") * share), F.lit(1.0))).drop("draw_rank", "stratum_size")


def two_tiers(df: DataFrame, full: Column, stratum: str, per_class: dict[str, int], seed: int | str, *ids: str) -> DataFrame:
    """Every row for which full holds (tier T1), and of the rest a fixed number per class (tier T2). Null full is not full."""
    is_full = F.coalesce(full, F.lit(False))
    limit = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in per_class.items() for x in (F.lit(k), F.lit(v)))), F.coalesce(F.col(stratum), F.lit(""))), F.lit(0))
    w = Window.partitionBy("_full", stratum).orderBy(order_key(seed, *ids), *ids)
    ranked = df.withColumn("_full", is_full).withColumn("_r", F.row_number().over(w))
    return ranked.filter(F.col("_full") | (F.col("_r") <= limit)).withColumn("tier", F.when(F.col("_full"), "T1").otherwise("T2")).drop("_full", "_r")
