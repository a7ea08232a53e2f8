"""Results per key where a handful of keys hold most rows.

Every measure is algebraic: each task folds its rows into one small state per key in a bounded hash table that spills, and
only those states are shuffled. A key that holds a third of all rows then sends one state per task, like any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """One row per key, the null key included, with mergeable measures (count, sum, min, max, avg and what is built of them).

    No rows give no rows. The plan is partial aggregate, exchange of states, final aggregate; collecting and distinct
    aggregates don't belong here, for their states grow with the rows.
    """
    return df.groupBy(F.col(key).alias("key")).agg(*(m.alias(n) for n, m in measures.items()))


def keys_above(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n_rows, total_rows) of the keys with at least a share of all rows, null keys counted in the total but never returned.

    The total is counted first, for Parquet from the footers alone; ties at the share are kept.
    """
    total = df.count()
    counts = per_key(df, key, {"n_rows": F.count(F.lit(1))}).withColumn("total_rows", F.lit(total).cast("bigint"))
    return counts.filter(F.col("key").isNotNull() & (F.col("n_rows") >= share * total))
