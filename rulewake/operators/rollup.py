"""Aggregates of comments up to obligations and dockets. Counts and sums only, so partial aggregation does most of the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewake.functions import text


def universe(verified: DataFrame, matches: DataFrame) -> DataFrame:
    """(obligation_id, docket_id): every verified obligation of each (docket, rule type) that any match names. Rows without an index have no id."""
    ids = verified.filter("verified").select(text.obligation_id(F.col("docket_id"), F.col("rule_type"), F.col("candidate_idx"), F.col("split_idx")).alias("obligation_id"), "docket_id", "rule_type")
    named = matches.select(text.docket_of_obligation(F.col("obligation_id")).alias("docket_id"), F.regexp_extract("obligation_id", "__(proposed|final)__", 1).alias("rule_type")).distinct()
    return ids.filter("obligation_id IS NOT NULL").join(named, ["docket_id", "rule_type"], "left_semi").select("obligation_id", "docket_id").distinct()


def features(matches: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per obligation, over addressing rows: their number, stances, share of organisations and individuals among the known kinds, mean cosine, ids.

    matches: comment_id, obligation_id, addressed, stance, cosine_similarity; kinds: comment_id, submitter_kind. Rows count as
    often as they stand there; null addressed is not addressed; shares are null where no kind is known.
    """
    m = matches.filter("addressed").join(kinds, "comment_id", "left")
    organisations, individuals = F.count_if(F.col("submitter_kind") == "organizational"), F.count_if(F.col("submitter_kind") == "individual")
    return m.groupBy("obligation_id").agg(
        F.count("*").alias("n_comments_addressed"),
        *(F.count_if(text.stance(F.col("stance")) == s).alias(n) for s, n in (("SUPPORTING", "n_supporting"), ("OPPOSING", "n_opposing"), ("SUGGESTING_MODIFICATION", "n_modifying"))),
        F.try_divide(organisations, organisations + individuals).alias("pct_organizational"),
        F.try_divide(individuals, organisations + individuals).alias("pct_individual"),
        F.avg("cosine_similarity").alias("mean_cosine"),
        F.array_join(F.array_sort(F.collect_set("comment_id")), ";").alias("addressing_comment_ids"),
    )


COUNTS = {"n_comments_addressed": 0, "n_supporting": 0, "n_opposing": 0, "n_modifying": 0, "addressing_comment_ids": ""}


def obligation_table(obligations: DataFrame, matches: DataFrame, kinds: DataFrame) -> DataFrame:
    """features() for every obligation; those nobody addressed have counts of 0 and no ids."""
    return obligations.join(features(matches, kinds), "obligation_id", "left").fillna(COUNTS)


def engagement(matches: DataFrame, kinds: DataFrame, distinct_titles: bool = False) -> DataFrame:
    """(obligation_id, n_addressing, n_org, n_ind, org_share): distinct comments, and rows by kind; org_share over at least 1.

    With distinct_titles, kinds holds one row per comment and n_addressing counts rows instead.
    """
    m = matches.filter("addressed").join(kinds, "comment_id", "left")
    n = F.count("*") if distinct_titles else F.count_distinct("comment_id")
    g = m.groupBy("obligation_id").agg(n.alias("n_addressing"), F.count_if(F.col("submitter_kind") == "organizational").alias("n_org"), F.count_if(F.col("submitter_kind") == "individual").alias("n_ind"))
    return g.withColumn("org_share", F.col("n_org") / F.greatest(F.col("n_org") + F.col("n_ind"), F.lit(1)))


def cluster_votes(matches: DataFrame, kinds: DataFrame, clusters: DataFrame) -> DataFrame:
    """engagement() with one vote per cluster of copies: a cluster is organizational if more than half of its members are; a comment in no cluster is its own."""
    pairs = matches.filter("addressed").select("comment_id", "obligation_id").distinct()
    named = pairs.join(clusters.select("comment_id", "cluster"), "comment_id", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("solo::"), "comment_id")))
    members = named.select("comment_id", "cluster").distinct().join(kinds, "comment_id", "left")
    kind = members.groupBy("cluster").agg(F.when(F.avg((F.coalesce("submitter_kind", F.lit("")) == "organizational").cast("int")) > 0.5, "organizational").otherwise("individual").alias("kind"))
    votes = named.select("obligation_id", "cluster").distinct().join(kind, "cluster")
    g = votes.groupBy("obligation_id").agg(F.count("*").alias("n_addressing"), F.count_if(F.col("kind") == "organizational").alias("n_org"), F.count_if(F.col("kind") == "individual").alias("n_ind"))
    return g.withColumn("org_share", F.col("n_org") / F.greatest(F.col("n_org") + F.col("n_ind"), F.lit(1)))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): nulls are a value of their own."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def totals(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures by each key alone and over all rows in one pass: (dimension, value, measures)."""
    g = df.groupingSets([[k] for k in keys] + [[]], *keys).agg(*(m.alias(n) for n, m in measures.items()), F.grouping_id().alias("_g"))
    top = 1 << len(keys)
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        alone = F.col("_g") == top - 1 - (1 << (len(keys) - 1 - i))
        dimension, value = F.when(alone, k).otherwise(dimension), F.when(alone, F.col(k).cast("string")).otherwise(value)
    return g.select(dimension.alias("dimension"), value.alias("value"), *measures)


def wide_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each given value per key, 0 where none; null keys are dropped."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) for each bin, the last one closed, empty ones with 0; values outside and nulls are left out."""
    bins = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    v = F.col(column).cast("double")
    which = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, a, b in bins:
        which = which.when((v >= a) & ((v < b) | (F.lit(i == len(bins) - 1) & (v == b))), i)
    counts = df.select(which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.createDataFrame(bins, "bin int, low double, high double").join(counts, "bin", "left").fillna({"n": 0})


def lower_quantile(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Per key, for each share the element at floor((n - 1) * share) of the sorted values; nulls are left out. Ranks come from one window."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(column).isNotNull()).select(*keys, column, (F.row_number().over(w.orderBy(column)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * s), F.col(column))).alias(n) for n, s in shares.items()))


def leave_one_out(df: DataFrame, group: str, cells: dict[str, Column]) -> DataFrame:
    """(dropped, n_dropped, cells): the cells of all rows without each group, from sums by group: each row is read once."""
    by = df.groupBy(F.col(group).alias("dropped")).agg(F.count("*").alias("n_dropped"), *(F.sum(c.cast("bigint")).alias(n) for n, c in cells.items()))
    everything = Window.partitionBy()
    return by.select("dropped", "n_dropped", *(F.coalesce(F.sum(n).over(everything) - F.col(n), F.lit(0)).alias(n) for n in cells))


def confusion(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """(label_a, label_b, n) for every pair of labels, 0 where none; other labels are left out."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "label_a string, label_b string")
    counts = df.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["label_a", "label_b"], "left").fillna({"n": 0})


def class_scores(df: DataFrame, gold: str, given: str, labels: list[str]) -> DataFrame:
    """(label, precision, recall, support) of given against gold over rows that have both; 0 where nothing can be divided."""
    rows = df.filter(F.col(gold).isin(labels) & F.col(given).isin(labels))
    long = rows.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), F.col(gold).alias("g"), F.col(given).alias("p"))
    hit = F.count_if((F.col("g") == F.col("label")) & (F.col("p") == F.col("label")))
    n = lambda c: F.count_if(F.col(c) == F.col("label"))
    return long.groupBy("label").agg(F.coalesce(F.try_divide(hit, n("p")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit, n("g")), F.lit(0.0)).alias("recall"), n("g").alias("support"))
