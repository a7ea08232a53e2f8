"""Filters, joins, sets and ranks on whole tables. Broadcasts are left to the optimizer, which decides by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewake.functions import numbers, text


def eligible(comments: DataFrame, least: int = 50) -> DataFrame:
    """Comments worth matching: no failed attachment without text of its own, and `least` characters of text. Nulls count as no text."""
    failed = F.coalesce(F.col("is_attachment_only"), F.lit(False)) & F.col("text_source").eqNullSafe("attachment_failed")
    return comments.filter(~failed & (F.length(text.stripped(F.coalesce("comment", F.lit("")))) >= least))


def eligibility_counts(comments: DataFrame, least: int = 50) -> DataFrame:
    """One row: how many rows each rule drops on its own, how many are dropped in all, how many are kept."""
    failed = F.coalesce(F.col("is_attachment_only"), F.lit(False)) & F.col("text_source").eqNullSafe("attachment_failed")
    short = F.length(text.stripped(F.coalesce("comment", F.lit("")))) < least
    return comments.agg(
        F.count_if(failed).alias("attachment_failed"), F.count_if(short).alias("too_short"), F.count_if(failed | short).alias("total_dropped"), F.count_if(~(failed | short)).alias("n_kept")
    )


def usable_corpus(comments: DataFrame) -> DataFrame:
    """Comments with text whose attachment was not lost; a null text_source is kept."""
    return comments.filter(~F.col("text_source").eqNullSafe("attachment_failed") & (F.length(text.stripped(F.coalesce("comment", F.lit("")))) > 0))


def conformed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a schema in its order, null where missing; others are dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[n.lower()]}`") if n.lower() in have else F.lit(None)).cast(t).alias(n) for n, t in columns.items()))


def snake(name: str) -> str:
    """A header as a column name: lower case, runs of other characters one underline."""
    out = "".join(c.lower() if c.isalnum() else "_" for c in name.strip())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


def snake_columns(df: DataFrame) -> DataFrame:
    """Columns renamed by snake(); where two become equal the later ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = snake(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order. Ties are settled by the order's later columns, so give one that is unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows per key with their rank; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones of the same key, columns by name; applied twice it gives the same. Rows with a null key never match."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def with_status(table: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The column taken from updates where they have one, else kept. Of several updates of a key the greatest counts."""
    new = updates.groupBy(*keys).agg(F.max(column).alias("_new"))
    return table.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def left_filled(left: DataFrame, right: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """A left join whose missing values on the right become the given ones."""
    return left.join(right, keys, "left").fillna(fill)


def differing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): distinct keys that stand on one side only; empty if both are aligned. Null keys are compared as equal."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def windowed_pairs(pairs: DataFrame, comments: DataFrame, periods: DataFrame) -> DataFrame:
    """Pairs whose comment came between opening and close (plus a day) of the obligation's docket; pairs without a date are dropped.

    pairs: comment_id, obligation_id; comments: document_id, received_date, posted_date; periods: docket_id, opened, closed.
    """
    when = comments.groupBy("document_id").agg(F.min(numbers.comment_time(F.col("received_date"), F.col("posted_date"))).alias("came"))
    dated = pairs.join(when, F.col("comment_id") == F.col("document_id")).withColumn("docket_id", text.docket_of_obligation(F.col("obligation_id")))
    return dated.join(periods, "docket_id").filter(numbers.in_window(F.col("came"), F.col("opened"), F.col("closed"))).select(*pairs.columns)


def shared_with_larger(df: DataFrame, owner: str, item: str, size: str) -> DataFrame:
    """(owner, item, kept_owner): owners that share an item with a larger one, which keeps it. Ties go to the smaller name. Null items are nobody's."""
    w = Window.partitionBy(item).orderBy(F.desc(size), owner)
    rows = df.filter(F.col(item).isNotNull()).select(owner, item, size).distinct()
    return rows.withColumn("_r", F.row_number().over(w)).withColumn("kept_owner", F.first(owner).over(w)).filter("_r > 1").select(owner, item, "kept_owner")


def reversal_pairs(final: DataFrame, proposed: DataFrame, least_parts: int = 3, least_words: int = 3) -> DataFrame:
    """Best pair of a final and a proposed document for each two dockets: most shared CFR parts, or a text that refers to the other docket.

    Both: docket_id, doc_id, title, text. Instead of comparing all documents, those that share a CFR part meet by an equi-join
    on the part, and those that name a docket by an equi-join on the names found in the text. Shared title words count only
    between documents that share a part. Ties go to the smaller ids.
    """
    parts = lambda d, s: d.select(F.col("docket_id").alias(f"docket_{s}"), F.col("doc_id").alias(f"doc_{s}"), F.explode(text.cfr_parts(F.col("text"))).alias("part"))
    met = parts(final, "a").join(parts(proposed, "b"), "part").filter("docket_a <> docket_b")
    by_parts = met.groupBy("docket_a", "doc_a", "docket_b", "doc_b").agg(F.count_distinct("part").alias("n_parts"))
    words = lambda d, s: d.select(F.col("doc_id").alias(f"doc_{s}"), text.title_keywords(F.col("title" if s == "a" else "text")).alias(f"words_{s}"), text.reversal_word(F.col("text")).alias(f"reversal_{s}"))
    both = by_parts.join(words(final, "a"), "doc_a").join(words(proposed, "b"), "doc_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    scored = both.filter((F.col("n_parts") >= least_parts) | (F.col("reversal_b") & (shared >= least_words))).select("docket_a", "doc_a", "docket_b", "doc_b", "n_parts")
    named = proposed.select(F.col("docket_id").alias("docket_b"), F.col("doc_id").alias("doc_b"), F.explode(text.found_all(F.col("text"), r"\b[A-Z]{2,5}-(?:HQ|R\d\d)-[A-Z]+-\d{4}-\d{4}\b")).alias("docket_a"))
    refers = named.join(final.select(F.col("docket_id").alias("docket_a"), F.col("doc_id").alias("doc_a")), "docket_a").filter("docket_a <> docket_b")
    every = scored.unionByName(refers.select("docket_a", "doc_a", "docket_b", "doc_b", F.lit(0).cast("bigint").alias("n_parts")))
    return first_by(every, ["docket_a", "docket_b"], F.desc("n_parts"), F.col("doc_a"), F.col("doc_b"))
