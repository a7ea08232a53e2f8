"""Queries on the dockets that hold most comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.operators import hot_keys
from rulewake.session import read

SHARE = 0.03


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = read(spark, sf_dir, "anchor_rules_locked").select("docket_id").distinct()
    hot = hot_keys.keys_above(read(spark, sf_dir, "comments"), "docket_id", SHARE).select(F.col("key").alias("docket_id"))
    return anchors.join(hot, "docket_id", "left_semi")


def p3_docket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {
        "n_rows": F.count(F.lit(1)),
        "n_attach_only": F.count_if("is_attachment_only"),
        "n_late": F.count_if(F.col("loaded_at") > F.col("posted_date") + F.expr("INTERVAL 366 DAYS")),
        "n_chars": F.coalesce(F.sum(F.length("comment").cast("bigint")), F.lit(0).cast("bigint")),
        "first_received": F.min("received_date"),
        "last_received": F.max("received_date"),
    }
    stats = hot_keys.per_key(read(spark, sf_dir, "comments"), "docket_id", measures)
    anchors = hot_keys.per_key(read(spark, sf_dir, "anchor_rules_locked"), "docket_id", {"n_anchors": F.count(F.lit(1)), "n_expected": F.max("n_comments")})
    return (
        stats.filter("key IS NOT NULL")
        .join(anchors.filter("key IS NOT NULL"), "key", "left")
        .select(F.col("key").alias("docket_id"), *measures, F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"), "n_expected", F.round(F.col("n_attach_only") / F.col("n_rows"), 9).alias("share_attach_only"))
    )


QUERIES = {"p3_found": p3_found, "p3_docket_stats": p3_docket_stats}

SQL = {
    "p3_found": """
        SELECT docket_id FROM comments WHERE docket_id IN (SELECT docket_id FROM anchor_rules_locked)
        GROUP BY docket_id HAVING COUNT(*) >= 0.03 * (SELECT COUNT(*) FROM comments)""",
    "p3_docket_stats": """
        WITH a AS (SELECT docket_id, COUNT(*) AS n_anchors, MAX(n_comments) AS n_expected FROM anchor_rules_locked WHERE docket_id IS NOT NULL GROUP BY docket_id),
        s AS (SELECT docket_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE is_attachment_only) AS n_attach_only,
                COUNT(*) FILTER (WHERE loaded_at > posted_date + INTERVAL 366 DAY) AS n_late, CAST(COALESCE(SUM(LENGTH(comment)), 0) AS BIGINT) AS n_chars,
                MIN(received_date) AS first_received, MAX(received_date) AS last_received FROM comments WHERE docket_id IS NOT NULL GROUP BY docket_id)
        SELECT s.*, COALESCE(n_anchors, 0) AS n_anchors, n_expected, ROUND(n_attach_only / n_rows, 9) AS share_attach_only FROM s LEFT JOIN a USING (docket_id)""",
}
