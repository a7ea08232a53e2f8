"""Queries on whole tables for the preparation of training text, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.llm import annotators, byte_bpe, cut_ends, encoding_repair, formatting_copies, name_variants, packing, personal_data, structure
from rulewake.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = name_variants.linked(read(spark, sf_dir, "comments"), "document_id", "title")
    return name_variants.pairs(entities).select(F.col("id_a").alias("document_id_a"), F.col("id_b").alias("document_id_b"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.members(name_variants.linked(read(spark, sf_dir, "comments"), "document_id", "title")).withColumnRenamed("id", "document_id")


#: The labels of the audit, in the order in which ties are settled.
LABELS = ["SURVIVED-unchanged", "SURVIVED-edited", "MODIFIED", "DROPPED", "NEW"]
OWN_COLUMNS = ["rater_1_label", "rater_2_label", "classifier_label", "adjudicated_label"]


def _audit_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rater, label, at) of all annotators, each column of the audit table being one."""
    wide = read(spark, sf_dir, "outcome_audit_reconciled").select(F.col("obligation_id").alias("item_id"), *OWN_COLUMNS)
    own = wide.unpivot("item_id", OWN_COLUMNS, "rater", "label").withColumn("at", F.lit(None).cast("timestamp_ntz"))
    more = read(spark, sf_dir, "audit_labels").select(F.col("obligation_id").alias("item_id"), F.col("rater_id").alias("rater"), "label", F.col("labelled_at").alias("at"))
    return own.unionByName(more)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = annotators.resolved(_audit_votes(spark, sf_dir), LABELS)
    best = annotators.consensus(table, model).select(F.col("item_id").alias("obligation_id"), F.col("label").alias("best"))
    given = annotators.normal(F.col("classifier_label"), LABELS)
    own = read(spark, sf_dir, "outcome_audit_reconciled").select("obligation_id", given.alias("given")).filter("obligation_id IS NOT NULL AND given IS NOT NULL")
    # repeated rows of an obligation: the last label in the list counts, as among its votes
    own = own.groupBy("obligation_id").agg(F.max_by("given", F.array_position(F.array(*map(F.lit, LABELS)), F.col("given"))).alias("given"))
    return own.join(best, "obligation_id").filter(F.col("best") != F.col("given")).select("obligation_id")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = annotators.resolved(_audit_votes(spark, sf_dir), LABELS)
    return annotators.consensus(table, model).withColumnRenamed("item_id", "obligation_id")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = annotators.resolved(_audit_votes(spark, sf_dir), LABELS)
    return spark.createDataFrame(annotators.reliability(model), "rater string, skill double, accuracy double, bits double")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.examined(read(spark, sf_dir, "comments"), "document_id", ["comment", "title"]).select(F.col("id").alias("document_id"), "field").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoding_repair.examined(read(spark, sf_dir, "comments"), "document_id", ["comment", "title"])
    return found.select(F.col("id").alias("document_id"), "field", "kind", "chain", "restored", "gain")


def _own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that say something themselves, instead of pointing to an attachment."""
    return read(spark, sf_dir, "comments").filter(~F.coalesce("is_attachment_only", F.lit(False)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_copies.copies(_own_text(spark, sf_dir), "document_id", "comment").select(F.col("first_id").alias("first_document_id"), F.col("id").alias("document_id"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_copies.collapsed(_own_text(spark, sf_dir), "document_id", "comment").select(F.col("first_id").alias("document_id"), F.col("text").alias("comment"), "n_copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_ends.found(read(spark, sf_dir, "comments"), "document_id", ["comment"], "text_source").select(F.col("id").alias("document_id"))


def p6_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_ends.found(read(spark, sf_dir, "comments"), "document_id", ["comment", "title"], "text_source").withColumnRenamed("id", "document_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_ends.rates(read(spark, sf_dir, "comments"), "document_id", ["comment"], "text_source").withColumnRenamed("source", "text_source")


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cut_ends.rows(read(spark, sf_dir, "comments"), "document_id", ["comment"], "text_source")
    return cut_ends.limits(cut_ends.measured(texts)).withColumnRenamed("source", "text_source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.kinds(read(spark, sf_dir, "comments"), "document_id", "comment").withColumnRenamed("id", "document_id")


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.examined(read(spark, sf_dir, "comments"), "document_id", "comment")
    return found.select(F.col("id").alias("document_id"), F.array_join("kinds", ",").alias("kinds"), "n_spans", F.col("redacted").alias("comment")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(read(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p9_containers(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.quality(read(spark, sf_dir, "documents")).filter("prose_share < 0.5").select("doc_id")


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.quality(read(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_consensus": p2_consensus,
    "p2_reliability": p2_reliability,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_found": p6_found,
    "p6_cut": p6_cut,
    "p6_rates": p6_rates,
    "p6_limits": p6_limits,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}

#: The SQL below is written out on its own, with its own patterns and figures, so that a slip in the library shows.
_LETTERS = "replace(lower(regexp_replace(nfc_normalize({t}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')), 'ß', 'ss')"
_FIELD = r"^\s*(\p{L}[\p{L}\p{N} ''’/_.-]{0,38}?)\s*[:=]\s*(.*)$"
_COPIES = rf"""t AS (SELECT DISTINCT document_id, comment FROM comments WHERE is_attachment_only IS DISTINCT FROM TRUE AND comment IS NOT NULL AND document_id IS NOT NULL),
    b AS (SELECT document_id, comment, {_LETTERS.format(t='comment')} AS bare, list_filter(regexp_split_to_array(comment, '[;|\r\n\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda p: {_LETTERS.format(t='p')} <> '') AS parts FROM t),
    f AS (SELECT document_id, comment, COALESCE(NULLIF(bare, ''), chr(1) || comment) AS bare, CASE WHEN LEN(parts) > 1 AND LEN(list_filter(parts, lambda p: NOT regexp_matches(p, '{_FIELD}'))) = 0
        THEN array_to_string(list_sort(list_transform(parts, lambda p: {_LETTERS.format(t=f"regexp_extract(p, '{_FIELD}', 1)")} || ':' || {_LETTERS.format(t=f"regexp_extract(p, '{_FIELD}', 2)")})), '|') END AS form FROM b),
    k AS (SELECT document_id, comment, COALESCE(chr(2) || MIN(form) OVER (PARTITION BY bare), bare) AS canonical FROM f),
    g AS (SELECT document_id, comment, MIN(document_id) OVER (PARTITION BY canonical) AS first_id, canonical FROM k)"""
_OPEN = r"[^.!?\s)\]”’\"»''][)\]”’\"»''\s]*$|(?:\.{3,}|…)[\])>\s]*$|\[[^\]]{0,30}\]\s*$|[)\]”’\"»'']\s*$|\s{40}$"

#: The other queries learn a model, merge symbols or fill containers, which SQL can't express; tests/llm hold them against brute force, round trips and held-out cases.
SQL: dict[str, str] = {
    "p5_found": f"WITH {_COPIES} SELECT DISTINCT first_id AS first_document_id, document_id FROM g WHERE document_id <> first_id",
    "p5_collapsed": f"""WITH {_COPIES}, n AS (SELECT first_id, COUNT(DISTINCT document_id) AS n_copies FROM g GROUP BY 1)
        SELECT first_id AS document_id, (SELECT MIN(comment) FROM t WHERE document_id = first_id) AS comment, n_copies FROM n""",
    "p6_limits": f"""WITH t AS (SELECT DISTINCT COALESCE(text_source, '(none)') AS s, LENGTH(comment) AS c, strlen(comment) AS o, comment, regexp_matches(right(comment, 48), '{_OPEN}')::INT AS e FROM comments
            WHERE document_id IS NOT NULL AND LENGTH(trim(comment)) > 0),
        h AS (SELECT s, u, l, COUNT(*) AS n, AVG(e) AS a FROM (SELECT s, 'char' AS u, c AS l, e FROM t UNION ALL SELECT s, 'byte', o, e FROM t) GROUP BY 1, 2, 3),
        w AS (SELECT h.s, h.u, h.l, ANY_VALUE(h.n) AS n, ANY_VALUE(h.a) AS a, COALESCE(SUM(v.n) FILTER (v.l <> h.l), 0) / 40 AS r FROM h JOIN h v ON h.s = v.s AND h.u = v.u AND v.l BETWEEN h.l - 20 AND h.l + 20 GROUP BY 1, 2, 3)
        SELECT s AS text_source, 'comment' AS field, u AS unit, CAST(l AS INT) AS length, n AS n_texts, a AS open_share FROM w WHERE n >= 8 + 4 * r AND a >= 0.5""",
}
