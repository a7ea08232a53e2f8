"""Queries on scans, filters, projections, joins, sets and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.functions import numbers, text
from rulewake.operators import rollup, tables
from rulewake.session import read

#: White space of Unicode for DuckDB's expressions, as in functions.text.
S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = f"regexp_replace(COALESCE(comment, ''), '^{S}+|{S}+$', '', 'g')"
SQUEEZE = f"trim(regexp_replace(COALESCE(comment, ''), '{S}+', ' ', 'g'))"


def _c(spark, d):
    return read(spark, d, "comments")


def sc8_projected_scan(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).select("document_id", "docket_id", "posted_date").distinct()


def sc9_semi_scan(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).join(read(spark, d, "stage4_matches").select(F.col("comment_id").alias("document_id")), "document_id", "left_semi").groupBy("agency").agg(F.count("*").alias("n"))


def sc15_dominant(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).agg(F.mode(F.col("agency"), True).alias("agency"), F.mode(F.col("data_year"), True).alias("data_year"))


def sk10_release(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.sources.sinks import release

    return release(read(spark, d, "stage4_matches"), ["comment_id", "obligation_id", "addressed", "stance"])


def pf6_eligibility_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.eligibility_counts(_c(spark, d))


def pf6_eligible(spark: SparkSession, d: str) -> DataFrame:
    return tables.eligible(_c(spark, d)).groupBy("text_source").agg(F.count("*").alias("n"))


def pf7_docket_filter(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked")
    return a.filter((F.col("n_comments") >= 50) & F.col("proposed_year").isNotNull() & F.col("final_year").isNotNull() & F.col("year_cluster").isin("2009-2016", "2017-2023")).select("docket_id", "n_comments", "year_cluster").distinct()


def pf9_usable_corpus(spark: SparkSession, d: str) -> DataFrame:
    return tables.usable_corpus(_c(spark, d)).groupBy("data_year").agg(F.count("*").alias("n"))


def pf10_addressed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stage4_matches").filter("addressed").groupBy("via").agg(F.count("*").alias("n"))


def pf14_truncated_pairs(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.sources.sinks import truncated_pairs

    return truncated_pairs(read(spark, d, "stage4_matches")).groupBy("docket_id", "rule_type").agg(F.count("*").alias("n"))


def pf15_year_between(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "anchor_rules_locked").filter(F.col("final_year").between(2010, 2016)).select("docket_id", "final_year").distinct()


def pf17_not_yet_coded(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).join(read(spark, d, "stage4_matches").select(F.col("comment_id").alias("document_id")), "document_id", "left_anti").groupBy("agency").agg(F.count_distinct("document_id").alias("n"))


def j1_kinds_on_matches(spark: SparkSession, d: str) -> DataFrame:
    kinds = _c(spark, d).groupBy("document_id").agg(F.min("title").alias("title")).select(F.col("document_id").alias("comment_id"), text.submitter_kind(F.col("title")).alias("kind"))
    return read(spark, d, "stage4_matches").join(kinds, "comment_id", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def j2_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    n = _c(spark, d).groupBy("docket_id").agg(F.count("*").alias("n_rows"))
    return tables.left_filled(read(spark, d, "anchor_rules_locked").select("docket_id", "selection_method"), n, ["docket_id"], {"n_rows": 0})


def j3_rater_join(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit_labels").filter("rater_id IN ('rater_5', 'rater_18')").select("obligation_id", "rater_id", "label").distinct()
    x, y = (a.filter(F.col("rater_id") == r).groupBy("obligation_id").agg(F.max("label").alias(r)) for r in ("rater_5", "rater_18"))
    key = read(spark, d, "outcome_audit_reconciled").groupBy("obligation_id").agg(F.max("classifier_label").alias("key_label"))
    return x.join(y, "obligation_id").join(key, "obligation_id")


def j4_left_chain(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d).filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.count("*").alias("n_comments"))
    v = rollup.wide_counts(read(spark, d, "verified_obligations"), "docket_id", "rule_type", ["proposed", "final"])
    y = read(spark, d, "anchor_rules_locked").groupBy("docket_id").agg(F.min("proposed_year").alias("first_proposed"), F.min("final_year").alias("first_final"))
    return c.join(v, "docket_id", "left").join(y, "docket_id", "left").fillna({"proposed": 0, "final": 0})


def j8_reversal_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("docket_id", "doc_id", F.left("text", F.lit(200)).alias("title"), "text", "rule_type").filter("docket_id IS NOT NULL AND text IS NOT NULL")
    return tables.reversal_pairs(docs.filter("rule_type = 'final'"), docs.filter("rule_type = 'proposed'"), 2).withColumnRenamed("n_parts", "n_shared_parts")


def j11_window(spark: SparkSession, d: str) -> DataFrame:
    periods = read(spark, d, "anchor_rules_locked").groupBy("docket_id").agg(F.min("proposed_year").alias("p"), F.max("final_year").alias("f")).filter("p IS NOT NULL AND f IS NOT NULL")
    periods = periods.select("docket_id", F.make_date("p", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("opened"), F.make_date("f", F.lit(12), F.lit(31)).cast("timestamp_ntz").alias("closed"))
    pairs = read(spark, d, "stage4_matches").filter("addressed").select("comment_id", "obligation_id").distinct()
    return tables.windowed_pairs(pairs, _c(spark, d), periods).groupBy(text.docket_of_obligation(F.col("obligation_id")).alias("docket_id")).agg(F.count("*").alias("n"))


def j14_shared_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text IS NOT NULL AND docket_id IS NOT NULL").select("docket_id", F.md5(F.col("text").cast("binary")).alias("item"))
    size = _c(spark, d).groupBy("docket_id").agg(F.count("*").alias("n"))
    return tables.shared_with_larger(docs.join(size, "docket_id", "left").fillna({"n": 0}), "docket_id", "item", "n")


def j15_unresolved(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations").select(text.obligation_id(F.col("docket_id"), F.col("rule_type"), F.col("candidate_idx"), F.col("split_idx")).alias("obligation_id")).distinct()
    return read(spark, d, "stage4_matches").select("obligation_id").distinct().join(v, "obligation_id", "left_anti")


def j17_alignment(spark: SparkSession, d: str) -> DataFrame:
    return tables.differing_keys(read(spark, d, "outcome_audit_reconciled"), read(spark, d, "audit_labels"), ["obligation_id"])


def so1_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "stage4_matches").select(F.col("comment_id").alias("id"), "via")
    b = _c(spark, d).select(F.col("document_id").alias("id"), "agency")
    return a.unionByName(b, allowMissingColumns=True).groupBy("via", "agency").agg(F.count("*").alias("n"))


def so2_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "anchor_rules_locked").select("docket_id").exceptAll(_c(spark, d).select("docket_id").distinct())


def sl1_sorted_anchors(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").select("docket_id", "year_cluster", "n_comments", "selection_method").distinct()
    return tables.first_by(a, ["docket_id"], F.asc("selection_method"), F.desc_nulls_last("n_comments")).orderBy("year_cluster", F.desc("n_comments"), "docket_id")


def sl2_largest_dockets(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "docket_id").limit(25)


def w1_top_matches(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches").select("comment_id", "obligation_id", "cosine_similarity").distinct()
    best = m.groupBy("comment_id", "obligation_id").agg(F.max("cosine_similarity").alias("cosine_similarity"))
    top = tables.top_by(best, ["comment_id"], 3, F.desc("cosine_similarity"), F.col("obligation_id"))
    return top.filter("cosine_similarity >= 0.3")


def w2_first_per_docket(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("docket_id IS NOT NULL AND rule_type IS NOT NULL").select("docket_id", "rule_type", "doc_id", "n_chars", "publication_date")
    return tables.first_by(docs, ["docket_id", "rule_type"], F.desc_nulls_last("n_chars"), F.asc("doc_id"))


def w7_docket_size(spark: SparkSession, d: str) -> DataFrame:
    n = _c(spark, d).groupBy("docket_id").agg(F.count("*").alias("docket_size"))
    return n.groupBy("docket_size").agg(F.count("*").alias("n_dockets"))


def c9_docket_flags(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").groupBy("docket_id").agg(F.min("proposed_year").alias("p"), F.max("final_year").alias("f"), F.max("n_comments").alias("n"))
    flags = F.array_compact(F.array(F.when(F.col("f") < F.col("p"), "ORDER"), F.when(F.col("p") > 2018, "POST_CORPUS"), F.when(F.col("n").isNull(), "UNCOUNTED")))
    return a.select("docket_id", F.array_join(flags, ",").alias("flags")).filter("flags <> ''")


def c11_status(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.count_if(F.col("rule_type") == "proposed").alias("p"), F.count_if(F.col("rule_type") == "final").alias("f"))
    status = F.when((F.col("p") > 0) & (F.col("f") > 0), "LOCKABLE").when((F.col("p") == 0) & (F.col("f") == 0), "EMPTY").otherwise("NO_PAIR")
    return g.select("docket_id", status.alias("status"))


def c16_plan(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.operators.labels import plan

    targets = read(spark, d, "anchor_rules_locked").select("docket_id").distinct().withColumn("rule_type", F.explode(F.array(F.lit("proposed"), F.lit("final"))))
    return plan(targets, read(spark, d, "documents").filter("rule_type IS NOT NULL AND docket_id IS NOT NULL"), read(spark, d, "verified_obligations"), ["docket_id", "rule_type"])


def c18_universe(spark: SparkSession, d: str) -> DataFrame:
    return rollup.universe(read(spark, d, "verified_obligations"), read(spark, d, "stage4_matches"))


def c25_missing_rules(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "documents").filter("docket_id IS NOT NULL").select("docket_id", "rule_type").distinct()
    expected = read(spark, d, "anchor_rules_locked").select("docket_id").distinct().withColumn("rule_type", F.explode(F.array(F.lit("proposed"), F.lit("final"))))
    return expected.join(have, ["docket_id", "rule_type"], "left_anti")


def m3_dot(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    mean = e.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    first = e.join(mean, (e["vec_id"] == mean["first_id"]) & (e["label"] == mean["label"]), "left_semi").select("label", F.col("embedding").alias("reference"))
    return e.join(first, "label").select("vec_id", F.round(numbers.dot(F.col("embedding"), F.col("reference")), 5).alias("similarity"))


_names = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _names}

_OBLIGATION = "docket_id || '__' || rule_type || '__' || CAST(candidate_idx AS VARCHAR) || '_' || CAST(split_idx AS VARCHAR)"
_KIND_WORDS = "|".join(w.replace(r"\.", r"\.") for w in text.ORGANISATION_WORDS)
KIND = f"""CASE WHEN t IS NULL OR t = '' THEN 'other' WHEN regexp_matches(t, '(?i)^comments?\\s+(?:of|from)\\s+') THEN 'organizational'
    WHEN regexp_matches(t, '(?i)^comment\\s+submitted\\s+by\\s+') THEN CASE WHEN regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{_KIND_WORDS})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'organizational' ELSE 'individual' END
    WHEN regexp_matches(t, '(?i)^anonymous\\s+public\\s+comment\\b') THEN 'individual' WHEN regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{_KIND_WORDS})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'organizational' ELSE 'other' END"""
TITLE = f"regexp_replace(title, '^{S}+|{S}+$', '', 'g')"
DOCKET = "NULLIF(regexp_extract(obligation_id, '^(.+?)__(?:proposed|final)__', 1), '')"

SQL = {
    "sc8_projected_scan": "SELECT DISTINCT document_id, docket_id, posted_date FROM comments",
    "sc9_semi_scan": "SELECT agency, COUNT(*) AS n FROM comments WHERE document_id IN (SELECT comment_id FROM stage4_matches) GROUP BY agency",
    "sc15_dominant": """SELECT (SELECT agency FROM comments WHERE agency IS NOT NULL GROUP BY agency ORDER BY COUNT(*) DESC, agency LIMIT 1) AS agency,
        (SELECT data_year FROM comments WHERE data_year IS NOT NULL GROUP BY data_year ORDER BY COUNT(*) DESC, data_year LIMIT 1) AS data_year""",
    "sk10_release": "SELECT DISTINCT comment_id, obligation_id, addressed, stance FROM stage4_matches",
    "pf6_eligibility_counts": f"""WITH r AS (SELECT COALESCE(is_attachment_only, FALSE) AND COALESCE(text_source = 'attachment_failed', FALSE) AS f, LENGTH({STRIP}) < 50 AS s FROM comments)
        SELECT COUNT(*) FILTER (WHERE f) AS attachment_failed, COUNT(*) FILTER (WHERE s) AS too_short, COUNT(*) FILTER (WHERE f OR s) AS total_dropped, COUNT(*) FILTER (WHERE NOT (f OR s)) AS n_kept FROM r""",
    "pf6_eligible": f"""SELECT text_source, COUNT(*) AS n FROM comments
        WHERE NOT (COALESCE(is_attachment_only, FALSE) AND COALESCE(text_source = 'attachment_failed', FALSE)) AND LENGTH({STRIP}) >= 50 GROUP BY text_source""",
    "pf7_docket_filter": """SELECT DISTINCT docket_id, n_comments, year_cluster FROM anchor_rules_locked
        WHERE n_comments >= 50 AND proposed_year IS NOT NULL AND final_year IS NOT NULL AND year_cluster IN ('2009-2016', '2017-2023')""",
    "pf9_usable_corpus": f"SELECT data_year, COUNT(*) AS n FROM comments WHERE text_source IS DISTINCT FROM 'attachment_failed' AND LENGTH({STRIP}) > 0 GROUP BY data_year",
    "pf10_addressed": "SELECT via, COUNT(*) AS n FROM stage4_matches WHERE addressed GROUP BY via",
    "pf14_truncated_pairs": """SELECT regexp_extract(obligation_id, '^(.+?)__(proposed|final)__', 1) AS docket_id, regexp_extract(obligation_id, '^(.+?)__(proposed|final)__', 2) AS rule_type,
        COUNT(*) AS n FROM stage4_matches WHERE uncertainty_truncated GROUP BY ALL""",
    "pf15_year_between": "SELECT DISTINCT docket_id, final_year FROM anchor_rules_locked WHERE final_year BETWEEN 2010 AND 2016",
    "pf17_not_yet_coded": "SELECT agency, COUNT(DISTINCT document_id) AS n FROM comments WHERE document_id NOT IN (SELECT comment_id FROM stage4_matches WHERE comment_id IS NOT NULL) GROUP BY agency",
    "j1_kinds_on_matches": f"""WITH k AS (SELECT document_id, {KIND} AS kind FROM (SELECT document_id, MIN(title) AS title, {TITLE.replace('title', 'MIN(title)', 1)} AS t FROM comments GROUP BY document_id))
        SELECT COALESCE(kind, 'unknown') AS kind, COUNT(*) AS n FROM stage4_matches LEFT JOIN k ON comment_id = document_id GROUP BY ALL""",
    "j2_zero_filled": """SELECT a.docket_id, selection_method, COALESCE(n_rows, 0) AS n_rows FROM anchor_rules_locked a
        LEFT JOIN (SELECT docket_id, COUNT(*) AS n_rows FROM comments GROUP BY docket_id) USING (docket_id)""",
    "j3_rater_join": """WITH x AS (SELECT obligation_id, MAX(label) AS rater_5 FROM audit_labels WHERE rater_id = 'rater_5' GROUP BY 1), y AS (SELECT obligation_id, MAX(label) AS rater_18 FROM audit_labels WHERE rater_id = 'rater_18' GROUP BY 1),
        k AS (SELECT obligation_id, MAX(classifier_label) AS key_label FROM outcome_audit_reconciled GROUP BY 1) SELECT * FROM x JOIN y USING (obligation_id) JOIN k USING (obligation_id)""",
    "j4_left_chain": """WITH c AS (SELECT docket_id, COUNT(*) AS n_comments FROM comments WHERE docket_id IS NOT NULL GROUP BY 1),
        v AS (SELECT docket_id, COUNT(*) FILTER (WHERE rule_type = 'proposed') AS proposed, COUNT(*) FILTER (WHERE rule_type = 'final') AS final FROM verified_obligations WHERE docket_id IS NOT NULL GROUP BY 1),
        y AS (SELECT docket_id, MIN(proposed_year) AS first_proposed, MIN(final_year) AS first_final FROM anchor_rules_locked GROUP BY 1)
        SELECT docket_id, n_comments, COALESCE(proposed, 0) AS proposed, COALESCE(final, 0) AS final, first_proposed, first_final FROM c LEFT JOIN v USING (docket_id) LEFT JOIN y USING (docket_id)""",
    "j11_window": f"""WITH p AS (SELECT docket_id, make_date(MIN(proposed_year), 1, 1) AS o, make_date(MAX(final_year), 12, 31) AS e FROM anchor_rules_locked GROUP BY 1 HAVING MIN(proposed_year) IS NOT NULL AND MAX(final_year) IS NOT NULL),
        w AS (SELECT document_id, MIN(COALESCE(received_date, posted_date)) AS came FROM comments GROUP BY 1), m AS (SELECT DISTINCT comment_id, obligation_id, {DOCKET} AS docket_id FROM stage4_matches WHERE addressed)
        SELECT docket_id, COUNT(*) AS n FROM m JOIN w ON comment_id = document_id JOIN p USING (docket_id) WHERE came >= o AND came <= e + INTERVAL 1 DAY GROUP BY 1""",
    "j14_shared_rules": """WITH s AS (SELECT docket_id, COUNT(*) AS n FROM comments GROUP BY 1), r AS (SELECT DISTINCT docket_id, md5(text) AS item, COALESCE(n, 0) AS n FROM documents LEFT JOIN s USING (docket_id) WHERE text IS NOT NULL AND docket_id IS NOT NULL),
        k AS (SELECT *, ROW_NUMBER() OVER w AS rn, FIRST_VALUE(docket_id) OVER w AS kept_owner FROM r WINDOW w AS (PARTITION BY item ORDER BY n DESC, docket_id)) SELECT docket_id, item, kept_owner FROM k WHERE rn > 1""",
    "j15_unresolved": f"SELECT DISTINCT obligation_id FROM stage4_matches WHERE obligation_id IS NOT NULL AND obligation_id NOT IN (SELECT {_OBLIGATION} FROM verified_obligations WHERE {_OBLIGATION} IS NOT NULL)",
    "j17_alignment": """SELECT obligation_id, 'left' AS side FROM (SELECT DISTINCT obligation_id FROM outcome_audit_reconciled EXCEPT SELECT obligation_id FROM audit_labels)
        UNION ALL SELECT obligation_id, 'right' FROM (SELECT DISTINCT obligation_id FROM audit_labels EXCEPT SELECT obligation_id FROM outcome_audit_reconciled)""",
    "so1_union_by_name": "SELECT via, agency, COUNT(*) AS n FROM (SELECT via, NULL AS agency FROM stage4_matches UNION ALL SELECT NULL, agency FROM comments) GROUP BY ALL",
    "so2_difference": "SELECT docket_id FROM anchor_rules_locked EXCEPT ALL SELECT DISTINCT docket_id FROM comments",
    "sl1_sorted_anchors": """SELECT docket_id, year_cluster, n_comments, selection_method FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY docket_id ORDER BY selection_method, n_comments DESC NULLS LAST) AS r
        FROM (SELECT DISTINCT docket_id, year_cluster, n_comments, selection_method FROM anchor_rules_locked)) WHERE r = 1""",
    "sl2_largest_dockets": "SELECT docket_id, COUNT(*) AS n FROM comments WHERE docket_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, docket_id LIMIT 25",
    "w1_top_matches": """SELECT comment_id, obligation_id, cosine_similarity, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY comment_id ORDER BY cosine_similarity DESC, obligation_id) AS INT) AS rank
        FROM (SELECT comment_id, obligation_id, MAX(cosine_similarity) AS cosine_similarity FROM stage4_matches GROUP BY 1, 2)) WHERE rank <= 3 AND cosine_similarity >= 0.3""",
    "w2_first_per_docket": """SELECT docket_id, rule_type, doc_id, n_chars, publication_date FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY docket_id, rule_type ORDER BY n_chars DESC NULLS LAST, doc_id) AS r
        FROM documents WHERE docket_id IS NOT NULL AND rule_type IS NOT NULL) WHERE r = 1""",
    "w7_docket_size": "SELECT docket_size, COUNT(*) AS n_dockets FROM (SELECT docket_id, COUNT(*) AS docket_size FROM comments GROUP BY 1) GROUP BY 1",
    "c9_docket_flags": """WITH a AS (SELECT docket_id, MIN(proposed_year) AS p, MAX(final_year) AS f, MAX(n_comments) AS n FROM anchor_rules_locked GROUP BY 1)
        SELECT docket_id, flags FROM (SELECT docket_id, concat_ws(',', CASE WHEN f < p THEN 'ORDER' END, CASE WHEN p > 2018 THEN 'POST_CORPUS' END, CASE WHEN n IS NULL THEN 'UNCOUNTED' END) AS flags FROM a) WHERE flags <> ''""",
    "c11_status": """SELECT docket_id, CASE WHEN p > 0 AND f > 0 THEN 'LOCKABLE' WHEN p = 0 AND f = 0 THEN 'EMPTY' ELSE 'NO_PAIR' END AS status FROM
        (SELECT docket_id, COUNT(*) FILTER (WHERE rule_type = 'proposed') AS p, COUNT(*) FILTER (WHERE rule_type = 'final') AS f FROM documents WHERE docket_id IS NOT NULL GROUP BY 1)""",
    "c16_plan": """WITH t AS (SELECT DISTINCT docket_id, r.rule_type FROM anchor_rules_locked, (VALUES ('proposed'), ('final')) r(rule_type)), s AS (SELECT DISTINCT docket_id, rule_type, TRUE AS s FROM documents),
        d AS (SELECT DISTINCT docket_id, rule_type, TRUE AS d FROM verified_obligations), x AS (SELECT docket_id, rule_type, CASE WHEN d THEN 'done' WHEN s THEN 'ready' ELSE 'missing' END AS status FROM t LEFT JOIN s USING (docket_id, rule_type) LEFT JOIN d USING (docket_id, rule_type))
        SELECT *, CASE status WHEN 'done' THEN 'already labelled' WHEN 'missing' THEN 'no source' END AS reason FROM x""",
    "c18_universe": f"""WITH n AS (SELECT DISTINCT {DOCKET} AS docket_id, regexp_extract(obligation_id, '__(proposed|final)__', 1) AS rule_type FROM stage4_matches)
        SELECT DISTINCT {_OBLIGATION} AS obligation_id, docket_id FROM verified_obligations SEMI JOIN n USING (docket_id, rule_type) WHERE verified AND {_OBLIGATION} IS NOT NULL""",
    "c25_missing_rules": """SELECT DISTINCT docket_id, r.rule_type FROM anchor_rules_locked, (VALUES ('proposed'), ('final')) r(rule_type) EXCEPT SELECT docket_id, rule_type FROM documents""",
    "m3_dot": """WITH f AS (SELECT label, MIN(vec_id) AS first_id FROM embeddings GROUP BY 1), r AS (SELECT e.label, e.embedding AS reference FROM embeddings e JOIN f ON e.label = f.label AND e.vec_id = f.first_id)
        SELECT vec_id, ROUND(list_sum(list_transform(list_zip(embedding, reference), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5) AS similarity FROM embeddings JOIN r USING (label)""",
}
