"""Queries that roll comments up to obligations, dockets and cells, and the statistics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.operators import rollup
from rulewake.operators import statistics as st
from rulewake.plans.scans import DOCKET, KIND, SQUEEZE, TITLE
from rulewake.session import read

LABELS = ["SURVIVED-unchanged", "SURVIVED-edited", "MODIFIED", "DROPPED", "NEW"]


def _matches(spark, d):
    return read(spark, d, "stage4_matches")


def _kinds(spark, d):
    titles = read(spark, d, "comments").groupBy("document_id").agg(F.min("title").alias("title"))
    return titles.select(F.col("document_id").alias("comment_id"), text.submitter_kind(F.col("title")).alias("submitter_kind"))


def _audit(spark, d):
    """One row per audited obligation with its labels in normal spelling."""
    columns = ["rater_1_label", "rater_2_label", "classifier_label", "adjudicated_label"]
    a = read(spark, d, "outcome_audit_reconciled").groupBy("obligation_id").agg(*(F.max(c).alias(c) for c in columns))
    return a.select("obligation_id", text.docket_of_obligation(F.col("obligation_id")).alias("docket_id"), *(text.loose_label(F.col(c), LABELS).alias(c[:-6]) for c in columns))


def _engaged(spark, d):
    """Audited obligations with their engagement: organisation majority and whether the duty survived."""
    e = rollup.engagement(_matches(spark, d), _kinds(spark, d))
    joined = _audit(spark, d).filter("classifier IS NOT NULL").join(e, "obligation_id", "left").fillna({"n_addressing": 0, "n_org": 0, "n_ind": 0, "org_share": 0.0})
    return joined.withColumn("majority", F.col("org_share") > 0.5).withColumn("engaged", F.col("n_addressing") >= 1).withColumn("revised", F.col("classifier").isin("MODIFIED", "DROPPED", "SURVIVED-edited"))


def a1_obligation_table(spark: SparkSession, d: str) -> DataFrame:
    obligations = rollup.universe(read(spark, d, "verified_obligations"), _matches(spark, d))
    t = rollup.obligation_table(obligations, _matches(spark, d), _kinds(spark, d))
    return t.select(*(F.round(c, 8).alias(c) if c in ("pct_organizational", "pct_individual", "mean_cosine") else F.col(c) for c in t.columns))


def a2_engagement(spark: SparkSession, d: str) -> DataFrame:
    return rollup.engagement(_matches(spark, d), _kinds(spark, d)).withColumn("org_share", F.round("org_share", 6))


def a3_engagement_rows(spark: SparkSession, d: str) -> DataFrame:
    return rollup.engagement(_matches(spark, d), _kinds(spark, d), distinct_titles=True).withColumn("org_share", F.round("org_share", 6))


def a4_stance_counts(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d).filter("addressed").withColumn("stance", text.stance(F.col("stance")))
    return m.groupBy("obligation_id").agg(*(F.count_if(F.col("stance") == s).alias(s.lower()) for s in text.STANCES))


def a5_docket_attachments(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "comments").filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.count("*").alias("n_comments"), F.count_if("is_attachment_only").alias("n_attach_only"))
    return g.withColumn("pct_attach_only", F.round(100 * F.col("n_attach_only") / F.col("n_comments"), 6))


def a6_rule_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rollup.wide_counts(read(spark, d, "documents"), "docket_id", "rule_type", ["proposed", "final"])


def a8_label_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return rollup.frequencies(_audit(spark, d), "classifier").withColumn("share", F.round("share", 6))


def a14_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.totals(read(spark, d, "comments"), ["agency", "data_year"], {"n": F.count("*"), "n_attach_only": F.count_if("is_attachment_only")})


def a16_cluster_votes(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.operators.clusters import word_key

    c = read(spark, d, "comments").groupBy("document_id").agg(F.min("comment").alias("comment"), F.min("docket_id").alias("docket_id"))
    clusters = c.select(F.col("document_id").alias("comment_id"), F.concat(F.coalesce("docket_id", F.lit("")), F.lit("::"), word_key(F.col("comment"))).alias("cluster")).filter("cluster IS NOT NULL")
    return rollup.cluster_votes(_matches(spark, d), _kinds(spark, d), clusters).withColumn("org_share", F.round("org_share", 6))


def a17_descriptive(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "comments")
    return c.agg(
        F.count("*").alias("n_rows"), F.count_distinct("document_id").alias("n_comments"), F.count_distinct("docket_id").alias("n_dockets"), F.count_if("is_attachment_only").alias("n_attach_only"),
        F.round(F.avg(F.length("comment")), 4).alias("mean_chars"), F.min("posted_date").alias("first_posted"), F.max("posted_date").alias("last_posted"),
    )


def a18_prevalence(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations")
    flags = v.select(*(F.col(c).cast("int").alias(c) for c in ("verified", "passive_voice", "is_conditional")), F.col("cfr_part").isNotNull().cast("int").alias("has_part"), F.col("cross_reference").isNotNull().cast("int").alias("has_reference"))
    return flags.unpivot([], flags.columns, "flag", "value").groupBy("flag").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("share"))


def a19_quantiles(spark: SparkSession, d: str) -> DataFrame:
    low = rollup.lower_quantile(read(spark, d, "anchor_rules_locked"), ["year_cluster"], "n_comments", {"low_33": 1 / 3, "low_67": 2 / 3})
    exact = read(spark, d, "anchor_rules_locked").groupBy("year_cluster").agg(F.round(F.percentile("n_comments", F.lit(0.5)), 6).alias("median"))
    return low.join(exact, "year_cluster")


def a20_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollup.histogram(_matches(spark, d), "cosine_similarity", [i / 10 for i in range(11)])


def a21_confusion(spark: SparkSession, d: str) -> DataFrame:
    return rollup.confusion(_audit(spark, d), "rater_1", "classifier", LABELS)


def a22_class_scores(spark: SparkSession, d: str) -> DataFrame:
    s = rollup.class_scores(_audit(spark, d), "rater_1", "classifier", LABELS)
    return s.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


def a23_cost(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("via").agg(F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def a24_most_copied(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "comments").withColumn("h", text.comment_hash(F.col("comment"))).filter("h IS NOT NULL")
    g = c.groupBy("h").agg(F.count("*").alias("n"), F.min_by("comment", F.struct("document_id", "comment")).alias("sample"))
    return g.orderBy(F.desc("n"), "h").limit(5)


def a25_model_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations").distinct().filter("candidate_idx IS NOT NULL")
    g = v.groupBy("docket_id", "rule_type", "candidate_idx").agg(F.count_distinct("modal_strength").alias("n_strengths"), F.count_distinct("amendatory_action").alias("n_actions"), F.count("*").alias("n"))
    return g.filter("n > 1").agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("n_strengths") == 1).cast("int")), 6).alias("same_strength"), F.round(F.avg((F.col("n_actions") == 1).cast("int")), 6).alias("same_action"))


def t1_yates(spark: SparkSession, d: str) -> DataFrame:
    c = st.cells(_engaged(spark, d), F.col("engaged"), F.col("revised"))
    a, b, x, y = (F.col(n) for n in "abcd")
    chi2 = st.yates(a, b, x, y)
    return c.select("a", "b", "c", "d", F.round(chi2, 6).alias("chi2"), F.round(st.cramers_v(chi2, a + b + x + y), 6).alias("cramers_v"))


def t3_two_proportions(spark: SparkSession, d: str) -> DataFrame:
    c = st.cells(_engaged(spark, d), F.col("engaged"), F.col("revised"))
    return c.select(F.round(st.two_proportions(F.col("a"), F.col("a") + F.col("b"), F.col("c"), F.col("c") + F.col("d")), 6).alias("z"))


def t4_odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = st.cells(_engaged(spark, d), F.col("engaged"), F.col("revised"))
    o = st.odds_ratio(*(F.col(n) for n in "abcd"))
    row = c.first()
    return c.select("a", "b", "c", "d", *(F.round(v, 6).alias(n) for n, v in o.items()), F.round(F.lit(st.fisher_p(*row)), 6).alias("p"))


def t5_odds_ratio_plain(spark: SparkSession, d: str) -> DataFrame:
    c = st.cells(_engaged(spark, d), F.col("majority"), F.col("revised"))
    return c.select(*(F.round(v, 6).alias(n) for n, v in st.odds_ratio(*(F.col(n) for n in "abcd"), adjusted=False).items()))


def t6_strata(spark: SparkSession, d: str) -> DataFrame:
    return st.strata_cells(_engaged(spark, d).filter("docket_id IS NOT NULL"), "docket_id", F.col("engaged"), F.col("revised"))


def t6_mantel_haenszel(spark: SparkSession, d: str) -> DataFrame:
    strata = t6_strata(spark, d).orderBy("stratum").collect()  # one row per docket
    p = st.mantel_haenszel([(r["a"], r["b"], r["c"], r["d"]) for r in strata])
    return spark.createDataFrame([tuple(round(float(v), 6) if isinstance(v, float) else v for v in p.__dict__.values())], "odds_ratio double, ci_lo double, ci_hi double, p_null double, p_equal double, strata int, n int")


def _logit_rows(spark, d, fixed):
    e = _engaged(spark, d).filter("docket_id IS NOT NULL").withColumn("log_n", F.log1p("n_addressing"))
    return st.clustered_logit(e, F.col("revised"), {"majority": F.col("majority"), "log_n": F.col("log_n")}, "docket_id", fixed_effects=fixed, penalty=0.1 if fixed else 0.0)


def _as_rows(spark, model, names):
    out = [(n, *(round(float(v), 4) for v in model.ratio(n)), model.n, model.clusters) for n in names]
    return spark.createDataFrame(out, "term string, odds_ratio double, ci_lo double, ci_hi double, p double, n int, clusters int")


def t7_clustered_logit(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(spark, _logit_rows(spark, d, False), ["majority", "log_n"])


def t8_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(spark, _logit_rows(spark, d, True), ["majority", "log_n"])


def t9_separation(spark: SparkSession, d: str) -> DataFrame:
    g = _engaged(spark, d).filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.count("*").alias("n"), F.count_if("revised").alias("n_revised"), F.count_if("majority").alias("n_majority"))
    return g.withColumn("varies", (F.col("n_revised") > 0) & (F.col("n_revised") < F.col("n"))).withColumn("informative", F.col("varies") & (F.col("n_majority") > 0) & (F.col("n_majority") < F.col("n")))


def t10_interaction(spark: SparkSession, d: str) -> DataFrame:
    e = _engaged(spark, d).filter("docket_id IS NOT NULL").withColumn("late", text.docket_year(F.col("docket_id")) >= 2012)
    m = st.clustered_logit(e, F.col("revised"), {"engaged": F.col("engaged"), "late": F.col("late"), "engaged_late": F.col("engaged") & F.col("late")}, "docket_id")
    chi2, p = m.wald(["engaged_late"])
    return spark.createDataFrame([(round(float(chi2), 6), round(float(p), 6), m.n, m.clusters)], "wald double, p double, n int, clusters int")


def t11_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = st.kappa(_audit(spark, d), "rater_1", "rater_2")
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "chance", "kappa")))


def t12_kappa_by_class(spark: SparkSession, d: str) -> DataFrame:
    return st.kappa_by_class(_audit(spark, d), "rater_1", "rater_2", LABELS).withColumn("kappa", F.round("kappa", 6))


def t13_kappa_interval(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    counts = np.zeros((len(LABELS), len(LABELS)))
    for r in st.kappa_table(_audit(spark, d), "rater_1", "rater_2").collect():  # one row per pair of labels
        counts[LABELS.index(r["a"]), LABELS.index(r["b"])] = r["n"]
    low, high = st.kappa_bootstrap(counts)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (st.kappa_of_counts(counts), low, high))], "kappa double, ci_lo double, ci_hi double")


def t14_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = _engaged(spark, d).groupBy("classifier").agg(F.count_if("engaged").alias("hits"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("hits"), F.col("n"))
    return g.select("classifier", "hits", "n", F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


def t15_kappa_report(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    rows = None
    for x, y in (("rater_1", "rater_2"), ("rater_1", "classifier"), ("rater_2", "classifier"), ("classifier", "adjudicated")):
        k = st.kappa(a, x, y).select(F.lit(f"{x}/{y}").alias("pair"), "n", F.round("observed", 6).alias("observed"), F.round("kappa", 6).alias("kappa"))
        rows = k if rows is None else rows.unionByName(k)
    return rows


def t18_majority(spark: SparkSession, d: str) -> DataFrame:
    return st.cells(_engaged(spark, d).filter("n_addressing >= 2"), F.col("majority"), F.col("revised"))


def t19_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = _engaged(spark, d).select("org_share", "revised", F.explode(F.array(*(F.lit(t) for t in (0.33, 0.4, 0.5, 0.6, 0.67)))).alias("threshold"))
    above = F.col("org_share") > F.col("threshold")
    return e.groupBy("threshold").agg(F.count_if(above & F.col("revised")).alias("a"), F.count_if(above & ~F.col("revised")).alias("b"), F.count_if(~above & F.col("revised")).alias("c"), F.count_if(~above & ~F.col("revised")).alias("d"))


def t20_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("engaged"), F.col("revised")
    loo = rollup.leave_one_out(_engaged(spark, d).filter("docket_id IS NOT NULL"), "docket_id", {"a": x & y, "b": x & ~y, "c": ~x & y, "d": ~x & ~y})
    return loo.withColumn("chi2", F.round(st.yates(*(F.col(n) for n in "abcd")), 6))


def sl3_most_influential(spark: SparkSession, d: str) -> DataFrame:
    return t20_leave_one_out(spark, d).orderBy(F.desc("n_dropped"), "dropped").limit(10)


def c7_relabelled(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    return a.select("obligation_id", F.coalesce("adjudicated", "classifier").alias("outcome_state"), F.col("classifier").alias("headline"))


def c8_adjudication(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d).filter("rater_1 IS NOT NULL AND rater_2 IS NOT NULL")
    return a.select("obligation_id", F.when(F.col("rater_1") == F.col("rater_2"), F.col("rater_1")).otherwise("DISAGREE").alias("decision"))


def c19_engaged(spark: SparkSession, d: str) -> DataFrame:
    return _engaged(spark, d).filter("n_addressing >= 2 AND classifier IN ('MODIFIED', 'DROPPED')").select("obligation_id", "n_addressing", "classifier")


_names = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _names}


def _loose(c: str) -> str:
    return "CASE regexp_replace(lower(COALESCE(" + c + ", '')), '[^a-z0-9]', '', 'g') " + " ".join(f"WHEN '{''.join(x for x in n.lower() if x.isalnum())}' THEN '{n}'" for n in LABELS) + " END"


_KINDS = f"kinds AS (SELECT document_id AS comment_id, {KIND} AS submitter_kind FROM (SELECT document_id, {TITLE.replace('title', 'MIN(title)', 1)} AS t FROM comments GROUP BY document_id))"
_AUDIT = f"""audit AS (SELECT obligation_id, {DOCKET} AS docket_id, {_loose('r1')} AS rater_1, {_loose('r2')} AS rater_2, {_loose('cl')} AS classifier, {_loose('ad')} AS adjudicated
    FROM (SELECT obligation_id, MAX(rater_1_label) AS r1, MAX(rater_2_label) AS r2, MAX(classifier_label) AS cl, MAX(adjudicated_label) AS ad FROM outcome_audit_reconciled GROUP BY 1))"""
_ENGAGE = f"""{_KINDS}, engage AS (SELECT obligation_id, COUNT(DISTINCT m.comment_id) AS n_addressing, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE submitter_kind = 'organizational') AS n_org,
    COUNT(*) FILTER (WHERE submitter_kind = 'individual') AS n_ind FROM stage4_matches m LEFT JOIN kinds USING (comment_id) WHERE addressed GROUP BY 1)"""
_ENGAGED = f"""{_AUDIT}, {_ENGAGE}, e AS (SELECT a.*, COALESCE(n_addressing, 0) AS n_addressing, COALESCE(n_org / GREATEST(n_org + n_ind, 1), 0) > 0.5 AS majority, COALESCE(n_org / GREATEST(n_org + n_ind, 1), 0) AS org_share,
    COALESCE(n_addressing, 0) >= 1 AS engaged, classifier IN ('MODIFIED', 'DROPPED', 'SURVIVED-edited') AS revised FROM audit a LEFT JOIN engage USING (obligation_id) WHERE classifier IS NOT NULL)"""
_CELLS = "COUNT(*) FILTER (WHERE {x} AND revised) AS a, COUNT(*) FILTER (WHERE {x} AND NOT revised) AS b, COUNT(*) FILTER (WHERE NOT {x} AND revised) AS c, COUNT(*) FILTER (WHERE NOT {x} AND NOT revised) AS d"
_E = _CELLS.format(x="engaged")
_CHI2 = "(a + b + c + d) * POWER(GREATEST(ABS(a::DOUBLE * d - b::DOUBLE * c) - (a + b + c + d) / 2, 0), 2) / NULLIF((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0)"
_OBL = "docket_id || '__' || rule_type || '__' || CAST(candidate_idx AS VARCHAR) || '_' || CAST(split_idx AS VARCHAR)"
_STANCE = "upper(trim(stance))"
_NORMAL = f"lower({SQUEEZE})"


def _kappa(x: str, y: str, where: str = "") -> str:
    return f"""SELECT COUNT(*) AS n, AVG(({x} = {y})::INT) AS o, (SELECT SUM(p.n::DOUBLE * q.n) FROM (SELECT {x} AS l, COUNT(*) AS n FROM audit WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1) p
        JOIN (SELECT {y} AS l, COUNT(*) AS n FROM audit WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1) q USING (l)) / COUNT(*) / COUNT(*) AS c FROM audit WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


SQL = {
    "a1_obligation_table": f"""WITH {_KINDS}, named AS (SELECT DISTINCT {DOCKET} AS docket_id, regexp_extract(obligation_id, '__(proposed|final)__', 1) AS rule_type FROM stage4_matches),
        u AS (SELECT DISTINCT {_OBL} AS obligation_id, docket_id FROM verified_obligations SEMI JOIN named USING (docket_id, rule_type) WHERE verified AND {_OBL} IS NOT NULL),
        f AS (SELECT obligation_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_STANCE} = 'SUPPORTING') AS s, COUNT(*) FILTER (WHERE {_STANCE} = 'OPPOSING') AS o, COUNT(*) FILTER (WHERE {_STANCE} = 'SUGGESTING_MODIFICATION') AS m,
            COUNT(*) FILTER (WHERE submitter_kind = 'organizational') AS org, COUNT(*) FILTER (WHERE submitter_kind = 'individual') AS ind, AVG(cosine_similarity) AS cos,
            array_to_string(list_sort(list(DISTINCT comment_id) FILTER (WHERE comment_id IS NOT NULL)), ';') AS ids FROM stage4_matches LEFT JOIN kinds USING (comment_id) WHERE addressed GROUP BY 1)
        SELECT obligation_id, docket_id, COALESCE(n, 0) AS n_comments_addressed, COALESCE(s, 0) AS n_supporting, COALESCE(o, 0) AS n_opposing, COALESCE(m, 0) AS n_modifying, ROUND(org / NULLIF(org + ind, 0), 8) AS pct_organizational,
            ROUND(ind / NULLIF(org + ind, 0), 8) AS pct_individual, ROUND(cos, 8) AS mean_cosine, COALESCE(ids, '') AS addressing_comment_ids FROM u LEFT JOIN f USING (obligation_id)""",
    "a2_engagement": f"WITH {_ENGAGE} SELECT obligation_id, n_addressing, n_org, n_ind, ROUND(n_org / GREATEST(n_org + n_ind, 1), 6) AS org_share FROM engage",
    "a3_engagement_rows": f"WITH {_ENGAGE} SELECT obligation_id, n_rows AS n_addressing, n_org, n_ind, ROUND(n_org / GREATEST(n_org + n_ind, 1), 6) AS org_share FROM engage",
    "a4_stance_counts": "SELECT obligation_id, " + ", ".join(f"COUNT(*) FILTER (WHERE {_STANCE} = '{s}') AS {s.lower()}" for s in text.STANCES) + " FROM stage4_matches WHERE addressed GROUP BY 1",
    "a5_docket_attachments": """SELECT *, ROUND(100 * n_attach_only / n_comments, 6) AS pct_attach_only FROM (SELECT docket_id, COUNT(*) AS n_comments, COUNT(*) FILTER (WHERE is_attachment_only) AS n_attach_only FROM comments WHERE docket_id IS NOT NULL GROUP BY 1)""",
    "a6_rule_pivot": "SELECT docket_id, COUNT(*) FILTER (WHERE rule_type = 'proposed') AS proposed, COUNT(*) FILTER (WHERE rule_type = 'final') AS final FROM documents WHERE docket_id IS NOT NULL GROUP BY 1",
    "a8_label_frequencies": f"WITH {_AUDIT} SELECT classifier AS value, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM audit GROUP BY 1",
    "a14_rollup": """SELECT 'agency' AS dimension, agency AS value, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_attachment_only) AS n_attach_only FROM comments GROUP BY 2 UNION ALL
        SELECT 'data_year', CAST(data_year AS VARCHAR), COUNT(*), COUNT(*) FILTER (WHERE is_attachment_only) FROM comments GROUP BY 2 UNION ALL SELECT 'all', NULL, COUNT(*), COUNT(*) FILTER (WHERE is_attachment_only) FROM comments""",
    "a16_cluster_votes": f"""WITH {_KINDS}, c AS (SELECT document_id AS comment_id, COALESCE(MIN(docket_id), '') || '::' || NULLIF(array_to_string(regexp_extract_all(lower(COALESCE(MIN(comment), '')), '[a-z0-9]+'), ' '), '') AS cluster FROM comments GROUP BY 1),
        p AS (SELECT DISTINCT m.comment_id, obligation_id, COALESCE(cluster, 'solo::' || m.comment_id) AS cluster FROM stage4_matches m LEFT JOIN c USING (comment_id) WHERE addressed),
        k AS (SELECT cluster, CASE WHEN AVG((COALESCE(submitter_kind, '') = 'organizational')::INT) > 0.5 THEN 'organizational' ELSE 'individual' END AS kind FROM (SELECT DISTINCT comment_id, cluster FROM p) LEFT JOIN kinds USING (comment_id) GROUP BY 1),
        g AS (SELECT obligation_id, COUNT(*) AS n_addressing, COUNT(*) FILTER (WHERE kind = 'organizational') AS n_org, COUNT(*) FILTER (WHERE kind = 'individual') AS n_ind FROM (SELECT DISTINCT obligation_id, cluster FROM p) JOIN k USING (cluster) GROUP BY 1)
        SELECT *, ROUND(n_org / GREATEST(n_org + n_ind, 1), 6) AS org_share FROM g""",
    "a17_descriptive": """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT document_id) AS n_comments, COUNT(DISTINCT docket_id) AS n_dockets, COUNT(*) FILTER (WHERE is_attachment_only) AS n_attach_only, ROUND(AVG(LENGTH(comment)), 4) AS mean_chars,
        MIN(posted_date) AS first_posted, MAX(posted_date) AS last_posted FROM comments""",
    "a18_prevalence": " UNION ALL ".join(f"SELECT '{n}' AS flag, COUNT({e}) AS n, ROUND(AVG(({e})::INT), 6) AS share FROM verified_obligations" for n, e in (("verified", "verified"), ("passive_voice", "passive_voice"), ("is_conditional", "is_conditional"), ("has_part", "cfr_part IS NOT NULL"), ("has_reference", "cross_reference IS NOT NULL"))),
    "a19_quantiles": """WITH s AS (SELECT year_cluster, list_sort(list(n_comments) FILTER (WHERE n_comments IS NOT NULL)) AS v, MEDIAN(n_comments) AS m FROM anchor_rules_locked GROUP BY 1)
        SELECT year_cluster, v[CAST(FLOOR((LEN(v) - 1) / 3.0) AS BIGINT) + 1] AS low_33, v[CAST(FLOOR((LEN(v) - 1) * 2 / 3.0) AS BIGINT) + 1] AS low_67, ROUND(m, 6) AS median FROM s WHERE LEN(v) > 0""",
    "a20_histogram": """SELECT CAST(i AS INT) AS bin, i / 10 AS low, (i + 1) / 10 AS high, (SELECT COUNT(*) FROM stage4_matches WHERE cosine_similarity >= i / 10 AND (cosine_similarity < (i + 1) / 10 OR (i = 9 AND cosine_similarity = 1.0))) AS n FROM range(10) t(i)""",
    "a21_confusion": f"WITH {_AUDIT}, l AS (SELECT unnest({LABELS}) AS l) SELECT x.l AS label_a, y.l AS label_b, (SELECT COUNT(*) FROM audit WHERE rater_1 = x.l AND classifier = y.l) AS n FROM l x, l y",
    "a22_class_scores": f"""WITH {_AUDIT}, l AS (SELECT unnest({LABELS}) AS label), r AS (SELECT * FROM audit WHERE rater_1 IS NOT NULL AND classifier IS NOT NULL),
        s AS (SELECT label, COUNT(*) FILTER (WHERE rater_1 = label AND classifier = label) AS h, COUNT(*) FILTER (WHERE classifier = label) AS p, COUNT(*) FILTER (WHERE rater_1 = label) AS g FROM l, r GROUP BY 1)
        SELECT label, ROUND(COALESCE(h / NULLIF(p, 0), 0), 6) AS precision, ROUND(COALESCE(h / NULLIF(g, 0), 0), 6) AS recall, g AS support FROM s""",
    "a23_cost": "SELECT via, CAST(SUM(in_tokens) AS BIGINT) AS in_tokens, CAST(SUM(out_tokens) AS BIGINT) AS out_tokens, ROUND(SUM(cost_usd), 4) AS cost_usd FROM stage4_matches GROUP BY 1",
    "a25_model_agreement": """WITH v AS (SELECT docket_id, rule_type, candidate_idx, COUNT(DISTINCT modal_strength) AS s, COUNT(DISTINCT amendatory_action) AS a, COUNT(*) AS n FROM (SELECT DISTINCT * FROM verified_obligations) WHERE candidate_idx IS NOT NULL GROUP BY 1, 2, 3)
        SELECT COUNT(*) AS n_pairs, ROUND(AVG((s = 1)::INT), 6) AS same_strength, ROUND(AVG((a = 1)::INT), 6) AS same_action FROM v WHERE n > 1""",
    "t1_yates": f"WITH {_ENGAGED}, c AS (SELECT {_E} FROM e) SELECT a, b, c, d, ROUND({_CHI2}, 6) AS chi2, ROUND(SQRT({_CHI2} / (a + b + c + d)), 6) AS cramers_v FROM c",
    "t3_two_proportions": f"""WITH {_ENGAGED}, c AS (SELECT {_E} FROM e), p AS (SELECT *, (a + c) / (a + b + c + d) AS p FROM c)
        SELECT ROUND(CASE WHEN p > 0 AND p < 1 AND a + b > 0 AND c + d > 0 THEN (a / (a + b) - c / (c + d)) / SQRT(p * (1 - p) * (1 / (a + b) + 1 / (c + d))) END, 6) AS z FROM p""",
    "t4_odds_ratio": f"""WITH {_ENGAGED}, c AS (SELECT {_E} FROM e), z AS (SELECT *, CASE WHEN a * b * c * d = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM c), o AS (SELECT *, (a + h) * (d + h) / ((b + h) * (c + h)) AS r, 1.96 * SQRT(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)) AS s FROM z),
        x AS (SELECT i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS l, i = a AS own
            FROM c, range(GREATEST(0, a - d), LEAST(a + b, a + c) + 1) t(i))
        SELECT a, b, c, d, ROUND(r, 6) AS odds_ratio, ROUND(EXP(LN(r) - s), 6) AS ci_lo, ROUND(EXP(LN(r) + s), 6) AS ci_hi, ROUND((SELECT LEAST(1, SUM(EXP(l))) FROM x WHERE l <= (SELECT l FROM x WHERE own) + 1e-7), 6) AS p FROM o""",
    "t5_odds_ratio_plain": f"""WITH {_ENGAGED}, c AS (SELECT {_CELLS.format(x='majority')} FROM e), z AS (SELECT *, CASE WHEN a * b * c * d = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM c),
        o AS (SELECT *, (a + h) * (d + h) / ((b + h) * (c + h)) AS r, 1.96 * SQRT(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)) AS s FROM z)
        SELECT ROUND(a::DOUBLE * d / NULLIF(b::DOUBLE * c, 0), 6) AS odds_ratio, ROUND(EXP(LN(r) - s), 6) AS ci_lo, ROUND(EXP(LN(r) + s), 6) AS ci_hi FROM o""",
    "t6_strata": f"WITH {_ENGAGED} SELECT docket_id AS stratum, {_E} FROM e WHERE docket_id IS NOT NULL GROUP BY 1",
    "t9_separation": f"""WITH {_ENGAGED}, g AS (SELECT docket_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE revised) AS n_revised, COUNT(*) FILTER (WHERE majority) AS n_majority FROM e WHERE docket_id IS NOT NULL GROUP BY 1)
        SELECT *, n_revised > 0 AND n_revised < n AS varies, n_revised > 0 AND n_revised < n AND n_majority > 0 AND n_majority < n AS informative FROM g""",
    "t11_kappa": f"WITH {_AUDIT}, k AS ({_kappa('rater_1', 'rater_2')}) SELECT n, ROUND(o, 6) AS observed, ROUND(c, 6) AS chance, ROUND((o - c) / NULLIF(1 - c, 0), 6) AS kappa FROM k",
    "t12_kappa_by_class": f"""WITH {_AUDIT}, g AS (SELECT l AS label, COUNT(*) AS n, AVG(((rater_1 = l) = (rater_2 = l))::INT) AS o, AVG((rater_1 = l)::INT) AS p, AVG((rater_2 = l)::INT) AS q FROM audit, (SELECT unnest({LABELS}) AS l) WHERE rater_1 IS NOT NULL AND rater_2 IS NOT NULL GROUP BY 1)
        SELECT label, n, ROUND((o - p * q - (1 - p) * (1 - q)) / NULLIF(1 - p * q - (1 - p) * (1 - q), 0), 6) AS kappa FROM g""",
    "t14_wilson": f"""WITH {_ENGAGED}, g AS (SELECT classifier, COUNT(*) FILTER (WHERE engaged) AS hits, COUNT(*) AS n FROM e GROUP BY 1), x AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS z FROM g)
        SELECT classifier, hits, n, ROUND((p + z / (2 * n) - 1.96 * SQRT(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS lo, ROUND((p + z / (2 * n) + 1.96 * SQRT(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS hi FROM x""",
    "t15_kappa_report": f"WITH {_AUDIT} " + " UNION ALL ".join(f"SELECT '{x}/{y}' AS pair, n, ROUND(o, 6) AS observed, ROUND((o - c) / NULLIF(1 - c, 0), 6) AS kappa FROM ({_kappa(x, y)})" for x, y in (("rater_1", "rater_2"), ("rater_1", "classifier"), ("rater_2", "classifier"), ("classifier", "adjudicated"))),
    "t18_majority": f"WITH {_ENGAGED} SELECT {_CELLS.format(x='majority')} FROM e WHERE n_addressing >= 2",
    "t19_threshold_sweep": f"WITH {_ENGAGED} SELECT threshold, {_CELLS.format(x='(org_share > threshold)')} FROM e, (SELECT unnest([0.33::DOUBLE, 0.4, 0.5, 0.6, 0.67]) AS threshold) GROUP BY 1",
    "t20_leave_one_out": f"""WITH {_ENGAGED}, g AS (SELECT docket_id AS dropped, COUNT(*) AS n_dropped, {_E} FROM e WHERE docket_id IS NOT NULL GROUP BY 1), l AS (SELECT dropped, n_dropped, {', '.join(f'CAST(SUM({x}) OVER () - {x} AS BIGINT) AS {x}' for x in 'abcd')} FROM g)
        SELECT *, ROUND({_CHI2}, 6) AS chi2 FROM l""",
    "c7_relabelled": f"WITH {_AUDIT} SELECT obligation_id, COALESCE(adjudicated, classifier) AS outcome_state, classifier AS headline FROM audit",
    "c8_adjudication": f"WITH {_AUDIT} SELECT obligation_id, CASE WHEN rater_1 = rater_2 THEN rater_1 ELSE 'DISAGREE' END AS decision FROM audit WHERE rater_1 IS NOT NULL AND rater_2 IS NOT NULL",
    "c19_engaged": f"WITH {_ENGAGED} SELECT obligation_id, n_addressing, classifier FROM e WHERE n_addressing >= 2 AND classifier IN ('MODIFIED', 'DROPPED')",
    "a24_most_copied": f"""WITH n AS (SELECT document_id, comment, {_NORMAL} AS t FROM comments), h AS (SELECT document_id, comment, sha256(t) AS h FROM n WHERE t <> ''), g AS (SELECT h, COUNT(*) AS n FROM h GROUP BY 1)
        SELECT h, n, (SELECT comment FROM h x WHERE x.h = g.h ORDER BY document_id, comment LIMIT 1) AS sample FROM g ORDER BY n DESC, h LIMIT 5""",
}
SQL["sl3_most_influential"] = SQL["t20_leave_one_out"] + " ORDER BY n_dropped DESC, dropped LIMIT 10"
