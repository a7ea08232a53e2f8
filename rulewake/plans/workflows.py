"""Queries on chained operators, periods and findings."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.functions import numbers, text
from rulewake.operators import labels, tables, workflows
from rulewake.plans.pipelines import _OBL, _verified
from rulewake.plans.rollups import _CHI2, _E, _ENGAGED, _engaged
from rulewake.session import read


def pf4_comment_rules(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "comments")
    link, kind = F.col("docket_id"), F.col("title")
    rules = [workflows.is_comment(link, kind, r).alias(f"by_{r}") for r in ("link", "type", "any")]
    return c.select(*rules).groupBy("by_link", "by_type", "by_any").agg(F.count("*").alias("n"))


def pf8_scoped(spark: SparkSession, d: str) -> DataFrame:
    return workflows.scoped(read(spark, d, "comments"), read(spark, d, "anchor_rules_locked")).groupBy("docket_id").agg(F.count("*").alias("n"))


def pf11_recognition(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    again = workflows.needs_recognition(F.when(F.col("source") == "ocr_scan", "pdf").otherwise("text"), F.col("n_chars"), text.extraction_quality(F.col("text")))
    return docs.groupBy("source", again.alias("again")).agg(F.count("*").alias("n"))


def pf12_second_stage(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("source = 'ocr_scan'")
    status = F.when(F.col("text").isNull(), "failed").otherwise("ok")
    return docs.groupBy(workflows.second_stage(status, text.extraction_quality(F.col("text"))).alias("again")).agg(F.count("*").alias("n"))


def j7_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("ENV", "Environment"), ("COM", "Commerce"), ("MKT", "Markets")], "agency string, agency_name string")
    return read(spark, d, "comments").join(names, "agency", "left").groupBy("agency_name").agg(F.count("*").alias("n"))


def j16_positions(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "stage4_matches").groupBy("comment_id", "obligation_id").agg(F.max("justification").alias("justification"))
    answers = spark.range(0, 500, 7).select(F.concat(F.lit("pair_"), F.col("id").cast("string")).alias("custom_id"), F.lit("yes").alias("answer"))
    return workflows.by_position(answers, pairs, "comment_id", "obligation_id").select("position", "comment_id", "obligation_id", "answer")


def a9_first_years(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.year(F.min("publication_date")).alias("first_year"), F.year(F.max("publication_date")).alias("last_year"))


def a11_canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("docket_id IS NOT NULL").select("docket_id", F.coalesce("rule_type", F.lit("none")).alias("rule_type"), "doc_id", F.length("text").alias("n"))
    return docs.groupBy("docket_id", "rule_type").agg(F.max_by("doc_id", F.struct(F.coalesce("n", F.lit(-1)), -F.col("doc_id"))).alias("doc_id"))


def a13_rule_sets(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").filter("docket_id IS NOT NULL AND rule_type IS NOT NULL").groupBy("docket_id").agg(F.array_join(F.array_sort(F.collect_set("rule_type")), ",").alias("rule_types"))
    return g.withColumn("complete", F.col("rule_types") == "final,proposed")


def a15_distinct(spark: SparkSession, d: str) -> DataFrame:
    names = ("anchor_rules_locked", "verified_obligations", "stage4_matches", "outcome_audit_reconciled", "audit_labels")
    out = None
    for n in names:
        t = read(spark, d, n)
        one = t.groupBy(*t.columns).agg(F.count("*").alias("_n")).agg(F.lit(n).alias("table_name"), F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


def sl4_top_per_tertile(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.operators.rollup import lower_quantile

    a = read(spark, d, "anchor_rules_locked").filter("n_comments IS NOT NULL").groupBy("docket_id", "year_cluster").agg(F.max("n_comments").alias("n_comments"))
    cut = lower_quantile(a, ["year_cluster"], "n_comments", {"low": 1 / 3, "high": 2 / 3})
    tertile = text.tertile(F.col("n_comments"), F.col("low"), F.col("high"))
    return tables.top_by(a.join(cut, "year_cluster").withColumn("tertile", tertile), ["year_cluster", "tertile"], 3, F.desc("n_comments"), F.col("docket_id")).select("docket_id", "year_cluster", "tertile", "n_comments", "rank")


def w10_sample_index(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").select("docket_id").distinct()
    return labels.sharded(a.withColumn("k", F.lit(1)), ["k"], 1, "docket_id").select("docket_id", F.col("shard").alias("row_index"))


def dt1_parsed_times(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("posted_date").isNull(), "unknown").otherwise(F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss"))
    return read(spark, d, "comments").select(numbers.utc(shown).alias("t")).groupBy(F.year("t").alias("year")).agg(F.count("*").alias("n"))


def m4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").filter("proposed_year IS NOT NULL AND final_year IS NOT NULL").select("docket_id", "proposed_year", "final_year").distinct()
    return a.select("docket_id", "proposed_year", "final_year", F.round(numbers.interval_overlap(F.col("proposed_year"), F.col("final_year"), F.lit(2009), F.lit(2016)), 6).alias("overlap"))


def js6_synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations").filter("candidate_idx IS NOT NULL").select((F.col("candidate_idx") % 50).alias("block"), F.col("split_idx").alias("item")).distinct()
    return workflows.synthetic_ids(v, "block", "item")


def c12_second_pass(spark: SparkSession, d: str) -> DataFrame:
    """Each document's longest sentence as first finding; the second pass proposes every sentence with a modal."""

    def finder(blocks: list[str]) -> list[str | None]:
        modal = re.compile(r"\b(?:must|shall|may)\b")
        return [json.dumps([s.strip() for s in re.split(r"(?<=[.!?])|\n", b) if modal.search(s)]) for b in blocks]

    docs = read(spark, d, "documents").filter("text IS NOT NULL AND rule_type IS NOT NULL")
    first = docs.select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("row_id"), F.lit("1.1").alias("cfr_section"), F.lit(0).alias("start"), F.coalesce(F.nullif(F.instr("text", F.lit(".")), F.lit(0)), F.lit(1)).alias("end"))
    blocks = docs.select("doc_id", F.lit("b").alias("block_id"), F.lit("1.1").alias("cfr_section"), F.lit(0).alias("start"), "text")
    return workflows.with_second_pass(first, blocks, finder).groupBy("found_via").agg(F.count("*").alias("n"))


def c13_verified(spark: SparkSession, d: str) -> DataFrame:
    v = _verified(spark, d).select("obligation_id", "obligation_text", "subject")
    done = workflows.verified(v, labels.simple_parser, ["subject", "action"])
    return done.groupBy("verified", (F.lower("verified_subject") == F.lower("subject")).alias("same_subject")).agg(F.count("*").alias("n"))


def c13_cross_model(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations").filter("candidate_idx IS NOT NULL")
    one = lambda which: v.filter(F.col("llm_provider") == which).groupBy("docket_id", "rule_type", "candidate_idx", "split_idx").agg(*(F.max(c).alias(c) for c in ("modal_strength", "amendatory_action")))
    providers = [r[0] for r in v.select("llm_provider").filter("llm_provider IS NOT NULL").distinct().orderBy("llm_provider").limit(2).collect()]
    a, b = (providers * 2)[:2] if providers else ("none", "none")
    return workflows.model_agreement(one(a), one(b), ["docket_id", "rule_type", "candidate_idx", "split_idx"], ["modal_strength", "amendatory_action"])


def c20_text_index(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations")
    path = F.concat(F.lit("/data/verified_"), F.col("docket_id"), F.lit("_"), F.col("rule_type"), F.lit(".csv"))
    files = v.filter("docket_id IS NOT NULL").select(path.alias("path"), F.col("verified").cast("string").alias("verified"), "candidate_idx", "split_idx", "obligation_text")
    return workflows.text_index(files).select("obligation_id", F.md5(F.coalesce("obligation_text", F.lit("")).cast("binary")).alias("md5"))


def c21_periods(spark: SparkSession, d: str) -> DataFrame:
    return workflows.docket_periods(read(spark, d, "anchor_rules_locked"), read(spark, d, "documents"))


def t16_finding(spark: SparkSession, d: str) -> DataFrame:
    f = workflows.finding(_engaged(spark, d), F.col("engaged"), F.col("revised"))
    return f.select(*"abcd", *(F.round(c, 6).alias(c) for c in ("rate_1", "rate_2", "chi2", "cramers_v", "z", "odds_ratio")))


def t17_finding_by_majority(spark: SparkSession, d: str) -> DataFrame:
    e = _engaged(spark, d).filter("engaged")
    return workflows.finding(e, F.col("majority"), F.col("revised")).select(*"abcd", *(F.round(c, 6).alias(c) for c in ("rate_1", "rate_2")))


_names = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _names}

_QUALITY = r"CASE WHEN LENGTH(COALESCE(text, '')) < 500 THEN 'short' WHEN LENGTH(regexp_replace(COALESCE(text, ''), '[\x00-\x7F]', '', 'g')) / GREATEST(LENGTH(COALESCE(text, '')), 1) > 0.2 THEN 'garbled' ELSE 'ok' END"
SQL = {
    "pf4_comment_rules": """SELECT l AS by_link, t AS by_type, l OR t AS by_any, COUNT(*) AS n FROM (SELECT trim(COALESCE(docket_id, '')) <> '' AS l, regexp_matches(lower(COALESCE(title, '')), 'public submission|comment') AS t FROM comments) GROUP BY ALL""",
    "pf8_scoped": r"""SELECT docket_id, COUNT(*) AS n FROM comments WHERE docket_id IN (SELECT docket_id FROM anchor_rules_locked) AND LENGTH(regexp_replace(COALESCE(comment, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g')) > 0 GROUP BY 1""",
    "pf11_recognition": f"SELECT source, COALESCE(source = 'ocr_scan', FALSE) AND (COALESCE(n_chars, 0) < 500 OR {_QUALITY} IN ('short', 'garbled')) AS again, COUNT(*) AS n FROM documents GROUP BY ALL",
    "pf12_second_stage": f"SELECT text IS NULL OR {_QUALITY} <> 'ok' AS again, COUNT(*) AS n FROM documents WHERE source = 'ocr_scan' GROUP BY 1",
    "j7_lookup": "SELECT CASE agency WHEN 'ENV' THEN 'Environment' WHEN 'COM' THEN 'Commerce' WHEN 'MKT' THEN 'Markets' END AS agency_name, COUNT(*) AS n FROM comments GROUP BY 1",
    "j16_positions": """SELECT position, comment_id, obligation_id, 'yes' AS answer FROM (SELECT comment_id, obligation_id, CAST(ROW_NUMBER() OVER (ORDER BY comment_id NULLS FIRST, obligation_id NULLS FIRST) - 1 AS INT) AS position FROM (SELECT DISTINCT comment_id, obligation_id FROM stage4_matches)) WHERE position < 500 AND position % 7 = 0""",
    "a9_first_years": "SELECT docket_id, year(MIN(publication_date))::INT AS first_year, year(MAX(publication_date))::INT AS last_year FROM documents WHERE docket_id IS NOT NULL GROUP BY 1",
    "a11_canonical_documents": """SELECT docket_id, rule_type, doc_id FROM (SELECT docket_id, COALESCE(rule_type, 'none') AS rule_type, doc_id, ROW_NUMBER() OVER (PARTITION BY docket_id, COALESCE(rule_type, 'none') ORDER BY COALESCE(LENGTH(text), -1) DESC, doc_id) AS r FROM documents WHERE docket_id IS NOT NULL) WHERE r = 1""",
    "a13_rule_sets": "SELECT *, rule_types = 'final,proposed' AS complete FROM (SELECT docket_id, string_agg(DISTINCT rule_type, ',' ORDER BY rule_type) AS rule_types FROM documents WHERE docket_id IS NOT NULL AND rule_type IS NOT NULL GROUP BY 1)",
    "a15_distinct": " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT COUNT(*) FROM {n}) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {n})) AS n_distinct" for n in ("anchor_rules_locked", "verified_obligations", "stage4_matches", "outcome_audit_reconciled", "audit_labels")),
    "sl4_top_per_tertile": """WITH a AS (SELECT docket_id, year_cluster, MAX(n_comments) AS n_comments FROM anchor_rules_locked WHERE n_comments IS NOT NULL GROUP BY 1, 2), s AS (SELECT year_cluster, list_sort(list(n_comments)) AS v FROM a GROUP BY 1),
        t AS (SELECT a.*, CASE WHEN n_comments < v[CAST(FLOOR((LEN(v) - 1) / 3.0) AS BIGINT) + 1] THEN 'low' WHEN n_comments < v[CAST(FLOOR((LEN(v) - 1) * 2 / 3.0) AS BIGINT) + 1] THEN 'mid' ELSE 'high' END AS tertile FROM a JOIN s USING (year_cluster))
        SELECT docket_id, year_cluster, tertile, n_comments, CAST(r AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year_cluster, tertile ORDER BY n_comments DESC, docket_id) AS r FROM t) WHERE r <= 3""",
    "w10_sample_index": "SELECT docket_id, CAST(ROW_NUMBER() OVER (ORDER BY docket_id) - 1 AS INT) AS row_index FROM (SELECT DISTINCT docket_id FROM anchor_rules_locked)",
    "dt1_parsed_times": "SELECT year(posted_date)::INT AS year, COUNT(*) AS n FROM comments GROUP BY 1",
    "m4_overlaps": """SELECT DISTINCT docket_id, proposed_year, final_year, ROUND(CASE WHEN LEAST(final_year, 2016) - GREATEST(proposed_year, 2009) > 0 THEN (LEAST(final_year, 2016) - GREATEST(proposed_year, 2009)) / LEAST(GREATEST(final_year - proposed_year, 1), 7) ELSE 0 END, 6) AS overlap
        FROM anchor_rules_locked WHERE proposed_year IS NOT NULL AND final_year IS NOT NULL""",
    "js6_synthetic_ids": "SELECT DISTINCT candidate_idx % 50 AS block, split_idx AS item, 100000 + (candidate_idx % 50) * 100 + split_idx AS candidate_idx FROM verified_obligations WHERE candidate_idx IS NOT NULL",
    "c13_cross_model": """WITH p AS (SELECT list_sort(list(DISTINCT llm_provider) FILTER (WHERE llm_provider IS NOT NULL)) AS p FROM verified_obligations WHERE candidate_idx IS NOT NULL), v AS (SELECT docket_id, rule_type, candidate_idx, split_idx, llm_provider, MAX(modal_strength) AS m, MAX(amendatory_action) AS a FROM verified_obligations WHERE candidate_idx IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
        SELECT COUNT(*) AS n_pairs, AVG((x.m IS NOT DISTINCT FROM y.m)::INT) AS same_modal_strength, AVG((x.a IS NOT DISTINCT FROM y.a)::INT) AS same_amendatory_action FROM v x JOIN v y USING (docket_id, rule_type, candidate_idx, split_idx)
        WHERE x.llm_provider = (SELECT p[1] FROM p) AND y.llm_provider = (SELECT COALESCE(p[2], p[1]) FROM p)""",
    "c20_text_index": f"SELECT {_OBL} AS obligation_id, md5(COALESCE(MAX(obligation_text), '')) AS md5 FROM verified_obligations WHERE verified AND docket_id IS NOT NULL AND rule_type IN ('proposed', 'final') AND {_OBL} IS NOT NULL GROUP BY 1",
    "c21_periods": """WITH b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY docket_id, rule_type ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents WHERE docket_id IS NOT NULL) WHERE r = 1),
        j AS (SELECT a.docket_id, p.doc_id AS proposed_id, p.publication_date AS opened, f.doc_id AS final_id, f.publication_date AS closed FROM (SELECT DISTINCT docket_id FROM anchor_rules_locked) a LEFT JOIN b p ON a.docket_id = p.docket_id AND p.rule_type = 'proposed' LEFT JOIN b f ON a.docket_id = f.docket_id AND f.rule_type = 'final')
        SELECT *, CASE WHEN COALESCE(opened, closed) < TIMESTAMP '2017-01-20' THEN 'Obama' WHEN COALESCE(opened, closed) < TIMESTAMP '2021-01-20' THEN 'Trump' WHEN COALESCE(opened, closed) IS NOT NULL THEN 'Biden' END AS administration FROM j""",
    "t16_finding": f"""WITH {_ENGAGED}, c AS (SELECT {_E} FROM e), p AS (SELECT *, (a + c) / (a + b + c + d) AS p, CASE WHEN a * b * c * d = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM c)
        SELECT a, b, c, d, ROUND(a / NULLIF(a + b, 0), 6) AS rate_1, ROUND(c / NULLIF(c + d, 0), 6) AS rate_2, ROUND({_CHI2}, 6) AS chi2, ROUND(SQRT({_CHI2} / (a + b + c + d)), 6) AS cramers_v,
        ROUND(CASE WHEN p > 0 AND p < 1 AND a + b > 0 AND c + d > 0 THEN (a / (a + b) - c / (c + d)) / SQRT(p * (1 - p) * (1 / (a + b) + 1 / (c + d))) END, 6) AS z, ROUND((a + h) * (d + h) / ((b + h) * (c + h)), 6) AS odds_ratio FROM p""",
    "t17_finding_by_majority": f"""WITH {_ENGAGED}, c AS (SELECT COUNT(*) FILTER (WHERE majority AND revised) AS a, COUNT(*) FILTER (WHERE majority AND NOT revised) AS b, COUNT(*) FILTER (WHERE NOT majority AND revised) AS c, COUNT(*) FILTER (WHERE NOT majority AND NOT revised) AS d FROM e WHERE engaged)
        SELECT a, b, c, d, ROUND(a / NULLIF(a + b, 0), 6) AS rate_1, ROUND(c / NULLIF(c + d, 0), 6) AS rate_2 FROM c""",
}
assert set(SQL) <= set(QUERIES)
