"""Queries on texts: normal forms, classes, citations, sentences, word sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.functions import numbers, text
from rulewake.plans.scans import DOCKET, KIND, SQUEEZE, S, TITLE
from rulewake.session import read

OFFICES = ["OAR", "OW", "OPP", "OPPT", "OEM", "RCRA", "R01-OAR", "R05-OAR", "R06-OAR", "R05-OPP", "R08-OPP", "R01-OPP"]


def _c(spark, d):
    return read(spark, d, "comments")


def _v(spark, d):
    return read(spark, d, "verified_obligations")


def _docs(spark, d):
    return read(spark, d, "documents")


def st1_normal_comment(spark: SparkSession, d: str) -> DataFrame:
    n = text.normal_comment(F.col("comment"))
    return _c(spark, d).select("document_id", F.md5(n.cast("binary")).alias("normal_md5"), F.length(n).alias("n_chars")).distinct()


def st2_hash_check(spark: SparkSession, d: str) -> DataFrame:
    own = text.comment_hash(F.col("comment"))
    state = F.when(F.col("comment_text_hash").isNull(), "missing").when(own.isNull(), "no text").when(F.lower("comment_text_hash") == own, F.when(F.col("comment_text_hash") == own, "same").otherwise("capitals")).otherwise("out of date")
    return _c(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def st4_attachment_only(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).groupBy("is_attachment_only", text.is_attachment_only(F.col("comment")).alias("by_text")).agg(F.count("*").alias("n"))


def st5_submitter_kind(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).groupBy("agency", text.submitter_kind(F.col("title")).alias("kind")).agg(F.count("*").alias("n"))


def st6_permissive_kind(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).groupBy(text.submitter_kind_permissive(F.col("title")).alias("kind")).agg(F.count("*").alias("n"))


def st7_combined_kind(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).groupBy(text.submitter_kind_combined(F.col("title"), F.col("is_attachment_only")).alias("kind")).agg(F.count("*").alias("n"))


def st8_cfr_parts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(text.cfr_parts(F.col("text")), ",").alias("parts")).filter("parts <> ''")


def st9_title_keywords(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "anchor_rules_locked").select("docket_id", F.array_join(text.title_keywords(F.col("title")), " ").alias("keywords")).distinct()


def st10_reversals(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("text IS NOT NULL").groupBy("source", text.reversal_word(F.col("text")).alias("reversal")).agg(F.count("*").alias("n"))


def st11_register_years(spark: SparkSession, d: str) -> DataFrame:
    cite = F.regexp_extract(F.coalesce("text", F.lit("")), r"\b(\d{2,3} FR)\b", 1)
    return _docs(spark, d).select("doc_id", text.register_year(cite, F.lit(None).cast("string"), F.col("publication_date")).alias("year"))


def st12_periods(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("publication_date")
    return _docs(spark, d).groupBy(text.year_cluster(F.year(day)).alias("cluster"), text.administration(day).alias("administration")).agg(F.count("*").alias("n"))


def st13_offices(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d).filter("docket_id IS NOT NULL")
    return c.groupBy(text.program_office(F.col("docket_id"), OFFICES).alias("office"), text.docket_year(F.col("docket_id")).alias("year")).agg(F.count("*").alias("n"))


def st14_docket_of_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stage4_matches").groupBy(text.docket_of_obligation(F.col("obligation_id")).alias("docket_id")).agg(F.count("*").alias("n"))


def st15_section_base(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).groupBy(text.section_base(F.col("cfr_section")).alias("base"), text.section_plain(F.col("cfr_section")).alias("plain")).agg(F.count("*").alias("n"))


def st16_shingles(spark: SparkSession, d: str) -> DataFrame:
    words = text.tokens(F.col("obligation_text"))
    return _v(spark, d).select(text.obligation_id(F.col("docket_id"), F.col("rule_type"), F.col("candidate_idx"), F.col("split_idx")).alias("id"), F.size(words).alias("n_tokens"), F.size(text.shingles(words)).alias("n_shingles")).distinct()


def st17_elided(spark: SparkSession, d: str) -> DataFrame:
    e = text.elided(F.col("comment"))
    return _c(spark, d).select("document_id", F.length(e).alias("n_chars"), F.md5(e.cast("binary")).alias("md5")).distinct()


def st18_without_tags(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<div><p class='x'>"), F.coalesce("title", F.lit("")), F.lit("</p>&nbsp;&amp; more</div>"))
    return read(spark, d, "anchor_rules_locked").select("docket_id", text.without_tags(html).alias("plain")).distinct()


def st19_preamble_marks(spark: SparkSession, d: str) -> DataFrame:
    m = text.preamble_marks(F.col("text"))
    return _docs(spark, d).select("doc_id", *(F.array_join(c, "|").alias(n) for n, c in m.items()))


def st20_file_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "anchor_rules_locked").select("docket_id", text.safe_file_name(F.concat_ws("__", "docket_id", "title")).alias("file_name")).distinct()


def st21_quality(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source", text.extraction_quality(F.col("text")).alias("quality")).agg(F.count("*").alias("n"))


def st22_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = text.word_overlap(F.col("obligation_text"), F.concat_ws(" ", "subject", "modal", "action", "object"))
    return _v(spark, d).select("docket_id", "rule_type", "candidate_idx", "split_idx", *(F.round(c, 6).alias(n) for n, c in o.items())).distinct()


def st24_binding_start(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", text.binding_start(F.col("text")).alias("binding_start"))


def st26_modals(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("obligation_text")
    return _v(spark, d).groupBy(text.modal(s).alias("found"), text.modal_strength(s).alias("strength"), text.condition(s).isNotNull().alias("conditional")).agg(F.count("*").alias("n"))


def pf16_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy(text.heading_like(F.col("line")).alias("heading")).agg(F.count("*").alias("n"))


def st29_around(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "shall") - 1
    return _docs(spark, d).filter(F.contains("text", F.lit("shall"))).select("doc_id", F.md5(text.around(F.col("text"), at, at + 5, 40).cast("binary")).alias("md5"))


def st30_joined(spark: SparkSession, d: str) -> DataFrame:
    j = text.joined_obligation(*(F.col(c) for c in ("subject", "modal", "action", "object", "obligation_text")))
    return _v(spark, d).select("docket_id", "rule_type", "candidate_idx", "split_idx", F.md5(j.cast("binary")).alias("md5")).distinct()


def st31_stances(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stage4_matches").groupBy(text.stance(F.col("stance")).alias("stance"), "addressed").agg(F.count("*").alias("n"))


def st32_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def st33_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = text.filled("Duty of {docket}: {duty}\nStrength: {strength}", docket=F.col("docket_id"), duty=F.col("obligation_text"), strength=F.col("modal_strength"))
    return _v(spark, d).select("docket_id", "rule_type", "candidate_idx", "split_idx", F.md5(p.cast("binary")).alias("md5")).distinct()


def st34_docket_of_comment(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d)
    return c.groupBy((text.docket_of_comment(F.col("document_id")) == F.col("docket_id")).alias("same")).agg(F.count("*").alias("n"))


def st35_tertiles(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.operators.rollup import lower_quantile

    a = read(spark, d, "anchor_rules_locked").filter("n_comments IS NOT NULL")
    low = lower_quantile(a, ["year_cluster"], "n_comments", {"low": 1 / 3, "high": 2 / 3})
    return a.join(low, "year_cluster").groupBy("year_cluster", text.tertile(F.col("n_comments"), F.col("low"), F.col("high")).alias("tertile")).agg(F.count("*").alias("n"))


def st36_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("docket_id IS NOT NULL").groupBy("docket_id").agg(F.bool_or(F.coalesce(F.contains(F.lower("text"), F.lit("withdraw")), F.lit(False))).alias("withdrawn"))


def st37_audit_sheet(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d).withColumn("obligation_id", text.obligation_id(F.col("docket_id"), F.col("rule_type"), F.col("candidate_idx"), F.col("split_idx"))).filter("obligation_id IS NOT NULL")
    one = v.groupBy("obligation_id").agg(F.max("obligation_text").alias("obligation_text"), F.max("cfr_section").alias("cfr_section"))
    a = read(spark, d, "outcome_audit_reconciled").select("obligation_id", "audit_tier").distinct()
    found = a.join(one, "obligation_id", "left")
    return found.select("obligation_id", "audit_tier", F.coalesce("cfr_section", F.lit("(no section)")).alias("reference"), F.length("obligation_text").alias("n_chars"))


def dt3_comment_lag(spark: SparkSession, d: str) -> DataFrame:
    came = numbers.comment_time(F.col("received_date"), F.col("posted_date"))
    return _c(spark, d).groupBy(F.year(came).alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("loaded_at") > came + F.expr("INTERVAL 1 DAY")).alias("n_later"))


def dt4_long_dates(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("publication_date IS NOT NULL").select("doc_id", numbers.long_date(F.col("publication_date")).alias("long_date"))


def m5_cost(spark: SparkSession, d: str) -> DataFrame:
    c = numbers.token_cost(F.col("in_tokens"), F.col("out_tokens"), 1.0, 5.0, batch=True)
    return _v(spark, d).groupBy("llm_model").agg(F.round(F.sum(c), 6).alias("cost"))


def q_n_chars_check(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy((F.coalesce(F.length("text"), F.lit(0)) == F.col("n_chars")).alias("right")).agg(F.count("*").alias("n"))


_names = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _names}

_NORMAL = f"lower({SQUEEZE})"
_OBL = "docket_id || '__' || rule_type || '__' || CAST(candidate_idx AS VARCHAR) || '_' || CAST(split_idx AS VARCHAR)"
_TOKENS = "regexp_extract_all(lower(COALESCE({c}, '')), '[a-z0-9]+')"
_REV = "regexp_matches(lower(text), '" + "|".join(text.REVERSALS) + "')"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_EDGES = text.EDGES.replace("'", "''")
# RE2 has no Unicode word border, so the words of SQL stand between explicit classes where texts are not ASCII.
SQL = {
    "st1_normal_comment": f"SELECT DISTINCT document_id, md5({_NORMAL}) AS normal_md5, LENGTH({_NORMAL}) AS n_chars FROM comments",
    "st2_hash_check": f"""SELECT CASE WHEN comment_text_hash IS NULL THEN 'missing' WHEN {_NORMAL} = '' THEN 'no text' WHEN comment_text_hash = sha256({_NORMAL}) THEN 'same' WHEN lower(comment_text_hash) = sha256({_NORMAL}) THEN 'capitals' ELSE 'out of date' END AS state,
        COUNT(*) AS n FROM comments GROUP BY 1""",
    "st5_submitter_kind": f"SELECT agency, {KIND} AS kind, COUNT(*) AS n FROM (SELECT agency, {TITLE} AS t FROM comments) GROUP BY ALL",
    "st6_permissive_kind": "SELECT CASE WHEN regexp_matches(lower(COALESCE(title, '')), 'submitted by|on behalf|written by') THEN 'individual' ELSE 'organizational' END AS kind, COUNT(*) AS n FROM comments GROUP BY 1",
    "st7_combined_kind": f"SELECT CASE WHEN {KIND} = 'organizational' OR COALESCE(is_attachment_only, FALSE) THEN 'organizational' ELSE 'individual' END AS kind, COUNT(*) AS n FROM (SELECT is_attachment_only, {TITLE} AS t FROM comments) GROUP BY 1",
    "st8_cfr_parts": r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)\b(\d{1,3})\s*CFR\b', 1) AS t, regexp_split_to_array(text, '(?i)\b\d{1,3}\s*CFR\b')[2:] AS r FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(r[i], '\b(\d{1,4})\b', 1), lambda n: CAST(n AS INT) BETWEEN 1 AND 9999), lambda n: CAST(CAST(t[i] AS INT) AS VARCHAR) || '-' || CAST(CAST(n AS INT) AS VARCHAR)) AS l FROM s, range(1, LEN(t) + 1) x(i))
        SELECT doc_id, string_agg(DISTINCT v, ',' ORDER BY v) AS parts FROM (SELECT doc_id, unnest(l) AS v FROM p) GROUP BY 1""",
    "st9_title_keywords": f"""SELECT DISTINCT docket_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(COALESCE(title, ''), '[A-Za-z]{{4,}}'), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})))), ' ') AS keywords FROM anchor_rules_locked""",
    "st10_reversals": f"SELECT source, {_REV} AS reversal, COUNT(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "st11_register_years": r"""SELECT doc_id, COALESCE(CASE WHEN v BETWEEN 59 AND 200 THEN v + 1935 END, year(publication_date))::INT AS year FROM (SELECT doc_id, publication_date, TRY_CAST(NULLIF(regexp_extract(COALESCE(text, ''), '\b(\d{2,3}) FR\b', 1), '') AS INT) AS v FROM documents)""",
    "st12_periods": """SELECT CASE WHEN y IS NULL THEN 'no-proposed-rule' WHEN y BETWEEN 2010 AND 2012 THEN '2010-2012' WHEN y BETWEEN 2013 AND 2015 THEN '2013-2015' WHEN y BETWEEN 2016 AND 2018 THEN '2016-2018' WHEN y BETWEEN 2019 AND 2022 THEN '2019-2022' ELSE 'out-of-window' END AS cluster,
        CASE WHEN d IS NULL THEN NULL WHEN d < DATE '2017-01-20' THEN 'Obama' WHEN d < DATE '2021-01-20' THEN 'Trump' ELSE 'Biden' END AS administration, COUNT(*) AS n FROM (SELECT year(publication_date) AS y, CAST(publication_date AS DATE) AS d FROM documents) GROUP BY ALL""",
    "st13_offices": f"""WITH p AS (SELECT string_split(docket_id, '-') AS p FROM comments WHERE docket_id IS NOT NULL), o AS (SELECT CASE WHEN LEN(p) < 3 THEN NULL WHEN p[2] = 'HQ' THEN CASE WHEN LEN(p) >= 4 THEN p[3] END ELSE p[2] || '-' || p[3] END AS o,
        list_filter(p, lambda x: regexp_full_match(x, '\\d{{4}}') AND COALESCE(TRY_CAST(x AS INT), 0) BETWEEN 1990 AND 2030)[1]::INT AS year FROM p)
        SELECT CASE WHEN o IN ({', '.join(f"'{x}'" for x in OFFICES)}) THEN o ELSE 'OTHER' END AS office, year, COUNT(*) AS n FROM o GROUP BY ALL""",
    "st14_docket_of_id": f"SELECT {DOCKET} AS docket_id, COUNT(*) AS n FROM stage4_matches GROUP BY 1",
    "st15_section_base": r"""SELECT COALESCE(NULLIF(regexp_extract(trim(COALESCE(cfr_section, '')), '^(\d+\.\d+[A-Za-z]?)', 1), ''), trim(COALESCE(cfr_section, ''))) AS base, lower(trim(COALESCE(cfr_section, ''))) AS plain, COUNT(*) AS n FROM verified_obligations GROUP BY ALL""",
    "st16_shingles": f"""SELECT DISTINCT id, CAST(LEN(t) AS INT) AS n_tokens, CAST(CASE WHEN LEN(t) = 0 THEN 0 ELSE LEN(list_distinct(list_transform(range(1, GREATEST(LEN(t) - 2, 1) + 1), lambda i: array_to_string(t[i:i + 2], ' ')))) END AS INT) AS n_shingles
        FROM (SELECT {_OBL} AS id, {_TOKENS.format(c='obligation_text')} AS t FROM verified_obligations)""",
    "st17_elided": """SELECT DISTINCT document_id, CAST(LENGTH(e) AS INT) AS n_chars, md5(e) AS md5 FROM (SELECT document_id, CASE WHEN LENGTH(c) > 1500 THEN substr(c, 1, 1200) || chr(10) || '[...middle elided for length...]' || chr(10) || substr(c, LENGTH(c) - 199, 200) ELSE c END AS e
        FROM (SELECT document_id, COALESCE(comment, '') AS c FROM comments))""",
    "st18_without_tags": f"""SELECT DISTINCT docket_id, trim(regexp_replace(replace(replace(regexp_replace('<div><p class=''x''>' || COALESCE(title, '') || '</p>&nbsp;&amp; more</div>', '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '{S}+', ' ', 'g')) AS plain FROM anchor_rules_locked""",
    "st19_preamble_marks": f"SELECT doc_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(substr(COALESCE(text, ''), 1, 5000), '{p}'))), '|') AS {n}" for n, p in (("citations", text.CITATION), ("rins", text.RIN), ("dates", text.LONG_DATE))) + " FROM documents",
    "st20_file_names": "SELECT DISTINCT docket_id, regexp_replace(concat_ws('__', docket_id, title), '[^A-Za-z0-9._-]', '_', 'g') AS file_name FROM anchor_rules_locked",
    "st21_quality": r"""SELECT source, CASE WHEN LENGTH(t) < 500 THEN 'short' WHEN LENGTH(regexp_replace(t, '[\x00-\x7F]', '', 'g')) / GREATEST(LENGTH(t), 1) > 0.2 THEN 'garbled' ELSE 'ok' END AS quality, COUNT(*) AS n FROM (SELECT source, COALESCE(text, '') AS t FROM documents) GROUP BY ALL""",
    "st22_word_overlap": f"""WITH s AS (SELECT docket_id, rule_type, candidate_idx, split_idx, list_distinct({_TOKENS.format(c='obligation_text')}) AS x, list_distinct({_TOKENS.format(c="concat_ws(' ', subject, modal, action, object)")}) AS y FROM verified_obligations),
        r AS (SELECT *, LEN(list_intersect(x, y)) AS b FROM s), q AS (SELECT *, COALESCE(b / NULLIF(LEN(y), 0), 0) AS p, COALESCE(b / NULLIF(LEN(x), 0), 0) AS r, LEN(x) = 0 AND LEN(y) = 0 AS z FROM r)
        SELECT DISTINCT docket_id, rule_type, candidate_idx, split_idx, ROUND(CASE WHEN z THEN 1 ELSE p END, 6) AS precision, ROUND(CASE WHEN z THEN 1 ELSE r END, 6) AS recall, ROUND(CASE WHEN z THEN 1 ELSE COALESCE(2 * p * r / NULLIF(p + r, 0), 0) END, 6) AS f1 FROM q""",
    "st26_modals": r"""WITH s AS (SELECT regexp_extract(t, '(?i)\b(?:must(?:\s+not)?|shall(?:\s+not)?|may\s+not|(?:is|are)\s+required\s+to|(?:is|are)\s+prohibited\s+from|no\s+(?:person|operator|owner|entity|facility)\s+(?:shall|may))\b') AS s,
        regexp_extract(t, '(?i)\b(?:may|(?:is|are)\s+permitted\s+to|(?:is|are)\s+authorized\s+to)\b') AS p, t FROM (SELECT obligation_text AS t FROM verified_obligations)),
        c AS (SELECT *, regexp_matches(t, '(?i)^\s*(?:If|When|Upon|Where|Whenever)\b[^.]+?,') OR regexp_matches(t, '(?i),\s*(?:provided\s+that|unless|except\s+as|if\s+applicable)\b')
            OR (regexp_matches(t, '(?i),\s*subject\s+to\b') AND NOT regexp_matches(substr(regexp_extract(t, '(?is),\s*subject\s+to\b.*$'), 1, 50), '(?i)\bsubject\s+to\s+(?:§|paragraph|section)')) AS c FROM s)
        SELECT CASE WHEN s <> '' THEN lower(s) WHEN p <> '' THEN lower(p) END AS found, CASE WHEN s <> '' THEN 'strong' WHEN p <> '' THEN 'permissive' END AS strength, COALESCE(c, FALSE) AS conditional, COUNT(*) AS n FROM c GROUP BY ALL""",
    "st29_around": "SELECT doc_id, md5(substr(text, f + 1, LEAST(a + 45, LENGTH(text)) - f)) AS md5 FROM (SELECT doc_id, text, instr(text, 'shall') - 1 AS a, GREATEST(instr(text, 'shall') - 1 - 40, 0) AS f FROM documents WHERE contains(text, 'shall'))",
    "st30_joined": """SELECT DISTINCT docket_id, rule_type, candidate_idx, split_idx, md5(concat_ws(' ', NULLIF(trim(subject), ''), NULLIF(trim(modal), ''), NULLIF(trim(action), ''), NULLIF(trim(object), '')) || chr(10) || COALESCE(obligation_text, '')) AS md5 FROM verified_obligations""",
    "st31_stances": "SELECT CASE WHEN upper(trim(stance)) IN ('SUPPORTING', 'OPPOSING', 'SUGGESTING_MODIFICATION', 'NONE') THEN upper(trim(stance)) END AS stance, addressed, COUNT(*) AS n FROM stage4_matches GROUP BY ALL",
    "st32_content_hash": "SELECT doc_id, sha1(COALESCE(text, '')) AS content_hash FROM documents",
    "st33_prompt": "SELECT DISTINCT docket_id, rule_type, candidate_idx, split_idx, md5('Duty of ' || COALESCE(docket_id, '') || ': ' || COALESCE(obligation_text, '') || chr(10) || 'Strength: ' || COALESCE(modal_strength, '')) AS md5 FROM verified_obligations",
    "st34_docket_of_comment": "SELECT NULLIF(regexp_extract(document_id, '^(.*)-[^-]*$', 1), '') = docket_id AS same, COUNT(*) AS n FROM comments GROUP BY 1",
    "st35_tertiles": """WITH s AS (SELECT year_cluster, list_sort(list(n_comments)) AS v FROM anchor_rules_locked WHERE n_comments IS NOT NULL GROUP BY 1), b AS (SELECT year_cluster, v[CAST(FLOOR((LEN(v) - 1) / 3.0) AS BIGINT) + 1] AS low, v[CAST(FLOOR((LEN(v) - 1) * 2 / 3.0) AS BIGINT) + 1] AS high FROM s)
        SELECT year_cluster, CASE WHEN n_comments < low THEN 'low' WHEN n_comments < high THEN 'mid' ELSE 'high' END AS tertile, COUNT(*) AS n FROM anchor_rules_locked JOIN b USING (year_cluster) WHERE n_comments IS NOT NULL GROUP BY ALL""",
    "st36_withdrawn": "SELECT docket_id, bool_or(COALESCE(contains(lower(text), 'withdraw'), FALSE)) AS withdrawn FROM documents WHERE docket_id IS NOT NULL GROUP BY 1",
    "st37_audit_sheet": f"""WITH v AS (SELECT {_OBL} AS obligation_id, MAX(obligation_text) AS t, MAX(cfr_section) AS s FROM verified_obligations WHERE {_OBL} IS NOT NULL GROUP BY 1)
        SELECT obligation_id, audit_tier, COALESCE(s, '(no section)') AS reference, CAST(LENGTH(t) AS INT) AS n_chars FROM (SELECT DISTINCT obligation_id, audit_tier FROM outcome_audit_reconciled) LEFT JOIN v USING (obligation_id)""",
    "dt3_comment_lag": "SELECT year(c)::INT AS year, COUNT(*) AS n, COUNT(*) FILTER (WHERE loaded_at > c + INTERVAL 1 DAY) AS n_later FROM (SELECT COALESCE(received_date, posted_date) AS c, loaded_at FROM comments) GROUP BY 1",
    "dt4_long_dates": "SELECT doc_id, strftime(publication_date, '%B %-d, %Y') AS long_date FROM documents WHERE publication_date IS NOT NULL",
    "m5_cost": "SELECT llm_model, ROUND(SUM((COALESCE(in_tokens, 0) * 1.0 + COALESCE(out_tokens, 0) * 5.0) / 1000000 * 0.5), 6) AS cost FROM verified_obligations GROUP BY 1",
    "q_n_chars_check": "SELECT COALESCE(LENGTH(text), 0) = n_chars AS right, COUNT(*) AS n FROM documents GROUP BY 1",
    "st4_attachment_only": f"""WITH a AS (SELECT is_attachment_only, regexp_replace(regexp_replace(lower(COALESCE(comment, '')), '\\(\\s*s\\s*\\)', 's', 'g'), '\\(\\s*es\\s*\\)', 'es', 'g') AS t FROM comments),
        b AS (SELECT is_attachment_only, regexp_replace(trim(regexp_replace(t, '{S}+', ' ', 'g')), '^(?:please|kindly)\\s+', '') AS t FROM a), c AS (SELECT is_attachment_only, trim(regexp_replace(regexp_replace(t, '^{_EDGES}', ''), '{_EDGES}$', '')) AS t FROM b)
        SELECT is_attachment_only, t = '' OR regexp_matches(t, '{text.placeholder_pattern()}') AS by_text, COUNT(*) AS n FROM c GROUP BY ALL""",
    "st24_binding_start": f"""SELECT doc_id, CAST(CASE WHEN m <> '' THEN strpos(text, m) - 1 ELSE FLOOR(LENGTH(text) * 0.6::DOUBLE) END AS INT) AS binding_start FROM (SELECT doc_id, text, regexp_extract(text, '{text.BINDING}') AS m FROM documents WHERE text IS NOT NULL)""",
    "pf16_headings": f"""WITH l AS (SELECT regexp_replace(l, '^{S}+|{S}+$', '', 'g') AS s FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '')
        SELECT (regexp_matches(s, '^§\\s*\\d') AND LENGTH(s) < 80 AND NOT regexp_matches(s, '{text.STRONG}')) OR (upper(s) = s AND lower(s) <> s AND LENGTH(s) < 100) OR starts_with(lower(s), 'authority:') OR regexp_matches(s, '^(?:PART|Part)\\s+\\d') AS heading, COUNT(*) AS n FROM l GROUP BY 1""",
}
