"""Queries on samples, clusters, matches, outcomes, extraction and labels, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.operators import clusters, labels, matching, obligations, sampling, tables
from rulewake.plans.rollups import _E, _ENGAGED, _engaged
from rulewake.plans.scans import KIND, S, TITLE
from rulewake.session import read

SEED = 20260501
MIX = {"organizational": 0.4, "individual": 0.4, "other": 0.2}


def _comments(spark, d, *columns):
    """One row per comment id with the columns asked for: texts that nobody reads are neither read nor shuffled."""
    return read(spark, d, "comments").groupBy("document_id").agg(*(F.min(x).alias(x) for x in columns or ("docket_id",)))


def _verified(spark, d):
    v = read(spark, d, "verified_obligations").withColumn("obligation_id", text.obligation_id(F.col("docket_id"), F.col("rule_type"), F.col("candidate_idx"), F.col("split_idx"))).filter("obligation_id IS NOT NULL")
    columns = ("docket_id", "rule_type", "subject", "modal", "action", "object", "obligation_text", "cfr_section", "amendatory_action")
    return v.groupBy("obligation_id").agg(*(F.max(c).alias(c) for c in columns))


def sm1_stratified(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").select("docket_id", "year_cluster", "selection_method").distinct()
    return sampling.per_stratum(a, ["year_cluster", "selection_method"], 5, SEED, "docket_id").select("docket_id", "year_cluster", "selection_method", "draw_rank")


def sm1_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "anchor_rules_locked").select("docket_id", "year_cluster", "selection_method").distinct()
    return sampling.shortfalls(a, ["year_cluster", "selection_method"], 20)


def sm2_quota(spark: SparkSession, d: str) -> DataFrame:
    c = _comments(spark, d, "title").select("document_id", text.submitter_kind(F.col("title")).alias("kind"))
    return sampling.by_quota(c, "kind", 300, MIX, SEED, "document_id").select("document_id", "kind", "sample_index")


def sm3_capped_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _comments(spark, d, "agency", "data_year")
    return sampling.capped_cells(c, ["agency", "data_year"], 10, 400, SEED, "document_id")


def sm4_audit_sample(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches").select("comment_id", "obligation_id", "addressed", text.stance(F.col("stance")).alias("stance")).groupBy("comment_id", "obligation_id").agg(F.bool_or("addressed").alias("addressed"), F.max("stance").alias("stance"))
    cell = F.when(F.col("addressed"), F.coalesce("stance", F.lit("UNKNOWN"))).otherwise("not addressed")
    return sampling.per_stratum(m.withColumn("cell", cell), ["cell"], 25, SEED, "comment_id", "obligation_id").select("comment_id", "obligation_id", "cell", "draw_rank")


def sm5_two_tiers(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "outcome_audit_reconciled").groupBy("obligation_id").agg(F.max("audit_tier").alias("audit_tier"), F.max(text.loose_label(F.col("classifier_label"), ["MODIFIED", "DROPPED", "NEW"])).alias("state"))
    return sampling.two_tiers(a, (F.col("audit_tier") == "T1_F3") & (F.col("state") == "DROPPED"), "state", {"MODIFIED": 20, "DROPPED": 20, "NEW": 10}, SEED, "obligation_id").select("obligation_id", "state", "tier")


def sm7_fraction(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction_per_stratum(_verified(spark, d).select("obligation_id", "amendatory_action"), "amendatory_action", 0.05, SEED, "obligation_id")


def sm8_simple(spark: SparkSession, d: str) -> DataFrame:
    return sampling.simple(_comments(spark, d).select("document_id"), 50, SEED, "document_id")


def c1_exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.exact(_comments(spark, d, "docket_id", "comment"), "document_id", "comment", "docket_id").select(F.col("id").alias("document_id"), "scope", "cluster")


def c2_near_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.near(_comments(spark, d, "docket_id", "comment"), "document_id", "comment", "docket_id").select(F.col("id").alias("document_id"), "scope", "cluster")


def c2_near_clusters_three(spark: SparkSession, d: str) -> DataFrame:
    """At three words, similarity 0.7 and 32 bands of 4, each class named by its docket and smallest id."""
    near = clusters.near(_comments(spark, d, "docket_id", "comment").filter("docket_id IS NOT NULL"), "document_id", "comment", "docket_id", 3, 0.7, 32, 4)
    return near.select(F.col("id").alias("document_id"), F.concat_ws("::", "scope", F.col("cluster")).alias("cluster_near"))


def c3_components(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches").select("comment_id", "obligation_id").dropna().distinct()
    nodes = m.select(F.col("comment_id").alias("id")).unionByName(m.select(F.col("obligation_id").alias("id"))).distinct()
    return clusters.components(nodes, m.select(F.col("comment_id").alias("a"), F.col("obligation_id").alias("b"))).groupBy("component").agg(F.count("*").alias("n"))


def _vectors(spark, d, which):
    return read(spark, d, "embeddings").filter(which).select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def j9_top_k(spark: SparkSession, d: str) -> DataFrame:
    queries = _vectors(spark, d, "vec_id % 100 = 0").withColumn("key", F.lit(0))
    best = matching.best_pairs(queries, _vectors(spark, d, "true").withColumn("key", F.lit(0)), 5)
    return best.select("query_id", "item_id", F.round("cosine", 4).alias("cosine"), "rank").filter("query_id <> item_id")


def j10_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of even ids as the proposed version of a label's items, those of odd ids as the final one."""
    side = lambda which: _vectors(spark, d, which).withColumn("section", F.concat(F.lit("80."), (F.col("id") % 7).cast("string")))
    return matching.outcomes(side("vec_id % 2 = 0"), side("vec_id % 2 = 1")).select("key", "id", "outcome_state", "matched_id", F.round("best_cosine", 4).alias("best_cosine"))


def j10_outcomes_text_only(spark: SparkSession, d: str) -> DataFrame:
    side = lambda which: _vectors(spark, d, which).withColumn("section", F.lit(None).cast("string"))
    return matching.outcomes(side("vec_id % 2 = 0"), side("vec_id % 2 = 1"), gate_on_section=False).groupBy("key", "outcome_state").agg(F.count("*").alias("n"))


def sc20_stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = docs.filter("text IS NOT NULL AND length(text) < 1000").select("id", text.content_hash(F.col("text")).alias("content_hash"))
    return matching.stale(docs, cache).select(F.col("id").alias("doc_id"))


def st25_candidates(spark: SparkSession, d: str) -> DataFrame:
    return obligations.candidates(read(spark, d, "documents"))


def st25_rule_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each docket's verified obligations as one rule text, and what is found in it."""
    line = F.concat(F.lit("Section "), F.coalesce("cfr_section", F.lit("1.1")), F.lit(" is amended to read as follows:\n"), "obligation_text", F.lit(".\n"))
    docs = _verified(spark, d).filter("obligation_text IS NOT NULL").groupBy("docket_id", "rule_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obligation_id", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    docs = docs.select(F.concat_ws("|", "docket_id", "rule_type").alias("doc_id"), F.concat(F.lit("For the reasons set forth in the preamble\n"), "body").alias("text"))
    return obligations.candidates(docs).groupBy("doc_id", "amendatory_action", "modal_strength").agg(F.count("*").alias("n"))


def c5_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Obligations of a docket in order, their lengths laid end to end as places; every second finding is shifted onto its neighbour by half."""
    from pyspark.sql import Window

    v = _verified(spark, d).filter("obligation_text IS NOT NULL")
    w = Window.partitionBy("docket_id", "rule_type").orderBy("obligation_id")
    n = F.length("obligation_text")
    end = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    i = F.row_number().over(w)
    found = v.select(F.concat_ws("|", "docket_id", "rule_type").alias("doc_id"), F.col("obligation_id").alias("row_id"), F.when(i % 3 == 0, "safety_net").otherwise("primary").alias("found_via"), F.lit("80.1(a)").alias("cfr_section"), (end - n - F.when(i % 3 == 0, F.floor(n * 0.9)).otherwise(0)).alias("start"), (end - F.when(i % 3 == 0, F.floor(n * 0.9)).otherwise(0)).alias("end"))
    return obligations.without_repeats(found).select("doc_id", "row_id", "found_via")


def st28_places(spark: SparkSession, d: str) -> DataFrame:
    v = _verified(spark, d).filter("obligation_text IS NOT NULL AND docket_id IS NOT NULL").select(F.col("obligation_id"), F.concat_ws("|", "docket_id", "rule_type").alias("doc_id"), "obligation_text")
    docs = v.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obligation_id", "obligation_text"))), lambda x: F.regexp_replace(x["obligation_text"], " ", "  ")), "\n").alias("text"))
    return obligations.with_places(v, docs).select("obligation_id", "start", "end")


def st23_char_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = _verified(spark, d).withColumn("parts", F.concat_ws(" ", "subject", "modal", "action", "object"))
    return obligations.char_similarity(v, "obligation_text", "parts").select("obligation_id", F.round("char_similarity", 6).alias("char_similarity"))


def st27_structure(spark: SparkSession, d: str) -> DataFrame:
    done = labels.labelled(_verified(spark, d).select("obligation_id", "obligation_text"), "obligation_text", labels.simple_parser)
    return done.select("obligation_id", *(F.get_json_object("answer", f"$.{n}").alias(n) for n in ("subject", "action", "passive_voice")), "error")


def c22_labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches").select("comment_id", "obligation_id").dropna().distinct()
    c = _comments(spark, d, "comment").select(F.col("document_id").alias("comment_id"), text.elided(F.col("comment")).alias("c"))
    o = _verified(spark, d).select("obligation_id", F.coalesce("obligation_text", F.lit("")).alias("o"))
    prompts = m.join(c, "comment_id").join(o, "obligation_id").select("comment_id", "obligation_id", F.concat_ws("|||", "c", "o").alias("prompt"))
    answer = labels.match_answer(F.col("answer"))
    return labels.labelled(prompts, "prompt", labels.keyword_matcher).select("comment_id", "obligation_id", *(c.alias(n) for n, c in answer.items()))


def c14_shards(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches").select("comment_id", "obligation_id").dropna().distinct().withColumn("docket_id", text.docket_of_obligation(F.col("obligation_id")))
    return labels.sharded(m, ["docket_id"], 50, "comment_id", "obligation_id").groupBy("docket_id", "shard").agg(F.count("*").alias("n"))


def js4_split_rows(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "verified_obligations").filter("obligation_text IS NOT NULL").select("docket_id", "candidate_idx", "split_idx", F.col("in_tokens").alias("tokens"), F.split("obligation_text", ", ").alias("items")).withColumnRenamed("split_idx", "row_idx")
    return labels.split_rows(v, "items", ["tokens"]).groupBy("split_idx").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def js3_modals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "verified_obligations").groupBy(labels.coerced(F.col("modal"), labels.MODAL_ALIASES, "other").alias("modal_norm")).agg(F.count("*").alias("n"))


def sc14_batch_lines(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "stage4_matches")
    body = F.to_json(F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct(F.struct(F.col("justification").alias("content")).alias("message"))).alias("choices")).alias("body")))
    line = F.concat(F.lit('{"custom_id": "'), F.col("comment_id"), F.lit('", "response": '), body, F.when(F.col("addressed").isNull(), "").otherwise("}"))
    return labels.outcome_of_lines(m.select(line.alias("value"))).groupBy("bucket").agg(F.count("*").alias("n"))


def sk4_upsert(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.sources.sinks import merged

    m = read(spark, d, "stage4_matches").groupBy("comment_id", "obligation_id").agg(F.max("cosine_similarity").alias("cosine_similarity"), F.bool_or("uncertainty_truncated").alias("uncertainty_truncated"))
    again = m.filter("uncertainty_truncated").withColumn("uncertainty_truncated", F.lit(False))
    return merged(m, again, ["comment_id", "obligation_id"], 5000)


def sk7_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "anchor_rules_locked").select("docket_id", F.lit("submitted").alias("status")).distinct()
    done = read(spark, d, "stage4_matches").select(text.docket_of_obligation(F.col("obligation_id")).alias("docket_id"), F.lit("retrieved").alias("status")).dropna().distinct()
    return tables.with_status(jobs, done, ["docket_id"], "status")


def c10_variants(spark: SparkSession, d: str) -> DataFrame:
    from rulewake.operators import statistics as st
    from rulewake.plans.scans import c9_docket_flags

    e = _engaged(spark, d)
    flagged = c9_docket_flags(spark, d).select("docket_id")
    kept = e.join(flagged, "docket_id", "left_anti")
    one = lambda df, n: st.cells(df, F.col("engaged"), F.col("revised")).withColumn("variant", F.lit(n))
    return one(e, "paper").unionByName(one(kept, "exclude flagged"))


def c26_pairing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("docket_id IS NOT NULL AND rule_type IS NOT NULL AND text IS NOT NULL")
    rins = docs.select("docket_id", "doc_id", "rule_type", F.explode(text.preamble_marks(F.col("text"))["rins"]).alias("rin"))
    p, f = rins.filter("rule_type = 'proposed'").select("docket_id", "rin", F.col("doc_id").alias("proposed_id")), rins.filter("rule_type = 'final'").select("docket_id", "rin", F.col("doc_id").alias("final_id"))
    return p.join(f, ["docket_id", "rin"]).select("docket_id", "proposed_id", "final_id").distinct()


_names = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _names}

_KEY = "md5('" + str(SEED) + "|' || {id})"
_C = "c AS (SELECT document_id, MIN(docket_id) AS docket_id, MIN(comment) AS comment, MIN(title) AS title, MIN(agency) AS agency, MIN(data_year) AS data_year FROM comments GROUP BY 1)"
_OBL = "docket_id || '__' || rule_type || '__' || CAST(candidate_idx AS VARCHAR) || '_' || CAST(split_idx AS VARCHAR)"
_V = f"v AS (SELECT {_OBL} AS obligation_id, MAX(docket_id) AS docket_id, MAX(rule_type) AS rule_type, MAX(subject) AS subject, MAX(modal) AS modal, MAX(action) AS action, MAX(object) AS object, MAX(obligation_text) AS obligation_text, MAX(amendatory_action) AS amendatory_action FROM verified_obligations WHERE {_OBL} IS NOT NULL GROUP BY 1)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = "ROUND(" + _DOT.format(a="p.embedding", b="f.embedding") + " / SQRT(" + _DOT.format(a="p.embedding", b="p.embedding") + ") / SQRT(" + _DOT.format(a="f.embedding", b="f.embedding") + "), 9)"
_A = "a AS (SELECT DISTINCT docket_id, year_cluster, selection_method FROM anchor_rules_locked)"
_STATE = "CASE WHEN c >= 0.95 AND same THEN 'SURVIVED-unchanged' WHEN c >= 0.85 AND same THEN 'SURVIVED-edited' WHEN c >= 0.55 THEN 'MODIFIED' ELSE 'DROPPED' END"


def _outcomes(same: str) -> str:
    return f"""x AS (SELECT p.label AS k, p.vec_id AS pid, f.vec_id AS fid, {_COS} AS c, {same} AS same FROM embeddings p JOIN embeddings f ON p.label = f.label AND p.vec_id % 2 = 0 AND f.vec_id % 2 = 1),
        o AS (SELECT k AS key, pid AS id, {_STATE} AS outcome_state, CASE WHEN {_STATE} <> 'DROPPED' THEN fid END AS matched_id, c AS best_cosine FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, pid ORDER BY c DESC, fid) AS r FROM x) WHERE r = 1
            UNION ALL SELECT k, fid, 'NEW', NULL, MAX(c) FROM x GROUP BY 1, 2 HAVING MAX(c) < 0.55)"""


def _near(size: int, similar: float) -> str:
    """Classes of each docket by the exact similarity of all pairs that share a run of words, and everything reachable through them."""
    return f"""WITH RECURSIVE {_C}, t AS (SELECT document_id, COALESCE(docket_id, '') AS docket_id, regexp_extract_all(lower(COALESCE(comment, '')), '[a-z0-9]+') AS w FROM c),
        u AS (SELECT docket_id, MIN(document_id) AS rep, w FROM t WHERE LEN(w) > 0 GROUP BY docket_id, w),
        s AS (SELECT docket_id, rep, unnest(list_distinct(CASE WHEN LEN(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, LEN(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END)) AS g FROM u),
        n AS (SELECT docket_id, rep, COUNT(*) AS n FROM s GROUP BY 1, 2), x AS (SELECT x.docket_id, x.rep AS a, y.rep AS b, COUNT(*) AS k FROM s x JOIN s y ON x.docket_id = y.docket_id AND x.g = y.g AND x.rep <> y.rep GROUP BY 1, 2, 3),
        e AS (SELECT x.docket_id, x.a, x.b FROM x JOIN n p ON p.docket_id = x.docket_id AND p.rep = x.a JOIN n q ON q.docket_id = x.docket_id AND q.rep = x.b WHERE x.k >= {similar} * (p.n + q.n - x.k)),
        reach AS (SELECT docket_id, rep AS id, rep AS root FROM u UNION SELECT r.docket_id, e.b, r.root FROM reach r JOIN e ON e.docket_id = r.docket_id AND e.a = r.id),
        l AS (SELECT docket_id, id, MIN(root) AS root FROM reach GROUP BY 1, 2),
        f AS (SELECT t.document_id, t.docket_id, l.root FROM t LEFT JOIN u ON u.docket_id = t.docket_id AND u.w = t.w LEFT JOIN l ON l.docket_id = u.docket_id AND l.id = u.rep)"""


SQL = {
    "sm1_stratified": f"WITH {_A} SELECT docket_id, year_cluster, selection_method, CAST(r AS INT) AS draw_rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year_cluster, selection_method ORDER BY {_KEY.format(id='docket_id')}, docket_id) AS r FROM a) WHERE r <= 5",
    "sm1_shortfalls": f"WITH {_A} SELECT year_cluster, selection_method, COUNT(*) AS pool_size, LEAST(COUNT(*), 20) AS drawn, GREATEST(20 - COUNT(*), 0) AS shortfall FROM a GROUP BY 1, 2",
    "sm2_quota": f"""WITH {_C}, k AS (SELECT document_id, {KIND} AS kind, {_KEY.format(id='document_id')} AS h FROM (SELECT document_id, {TITLE} AS t FROM c)),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY h, document_id) <= CASE kind WHEN 'other' THEN 60 ELSE 120 END AS q FROM k), s AS (SELECT *, ROW_NUMBER() OVER (ORDER BY q DESC, h, document_id) - 1 AS i FROM r)
        SELECT document_id, kind, CAST(i AS INT) AS sample_index FROM s WHERE i < 300""",
    "sm3_capped_cells": f"""WITH {_C}, k AS (SELECT agency, data_year, COUNT(*) AS n FROM c GROUP BY 1, 2),
        x AS (SELECT GREATEST(400 - SUM(LEAST(n, 10)), 0) // NULLIF(COUNT(*) FILTER (n > 10), 0) AS extra FROM k),
        r AS (SELECT document_id, agency, data_year, {_KEY.format(id='document_id')} AS h FROM c), s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY agency, data_year ORDER BY h, document_id) AS i FROM r)
        SELECT document_id, agency, data_year FROM s, x WHERE i <= 10 + COALESCE(extra, 0) ORDER BY h, document_id LIMIT 400""",
    "c2_near_clusters": f"{_near(5, 0.8)} SELECT document_id, docket_id AS scope, COALESCE(root, document_id) AS cluster FROM f",
    "c2_near_clusters_three": f"{_near(3, 0.7)} SELECT document_id, docket_id || '::' || COALESCE(root, document_id) AS cluster_near FROM f WHERE docket_id <> ''",
    "c3_components": """WITH RECURSIVE m AS (SELECT DISTINCT comment_id AS a, obligation_id AS b FROM stage4_matches WHERE comment_id IS NOT NULL AND obligation_id IS NOT NULL),
        e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id WHERE r.root < e.b)
        SELECT component, COUNT(*) AS n FROM (SELECT id, MIN(root) AS component FROM reach GROUP BY 1) GROUP BY 1""",
    "c5_without_repeats": f"""WITH {_V}, o AS (SELECT concat_ws('|', docket_id, rule_type) AS doc_id, obligation_id AS row_id, LENGTH(obligation_text) AS n, ROW_NUMBER() OVER w AS i, SUM(LENGTH(obligation_text)) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM v WHERE obligation_text IS NOT NULL WINDOW w AS (PARTITION BY docket_id, rule_type ORDER BY obligation_id)),
        f AS (SELECT doc_id, row_id, CASE WHEN i % 3 = 0 THEN 'safety_net' ELSE 'primary' END AS found_via, e - n - CASE WHEN i % 3 = 0 THEN floor(n * 0.9::DOUBLE) ELSE 0 END AS s, e - CASE WHEN i % 3 = 0 THEN floor(n * 0.9::DOUBLE) ELSE 0 END AS e FROM o)
        SELECT doc_id, row_id, found_via FROM f q WHERE found_via = 'primary' OR NOT EXISTS (SELECT 1 FROM f p WHERE p.found_via = 'primary' AND p.doc_id = q.doc_id AND LEAST(p.e, q.e) - GREATEST(p.s, q.s) > 0.8 * GREATEST(1, LEAST(p.e - p.s, q.e - q.s)))""",
    "sc14_batch_lines": "SELECT bucket, COUNT(*) AS n FROM (SELECT CASE WHEN addressed IS NULL THEN 'malformed' WHEN trim(COALESCE(justification, '')) = '' THEN 'empty' ELSE 'ok' END AS bucket FROM stage4_matches WHERE comment_id IS NOT NULL) GROUP BY 1",
    "sm4_audit_sample": f"""WITH m AS (SELECT comment_id, obligation_id, bool_or(addressed) AS a, MAX(CASE WHEN upper(trim(stance)) IN ('SUPPORTING', 'OPPOSING', 'SUGGESTING_MODIFICATION', 'NONE') THEN upper(trim(stance)) END) AS s FROM stage4_matches GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN a THEN COALESCE(s, 'UNKNOWN') ELSE 'not addressed' END AS cell FROM m), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY {_KEY.format(id="concat_ws('|', comment_id, obligation_id)")}, comment_id, obligation_id) AS r FROM k)
        SELECT comment_id, obligation_id, cell, CAST(r AS INT) AS draw_rank FROM r WHERE r <= 25""",
    "sm7_fraction": f"""WITH {_V}, r AS (SELECT obligation_id, amendatory_action, ROW_NUMBER() OVER (PARTITION BY amendatory_action ORDER BY {_KEY.format(id='obligation_id')}, obligation_id) AS r, COUNT(*) OVER (PARTITION BY amendatory_action) AS n FROM v)
        SELECT obligation_id, amendatory_action FROM r WHERE r <= GREATEST(round_even(n * 0.05::DOUBLE, 0), 1)""",
    "sm8_simple": f"WITH {_C} SELECT document_id FROM c ORDER BY {_KEY.format(id='document_id')}, document_id LIMIT 50",
    "c1_exact_clusters": f"""WITH {_C}, k AS (SELECT document_id, COALESCE(docket_id, '') AS scope, array_to_string(regexp_extract_all(lower(COALESCE(comment, '')), '[a-z0-9]+'), ' ') AS w FROM c)
        SELECT document_id, scope, CASE WHEN w = '' THEN document_id ELSE MIN(document_id) OVER (PARTITION BY scope, w) END AS cluster FROM k""",
    "j9_top_k": f"""SELECT query_id, item_id, ROUND(c, 4) AS cosine, CAST(r AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS r FROM
        (SELECT p.vec_id AS query_id, f.vec_id AS item_id, {_COS} AS c FROM embeddings p, embeddings f WHERE p.vec_id % 100 = 0)) WHERE r <= 5 AND query_id <> item_id""",
    "j10_outcomes": f"WITH {_outcomes('p.vec_id % 7 = f.vec_id % 7')} SELECT key, id, outcome_state, matched_id, ROUND(best_cosine, 4) AS best_cosine FROM o",
    "j10_outcomes_text_only": f"WITH {_outcomes('TRUE')} SELECT key, outcome_state, COUNT(*) AS n FROM o GROUP BY 1, 2",
    "sc20_stale_vectors": "SELECT doc_id FROM documents WHERE text IS NULL OR LENGTH(text) >= 1000",
    "c14_shards": """WITH m AS (SELECT DISTINCT comment_id, obligation_id, NULLIF(regexp_extract(obligation_id, '^(.+?)__(?:proposed|final)__', 1), '') AS docket_id FROM stage4_matches WHERE comment_id IS NOT NULL AND obligation_id IS NOT NULL)
        SELECT docket_id, shard, COUNT(*) AS n FROM (SELECT docket_id, CAST((ROW_NUMBER() OVER (PARTITION BY docket_id ORDER BY comment_id, obligation_id) - 1) // 50 AS INT) AS shard FROM m) GROUP BY 1, 2""",
    "js4_split_rows": """WITH s AS (SELECT in_tokens, string_split(obligation_text, ', ') AS l FROM verified_obligations WHERE obligation_text IS NOT NULL)
        SELECT CAST(i AS INT) AS split_idx, COUNT(*) AS n, CAST(CASE WHEN i = 0 THEN SUM(in_tokens) ELSE 0 END AS BIGINT) AS tokens FROM s, unnest(range(0, LEN(l))) t(i) GROUP BY i""",
    "sk4_upsert": """WITH m AS (SELECT comment_id, obligation_id, MAX(cosine_similarity) AS cosine_similarity, bool_or(uncertainty_truncated) AS t FROM stage4_matches GROUP BY 1, 2)
        SELECT comment_id, obligation_id, cosine_similarity, CASE WHEN t THEN FALSE ELSE t END AS uncertainty_truncated, CASE WHEN t THEN 5000 END AS truncation_cap_used FROM m""",
    "sk7_status": """SELECT DISTINCT docket_id, CASE WHEN docket_id IN (SELECT regexp_extract(obligation_id, '^(.+?)__(?:proposed|final)__', 1) FROM stage4_matches WHERE obligation_id IS NOT NULL) THEN 'retrieved' ELSE 'submitted' END AS status FROM anchor_rules_locked""",
    "c26_pairing": f"""WITH r AS (SELECT docket_id, doc_id, rule_type, unnest(list_distinct(regexp_extract_all(substr(text, 1, 5000), '{text.RIN}'))) AS rin FROM documents WHERE docket_id IS NOT NULL AND rule_type IS NOT NULL AND text IS NOT NULL)
        SELECT DISTINCT p.docket_id, p.doc_id AS proposed_id, f.doc_id AS final_id FROM r p JOIN r f ON p.docket_id = f.docket_id AND p.rin = f.rin AND p.rule_type = 'proposed' AND f.rule_type = 'final'""",
    "sm5_two_tiers": f"""WITH a AS (SELECT obligation_id, MAX(audit_tier) AS t, MAX(CASE regexp_replace(lower(COALESCE(classifier_label, '')), '[^a-z0-9]', '', 'g') WHEN 'modified' THEN 'MODIFIED' WHEN 'dropped' THEN 'DROPPED' WHEN 'new' THEN 'NEW' END) AS state FROM outcome_audit_reconciled GROUP BY 1),
        f AS (SELECT *, COALESCE(t = 'T1_F3' AND state = 'DROPPED', FALSE) AS f FROM a), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY f, state ORDER BY {_KEY.format(id='obligation_id')}, obligation_id) AS r FROM f)
        SELECT obligation_id, state, CASE WHEN f THEN 'T1' ELSE 'T2' END AS tier FROM r WHERE f OR r <= CASE state WHEN 'MODIFIED' THEN 20 WHEN 'DROPPED' THEN 20 WHEN 'NEW' THEN 10 ELSE 0 END""",
    "js3_modals": "SELECT CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.MODAL_ALIASES.items()) + f" ELSE 'other' END AS modal_norm, COUNT(*) AS n FROM (SELECT lower(trim(regexp_replace(COALESCE(modal, ''), '{S}+', ' ', 'g'))) AS m FROM verified_obligations) GROUP BY 1",
    "c10_variants": f"""WITH {_ENGAGED}, fl AS (SELECT docket_id FROM (SELECT docket_id, MIN(proposed_year) AS p, MAX(final_year) AS f, MAX(n_comments) AS n FROM anchor_rules_locked GROUP BY 1) WHERE COALESCE(f < p, FALSE) OR COALESCE(p > 2018, FALSE) OR n IS NULL)
        SELECT {_E}, 'paper' AS variant FROM e UNION ALL SELECT {_E}, 'exclude flagged' FROM e WHERE docket_id IS NULL OR docket_id NOT IN (SELECT docket_id FROM fl WHERE docket_id IS NOT NULL)""",
}
