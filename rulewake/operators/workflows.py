"""Operators that chain others: candidates verified by services, a second pass for what was missed, periods of dockets, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.operators import labels, obligations, tables
from rulewake.operators import statistics as st


def is_comment(link: Column, document_type: Column, rule: str = "link") -> Column:
    """Whether a record is a comment: by its link to another document (`link`), by its type (`type`), or by either (`any`)."""
    by_link = F.trim(F.coalesce(link, F.lit(""))) != ""
    by_type = F.lower(F.coalesce(document_type, F.lit(""))).rlike("public submission|comment")
    return {"link": by_link, "type": by_type, "any": by_link | by_type}[rule]


def needs_recognition(kind: Column, n_chars: Column, quality: Column) -> Column:
    """Whether an extracted file should be read again by a recogniser: a PDF whose text is short, garbled or missing."""
    few = F.coalesce(F.try_to_number(n_chars.cast("string"), F.lit("999999999")), F.lit(0)) < 500
    return (F.coalesce(kind, F.lit("")) == "pdf") & (few | F.coalesce(quality, F.lit("short")).isin("short", "garbled"))


def second_stage(status: Column, quality: Column, mode: str = "targeted") -> Column:
    """Files for the vision model: all that were recognised, or only those that failed or came out badly."""
    return F.lit(True) if mode == "all" else F.coalesce(status.startswith("fail"), F.lit(True)) | F.coalesce(quality != "ok", F.lit(True))


def scoped(comments: DataFrame, dockets: DataFrame) -> DataFrame:
    """Comments with text of the given dockets."""
    return comments.join(dockets.select("docket_id").distinct(), "docket_id", "left_semi").filter(F.length(text.stripped(F.coalesce("comment", F.lit("")))) > 0)


def by_position(answers: DataFrame, pairs: DataFrame, *order: str) -> DataFrame:
    """Answers (custom_id pair_<i>, answer) joined to the i-th pair in an explicit order, from 0; answers with another id are left out."""
    numbered = labels.sharded(pairs.withColumn("_all", F.lit(1)), ["_all"], 1, *order).withColumnRenamed("shard", "position").drop("_all")
    at = F.try_to_number(F.nullif(F.regexp_extract("custom_id", r"^pair_(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return numbered.join(answers.withColumn("position", at).filter("position IS NOT NULL"), "position")


def synthetic_ids(rows: DataFrame, block: str, item: str, start: int = 100_000, width: int = 100) -> DataFrame:
    """Adds candidate_idx start + block * width + item. With width=100 a block of more than 100 items collides with the next one; a larger width doesn't."""
    return rows.withColumn("candidate_idx", F.lit(start) + F.col(block) * width + F.col(item))


def verified(candidates: DataFrame, labeler: labels.Labeler, fields: list[str], prompt: str = "obligation_text") -> DataFrame:
    """Candidates with the fields of the labeler's answer and verified: false where the answer is missing or no JSON, with its error."""
    done = labels.labelled(candidates, prompt, labeler)
    answer = labels.unfenced(F.col("answer"))
    good = F.try_parse_json(answer).isNotNull() & F.col("error").isNull()
    return done.select(*candidates.columns, *(F.get_json_object(answer, f"$.{f}").alias(f"verified_{f}") for f in fields), good.alias("verified"), F.coalesce("error", F.when(~good, "not json")).alias("error"))


def with_second_pass(first: DataFrame, blocks: DataFrame, finder: labels.Labeler, threshold: float = obligations.OVERLAP) -> DataFrame:
    """First findings and those a second pass over the blocks adds, without the ones that overlap a first finding in the same section.

    first: doc_id, row_id, cfr_section, start, end; blocks: doc_id, block_id, cfr_section, start, text. The finder answers a block
    with a JSON list of sentences, whose places are looked up in the block.
    """
    asked = labels.labelled(blocks, "text", finder)
    items = F.from_json(labels.unfenced(F.col("answer")), "array<string>")
    found = asked.select("doc_id", "block_id", "cfr_section", F.col("start").alias("block_start"), "text", F.posexplode(items).alias("i", "sentence"))
    at = F.instr("text", F.col("sentence"))
    second = found.select(
        "doc_id", F.concat_ws("/", "block_id", F.col("i").cast("string")).alias("row_id"), F.lit("safety_net").alias("found_via"), "cfr_section",
        F.when(at > 0, F.col("block_start") + at - 1).cast("int").alias("start"), F.when(at > 0, F.col("block_start") + at - 1 + F.length("sentence")).cast("int").alias("end"),
    )
    own = first.select("doc_id", "row_id", F.lit("primary").alias("found_via"), "cfr_section", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return obligations.without_repeats(own.unionByName(second), threshold)


def model_agreement(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: pairs that both models labelled, and for each field the share on which they agree (nulls agree with nulls)."""
    x, y = a.select(*keys, *(F.col(f).alias(f"{f}_a") for f in fields)), b.select(*keys, *(F.col(f).alias(f"{f}_b") for f in fields))
    return x.join(y, keys).agg(F.count("*").alias("n_pairs"), *(F.avg(F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")).cast("int")).alias(f"same_{f}") for f in fields))


def docket_periods(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """(docket_id, proposed_id, opened, final_id, closed, administration): the longest document of each rule type and its date."""
    best = tables.first_by(documents.filter("docket_id IS NOT NULL"), ["docket_id", "rule_type"], F.desc_nulls_last("n_chars"), F.asc("doc_id"))
    side = lambda rule, i, at: best.filter(F.col("rule_type") == rule).select("docket_id", F.col("doc_id").alias(i), F.col("publication_date").alias(at))
    both = anchors.select("docket_id").distinct().join(side("proposed", "proposed_id", "opened"), "docket_id", "left").join(side("final", "final_id", "closed"), "docket_id", "left")
    return both.withColumn("administration", text.administration(F.coalesce("opened", "closed")))


def text_index(files: DataFrame, pattern: str = r"verified_(.+)_(proposed|final)\.csv$") -> DataFrame:
    """(obligation_id, obligation_text) of verified rows, docket and rule type taken from the file name in `path`; one row per id."""
    docket, rule = F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)
    rows = files.filter(text.tolerant_bool(F.col("verified")) & (docket != "")).select(text.obligation_id(docket, rule, F.col("candidate_idx"), F.col("split_idx")).alias("obligation_id"), "obligation_text")
    return rows.filter("obligation_id IS NOT NULL").groupBy("obligation_id").agg(F.max("obligation_text").alias("obligation_text"))


def finding(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """One row for a 2x2 question: cells, both rates, chi-square, Cramer's V, z and odds ratio."""
    a, b, c, d = (F.col(n) for n in "abcd")
    chi2 = st.yates(a, b, c, d)
    ratio = st.odds_ratio(a, b, c, d)
    return st.cells(df, row, column).select(
        "a", "b", "c", "d", F.try_divide(a, a + b).alias("rate_1"), F.try_divide(c, c + d).alias("rate_2"), chi2.alias("chi2"), st.cramers_v(chi2, a + b + c + d).alias("cramers_v"),
        st.two_proportions(a, a + b, c, c + d).alias("z"), ratio["odds_ratio"].alias("odds_ratio"),
    )


def must_equal(found: dict[str, float], expected: dict[str, float], within: float = 5e-4) -> None:
    """An error naming every number that is off: a run stops before it builds on drifted results."""
    wrong = {k: (found.get(k), v) for k, v in expected.items() if k not in found or found[k] is None or abs(found[k] - v) > within}
    if wrong:
        raise AssertionError(f"not as published: {wrong}")
