import json

import pytest
from pyspark.sql import functions as F

from rulewake.operators import workflows


def test_comment_rules(spark):
    d = spark.createDataFrame([("x", None), (" ", "Public Submission"), (None, "Rule"), ("y", "Comment")], "link string, kind string")
    got = [tuple(r) for r in d.select(*(workflows.is_comment(F.col("link"), F.col("kind"), r).alias(r) for r in ("link", "type", "any"))).collect()]
    assert got == [(True, False, True), (False, True, True), (False, False, False), (True, True, True)]


def test_answers_by_position(spark):
    pairs = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    answers = spark.createDataFrame([("pair_0", "A"), ("pair_2", "C"), ("pair_9", "?"), ("other", "?"), (None, "?")], "custom_id string, answer string")
    assert {(r.id, r.answer) for r in workflows.by_position(answers, pairs, "id").collect()} == {("a", "A"), ("c", "C")}


def test_synthetic_ids_collide_only_beyond_the_width(spark):
    d = spark.createDataFrame([(0, 100), (1, 0)], "b int, i int")
    assert len({r.candidate_idx for r in workflows.synthetic_ids(d, "b", "i").collect()}) == 1
    assert len({r.candidate_idx for r in workflows.synthetic_ids(d, "b", "i", width=1000).collect()}) == 2


def test_verified(spark):
    d = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, obligation_text string")

    def labeler(ps):
        return ['```json\n{"subject": "s"}\n```' if p == "good" else "{" if p == "bad" else None for p in ps]

    got = {r.i: (r.verified, r.verified_subject, r.error) for r in workflows.verified(d, labeler, ["subject"]).collect()}
    assert got == {1: (True, "s", None), 2: (False, None, "not json"), 3: (False, None, "no answer")}


def test_second_pass_adds_only_what_is_new(spark):
    text = "Owners must report. Others shall wait."
    first = spark.createDataFrame([(1, "p", "80.1(a)", 0, 19)], "doc_id int, row_id string, cfr_section string, start int, end int")
    blocks = spark.createDataFrame([(1, "b", "80.1", 0, text)], "doc_id int, block_id string, cfr_section string, start int, text string")
    found = workflows.with_second_pass(first, blocks, lambda bs: [json.dumps(["Owners must report.", "Others shall wait.", "not there"]) for _ in bs]).collect()
    assert {(r.found_via, r.start, r.end) for r in found} == {("primary", 0, 19), ("safety_net", 20, 38), ("safety_net", None, None)}


def test_agreement_periods_index_finding(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "m")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", None), (2, "z", "m"), (3, "q", "m")], "k int, f string, g string")
    assert tuple(workflows.model_agreement(a, b, ["k"], ["f", "g"]).first()) == (2, 0.5, 1.0)
    docs = spark.createDataFrame([("d", "proposed", 1, 10, "2015-01-01"), ("d", "proposed", 2, 20, "2018-01-01"), ("e", "final", 3, None, None)], "docket_id string, rule_type string, doc_id int, n_chars int, day string").withColumn("publication_date", F.to_timestamp("day"))
    p = {r.docket_id: r for r in workflows.docket_periods(spark.createDataFrame([("d",), ("e",), ("f",)], "docket_id string"), docs).collect()}
    assert p["d"].proposed_id == 2 and p["d"].administration == "Trump" and p["e"].final_id == 3 and p["f"].administration is None
    files = spark.createDataFrame([("/x/verified_D-1_final.csv", "True", 3, 0, "t"), ("/x/verified_D-1_final.csv", "False", 4, 0, "t"), ("/x/other.csv", "True", 5, 0, "t")], "path string, verified string, candidate_idx int, split_idx int, obligation_text string")
    assert [tuple(r) for r in workflows.text_index(files).collect()] == [("D-1__final__3_0", "t")]
    f = workflows.finding(spark.createDataFrame([(True, True)] * 3 + [(False, None)], "r boolean, c boolean"), F.col("r"), F.col("c")).first()
    assert (f.a, f.d, f.rate_1, f.rate_2) == (3, 1, 1.0, 0.0)
    workflows.must_equal({"a": 1.0}, {"a": 1.0001})
    with pytest.raises(AssertionError):
        workflows.must_equal({"a": 1.0}, {"a": 1.1, "b": 2.0})
