import pytest
from pyspark.sql import functions as F

from rulewake.functions import numbers, text


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, expected", [
    ("See attached file(s)", True), ("Please see the attached comments.", True), ("attached", True), ("N/A", True), ("", True), (None, True), ("letter attached", True), ("pdf", True), ("no comments", True),
    ("comment", False), ("I support the rule", False), ("See attached why this rule is bad for everybody who lives near the plant", False), ("Comments of the Oak Club attached", True),
])
def test_placeholders(spark, given, expected):
    assert one(spark, text.is_attachment_only(F.col("t")), t=given) is expected


@pytest.mark.parametrize("title, kind", [
    ("Comment submitted by Jane Roe", "individual"), ("Comment submitted by Jane Roe, Executive Director, WMA", "organizational"), ("Comments of the Oak Association", "organizational"), ("Comment from J. Roe", "organizational"),
    ("Anonymous public comment", "individual"), ("Oak Company", "organizational"), ("Comment", "other"), (None, "other"), ("  ", "other"), ("comment SUBMITTED by X", "individual"), ("Mass mail", "other"), ("Letter of the Board", "organizational"),
])
def test_titles(spark, title, kind):
    assert one(spark, text.submitter_kind(F.col("t")), t=title) == kind


def test_normal_form_and_hash(spark):
    import hashlib

    assert one(spark, text.normal_comment(F.col("t")), t=" The\xa0 RULE\n is ") == "the rule is"
    assert one(spark, text.comment_hash(F.col("t")), t=" A  b") == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, text.comment_hash(F.col("t")), t="  ") is None


@pytest.mark.parametrize("given, expected", [("80.1435(b)(1)", "80.1435"), ("80.27", "80.27"), ("", ""), (None, ""), ("Part 7", "Part 7")])
def test_section(spark, given, expected):
    assert one(spark, text.section_base(F.col("t")), t=given) == expected


def test_cfr_parts(spark):
    assert one(spark, text.cfr_parts(F.col("t")), t="40 CFR Parts 60, 63; 33 cfr 328") == ["33-328", "40-60", "40-63"]
    assert one(spark, text.cfr_parts(F.col("t")), t="40 CFR 60.5777") == ["40-5777", "40-60"]
    assert one(spark, text.cfr_parts(F.col("t")), t=None) == []


def test_years(spark):
    y = text.register_year(F.col("a"), F.col("b"), F.col("c").cast("timestamp"))
    assert one(spark, y, a="75 FR 100", b=None, c=None) == 2010
    assert one(spark, y, a="300 FR 1", b="94-11399", c=None) == 1994
    assert one(spark, y, a=None, b="2022-18320", c=None) == 2022
    assert one(spark, y, a=None, b=None, c="2015-02-03") == 2015


def test_periods(spark):
    assert one(spark, text.administration(F.col("d").cast("date")), d="2017-01-19") == "Obama"
    assert one(spark, text.administration(F.col("d").cast("date")), d="2017-01-20") == "Trump"
    assert one(spark, text.year_cluster(F.col("y")), y=2013) == "2013-2015"
    assert one(spark, text.docket_year(F.col("d")), d="EPA-HQ-OAR-2004-0265") == 2004


@pytest.mark.parametrize("sentence, modal, strength, conditional", [
    ("Owners must not emit.", "must not", "strong", False), ("You may apply.", "may", "permissive", False), ("No person shall enter.", "no person shall", "strong", False), ("It is late.", None, None, False),
    ("If it rains, owners shall wait.", "shall", "strong", True), ("Owners shall report, unless exempt.", "shall", "strong", True), ("Owners shall report, subject to section 5.", "shall", "strong", False), ("Owners shall report, subject to review.", "shall", "strong", True),
])
def test_modals(spark, sentence, modal, strength, conditional):
    s = F.col("s")
    assert one(spark, text.modal(s), s=sentence) == modal and one(spark, text.modal_strength(s), s=sentence) == strength
    assert (one(spark, text.condition(s), s=sentence) is not None) is conditional


def test_elision(spark):
    assert one(spark, text.elided(F.col("t")), t="x" * 1500) == "x" * 1500
    assert one(spark, text.elided(F.col("t")), t="a" * 1301 + "b" * 200) == "a" * 1200 + text.ELISION + "b" * 200
    assert one(spark, text.elided(F.col("t")), t=None) == ""


def test_shingles(spark):
    assert one(spark, text.shingles(F.col("w")), w=["a", "b", "c", "d"]) == ["a b c", "b c d"]
    assert one(spark, text.shingles(F.col("w")), w=["a", "b"]) == ["a b"]
    assert one(spark, text.shingles(F.col("w")), w=[]) == []


@pytest.mark.parametrize("a, b, expected", [((100, 200), (100, 200), 1.0), ((100, 200), (200, 300), 0.0), ((100, 200), (120, 140), 1.0), ((100, 200), (150, 250), 0.5)])
def test_overlap(spark, a, b, expected):
    x = numbers.interval_overlap(*(F.lit(v) for v in (*a, *b)))
    assert one(spark, x, t="") == expected


def test_words_and_vectors(spark):
    o = text.word_overlap(F.col("a"), F.col("b"))
    assert [one(spark, o[k], a="the rule is late", b="the rule") for k in ("precision", "recall")] == [1.0, 0.5]
    assert one(spark, o["f1"], a="", b=None) == 1.0 and one(spark, o["f1"], a="x", b="") == 0.0
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, numbers.cosine(v(1.0, 0.0), v(1.0, 1.0)), t="") == pytest.approx(0.5**0.5)
    assert one(spark, numbers.cosine(v(0.0, 0.0), v(1.0, 1.0)), t="") == 0.0
    assert one(spark, numbers.jaccard(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))), t="") == 0.5


def test_labels(spark):
    assert one(spark, text.stance(F.col("t")), t=" opposing ") == "OPPOSING" and one(spark, text.stance(F.col("t")), t="maybe") is None
    assert one(spark, text.tolerant_bool(F.col("t")), t=" Yes") is True and one(spark, text.tolerant_bool(F.col("t")), t="2") is None
    assert one(spark, text.loose_label(F.col("t"), ["SURVIVED-edited"]), t="survived edited\t") == "SURVIVED-edited"
    assert one(spark, text.filled("a {x} b {y}", x=F.col("t"), y=F.lit(None)), t="1") == "a 1 b "
