import random

import pytest

from rulewake.llm import cut_ends

OPENINGS = ["The agency should publish the limits used for lead", "We urge the office to expand the testing protocol for shipyards because it is practical", "Owners of pulp mills shall submit the plan no later than 40 days after the effective date", "My kids deserve clean air, not asthma attacks", "Nothing in the record explains why ozone should be measured every 31 feet", "If the exemption is finalized, farmworkers will see lost workdays within 12 months"]


def texts(n=500, seed=2):
    r = random.Random(seed)
    return [" ".join(r.choice(OPENINGS).replace("40", str(r.randint(1, 99))) + "." for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def ends():
    return cut_ends.Ends.of(texts())


@pytest.mark.parametrize("tail", ["We urge the office to expand the testing proto", "Nothing in the record explains why ozone should be", "shall submit the plan no later than 40 days after the", "My kids deserve clean air, not asthma attacks. Owners of pulp mi [...]", "If the exemption is finalized, farmworkers will see lost wor..."])
def test_cut(ends, tail):
    assert cut_ends.lost(tail, False, ends)


@pytest.mark.parametrize("tail", ["My kids deserve clean air, not asthma attacks", "shall submit the plan no later than 40 days after the effective date", "It is done.\n- testing protocol", "See https://docs.example.org/a", "It is late.\nTown: Oak; Size: 3", "And so on...", "measured every 31 feet", "", "attachment", "N/A"])
def test_complete(ends, tail):
    assert not cut_ends.lost(tail, False, ends)


def test_held_out_accuracy(ends):
    r = random.Random(9)
    right = total = 0
    for t in texts(200, 5):
        cut = r.randint(len(t) // 2, len(t) - 12)
        if t[cut - 1] in ". " or t[cut] in ". ":
            continue
        right += cut_ends.lost(t[:cut], False, ends) + (not cut_ends.lost(t.rstrip("."), False, ends))
        total += 2
    assert right / total > 0.9


def test_limits_and_rates(spark):
    r = random.Random(1)
    rows = []
    for i, t in enumerate(texts(1200, 8)):
        long = t * 3
        rows.append((f"d{i}", long[:300] if i % 2 else long, "web" if i % 2 else None))
    rows += [("n", None, "web"), ("b", "  ", "web"), (None, "x", "web"), ("d1", rows[1][1], "web")]
    df = spark.createDataFrame(rows, "document_id string, comment string, text_source string")
    at = cut_ends.limits(cut_ends.measured(cut_ends.rows(df, "document_id", ["comment"], "text_source"))).collect()
    assert {(x.source, x.length) for x in at if x.unit == "char"} == {("web", 300)}
    ways = {x.id: x.how for x in cut_ends.found(df, "document_id", ["comment"], "text_source").collect()}
    assert {i for i, how in ways.items() if how == "limit"} == {i for i, t, s in rows if s == "web" and i and t and len(t) == 300 and t.rstrip()[-1] != "."}
    found = {x.id for x in cut_ends.found(df, "document_id", ["comment"], "text_source").collect()}
    expected = {i for i, t, s in rows if s == "web" and i and t and len(t) == 300 and not t.rstrip().endswith(".")}
    assert len(found & expected) / len(expected) > 0.97 and len(found - expected) < 0.02 * len(rows)
    rates = {x.source: x for x in cut_ends.rates(df, "document_id", ["comment"], "text_source").collect()}
    assert rates["web"].share > 0.8 and rates["(none)"].share < 0.05 and r
    assert cut_ends.found(df.limit(0), "document_id", ["comment"], "text_source").count() == 0


def test_columns_have_limits_of_their_own(spark):
    rows = [(f"d{i}", t * 2, (t[:120] if i % 2 else t[:60].rsplit(" ", 1)[0] + "."), "web") for i, t in enumerate(texts(400, 3))]
    df = spark.createDataFrame(rows, "id string, comment string, title string, source string")
    at = cut_ends.limits(cut_ends.measured(cut_ends.rows(df, "id", ["comment", "title"], "source"))).filter("unit = 'char'").collect()
    assert {(x.field, x.length) for x in at} == {("title", 120)}


def test_model_counts_all_texts(spark, monkeypatch):
    rows = texts(700, 4) + ["See attached", "see attached please"] * 3
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    whole, own = cut_ends.Ends.of(rows), cut_ends.fitted(df)
    assert (own.known, own.seen, own.ended, own.suffixes, own.share) == (whole.known, whole.seen, whole.ended, whole.suffixes, whole.share)
    monkeypatch.setattr(cut_ends, "MODEL_TEXTS", 200)  # a larger table: the same counts per 200 texts
    scale = len(rows) / 200
    own = cut_ends.fitted(df)
    assert own.seen and own.seen == {g: n / scale for g, n in whole.seen.items() if n >= scale and all(w in own.known or w in ("<s>", "^") for w in g)}


def test_short_texts_of_many_are_complete(spark, monkeypatch):
    monkeypatch.setattr(cut_ends, "MODEL_TEXTS", 100)
    rows = [(f"p{i}", t, "web") for i, t in enumerate(["See attached", "SEE ATTACHED", "See attached comments", "Attached"] * 40)] + [(f"d{i}", t, "web") for i, t in enumerate(texts(600, 7))]
    rows += [(f"c{i}", texts(1, i)[0].rsplit(" ", 3)[0] + " my", "web") for i in range(5)]
    got = {r.id for r in cut_ends.found(spark.createDataFrame(rows, "id string, comment string, source string"), "id", ["comment"], "source").collect()}
    assert not any(i[0] == "p" for i in got) and {f"c{i}" for i in range(5)} <= got
