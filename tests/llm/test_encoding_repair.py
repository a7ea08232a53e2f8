import pytest

from rulewake.llm import encoding_repair as er

CLEAN = [
    "La compañía no explicó qué pasó con el agua, después de 40 años.", "L’été dernier, la santé des élèves n’a pas été évaluée – ça ne se négocie pas.", "Our café pays €18 more; it’s “the price” of lead…",
    "At 25 °C ± 2 °C the plan yields 17 ½ tons; see § 4.", "The sign said ACÃO VERDE and «Âge et santé».", "Ångström units, ≥ 0.5, α and Γ.", "The word вода was printed.", "naïve résumé nº 40", "Привет мир, это правило важно для людей.", "Мы живём здесь, и вода важна.",
] * 6


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    counted = Counter()
    for t in CLEAN:
        counted.update(er.grams(t))
    m = er.Model.of(counted)
    m.margin = er.validated(m, CLEAN)
    m.margin_other, m.least_other = er.validated_other(m, CLEAN)
    return m


@pytest.mark.parametrize("encoding", er.ENCODINGS)
def test_round_trip(model, encoding):
    for t in CLEAN[:4] + [CLEAN[7]]:
        chain, restored, gain = er.spots(er.garbled(t, encoding), model)
        assert restored == t and gain > model.margin


def test_double_reading_and_references(model):
    t = CLEAN[2]
    assert er.spots(er.garbled(er.garbled(t, "cp1252"), "cp1252"), model)[1] == t
    bad = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in er.garbled(t, "cp1252"))
    assert er.spots(bad, model)[1] == t


def test_clean_texts_are_no_cases(model):
    assert all(er.spots(t, model) is None for t in CLEAN)


def test_one_spot_among_right_ones(model):
    found = er.spots("Our café pays â‚¬18 and the naïve plan", model)
    assert found and found[1] == "Our café pays €18 and the naïve plan"


def test_table(spark):
    rows = [("a", CLEAN[0], er.garbled("José", "cp1252")), ("a", CLEAN[0], er.garbled("José", "cp1252")), ("b", er.garbled(CLEAN[0], "cp437"), None), ("c", "lost � here", "plain"), (None, "Ã©", "x"), ("d", None, ""), ("e", "x" * 200_000 + " cafÃ©", "t")]
    rows += [(f"k{i}", t, "T") for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(rows, "document_id string, comment string, title string")
    got = {(r.id, r.field): r for r in er.examined(df, "document_id", ["comment", "title"]).collect()}
    assert set(got) == {("a", "title"), ("b", "comment"), ("c", "comment"), ("e", "comment")}
    assert got["b", "comment"].restored == CLEAN[0] and got["c", "comment"].chain is None and got["e", "comment"].restored.endswith("café")
    assert er.examined(df.limit(0), "document_id", ["comment", "title"]).count() == 0


@pytest.mark.parametrize("wrote, read", [("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1252")])
def test_one_legacy_encoding_read_as_another(model, wrote, read):
    for t in ("Привет мир", "вода важна для людей"):
        raw = t.encode(wrote)
        try:
            bad = raw.decode(read)
        except UnicodeDecodeError:
            continue
        found = er.spots(bad, model)
        assert found and "<" in found[0] and sum(a == b for a, b in zip(found[1], t)) >= 0.6 * len(t), (bad, found)


def test_a_blank_in_place_of_the_second_byte(model):
    text = "nous allons à la plage"
    m = er.Model.of(dict(er.grams(text * 1)) | dict(er.grams("vient à la rivière à la fin à la santé")))
    assert er.spots("nous allons Ã  la plage", m)[1] == text


def test_kinds(spark):
    rows = [("a", er.garbled(CLEAN[0], "cp1252")), ("b", "caf&#233; ferm&#233;"), ("c", "lost � here")] + [(f"k{i}", t) for i, t in enumerate(CLEAN)]
    got = {r.id: r.kind for r in er.examined(spark.createDataFrame(rows, "id string, comment string"), "id", ["comment"]).collect()}
    assert got == {"a": "decoded", "b": "references", "c": "lost"}


def test_margins_come_from_all_clean_records(spark):
    import random

    r = random.Random(3)
    rows = [" ".join(r.choice(CLEAN).split()[0] + r.choice("éñçàü") * r.randint(1, 2) + "".join(r.choices("абвгдежз", k=r.randint(3, 5))) for _ in range(3)) for _ in range(4000)]
    rows = sorted({t for t in rows if not er._suspicious(t)})
    assert len(rows) > 2100  # more than any sample that was taken
    model = er.trained(spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, comment string"), "id", ["comment"])
    assert model.margin == er.validated(model, rows)
    assert (model.margin_other, model.least_other) == er.validated_other(model, rows)
