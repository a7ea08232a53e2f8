import numpy as np
import pytest

from rulewake.llm import boosting
from rulewake.llm import personal_data as pd_


@pytest.fixture(scope="module")
def model():
    return pd_.trained(pd_.Words({w: 3 for w in ("the", "rule", "will", "town", "people", "small", "farms")}))


CASES = {
    "You can reach me at ann.lee@example.org today.": {"email"},
    "Write to bob72 [at] farm dot test please.": {"email"},
    "Call me at (555) 555-0142 tonight.": {"phone"},
    "My SSN is 666-12-3456.": {"id_number"},
    "My passport number is ZX1234567.": {"id_number"},
    "I live at 4411 Juniper Bend Road, Oakford.": {"address"},
    "Mail the notice to P.O. Box 551, Oakford.": {"address"},
    "My name is Katherine Norvelski and I vote.": {"name"},
    "See section 323.7873 and § 12.4 of docket ENV-HQ-OW-2014-2175.": set(),
    "The chemical with CAS No. 1584-78-4 is not listed.": set(),
    "Permit No. 76-4973-9 was issued near Camp Oakford ward 12.": set(),
    "We sample @ 96 sites instead of 307 sites.": set(),
    "": set(),
}


@pytest.mark.parametrize("text", list(CASES))
def test_kinds(model, text):
    assert {k for k, _, _ in pd_.selected([text], model)[0]} == CASES[text]


@pytest.mark.parametrize("number", ["eight one two, four three six, nine seven one six", "five five five, oh one nine one", "three  one\nfour six - two eight nine", "NINE NINE ONE, SEVEN SIX FOUR TWO"])
def test_numbers_in_words(model, number):
    text = f"Call me at {number}. Thank you."
    assert pd_.selected([text], model)[0] == [("phone", 11, 11 + len(number))]


def test_few_digit_words(model):
    assert pd_.selected(["One of two plans, or three, four, five and six, none of the seven or eight or nine."], model)[0] == []


def test_held_out_accuracy(model):
    maker = pd_.Sentences(5)
    x, y = pd_.examples([maker.one() for _ in range(600)], model.words)
    p = model.trees.probability(np.minimum(x, boosting.BINS - 1))
    for k in range(len(pd_.KINDS)):
        own = x[:, 0] == k
        passed = p[own] >= model.thresholds[k]
        assert (y[own] * passed).sum() / max(1, passed.sum()) > 0.92 and (y[own] * passed).sum() / y[own].sum() > 0.85


def test_redaction_keeps_the_rest(model):
    text = "Ask Katherine Norvelski (ann@example.org), or call 555-555-0142; see § 4."
    spans = pd_.selected([text], model)[0]
    out = pd_.redacted(text, spans)
    assert "ann@" not in out and "[EMAIL]" in out and out.startswith("Ask ") and out.endswith("; see § 4.")


def test_table(spark, model):
    rows = [("a", "My SSN is 666-12-3456. Call me at 555-0142."), ("a", "My SSN is 666-12-3456. Call me at 555-0142."), ("b", None), (None, "My SSN is 666-12-3456."), ("c", "word " * 50_000 + "Call me at (555) 555-0142."), ("d", "İstanbul ẞ: mail ann@example.org")]
    df = spark.createDataFrame(rows, "document_id string, comment string")
    got = {(r.id, k) for r in pd_.examined(df, "document_id", "comment", model).collect() for k in r.kinds}
    assert got == {("a", "id_number"), ("a", "phone"), ("c", "phone"), ("d", "email")}
    assert pd_.kinds(df.limit(0), "document_id", "comment").count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (2000, 5))
    y = ((x[:, 1] > 1) ^ (x[:, 3] > 1)).astype(float)
    m = boosting.fit(x[:1500], y[:1500], trees=60)
    assert ((m.probability(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.97


GIVEN = "Aisha Ngozi Priya Wei Olga Emily Carlos Fatima Hiroshi Ingrid Kwame Lars Mei Nadia Omar Paulo Quentin Rosa Svetlana Tariq Ursula Viktor Wanda Ximena Yusuf Zanele Amara Bjorn Chidi Dmitri".split()
SURNAMES = "Khan Okafor Nair Zhang Petrov Carter Ramirez Haddad Tanaka Larsen Mensah Nguyen Rossi Silva Weber Kowalczyk Moreau Ivanova Schmidt Lindqvist Abebe Castillo Dubois Eriksen Fischer Gupta Hassan Ito Jansen Li".split()
SAID = ["Hello, my name is {} and I oppose this.", "I, {}, oppose the proposal.", "My neighbor {} moved away.", "Our doctor, {}, warned us.", "It is unfair.\n\nSincerely,\n{}", "It is unfair.\n\n{}", "Signed: {}", "As {} told the panel, it leaks.", "We spoke with {} about it.", "My cousin {} farms nearby."]
NUMBERS = ["+44 20 7946 0{:03d}", "+33 1 70 18 {:02d} 41", "(212) 555-0{:03d}", "020 7946 0{:03d}", "+49 30 901820{:02d}", "555.201.0{:03d}", "+91 98765 432{:02d}"]
HOUSES = ["{} Maple Crescent", "{} Ashgrove Lane", "{}B Kensington Gardens", "{} Fernhill Road", "{} Upper Dock Street"]


def test_names_and_numbers_outside_every_list(model):
    cases = []
    for i in range(300):
        name = f"{GIVEN[i % 30]} {SURNAMES[(7 * i + i // 30) % 30]}"
        cases.append(("name", SAID[(i // 3) % len(SAID)].format(name), name))
    cases += [("phone", f"Please call {NUMBERS[i % 7].format(10 + i % 80)} about it.", NUMBERS[i % 7].format(10 + i % 80)) for i in range(140)]
    cases += [("address", f"I live at {HOUSES[i % 5].format(i + 3)}, near the river.", HOUSES[i % 5].format(i + 3)) for i in range(100)]
    assert not {w.lower() for w in GIVEN} & pd_.GIVEN
    found = right = 0
    hits = {"name": [], "phone": [], "address": []}
    for (kind, text, value), spans in zip(cases, pd_.selected([t for _, t, _ in cases], model)):
        hits[kind].append(any(k == kind and value in text[a:b] for k, a, b in spans))
        found += len(spans)
        right += sum(k == kind and text[a:b] in value or value in text[a:b] for k, a, b in spans)
    assert all(sum(h) / len(h) >= 0.9 for h in hits.values()), {k: sum(h) / len(h) for k, h in hits.items()}
    assert right / found >= 0.9


def test_places_bodies_and_citations_are_no_names(model):
    for text in ("The Clean Water Act covers Stone Creek and the Green Valley.", "See 40 CFR 60.5375, 81 FR 35824 and § 12.4.", "Lake Arden and Port Stanley are in Holt County.", "Dear Administrator,\n\nPlease act.\n\nThank you", "The Environmental Protection Agency and the Supreme Court disagree."):
        assert pd_.selected([text], model)[0] == [], text


def test_words_in_lower_case_are_counted_over_all_rows(spark):
    rows = [(f"d{i}", "The rule will help Ramirez." if i % 2 else "THE RULE WILL HELP") for i in range(40)] + [("n", None), ("e", "")]
    words = pd_.counted_words(spark.createDataFrame(rows, "id string, text string").filter("text IS NOT NULL"), 41)
    assert words.of("rule") == 3 and words.of("help") == 3 and words.of("ramirez") == 0
