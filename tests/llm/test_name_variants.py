import pytest

from rulewake.llm import name_variants as nv

TITLES = {
    "p1": "Comment submitted by Abigail Norvelski, Oakbrenford", "p2": "Comment from Norvelski, Abby (Oakbrenford)", "p3": "Oakbrenford: A. Norvelski", "p4": "Abigial Norvelsky, City of Oakbrenford",
    "p5": "comment by Dr. ABIGAIL R. NORVELSKI, PH.D. / OAKBRENFORD", "q1": "Comment submitted by Samuel Norvelski, Oakbrenford", "q2": "Sam Norvelski, Oakbrenford — Comment", "r1": "Abigail Norvelski, Lakewimburg",
    "o1": "Comment of East Tarvinport Clean Air Council", "o2": "Council for Clean Air of E. Tarvinport", "o3": "Clean-Air Cncl. (East Tarvinprot), Inc.", "o4": "East Tarvinport Clean Air Union", "o5": "West Tarvinport Clean Air Council", "o6": "Letter – East Tarvinport CAC",
    "a1": "Anonymous public comment", "a2": "Comment", "a3": "Comment on Proposed Rule", "a4": None, "a5": "Untitled – web form", "a6": "",
}
PLACES = [a + b + c for a in ("Marl", "Kelv", "Dors", "Farn", "Gild", "Hexm", "Ivor", "Jarr") for b in ("ow", "in", "et", "ug") for c in ("ton", "bury", "wold")]
FILL = [f"{m} {p} {s} {k}" for i, p in enumerate(PLACES) for m, s, k in [(("East", "West", "Old")[i % 3], s, k) for s, k in (("Clean Air", "Council"), ("River Protection", "Union"), ("Public Health", "Association"))]]


@pytest.fixture(scope="module")
def entities(spark):
    rows = [*TITLES.items(), ("p1", TITLES["p1"]), (None, "Abigail Norvelski, Oakbrenford"), *((f"z{i}", t) for i, t in enumerate(FILL))]
    df = spark.createDataFrame(rows, "document_id string, title string")
    return {r.id: r.entity for r in nv.linked(df, "document_id", "title").collect()}


def test_one_person(entities):
    assert len({entities[i] for i in ("p1", "p2", "p3", "p4", "p5")}) == 1


def test_other_persons(entities):
    assert entities["q1"] == entities["q2"] != entities["p1"] and entities["r1"] not in (entities["p1"], entities["q1"])


def test_organisations(entities):
    assert entities["o1"] == entities["o2"] == entities["o3"] == entities["o6"]
    assert len({entities[i] for i in ("o1", "o4", "o5")}) == 3
    assert len({entities[f"z{i}"] for i in range(len(FILL))}) == len(FILL)


def test_nobody(entities):
    assert not {"a1", "a2", "a3", "a4", "a5", "a6"} & set(entities)


def test_pairs(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("a", 1)], "id string, entity bigint")
    assert {(r.id_a, r.id_b) for r in nv.pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_repeated_misspellings(spark):
    times = {"Oliver N. Kelantamwick - Yarclihaven": 12, "Kelantsmwick, Oliver / Yarclihaven": 3, "Oliver Kelantsmwick, Dorsetbury": 2, "Oliver Kelantamwick, Dorsetbury": 9, "Council for Clean Air of East Tarvinport": 9, "East Tarvinprot Clean Air Council": 4, "Anna Marlowton, Gildwold": 5, "Ruth Marlowten, Gildwold": 5}
    rows = [(f"{t}{i}", t) for t, n in times.items() for i in range(n)] + [(f"z{i}", t) for i, t in enumerate(FILL)]
    got = {r.id: r.entity for r in nv.linked(spark.createDataFrame(rows, "document_id string, title string"), "document_id", "title").collect()}
    e = [got[f"{t}0"] for t in times]
    assert e[0] == e[1] and e[2] == e[3] != e[0] and e[4] == e[5] and e[6] != e[7]


def test_two_frequent_words_are_two():
    assert nv.apart([30, 90], 5, [40, 90], 20, [], []) == ([25, 85], [20, 70]) and nv.apart([9], 8, [9], 9, [], []) == ([9], [9])
    assert nv.apart([30], 9, [40], 9, ["abby"], ["abigail"]) == ([1], [1]) and nv.apart([30], 9, [40], 9, ["a"], ["a"]) == ([30], [40])


def test_wrong_first_letters(spark):
    persons = [("Anna Kowalski, Quinivoxdale", "Anna Lowalski, Quinivoxdale"), ("Ruth Kowalski, Hexmugbury", "Ruth owalski, Hexmugbury"), ("Sam Norvelski, Oakbrenford", "Sam Norvelski, Pakbrenford"), ("Paul Pelboretti, Gildetwold", "Paul Elboretti, Gildetwold")]
    orgs = [("East Tarvinport Clean Air Council", "Wast Tarvinport Clean Air Council"), ("East Tarvinport Clean Air Council", "East Tarvinport Dlean Air Council"), ("East Tarvinport Clean Air Council", "East Tarvinport Clean Air Vouncil")]
    titles = sorted({t for pair in persons + orgs for t in pair})
    rows = [(t, t) for t in titles] + [(f"{t}2", t) for t, _ in persons + orgs] + [(f"z{i}", t) for i, t in enumerate(FILL)]
    got = {r.id: r.entity for r in nv.linked(spark.createDataFrame(rows, "document_id string, title string"), "document_id", "title").collect()}
    assert [(a, b) for a, b in persons + orgs if got[a] != got[b]] == []


def test_all_near_words_meet():
    import random

    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abcdeo") for _ in range(r.randint(3, 11)))
        b = list(a)
        for _ in range(r.randint(1, 2)):
            i, how = r.randrange(len(b)), r.randrange(4)
            b[i : i + 2] = {0: b[i + 1 : i + 2], 1: [r.choice("abcdeo"), *b[i : i + 2]], 2: [r.choice("abcdeo"), *b[i + 1 : i + 2]], 3: b[i : i + 2][::-1]}[how]
            b = b or ["a"]
        if nv.alike(a, "".join(b)):
            assert nv.shortened(a) & nv.shortened("".join(b)), (a, b)


def test_exchanged_letters_in_short_places(spark):
    places = [p for p in PLACES if len(p) in (7, 8)]
    rows = []
    for p in places:
        q = p[:3] + p[4] + p[3] + p[5:]
        rows += [(f"{p}{i}", f"East {p} Clean Air Council") for i in range(3)] + [(q, f"East {q} Clean Air Council")]
    got = {r.id: r.entity for r in nv.linked(spark.createDataFrame(rows, "document_id string, title string"), "document_id", "title").collect()}
    alone = [p for p in places if got[f"{p}0"] != got[p[:3] + p[4] + p[3] + p[5:]]]
    assert alone == []


def test_bands_follow_the_curve():
    bands, height = nv.tuned(0.6, 0.95, 24)
    assert nv.curve(0.6, bands, height) >= 0.95 and bands <= 24
    assert all(nv.curve(0.6, b, height + 1) < 0.95 for b in range(1, 25))


def test_banding_recall_against_the_curve():
    import numpy as np

    rng = np.random.default_rng(0)
    met = total = 0
    for _ in range(150):
        base = [f"g{x}" for x in rng.integers(0, 10**6, 40)]
        other = base[:30] + [f"h{x}" for x in rng.integers(0, 10**6, 10)]  # Jaccard 0.6
        s = nv.signatures([base, other], 22, 4)
        met += bool((s[0] == s[1]).any())
        total += 1
    assert met / total > 0.85


def test_words():
    assert nv.edits("abcd", "abdc") == 1 and nv.edits("abc", "xyz", 2) == 3 and nv.jaro_winkler("martha", "marhta") > 0.96
    assert nv.monge_elkan(["norvelski"], ["norvelsky"]) > 0.9 and nv.monge_elkan(["a"], []) == 0 and nv.monge_elkan([], []) == 1


def test_empty_table(spark):
    assert nv.linked(spark.createDataFrame([], "document_id string, title string, entity int"), "document_id", "title").count() == 0


def test_names_of_two_letters_further_kinds_and_frequent_places(spark):
    rows = [("a1", "Wei Li, Oakford"), ("a2", "Li, Wei (Oakford)"), ("b1", "Dr. Amy Wu, Oakford"), ("b2", "Amy Wu – Oakford"), ("c1", "Comment from Oakford Water District"), ("c2", "Oakford Water District"), ("d1", "University of Velmoor"), ("d2", "University of Velmoor")]
    rows += [(f"h{i}", f"{'Comments of ' * (i % 2)}Hotplace Water Association{' ' * (i % 7)}") for i in range(200)]
    got = {r.id: r.entity for r in nv.linked(spark.createDataFrame(rows, "id string, title string"), "id", "title").collect()}
    assert set(got) == {i for i, _ in rows}
    for a, b in (("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("d1", "d2"), ("h0", "h199")):
        assert got[a] == got[b]
    assert len(set(got.values())) == 5


def test_given_names_of_men_and_women_stay_apart():
    assert len(set(nv.resolved(["marie", "maria"], [3, 2]))) == 2 and len(set(nv.resolved(["ann", "anna"], [3, 2], [40, 30]))) == 2
    assert len(set(nv.resolved(["norvell", "norvel"], [5, 1]))) == 1 and len(set(nv.resolved(["konstantin", "konst", "k"], [5, 1, 1]))) == 1
    assert len(set(nv.resolved(["jared", "jarod"], [5, 4], [40, 30]))) == 2


def test_members_count_their_links(spark):
    entities = spark.createDataFrame([("a", 1, "p"), ("b", 1, "p"), ("c", 2, "o")], "id string, entity bigint, sort string")
    assert {r.id: r.n_links for r in nv.members(entities).collect()} == {"a": 1, "b": 1, "c": 0}


def test_recall_by_kind_of_variant(spark):
    import random

    r = random.Random(5)
    made = lambda: "".join(r.choice("b d f g k l m n p r s t v z".split()) + r.choice("aeiou") for _ in range(r.randint(3, 4))) + r.choice(["n", "rt", "sk", "ll"])
    def typo(w, at):
        return w[:at] + r.choice("bcdfgklmnprst".replace(w[at], "")) + w[at + 1 :]

    def swapped(w):
        k = r.randint(1, len(w) - 3)
        return w[:k] + w[k + 1] + w[k] + w[k + 2 :]

    rows, expected = [], []
    for i in range(120):
        given, surname, place = made().capitalize(), made(), made()
        title = lambda g, s, p: f"{g} {s.capitalize()}, {p.capitalize()}"
        rows += [(f"{i}-base{k}", title(given, surname, place)) for k in range(2)]
        variants = {
            "typo": title(given, typo(surname, r.randint(1, len(surname) - 2)), place),
            "exchange": title(given, swapped(surname), place),
            "first": title(given, typo(surname, 0), place),
            "first of place": title(given, surname, typo(place, 0)),
            "order": f"{surname.upper()}, {given} ({place.capitalize()})",
            "initial": title(given[0] + ".", surname, place),
            "beginning": title(given[:3] + ".", surname, place),
        }
        rows += [(f"{i}-{kind}", t) for kind, t in variants.items()]
        expected += [(f"{i}-base0", f"{i}-{kind}", kind) for kind in variants]
    got = {x.id: x.entity for x in nv.linked(spark.createDataFrame(rows, "id string, title string"), "id", "title").collect()}
    hits = {}
    for a, b, kind in expected:
        hits.setdefault(kind, []).append(got.get(a) is not None and got.get(a) == got.get(b))
    assert all(sum(h) / len(h) >= 0.9 for h in hits.values()), {k: round(sum(h) / len(h), 3) for k, h in hits.items()}
    persons = {}
    for i, e in got.items():
        persons.setdefault(e, set()).add(i.split("-")[0])
    assert sum(len(x) == 1 for x in persons.values()) / len(persons) > 0.97


def test_keys_of_cores_are_never_gathered_on_the_driver(spark):
    # one small file of few names, of which each has hundreds of keys: its size must not pass for that of the keys
    names = spark.range(50)
    keys = names.mapInPandas(lambda batches: (type(b)({"core_id": b["id"].repeat(300), "band": 0, "key": list(range(300)) * len(b)}) for b in batches if len(b)), "core_id bigint, band int, key bigint")
    met = nv.meeting(keys)
    assert met.count() == 50 * 49 // 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
