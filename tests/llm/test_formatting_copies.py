import unicodedata

from rulewake.llm import formatting_copies as fc

ROWS = [
    ("d1", "The rule is late."), ("d2", "the RULE  is late"), ("d3", "The rule is late."), ("d3", "The rule is late."), ("d4", "The rule is later."),
    ("f1", "Town: Oak\nPosition: Support; Size: 3"), ("f2", "size=3 | position=SUPPORT | town=oak"), ("f3", "Town: Oak\nPosition: Support; Size: 4"),
    ("e1", "!!!"), ("e2", "???"), ("e3", "!!!"), ("n1", None), ("n2", ""), (None, "The rule is late."), ("a1", "Caf\u00e9 ouvert"), ("a2", "cafe\u0301, OUVERT"), ("a3", "Cafe ouvert"), ("h1", "हिन्दी"), ("h2", "हनद"), ("k1", "\u212bngstr\u00f6m"), ("k2", "\u00e5ngstro\u0308m!"), ("u1", "Straße Élan"), ("u2", "STRASSE élan"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "document_id string, comment string")


def brute():
    def canon(t):
        return "".join(c for c in unicodedata.normalize("NFC", t).lower().replace("ß", "ss") if c.isalnum() or unicodedata.category(c)[0] == "M")

    def form(t):
        import re

        parts = [p for p in re.split(r"[\n;|]", t) if canon(p)]
        if len(parts) < 2 or not all(re.match(r"\s*[A-Za-z ]+\s*[:=]", p) for p in parts):
            return None
        return tuple(sorted(tuple(canon(x) for x in re.split("[:=]", p, maxsplit=1)) for p in parts))

    groups = {}
    for i, t in set(ROWS):
        if i is not None and t is not None:
            groups.setdefault(form(t) or canon(t) or ("raw", t), set()).add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_copies_equal_brute_force(spark):
    got = {(r.first_id, r.id) for r in fc.copies(frame(spark), "document_id", "comment").collect()}
    assert got == brute()


def test_each_text_once_with_its_copies(spark):
    rows = {r.first_id: (r.text, r.n_copies) for r in fc.collapsed(frame(spark), "document_id", "comment").collect()}
    assert rows["d1"] == ("The rule is late.", 3) and rows["f1"][1] == 2 and rows["e1"][1] == 2 and rows["n2"] == ("", 1)
    assert sum(n for _, n in rows.values()) == len({i for i, t in ROWS if i and t is not None})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "document_id string, comment string, raw string, id int")
    assert fc.copies(empty, "document_id", "comment").count() == 0
