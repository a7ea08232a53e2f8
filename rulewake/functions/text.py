"""Text as column expressions: normal forms, classes, citations and extracts. All run inside the JVM; null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for engines whose \\s is ASCII only.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normal_comment(text: Column) -> Column:
    """Lower case, white space squeezed; null becomes empty."""
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def comment_hash(text: Column) -> Column:
    """SHA-256 of the normal form; null where that is empty."""
    n = normal_comment(text)
    return F.when(n != "", F.sha2(n, 256))


def content_hash(text: Column) -> Column:
    """SHA-1 of the bytes, the key under which an embedding of the text is kept."""
    return F.sha1(F.coalesce(text, F.lit("")))


# The words of placeholders that stand for an attachment.
POINTING_VERBS = ["see", r"refer\s+to", "view", "read", "review", "find", r"please\s+see", r"please\s+refer\s+to", r"please\s+find"]
POINTED_DETERMINERS = ["the", "my", "our", "this", "enclosed", "attached", "uploaded", "provided", "following", "below"]
POINTED_NOUNS = [
    "attached", "attachment", "attachments", "file", "files", "document", "documents", "letter", "letters", "comments?", "submission", "submissions", "pdf",
    "response", r"response\s+letter", "email", "emails", "memo", "memos", "message", "messages", "materials?", "paper", "papers",
]
BARE_NOUNS = ["attached", "attachment", "attachments", "file", "files", "document", "documents", "pdf", "submission", "submissions", "materials"]
NO_CONTENT = [r"n\s*/\s*a", "none", r"no\s+comment", r"no\s+comments"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _more(most: int) -> str:
    return rf"\w+(?:\s+\w+){{0,{most}}}"


def placeholder_pattern() -> str:
    """One pattern for the texts that only point to an attachment or say nothing."""
    verb, article, noun = _any(POINTING_VERBS), _any(POINTED_DETERMINERS), _any(POINTED_NOUNS)
    nouns = rf"{noun}(?:\s+{noun})*"
    shapes = [
        rf"{verb}(?:\s+{article})*\s+{noun}(?:\s+{noun}|\s+for\s+{noun}|\s+of\s+{_more(5)})*",
        rf"{article}\s+{nouns}",
        _any(BARE_NOUNS),
        rf"(?:{verb}\s+)?{nouns}\s+(?:is|are)?\s*attached(?:\s+{_more(5)})?",
        rf"{nouns}\s+of\s+{_more(8)}\s+(?:is|are)?\s*attached",
        rf"attached\s+(?:please\s+)?(?:find|are|is)?(?:\s+(?:the|my|our))?(?:\s+{noun})?(?:\s+{_more(8)})?",
        rf"{verb}(?:\s+{article})*\s+{noun}\s+for\s+{noun}",
        _any(NO_CONTENT),
    ]
    return "^(?:" + "|".join(shapes) + ")$"


#: Punctuation dropped at the ends before placeholders are looked for.
EDGES = r"""[.,;:!\-_"'“”‘’()\[\]]+"""


def normal_placeholder(text: Column) -> Column:
    """The form in which placeholders are recognised; null becomes empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\(\s*s\s*\)", "s"), r"\(\s*es\s*\)", "es")
    t = F.regexp_replace(squeezed(t), r"^(?:please|kindly)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^" + EDGES, ""), EDGES + "$", ""))


def is_attachment_only(text: Column) -> Column:
    """True for empty texts and placeholders; never null."""
    n = normal_placeholder(text)
    return (n == "") | n.rlike(placeholder_pattern())


# Words by which a title shows an organisation or an office.
ORGANISATION_WORDS = [
    "association", "coalition", "institute", "council", "federation", "society", "corporation", "company", r"inc\.?", "llc", "llp", "university", "center", "environmental defense",
    "sierra club", "nrdc", "chamber", "alliance", "department", "committee", "agency", "administration", "union", "bureau", "board", "consortium", "executive director", "president",
    "vice president", "director", "general counsel", "associate general counsel",
]
ORGANISATION = r"(?i)\b" + _any(ORGANISATION_WORDS) + r"\b"


def submitter_kind(title: Column) -> Column:
    """organizational, individual or other, by the first rule that holds; null and empty titles are other."""
    t = stripped(title)
    return (
        F.when(t.isNull() | (t == ""), "other")
        .when(t.rlike(r"(?i)^comments?\s+(?:of|from)\s+"), "organizational")
        .when(t.rlike(r"(?i)^comment\s+submitted\s+by\s+"), F.when(t.rlike(ORGANISATION), "organizational").otherwise("individual"))
        .when(t.rlike(r"(?i)^anonymous\s+public\s+comment\b"), "individual")
        .when(t.rlike(ORGANISATION), "organizational")
        .otherwise("other")
    )


def submitter_kind_permissive(title: Column) -> Column:
    """individual where a title says submitted by, on behalf or written by, else organizational, null titles too."""
    return F.when(F.lower(F.coalesce(title, F.lit(""))).rlike("submitted by|on behalf|written by"), "individual").otherwise("organizational")


def submitter_kind_combined(title: Column, attachment_only: Column) -> Column:
    """organizational where the title's class or an attachment says so, else individual."""
    return F.when((submitter_kind(title) == "organizational") | F.coalesce(attachment_only, F.lit(False)), "organizational").otherwise("individual")


def cfr_parts(text: Column) -> Column:
    """Distinct `title-part` strings, sorted: after each `N CFR`, every whole number of 1 to 9999 up to the next one. Empty where none."""
    t = F.coalesce(text, F.lit(""))
    titles = F.regexp_extract_all(t, F.lit(r"(?i)\b(\d{1,3})\s*CFR\b"), F.lit(1))
    rests = F.slice(F.split(t, r"(?i)\b\d{1,3}\s*CFR\b"), 2, 1 << 20)
    pairs = F.transform(
        F.arrays_zip(titles.alias("t"), rests.alias("r")),
        lambda p: F.transform(
            F.filter(F.regexp_extract_all(p["r"], F.lit(r"\b(\d{1,4})\b"), F.lit(1)), lambda n: n.cast("int").between(1, 9999)), lambda n: F.concat(p["t"].cast("int").cast("string"), F.lit("-"), n.cast("int").cast("string"))
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(pairs)))


# Words left out of a title's keywords, and words that announce the reversal of a rule.
STOPWORDS = "a an and the of for in on at to from is are was were be been being by with as or that this it its their our rule rules proposed final act".split()
REVERSALS = (
    "repeal repeals repealed repealing rescind rescinds rescinded rescinding rescission withdraw withdraws withdrawn withdrawing withdrawal recodify recodifies recodified recodifying "
    "recodification supersede supersedes superseded superseding reconsider reconsiders reconsidered reconsidering reconsideration vacate vacates vacated vacating vacatur"
).split()


def title_keywords(title: Column) -> Column:
    """Distinct lower-case words of four letters or more that are no stopwords, sorted; empty for null."""
    words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS))))


def reversal_word(text: Column) -> Column:
    """Whether a word of reversal stands anywhere in the text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(REVERSALS))


def refers_to(docket_id: Column, document_number: Column, title: Column, text: Column, least: int = 3) -> Column:
    """Why a text refers to a docket: `docket`, `number` or `words` (a word of reversal and shared keywords); null where it doesn't."""
    shared = F.size(F.array_intersect(title_keywords(title), title_keywords(text)))
    number = F.coalesce(F.trim(document_number), F.lit(""))
    return (
        F.when((F.coalesce(docket_id, F.lit("")) != "") & F.contains(text, docket_id), "docket")
        .when((number != "") & F.contains(text, document_number), "number")
        .when(reversal_word(text) & (shared >= least), "words")
    )


def register_year(citation: Column, number: Column, posted: Column) -> Column:
    """Year of publication: by the volume of a citation (59 to 200, 1935 + volume), else by the document number's prefix, else the year posted."""
    v = F.regexp_extract(F.coalesce(citation, F.lit("")), r"\b(\d{2,3})\s+FR\b", 1)
    by_volume = F.when(v != "", F.when(v.cast("int").between(59, 200), v.cast("int") + 1935))
    four = F.regexp_extract(F.coalesce(number, F.lit("")), r"^(20\d{2})-", 1)
    two = F.regexp_extract(F.coalesce(number, F.lit("")), r"^(\d{2})-", 1)
    by_number = F.when(four != "", four.cast("int")).when(two != "", F.when(two.cast("int") >= 80, two.cast("int") + 1900).otherwise(two.cast("int") + 2000))
    return F.coalesce(by_volume, by_number, F.year(posted))


#: Ranges of years, first and last inclusive.
YEAR_CLUSTERS = (("2010-2012", 2010, 2012), ("2013-2015", 2013, 2015), ("2016-2018", 2016, 2018), ("2019-2022", 2019, 2022))
#: First days of administrations, ISO dates.
ADMINISTRATIONS = (("Obama", "2017-01-20"), ("Trump", "2021-01-20"), ("Biden", None))


def year_cluster(year: Column, clusters=YEAR_CLUSTERS) -> Column:
    """The range a year lies in; `no-proposed-rule` for null, `out-of-window` outside all."""
    out = F.when(year.isNull(), "no-proposed-rule")
    for name, low, high in clusters:
        out = out.when(year.between(low, high), name)
    return out.otherwise("out-of-window")


def administration(day: Column) -> Column:
    """Whose term a date falls in; null for null."""
    out = F.when(day.isNull(), None)
    for name, until in ADMINISTRATIONS[:-1]:
        out = out.when(day.cast("date") < F.lit(until).cast("date"), name)
    return out.otherwise(ADMINISTRATIONS[-1][0])


def program_office(docket_id: Column, known: list[str]) -> Column:
    """The office in a docket id such as AGENCY-HQ-OFFICE-year-number or AGENCY-Rnn-OFFICE-year-number; OTHER where unknown."""
    p = F.split(docket_id, "-")
    office = F.when(F.size(p) < 3, None).when(F.get(p, F.lit(1)) == "HQ", F.when(F.size(p) >= 4, F.get(p, F.lit(2)))).otherwise(F.concat_ws("-", F.get(p, F.lit(1)), F.get(p, F.lit(2))))
    return F.when(office.isin(known), office).otherwise("OTHER")


def docket_year(docket_id: Column) -> Column:
    """The first part of a docket id that is a year from 1990 to 2030."""
    years = F.filter(F.split(docket_id, "-"), lambda p: p.rlike(r"^\d{4}$") & F.coalesce(F.try_to_number(p, F.lit("9999")), F.lit(0)).between(1990, 2030))
    return F.get(years, F.lit(0)).cast("int")


def obligation_id(docket_id: Column, rule_type: Column, candidate: Column, split: Column) -> Column:
    """docket__rule__candidate_split; null where any part is."""
    return F.concat(docket_id, F.lit("__"), rule_type, F.lit("__"), candidate.cast("string"), F.lit("_"), split.cast("string"))


def docket_of_obligation(obligation: Column) -> Column:
    """The docket in an obligation id; null where the id has another shape."""
    d = F.regexp_extract(obligation, r"^(.+?)__(?:proposed|final)__", 1)
    return F.when(d != "", d)


def docket_of_comment(comment_id: Column) -> Column:
    """Everything before the last dash."""
    d = F.regexp_extract(comment_id, "^(.*)-[^-]*$", 1)
    return F.when(d != "", d)


def section_base(section: Column) -> Column:
    """part.section without paragraphs; the trimmed text where it has another shape; empty for null."""
    s = F.trim(F.coalesce(section, F.lit("")))
    base = F.regexp_extract(s, r"^(\d+\.\d+[A-Za-z]?)", 1)
    return F.when(base != "", base).otherwise(s)


def section_plain(section: Column) -> Column:
    """Trimmed and lower case; empty for null."""
    return F.lower(F.trim(F.coalesce(section, F.lit(""))))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of `size` words; a shorter text is one shingle, an empty one has none."""
    # the words are bound to a lambda variable, since an expression inside the inner one would be computed for every shingle
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " ")))
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>"))))


ELISION = "\n[...middle elided for length...]\n"


def elided(text: Column, head: int = 1200, tail: int = 200, trigger: int | None = None) -> Column:
    """Texts beyond the trigger (head + tail + 100) keep head and tail around a marker; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > (head + tail + 100 if trigger is None else trigger), F.concat(F.left(t, F.lit(head)), F.lit(ELISION), F.right(t, F.lit(tail)))).otherwise(t)


#: The character references that are resolved.
REFERENCES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def without_tags(html: Column) -> Column:
    """Text of HTML: tags become blanks, five references are resolved, white space is squeezed."""
    t = F.regexp_replace(html, "<[^>]+>", " ")
    for name, character in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(character))
    return squeezed(t)


def found_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))))


#: Characters of a document's beginning that count as its preamble.
PREAMBLE = 5000
CITATION, RIN = r"\b\d{2,3}\s+FR\s+\d{1,6}\b", r"\bRIN\s+\d{4}-[A-Z]{2}\d{1,3}\b"
LONG_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b"


def preamble_marks(text: Column) -> dict[str, Column]:
    """Citations, RINs and dates in the preamble of a document."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(PREAMBLE))
    return {"citations": found_all(head, CITATION), "rins": found_all(head, RIN), "dates": found_all(head, LONG_DATE)}


def safe_file_name(name: Column) -> Column:
    """Anything but letters, digits, dot, dash and underline becomes an underline."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def extraction_quality(text: Column, least: int = 500, most: float = 0.2) -> Column:
    """short, garbled (too many characters beyond ASCII) or ok; null texts are short."""
    t = F.coalesce(text, F.lit(""))
    beyond = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return F.when(F.length(t) < least, "short").when(beyond / F.greatest(F.length(t), F.lit(1)) > most, "garbled").otherwise("ok")


def word_overlap(a: Column, b: Column) -> dict[str, Column]:
    """precision, recall and f1 of the distinct words of b against those of a; both empty give 1, one empty 0."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both, none = F.size(F.array_intersect(x, y)), (F.size(x) == 0) & (F.size(y) == 0)
    p, r = F.coalesce(F.try_divide(both, F.size(y)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(x)), F.lit(0.0))
    whole = lambda v: F.when(none, 1.0).otherwise(v)
    return {"precision": whole(p), "recall": whole(r), "f1": whole(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))}


BINDING = r"(?i)For\s+the\s+reasons\s+(?:set\s+forth|stated)\s+in\s+the\s+preamble"


def binding_start(text: Column, share: float = 0.6) -> Column:
    """Characters before the binding part: up to its marker, else that share of the text."""
    at = F.regexp_instr(text, F.lit(BINDING))
    return F.when(at > 0, at - 1).otherwise(F.floor(F.length(text) * share)).cast("int")


# Words by which a sentence binds or permits.
STRONG = r"(?i)\b(?:must(?:\s+not)?|shall(?:\s+not)?|may\s+not|(?:is|are)\s+required\s+to|(?:is|are)\s+prohibited\s+from|no\s+(?:person|operator|owner|entity|facility)\s+(?:shall|may))\b"
PERMISSIVE = r"(?i)\b(?:may|(?:is|are)\s+permitted\s+to|(?:is|are)\s+authorized\s+to)\b"


def modal(sentence: Column) -> Column:
    """The binding word of a sentence in lower case, a strong one before a permissive one; null without any."""
    s, p = F.regexp_extract(sentence, STRONG, 0), F.regexp_extract(sentence, PERMISSIVE, 0)
    return F.when(s != "", F.lower(s)).when(p != "", F.lower(p))


def modal_strength(sentence: Column) -> Column:
    """strong, permissive or null."""
    return F.when(sentence.rlike(STRONG), "strong").when(sentence.rlike(PERMISSIVE), "permissive")


def condition(sentence: Column) -> Column:
    """The conditional part of a sentence: one that leads it, one in its middle, or `subject to` unless a citation follows; null without any."""
    leading = F.regexp_extract(sentence, r"(?i)^(\s*(?:If|When|Upon|Where|Whenever)\b[^.]+?),", 1)
    middle = F.regexp_extract(sentence, r"(?is)(,\s*(?:provided\s+that|unless|except\s+as|if\s+applicable)\b.*)$", 1)
    subject = F.regexp_extract(sentence, r"(?is)(,\s*subject\s+to\b.*)$", 1)
    cited = F.left(subject, F.lit(50)).rlike(r"(?i)\bsubject\s+to\s+(?:§|paragraph|section)")
    clean = lambda c: F.regexp_replace(c, r"^[, ]+|[, ]+$", "")
    return F.when(leading != "", F.trim(leading)).when(middle != "", clean(middle)).when((subject != "") & ~cited, clean(subject))


def heading_like(sentence: Column) -> Column:
    """Headings, authority lines and part headers, which state no duty; never null."""
    s = stripped(F.coalesce(sentence, F.lit("")))
    capitals = (F.upper(s) == s) & (F.lower(s) != s)
    short_section = s.rlike(r"^§\s*\d") & (F.length(s) < 80) & ~s.rlike(STRONG)
    return short_section | (capitals & (F.length(s) < 100)) | F.lower(s).startswith("authority:") | s.rlike(r"^(?:PART|Part)\s+\d")


def around(text: Column, start: Column, end: Column, margin: int = 600) -> Column:
    """The text from margin characters before start to margin after end (offsets from 0)."""
    first = F.greatest(start - margin, F.lit(0))
    return F.substring(text, first + 1, F.least(end + margin, F.length(text)) - first)


def joined_obligation(subject: Column, modal_word: Column, action: Column, obj: Column, text: Column) -> Column:
    """What is embedded of an obligation: its parts on a line, blanks skipped, then its text."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat(F.concat_ws(" ", part(subject), part(modal_word), part(action), part(obj)), F.lit("\n"), F.coalesce(text, F.lit("")))


def tolerant_bool(text: Column) -> Column:
    """True and false as people spell them; null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "y", "t"), True).when(t.isin("false", "0", "no", "n", "f"), False)


#: Stances of a comment.
STANCES = ["SUPPORTING", "OPPOSING", "SUGGESTING_MODIFICATION", "NONE"]


def stance(text: Column) -> Column:
    """The stance in capitals; null for anything that is none."""
    t = F.upper(F.trim(text))
    return F.when(t.isin(STANCES), t)


def loose_label(text: Column, labels: list[str]) -> Column:
    """The label spelled like the text but for case, blanks and the joining character; null for anything else."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in labels:
        out = out.when(bare == "".join(c for c in name.lower() if c.isalnum()), name)
    return out


def tertile(value: Column, low: Column, high: Column, names=("low", "mid", "high")) -> Column:
    """Below low, below high, else the top."""
    return F.when(value < low, names[0]).when(value < high, names[1]).otherwise(names[2])


def filled(template: str, **columns: Column) -> Column:
    """A template with {name} places filled from columns; null counts as empty."""
    out, rest = [], template
    for name in sorted(columns, key=lambda n: template.find("{" + n + "}")):
        before, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(before), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))
