"""Obligations in rule texts: candidate sentences with their place, and the removal of those found twice."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.functions import numbers, text
from rulewake.session import prepare

#: Characters behind a kept marker in which another one is ignored.
QUIET = 200
# Phrases that announce an amendment, with its kind.
_P = r"\([a-z0-9ivx]+\)"  # a paragraph's label
AMENDMENTS = [
    (r"is\s+revised\s+to\s+read\s+as\s+follows", "revise"),
    (r"is\s+amended\s+to\s+read\s+as\s+follows", "revise"),
    (r"is\s+added\s+to\s+read\s+as\s+follows", "add"),
    (rf"is\s+amended\s+by\s+adding\s+(?:paragraph|subparagraph|section)\s*{_P}\s+to\s+read\s+as\s+follows", "add"),
    (rf"is\s+amended\s+by\s+adding\s+(?:paragraphs?|subparagraphs?|sections?)\s*{_P}(?:\s*(?:through|to|and|,)\s*{_P})*\s+to\s+read\s+as\s+follows", "add"),
    (r"is\s+amended\s+by\s+adding\s+the\s+following", "add"),
    (rf"is\s+amended\s+by\s+revising\s+paragraph\s*{_P}\s+to\s+read\s+as\s+follows", "revise"),
    (r"is\s+amended\s+by\s+(?:adding|revising|removing|redesignating)", "revise"),
    (r"is\s+amended\s+by\s*:", "revise"),
    (rf"paragraph\s*{_P}\s+is\s+removed", "remove"),
    (r"is\s+removed\s+and\s+reserved", "remove"),
    (r"is\s+removed", "remove"),
    (r"is\s+redesignated\s+as", "redesignate"),
    (r"is\s+replaced\s+by", "replace"),
    (r"the\s+heading\s+is\s+revised\s+to\s+read\s+as\s+follows", "revise"),
]
PART_HEADER = r"^\s*(?:PART|Part)\s+(\d{1,3})\s*[—–-]"
AMENDED_SECTION = rf"Section\s+(\d{{1,3}}\.\d{{1,4}}(?:{_P})*)\s+is\s+(?:amended|revised|added|removed|redesignated|replaced)"
SECTION_HEADING = rf"Sec\.\s+(\d{{1,3}}\.\d{{1,4}}(?:{_P})*)\s+"
_amendments = [(re.compile(p, re.IGNORECASE), kind) for p, kind in AMENDMENTS]
_part = re.compile(PART_HEADER, re.MULTILINE)
_section = re.compile(AMENDED_SECTION, re.IGNORECASE)
_heading = re.compile(SECTION_HEADING, re.IGNORECASE)
_sentence = re.compile(r"[^.!?\n]+(?:\.(?=\S)[^.!?\n]*)*[.!?]?", re.UNICODE)
#: Fixed value: share of the shorter span from which two findings are the same.
OVERLAP = 0.80


def blocks(binding: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the parts of a text between amendment phrases; the longest phrase at a place counts, then silence for QUIET characters.

    A text without such a phrase, and what stands before the first one, is of kind none.
    """
    longest: dict[int, tuple[int, str]] = {}
    for pattern, kind in _amendments:
        for m in pattern.finditer(binding):
            if m.end() > longest.get(m.start(), (-1, ""))[0]:
                longest[m.start()] = (m.end(), kind)
    bounds, heard = ([(0, "none")] if 0 not in longest else []), 0
    for start in sorted(longest):
        if start >= heard:
            end, kind = longest[start]
            bounds.append((start, kind))
            heard = end + QUIET
    return [(start, until, kind) for (start, kind), (until, _) in zip(bounds, bounds[1:] + [(len(binding), "")])]


def _last(found: list[tuple[int, str]], offset: int) -> str | None:
    i = bisect.bisect_right(found, (offset, "￿")) - 1
    return found[i][1] if i >= 0 else None


def located(document: str) -> list[tuple]:
    """(start, end, kind, part, section, sentence) of every sentence of the binding part, with the last part header and section before it."""
    m = re.search(text.BINDING, document)
    begin = m.start() if m else int(0.6 * len(document))
    ends_before = lambda pattern: [(x.end(), x[1]) for x in pattern.finditer(document)]
    parts, sections, headings = ends_before(_part), ends_before(_section), ends_before(_heading)
    out = []
    for start, end, kind in blocks(document[begin:]):
        for s in _sentence.finditer(document, begin + start, begin + end):
            sentence = s[0].strip()
            if sentence:
                at = s.start() + len(s[0]) - len(s[0].lstrip())
                out.append((at, at + len(sentence), kind, _last(parts, at), _last(sections, at) or _last(headings, at), sentence))
    return out


def candidates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per sentence that binds or permits: its id's document, number, place, section, kind of amendment, modal and condition.

    Sentences and offsets come from one map over whole texts; everything about a sentence is a column expression. Headings
    are left out; null texts have none. Who has to do what is left to an injected parser, see labels.py.
    """
    prepare(documents.sparkSession)
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, *r) for d, t in zip(b["doc_id"], b["text"]) for i, r in enumerate(located(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_idx", "char_offset_start", "char_offset_end", "amendatory_action", "cfr_part", "cfr_section", "obligation_text"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInPandas(run, f"doc_id {kind}, sentence_idx int, char_offset_start int, char_offset_end int, amendatory_action string, cfr_part string, cfr_section string, obligation_text string")
    s = F.col("obligation_text")
    return found.filter(text.modal_strength(s).isNotNull() & ~text.heading_like(s)).select(
        "*", text.modal(s).alias("modal"), text.modal_strength(s).alias("modal_strength"), text.condition(s).isNotNull().alias("is_conditional"), text.condition(s).alias("condition_text")
    )


def without_repeats(rows: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Rows without those of the second pass that overlap one of the first in the same document and section by more than the threshold.

    rows: doc_id, row_id, found_via (primary or safety_net), cfr_section, start, end. A row without a place is kept.
    """
    second = rows.filter(F.col("found_via") == "safety_net").select("doc_id", "row_id", text.section_base(F.col("cfr_section")).alias("base"), F.col("start").alias("s"), F.col("end").alias("e")).filter("s IS NOT NULL AND e IS NOT NULL")
    first = rows.filter(F.col("found_via") == "primary").select("doc_id", text.section_base(F.col("cfr_section")).alias("base"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    repeated = second.join(first, ["doc_id", "base"]).filter(numbers.interval_overlap(F.col("s"), F.col("e"), F.col("ps"), F.col("pe")) > threshold).select("doc_id", "row_id").distinct()
    return rows.join(repeated, ["doc_id", "row_id"], "left_anti")


_gap = re.compile(r"(?:\s|\[\[Page \d+\]\])+")
_labels = re.compile(r"^\s*(?:\([A-Za-z0-9]+\)\s*){1,3}")
#: Characters of the beginnings by which a text is looked for.
BEGINNINGS = (100, 60)
#: Obligations that share one copy of their document.
TOGETHER = 500


class Document:
    """A text in which other texts are found, white space and page marks aside."""

    def __init__(self, body: str):
        self.body = body
        pieces, self.flat_starts, self.body_starts = [], [], []
        at = flat = 0
        for m in _gap.finditer(body):
            for piece, start in ((body[at : m.start()], at), (" ", m.start())):
                if piece:
                    pieces.append(piece)
                    self.flat_starts.append(flat)
                    self.body_starts.append(start)
                    flat += len(piece)
            at = m.end()
        pieces.append(body[at:])
        self.flat_starts.append(flat)
        self.body_starts.append(at)
        self.flat = "".join(pieces)

    def place(self, i: int) -> int:
        """Where a character of the flat text stands in the body; a gap stands where it begins."""
        k = bisect.bisect_right(self.flat_starts, i) - 1
        return self.body_starts[k] + i - self.flat_starts[k]

    def find(self, wanted: str) -> tuple[int, int] | None:
        """Offsets of what of a text is found first: all of it, its first 100 or 60 characters, all but its leading labels, or the first 60 characters of that.

        The first three are looked for as they are, and then, like the others, with white space made one blank. The end is
        that of what was found, not of the whole text.
        """
        bare = _labels.sub("", wanted, count=1)
        parts = [(wanted, True), *((wanted[:n], True) for n in BEGINNINGS)] + ([(bare, False), (bare[: BEGINNINGS[-1]], False)] if bare != wanted else [])
        seen: set[tuple[str, bool]] = set()
        for part, exact in parts:
            if not part or (part, exact) in seen:
                continue
            seen.add((part, exact))
            if exact and (i := self.body.find(part)) >= 0:
                return i, i + len(part)
            flat = " ".join(part.split())
            if flat and (i := self.flat.find(flat)) >= 0:
                return self.place(i), self.place(i + len(flat) - 1) + 1
        return None


def find(document: str, wanted: str) -> tuple[int, int] | None:
    return Document(document).find(wanted)


def with_places(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds start and end of each obligation_text in its document, null where it is not found or the document is missing. rows and documents share doc_id.

    A document travels once for at most about TOGETHER of its obligations, and its index is built once for them; a document
    with very many is spread over as many groups. Rows are told apart by their text, so repeated texts are looked for once.
    """
    prepare(rows.sparkSession)
    wanted = rows.select("doc_id", "obligation_text").dropna().distinct()
    sizes = wanted.groupBy("doc_id").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
    grouped = wanted.join(sizes, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("obligation_text"), F.col("groups")).alias("part")).agg(F.collect_list("obligation_text").alias("texts"))
    met = grouped.join(documents.select("doc_id", F.col("text").alias("document")).filter("document IS NOT NULL"), "doc_id").select("doc_id", "texts", "document")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, texts, body in zip(b["doc_id"], b["texts"], b["document"]):
                own = Document(body)
                found = [(key, t, *p) for t in texts if (p := own.find(t))]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "obligation_text", "start", "end"])

    placed = met.mapInPandas(run, f"doc_id {kind}, obligation_text string, start int, end int")
    return rows.join(placed, ["doc_id", "obligation_text"], "left").select(*rows.columns, "start", "end")


def similarity(a: str, b: str) -> float:
    """2 * longest common subsequence over both lengths: the share of characters kept by insertions and deletions alone; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:  # one machine word per character of the shorter text
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    common = len(b) - bin(v).count("1")
    return 2 * common / (len(a) + len(b))


def char_similarity(df: DataFrame, a: str, b: str, name: str = "char_similarity") -> DataFrame:
    """Adds similarity() of two columns; null counts as empty."""
    prepare(df.sparkSession)

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p or "", q or "") for p, q in zip(x, y)])

    return df.withColumn(name, of(a, b))
