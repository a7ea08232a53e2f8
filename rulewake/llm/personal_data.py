"""Personal data in free text: e-mail addresses, phone numbers, identity numbers, street addresses and names.

Generators with high recall propose overlapping spans by shape and cue: runs of capitalised words, words behind cues, titles,
initials, known given names and in signatures; any run of digits, digit words, or letters with digits; a number before words. Each
span gets features of its format, of the words around it and of how common its words are in lower case in the corpus, which
boosted trees, trained on labelled sentences made for the purpose, turn into a probability. Thresholds per kind, calibrated on
sentences held out, select the spans that are replaced by typed placeholders.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.llm import boosting
from rulewake.llm.name_variants import NICKNAMES
from rulewake.session import prepare

KINDS = ("email", "phone", "id_number", "address", "name")
#: Sentences on which the trees are trained, of which every fourth is held out for the thresholds; trees and their depth.
SENTENCES, TREES, DEPTH = 8000, 90, 4
#: Shares of texts that have a word in lower case from which on it is of level 1, 2, 3; a name seldom is of any.
LEVELS = (1 / 2000, 1 / 300, 1 / 30)
#: Characters before and after a span whose words are features.
BEFORE, AFTER = 48, 24

# Words that stand before, in or behind personal data, and words that stand before numbers and names that are none.
CUES = {
    "phone": "call phone telephone tel fax number reach reached message cell mobile dial ring text voicemail evenings ext whatsapp teléfono téléphone",
    "id": "ssn social security soc sec driver drivers license licence passport medicare medicaid taxpayer tax ein veterans veteran claim benefit identity id itin alien pasaporte",
    "email": "email e-mail mail online response write reach contact send best questions address",
    "address": "live lives home mail property residence house own reside resides notice address located street lot parcel neighbors moved apartment",
    "name": "name named neighbor neighbour doctor sincerely signed regards submitted yours respectfully truly dr mr mrs ms prof rev son daughter wife husband brother sister friend am i by thanks you mother father nurse teacher colleague uncle aunt cousin boss owner farmer",
    "verb": "said says told wrote asked testified explained thinks knows died reported claims who met thank with spoke agree from",
    "public": "section sections cfr fr cas permit rin docket naics industry code route table article sección rule no nos page chapter part see listed unit table",
    "place": "são santa saint camp fort lake mount port county city town precinct ward district near outside in at village san new north south east west river valley creek park island bay hills region state street",
    "body": "act agency association board bureau center coalition college commission committee company corporation council court department district foundation group hospital inc institute league llc office plan program project register report school service society standard system union university rule order",
}
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "rev", "señor", "señora", "mme")
STREETS = "street st avenue ave road rd lane ln drive dr court ct boulevard blvd turnpike tpke pike way place pl circle cir terrace ter trail trl highway hwy parkway pkwy square sq loop alley row"
#: Words that end a street's name, but are common otherwise too: only in capitals.
MORE_STREETS = "crescent close gardens grove hill mews path run ridge view walk quay plaza parade green rise glen bend"
#: Kinds of streets that stand before the name.
STREETS_FIRST = "calle rue avenida avenue av via rua chemin impasse carrer plaza paseo camino boulevard"
DIGIT_WORDS = "zero oh one two three four five six seven eight nine"
PARTICLES = "de del der den van von da di la le bin ibn al el ter zu dos du y e"
#: Function words and openings that are no part of a name, though capitals may stand before one.
NO_NAMES = "hello greetings the a an and or of to in on at for from by with as but if when while since this that these those my our your his her their its we i you he she they it is are was were be been not no yes dear sincerely regards respectfully signed submitted thank thanks yours truly please how why what where who which la el los las un una le les des et en se que por para con su lo mi"

_sets = {k: frozenset(v.split()) for k, v in CUES.items()}
_dash = "[-‐‑–—]"
_dots = r"(?:\.|\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?|\s+dot\s+|\s\.\s)"
_spelled_dots = r"(?:\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?|\s+dot\s+)"
_email = re.compile(
    rf"[\w.+-]{{2,64}}(?:\s?(?:@|＠|\[\s?at\s?\]|\(\s?at\s?\))\s?[a-z0-9-]{{2,40}}(?:{_dots}[a-z]{{2,20}}){{1,4}}|\s+at\s+[a-z0-9-]{{2,40}}(?:{_spelled_dots}[a-z]{{2,20}}){{1,4}})", re.IGNORECASE
)
#: Patterns begin with a set of characters, so that most places are passed over by one look; what may stand before them is looked at afterwards.
_digits = re.compile(
    rf"[\d(+](?:(?<=\+)1[\s./]?{_dash}?\s?\(?\d{{3}}|(?<=1)[\s./]?{_dash}?\s?\(?\d{{3}}|(?<=\()\d{{3}}|(?<=\d)\d\d)\)?[\s./]?{_dash}?\s?\d{{3}}(?:[\s./]|{_dash})?\s?\d{{4}}\b(?:\s*(?:ext|x|EXT|X)\.?\s*\d{{1,5}})?"
    rf"|\d\d\d(?:\s|[./]|{_dash})\s?\d{{4}}\b(?!{_dash}\d)"
    rf"|\d\d\d(?:\s{{0,2}}|{_dash}|\.)\d{{2}}(?:\s{{0,2}}|{_dash}|\.)\d{{4}}\b"
    rf"|\d\d(?:{_dash}|\s)?\d{{7}}\b"
)
#: A decimal right behind the word or sign for a section is a citation.
_decimal = re.compile(r"\d{3}\.\d{4}").fullmatch
_cited = re.compile(r"(?:§|section|sections|cfr|sección|article)\s*$", re.IGNORECASE)
_digit_word = r"\b(?:" + "|".join(DIGIT_WORDS.split()) + r")\b"
_spelled = re.compile(rf"{_digit_word}(?:[\s,.-]*{_digit_word}){{6,11}}", re.IGNORECASE)
_between = re.compile(r"[\s,.-]*").fullmatch
_street = re.compile(r"\d{1,5}\s+(?:(?:n|s|e|w|north|south|east|west)\b\.?\s+)?(?:[^\W\d_]+\s+){1,3}?(?:" + "|".join(STREETS.split()) + r")\b\.?", re.IGNORECASE)
_box = re.compile(r"\b(?:p\.?\s{0,2}o\.?|post\s+office)\s+box\s+\d{1,6}\b|\bbox\s+\d{2,6}\b", re.IGNORECASE)
#: Any run of groups of digits, as phones of all countries are written.
_run = re.compile(rf"[+(\d](?<=[\d+(])(?=[(\s]{{0,2}}(?:\d?[^\w\n]{{0,3}}){{1}}(?:\d[^\w\n]{{0,3}}){{5}}\d)[\s(]{{0,2}}\d{{0,12}}\)?(?:(?:\s{{0,2}}[./]?(?:{_dash})?\s?|\s?\()\d{{1,5}}\)?){{0,7}}(?![\w%])")
#: Letters and digits in one token, perhaps with blanks or dashes between its groups, in capitals; looked for from a digit on.
_mixed = re.compile(rf"(?:[A-Z]{{1,2}}(?:{_dash}|\s{{0,2}})\d\d|[A-Z]{{3,4}}-?\d{{3,}}|\d{{1,3}}[A-Z]{{1,3}}\d)[\dA-Z]*(?:(?:{_dash}|\s{{1,2}})[\dA-Z]*\d[\dA-Z]*){{0,4}}").fullmatch
_from_digit = re.compile(rf"\d[\dA-Za-z]*(?:(?:{_dash}|\s{{1,2}})[\dA-Za-z]*\d[\dA-Za-z]*){{0,4}}(?![\w-])")
_capital = "[A-Z\u00c0-\u00de\u0100-\u017f\u0386-\u03ab\u0400-\u042f]"
_part = r"(?:[^\W\d_]|&#\d{2,5};|[\u0080-\u00bf\u02c6-\u0303\u20ac\u2122\u0192\u2018-\u201e\u2020-\u2022\u2030\u2039\u203a\ufffd](?=[^\W\d_]|&#|[\u0080-\u00bf]))"
_name_word = rf"{_capital}(?!(?<=[\u00c2\u00c3\u00c5])(?:\W|[\u00aa\u00ba\u0152-\u0192]))(?:['’]?[^\W\d_])(?:{_part})*(?:['’-]{_capital}(?:{_part})*)?"
_names = re.compile(rf"{_name_word}(?:\s+{_capital}\.)*(?:\s+(?:{'|'.join(PARTICLES.split())})\b){{0,2}}(?:\s+(?:{_capital}\.\s+)?{_name_word})+(?![\w@])")
_house = re.compile(rf"\d{{1,5}}[A-Za-z]?(?:-\d{{1,4}})?[ \t]+(?:{_name_word}\.?[ \t]+){{1,3}}{_name_word}\b")
_house_last = re.compile(rf"\b(?:{'|'.join(STREETS_FIRST.split())})\.?\s+(?:[^\W\d_]+\s+){{0,4}}[^\W\d_]+,?\s+(?:n[oº]?\.?\s*)?\d{{1,5}}\b|\b\d{{1,5}},?\s+(?:bis\s+)?(?:rue|calle|avenida|chemin|via|rua|impasse)\s+(?:[^\W\d_]+[\s’']+){{0,3}}[^\W\d_]+", re.IGNORECASE)
#: Words behind which a name may stand in any case.
_cued = re.compile(r"(?:name(?:\s+is|\s*[:=])|(?:signed|submitted|written|comment)\s*(?:by\b|:)|i\s+am|i['’]m|this\s+is|i,|neighbou?r,?|doctor,?|nurse,?|teacher,?|husband,?|wife,?|son,?|daughter,?|friend,?|brother,?|sister,?|colleague,?|me llamo|m['’]appelle|soy|sincerely,?|regards,?|submitted,?|truly,?|yours,?|signed,?|thanks,?|you[.,])[\s—–-]*([^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+(?:\s+[^\W\d_]\.?)?\s+[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*)").match
_signature = re.compile(r"^[\s—–-]*((?:[^\W\d_][^\W\d_'’.-]*\.?\s+){1,3}[^\W\d_][\w'’-]*?)[\s.,]*$")
_closing = re.compile(r"(?:sincerely|regards|respectfully|signed|yours|truly|thank|thanks|atentamente|cordialement|saludos)[^\n]{0,24}\n\s*([^\n]{3,48})", re.IGNORECASE).match
_after_given = re.compile(r"(?:\s+[^\W\d_]\.?)?\s+([^\W\d_]{2,}(?:['’-][^\W\d_]+)?)")
_after_title = re.compile(r"\.?\s+(?:[^\W\d_]\.\s*)?([^\W\d_]{2,}(?:['’-][^\W\d_]+)?)(\s+[^\W\d_]{2,})?")
_initial = re.compile(r"[A-Za-z]\.\s?(?:[A-Za-z]\.\s?)?([^\W\d_]{2,}(?:['’-][^\W\d_]+)?)")
_reversed_name = re.compile(rf"[\n:(][ \t]*({_name_word}),[ \t]+({_name_word})\b(?!\s+{_capital})")
_begun, _begun_upper = re.compile(r"\b[A-Za-z]").findall, re.compile(r"\b[A-Z]").findall
_UPPER, _LOWER, _swapped = bytes(range(65, 91)), bytes(range(97, 123)), re.compile(r"\b[a-z][A-Z]{2,}").findall
_words = re.compile(r"[^\W\d_]+").findall
_stop = re.compile(r"(?<=[^\W\d_]{4})[.!?]\s|(?<=\d)[.!?]\s|\n")


def _given() -> set[str]:
    plain = str.maketrans("éëèêáíóúñ", "eeeeaioun")
    names = {w for full, short in NICKNAMES.items() for w in (full, *short.split())}
    return {x for n in names for x in (n, n.translate(plain))}


GIVEN = frozenset(_given())
#: Accented names whose accent may be garbled.
_garbled = re.compile(r"(?:andr|jos|ren|zo)(?:[^\x00-\x7f]|&#\d+;){1,12}e?", re.IGNORECASE)


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in GIVEN | {"zoë", "zoe"}:
        out.add_word(w, ("given", w))
    for w in TITLES:
        out.add_word(w, ("title", w))
    for w in ("@", "＠", "[at", "(at", " at ", "] at", "[ at", "( at"):
        out.add_word(w, ("at", w))
    out.add_word("box", ("box", "box"))
    for w in ("name", "signed", "submitted", "written", "comment by", "i am ", "i’m ", "i'm ", "this is ", "i, ", "neighbor", "neighbour", "doctor", "nurse", "teacher", "husband", "wife", "son", "daughter", "friend", "brother", "sister", "colleague", "me llamo", "m'appelle", "m’appelle", "soy ", "thanks", "you.", "you,"):
        out.add_word(w, ("cue", w))
    for w in ("sincerely", "regards", "respectfully", "truly", "yours", "thank", "atentamente", "cordialement", "saludos"):
        out.add_word(w, ("closing", w))
    for w in STREETS_FIRST.split():
        out.add_word(f"{w} ", ("street", w))
    for w in DIGIT_WORDS.split():
        out.add_word(w, ("digit", w))
    for w in ("andr", "jos", "ren", "zo"):
        if w not in GIVEN:
            out.add_word(w, ("garbled", w))
    out.make_automaton()
    return out


def cased(text: str) -> str | None:
    """The text in a case that tells names from other words, exchanged where it was typed so; None where case tells nothing."""
    raw = text.encode(errors="replace")
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    if upper > lower:
        if len(_swapped(text)) * 24 < upper:
            return None
        other = text.swapcase()
        return other if len(other) == len(text) else None
    if upper * 12 > lower and upper > 8 and len(_begun_upper(text)) > len(_begun(text)) / 2:
        return None
    return text if upper * 150 > lower else None


@dataclass
class Words:
    """How common words are in lower case: 0 hardly met, 3 in many texts."""

    level: dict[str, int]

    def of(self, word: str) -> int:
        return self.level.get(word, 0)


def mixed(text: str) -> Iterator[tuple[int, int]]:
    """Spans of letters and digits that may be a number of a document."""
    for m in _from_digit.finditer(text):
        begin = stop = m.start()
        while stop and text[stop - 1] in " -–—‐‑" and begin - stop < 2:
            stop -= 1
        start = stop
        while start and stop - start < 4 and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        for first in {begin, start} if start < stop and not (start and text[start - 1].isalnum()) else {begin}:
            if _mixed(text[first : m.end()].upper()):
                yield first, m.end()


def proposals(text: str, words: Words) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans that may be personal data, overlapping and with high recall."""
    out: dict[tuple[str, int, int], None] = {}
    level = words.level.get
    lower = text.lower()
    if len(lower) != len(text):  # some capitals have no lower case of one character
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    n = len(lower)
    shown = cased(text)

    def name(begin: int, end: int) -> None:
        out["name", begin, end] = None

    at, closed, box, street = [], [], False, False
    run, last, spelled = 0, 0, False  # digit words in a row, end of the last, whether seven stood in a row somewhere
    for end, (sort, w) in _automaton().iter(lower):
        begin = end + 1 - len(w)
        if sort == "at":
            at.append(begin)
        elif sort == "digit":
            if not spelled:
                run = run + 1 if run and begin > last and _between(lower, last, begin) else 1
                last, spelled = end + 1, run >= 7
        elif sort == "box":
            box = True
        elif sort == "street":
            street = True
        elif begin and lower[begin - 1].isalnum():
            continue
        elif sort == "given":
            # a given name that is a common word too needs a word behind it that is none
            if end + 1 < n and not lower[end + 1].isalpha() and (m := _after_given.match(lower, end + 1)) and m[1] not in _NO_NAMES and (level(m[1], 0) < 2 or level(w, 0) < 2 and level(m[1], 0) < 3):
                name(begin, m.end())
        elif sort == "title":
            if (m := _after_title.match(lower, end + 1)) and m[1] not in _NO_NAMES:
                more = m[2] and m[2].strip() not in _NO_NAMES and (level(m[2].strip(), 0) < 2 if shown is None else shown[m.start(2) : m.end(2)].strip()[0].isupper())
                name(begin, m.end() if more else m.end(1))
        elif sort == "cue" or sort == "closing":
            if sort == "closing" and (m := _closing(lower, begin)):
                closed.append((m.start(1), m[1]))
            if m := _cued(lower, begin):
                first, *_, second = m[1].split()
                if first.rstrip(".") not in _NO_NAMES and second not in _NO_NAMES and (level(first, 0) < 3 or level(second, 0) < 3):
                    name(m.start(1), m.end(1))
        elif sort == "garbled" and (g := _garbled.match(text, begin)) and (m := _after_given.match(lower, g.end())):
            name(begin, m.end())
    if shown is not None:
        for m in _names.finditer(shown):
            if m[0].isupper() or m.start() and (shown[m.start() - 1].isalnum() or shown[m.start() - 1] in "@.&-_"):
                continue
            parts = list(_token(m[0]))
            while len(parts) > 1 and (w := parts[0][0].lower()) and (w in _NO_NAMES or level(w, 0) == 3 and w not in GIVEN):
                parts.pop(0)
            if len(parts) > 1:
                own = [parts[:3]] if len(parts) < 4 else [parts[i : i + 2] for i in range(len(parts) - 1)]
                for x in own:
                    name(m.start() + x[0].start(), m.start() + x[-1].end())
        for m in _reversed_name.finditer("\n" + shown) if "," in text else ():
            if level(m[1].lower(), 0) < 2 and level(m[2].lower(), 0) < 2:
                name(m.start(1) - 1, m.end() - 1)
        for m in _house.finditer(shown):
            if not m.start() or not shown[m.start() - 1].isalnum() and shown[m.start() - 1] not in "._,$§-":
                out["address", m.start(), m.end()] = None
    bottom = text.rstrip()
    line = max(bottom.rfind("\n"), bottom.rfind("—"), bottom.rfind("–")) + 1
    for begin, found in [(line, bottom[line:]), *closed]:
        if len(found) < 48 and (m := _signature.match(found)) and m[1].split()[0].lower() not in _NO_NAMES and any(level(w, 0) < 2 for w in m[1].lower().split()):
            name(begin + m.start(1), begin + m.end(1))
    for m in _initial.finditer(text) if "." in text else ():
        if (not m.start() or text[m.start() - 1] in " \n\t\r(,:;\"“—–\xa0") and m[1].lower() not in _NO_NAMES and level(m[1].lower(), 0) < 3:
            name(m.start(), m.end())
    done = -1
    for a in at:
        stop = a
        while stop and text[stop - 1] in " \n[(" and a - stop < 3:
            stop -= 1
        begin = stop
        while begin and stop - begin < 64 and (text[begin - 1].isalnum() or text[begin - 1] in "._+-"):
            begin -= 1
        if stop - begin > 1 and begin > done and (m := _email.match(text, begin)):
            out["email", begin, m.end()] = None
            done = m.end()
    for m in (*(m.span() for m in _digits.finditer(text)), *(m.span() for m in _run.finditer(text) if sum(map(str.isdigit, m[0])) > 6), *mixed(text)):
        begin, end = m
        value = text[begin:end]
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.$€£-") or not 5 <= sum(map(str.isdigit, value)) < 16:
            continue
        if _decimal(value) and _cited.search(text, max(0, begin - 12), begin):
            continue
        out["phone", begin, end] = None
        out["id_number", begin, end] = None
    if spelled:
        out.update({("phone", m.start(), m.end()): None for m in _spelled.finditer(text)})
    for m in _street.finditer(text):
        if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            out["address", m.start(), m.end()] = None
    for m in _house_last.finditer(text) if street else ():
        out["address", m.start(), m.end()] = None
    if box:
        out.update({("address", m.start(), m.end()): None for m in _box.finditer(text)})
    return list(out)


def features(text: str, kind: str, start: int, end: int, words: Words) -> list[int]:
    """Bins of the format of a span and of the words around it."""
    span = text[start:end]
    left = text[max(0, start - BEFORE) : start]
    before = [w.lower() for w in _words(left)][-6:]
    right = text[end : end + AFTER]
    after = [w.lower() for w in _words(right)][:3]
    own = [w.lower() for w in _words(_stop.split(left)[-1])][-6:]
    inside = [w.lower() for w in _words(span)]
    groups = [len(d) for d in re.findall(r"\d+", span)]
    count = sum(groups)
    tail = left.rstrip()
    own_line = start == 0 or left[-1:] == "\n" or tail.endswith("\n") or tail[-1:] in "—–"
    ends_line = right[:1] in ("", "\n") or not right.strip() or right.strip(" .,")[:1] in ("", "\n")
    levels = [words.of(w) for w in inside] or [0]
    row = [KINDS.index(kind), min(15, len(span) // 2), min(15, count), min(7, len(groups))]
    row += [min(15, g) for g in (groups + [0] * 4)[:4]]
    row += [int(s in span) for s in (".", "/", "(", "+", "ext", " ", ":", "#")] + [int(any(c in span for c in "-‐‑–—"))]
    row += [int("@" in span or "＠" in span), int(bool(_at_word(span))), int(bool(_dot_word(span)))]
    row += [sum(c.isalpha() for c in span[:3]), min(7, len(inside)), sum(x >= 2 for x in levels[:4]), levels[0], levels[-1], max(levels), int(bool(inside) and inside[0] in GIVEN), int(bool(inside) and inside[0] in TITLES)]
    row += [int(span[:1].isupper()), int(own_line) + 2 * int(ends_line), int(tail[-1:] in ".!?") + 2 * int(tail[-1:] == ",") + 4 * int(tail[-1:] == ":") + 8 * int(not tail), int(right[:1] == "-") + 2 * int(left[-1:] in ("-", "§")) + 4 * int(right[:1] == ",")]
    row += [int(any(w in _sets["place"] for w in inside)), int(any(w in _sets["body"] for w in inside)), int(bool(inside) and inside[0] in _sets["public"]), int(bool(_single(span))), int(bool(after) and right.lstrip()[:1].isdigit() or bool(after) and _numbered(right) is not None)]
    marks = [_marks.get(w, 0) for w in before]
    own_marks, next_mark = [_marks.get(w, 0) for w in own], _marks.get(after[0], 0) if after else 0
    some = 0
    for x in marks:
        some |= x
    for k in range(len(_sets)):
        bit = 1 << k
        if some & bit:
            at = [bool(x & bit) for x in marks]
            row += [int(at[-1]), sum(at[-3:]), sum(bool(x & bit) for x in own_marks), at[::-1].index(True), int(bool(next_mark & bit))]
        else:
            row += [0, 0, 0, 7, int(bool(next_mark & bit))]
    row += [int("§" in left[-6:]), int(bool(_box_word(span))), int(bool(inside) and all(w in _DIGITS for w in inside) and not count), int(bool(inside) and inside[-1] in _STREETS), int(bool(inside) and any(w in _FIRST for w in inside[:2]))]
    return row


_at_word, _dot_word, _box_word = re.compile(r"[\[(]\s?at|\bat\b", re.IGNORECASE).search, re.compile(r"\bdot\b", re.IGNORECASE).search, re.compile(r"\bbox\b", re.IGNORECASE).search
_single, _numbered, _token = re.compile(r"(?:^|\s)[^\W\d_]\.").search, re.compile(r"\s+[^\W\d_]+\s+\d").match, re.compile(r"\S+").finditer
_EDGES = ".,;:!?()[]<>\"'“”‘’…—–-*/|="
_NO_NAMES = frozenset(NO_NAMES.split())
_marks: dict[str, int] = {}
for _k, _ws in enumerate(_sets.values()):
    for _w in _ws:
        _marks[_w] = _marks.get(_w, 0) | 1 << _k
_DIGITS, _STREETS, _FIRST = frozenset(DIGIT_WORDS.split()), frozenset((STREETS + " " + MORE_STREETS).split()), frozenset(STREETS_FIRST.split())


class Sentences:
    """Labelled sentences: personal data of every kind in many forms, and numbers, places, bodies and words that look like it."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)
        self.given = sorted(w for w in GIVEN if len(w) > 2)

    def made_up(self, capital: bool = True) -> str:
        r = self.r
        w = "".join(r.choice("b c d f g h j k l m n p r s t v w y z st br ch sh kh".split()) + r.choice("a e i o u ai ou ia é á ü".split() if r.random() < 0.1 else "a e i o u ai ou".split()) for _ in range(r.choice([1, 1, 2, 2, 3])))
        w += r.choice(["", "", "n", "r", "s", "l", "m", "ng", "ski", "ova", "ez", "ford", "mann", "son", "ton", "ini"])
        return w.capitalize() if capital else w

    def first(self) -> str:
        return self.r.choice(self.given).capitalize() if self.r.random() < 0.4 else self.made_up()

    def last(self) -> str:
        w, p = self.made_up(), self.r.random()
        return f"{w}-{self.made_up()}" if p < 0.05 else f"O'{w}" if p < 0.08 else f"{self.r.choice(['de', 'van', 'al', 'von', 'de la'])} {w}" if p < 0.11 else w

    def number(self, pattern: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTXZ") if c == "A" else c for c in pattern)

    def span(self, kind: str) -> str:
        r, c = self.r, self.r.choice
        if kind == "email":
            user = c([f"{self.first().lower()}{r.randint(1, 99)}", f"{self.first().lower()}.{self.made_up(False)}", f"{self.made_up(False)}_{c('abcdefg')}", f"{self.first().lower()}+{self.made_up(False)}{r.randint(1, 99)}"])
            host, top = c([self.made_up(False), f"mail.{self.made_up(False)}", f"{self.made_up(False)}-{self.made_up(False)}"]), c(["com", "net", "org", "test", "gov", "example", "de", "co.uk"])
            return c([f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user} [at] {host}.{top}", f"{user} (at) {host.replace('.', ' dot ')} dot {top}", f"{user} at {host.replace('.', ' dot ')} dot {top}", f"{user}[at]{host}[dot]{top}"])
        if kind == "phone":
            if r.random() < 0.14:
                words = DIGIT_WORDS.split()
                w = [c(words) for _ in range(c([7, 10]))]
                return c([f"{' '.join(w[:-4])}, {' '.join(w[-4:])}", f"{' '.join(w[:3])}, {' '.join(w[3:6])}, {' '.join(w[6:])}", " ".join(w), " - ".join(w)])
            return self.number(c(["999-9999", "999-999-9999", "(999) 999-9999", "(999)999 9999", "999.999.9999", "999/999-9999", "+1 999 999 9999", "1-999-999-9999 ext. 99", "9999999999", "999 999 9999", "999–9999", "999 9999"] + ["+99 99 9999 9999", "+99 (9)99 999 9999", "+99 999 999 999", "99 99 99 99 99", "0999 999999", "+999 9 999 9999", "(099) 9999 9999"]))
        if kind == "id_number":
            return self.number(c(["999-99-9999", "999 99 9999", "999999999", "99-9999999", "AA9999999", "A999-9999-99", "9AA9-AA9-AA99", "C 99 999 999", "A99999999", "999–99–9999", "AA 99 99 99 A", "99999999A", "999-999-999", "A9999 99999 99999"]))
        if kind == "address":
            street = " ".join(self.made_up() if r.random() < 0.6 else c("Willow Upper Station Cedar Orchard Second Fifth Market Chapel Elm Oak Church Birch Hollow".split()) for _ in range(r.randint(1, 2)))
            way = c(["Road", "Rd.", "Lane", "St", "Street", "Ave", "Avenue", "Drive", "Ct.", "Blvd", "Turnpike", "Way", "Crescent", "Close", "Gardens", "Terrace"])
            return c([f"{r.randint(1, 9999)} {c(['', 'N. ', 'West ', 'E '])}{street} {way}"] * 5 + [f"{r.randint(1, 400)}{c('ABC')} {street} {way}", f"{c(['PO', 'P.O.', 'Post Office', 'P. O.'])} Box {r.randint(10, 99999)}", f"{c(['PO', 'P.O.'])} Box {r.randint(10, 9999)}", f"{c(['calle', 'rue', 'Avenida', 'Rue de', 'Calle de'])} {street} {r.randint(1, 199)}", f"{r.randint(1, 99)} rue {street}"])
        first, last, letter = self.first(), self.last(), c("ABCDEGJKLMRSTW")
        return c([f"{first} {last}"] * 4 + [f"{first} {letter}. {last}", f"{letter}. {last}", f"{c(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.'])} {last}", f"{c(['Mr.', 'Dr.', 'Ms.'])} {first} {last}", f"{letter}. {c('ABC')}. {last}"])

    FRAMES = {
        "email": ["You can reach me at {}.", "Please send the answer to {}.", "<{}> works best.", "E-mail {} with questions.", "My address online is {} if you want a copy.", "Contact: {}", "{}", "Write to {} any time."],
        "phone": ["Call me at {}.", "My number is {}, evenings only.", "I can be reached by phone, {}.", "Leave a message on {} and I will call back.", "Tel: {}.", "Phone/fax {}.", "My cell is {}", "Dial {} after six.", "Text {} instead.", "Ring us on {}."],
        "id_number": ["My SSN is {}.", "SSN: {}.", "Social security number {}.", "My social is {} if you must know.", "For identification, {} is my social.", "Soc. sec. # {}.", "Driver's license no. {}.", "My passport number is {}.", "Medicare ID {}.", "Taxpayer ID {}.", "Veterans claim number {}.", "Benefit number {} was denied.", "Identity card {}.", "My tax number is {}."],
        "address": ["I live at {}, {P}.", "Our home is {}, next to the mill.", "Mail the notice to {}.", "Property at {} was affected.", "We own the house at {}.", "Residence: {}.", "The well at {} is dry.", "We moved to {} in May.", "Address: {}", "My mother resides at {}."],
        "name": ["My name is {} and I vote.", "I, {}, object.", "I, {}, write for myself.", "My neighbor {} got sick last year.", "Our doctor, {}, told us to move.", "As {} said at the meeting, this is personal.", "We asked {} about the wells.", "I am {}, a retired nurse.", "This is {} writing again.", "Sincerely,\n{}", "\n\n— {}", "\n\n{}", "\n\n{}", "Respectfully submitted, {}", "Signed: {}", "Thank you.\n{}", "My brother {} works there.", "{} told me about it.", "I agree with {}.", "Regards,\n{}\n", "Best,\n{}\n{P}", "My friend {} farms there.", "{} lost a job over this.", "Name: {}", "Comment by {}:", "We met {} at the plant.", "According to {}, nobody asked.", "{} and I were there."],
    }
    NOTHING = [
        "See section {999.9999} and § {999.999}.", "Substance CAS {9999-99-9} is listed.", "CAS number {999999-99-9}.", "Permit {99-9999-9} expired.", "Permit No {9999999} expired.", "The substance with CAS No {9999999} is exempt.", "RIN {9999-AA99} applies.", "Docket {AAA-AA-2019-9999} holds it.", "Docket {AAA-AAA-A99-AAA-2009-9999}-{99999}.",
        "NAICS code {999999} covers us.", "As printed at {99} FR {99999}, it holds.", "In {99} CFR {999.9999} the rule says so.", "They measure @ {9} wells instead of {999} wells.", "The bill was ${99},{999},{999}.", "About {9},{999},{999} tons a year.", "Rule {999.9999} ({2009}) holds.", "Between {1999} and {2009}, the {P} mills closed.", "On {2009}-{09}-{19} it rained.", "From {19}/{09}/{2019} to {19}/{09}/{2019}.",
        "Highway {99} passes Camp {P}.", "We live near Fort {P}.", "Hello from Lake {P} precinct {99}!", "I am from Mount {P} ward {9}.", "will {p} go on, may {p} stop?", "The word {P} was printed.", "Out in {P} County the water is brown.", "The {P} River and {P} Creek flood.", "People in {P} and {P} agree.", "North {P} is near Port {P} district {99}.", "{P} Valley is downwind of {P}.", "In San {P} they object.", "Parents outside {P} worry.", "Port {P} ward {9} is small.", "From Lake {P}.",
        "The Clean Rivers Act is old.", "The {P} Mining Company pays.", "{P} Water Association wrote.", "Friends of {P} Creek object.", "The National {P} Council met.", "The Supreme Court ruled.", "Federal Register notices help.", "Environmental Quality Office staff know.", "Dear Administrator,", "Dear Sir or Madam,", "Executive Summary", "General Comments\n", "Second Reading.", "Last March The Office wrote.", "Sincerely,\nA concerned voter", "Sincerely,\nThe members", "\n\nThank you for reading", "\n\nParents for {P} Creek", "\n\nA worried farmer", "Regards,\nWorried in {P}", "Town: Port {P}", "Workplace: {P}\nShift: night", "Place: {P} ward {9}", "Reason: {P} is dusty", "Yesterday {P} flooded.", "Near {P}, {P} and {P}.", "The {P} Street bridge fell.", "I live in the {P} district.", "the owners at {P} know",
        "Section {999.9999} is wrong.", "La sección {999.9999} no dice nada.", "L’article {999.9999} ne dit rien.", "En {P} hay {99} casas.", "Les gens de {P} le savent.", "counted {99999} letters about {p}.", "Rule section: {999.999}; Town: Mount {P} ward {99}", "Order {999-9999} of the series", "{999.9999}–{99}; the new plan", "See {999.9999}–{9} and {99.999}–{99}.",
        "Table {99} on page {999} lists {p}.", "{99} days on a hard road", "{9} miles down the old road", "{99} percent of the drive", "the agency U.S. {P} said", "Lot no. {999-9999} of batch {9999999}", "part A. {P} is a place", "Phone lines near {P} fell.", "license fees rose by {99} percent", "{9} New Rules for {P} Mills", "{2009} Clean Rivers Plan", "{99} Small Farms Closed",
        "the social cost is {999.9999} here", "section {999.9999} says who is to call", "our name for {p} is old", "doctors near {P} know", "model number {999-9999} of the meter", "invoice {99-9999999} for the pump", "version {9999999999} of the dataset", "serial {AA9999999} of the pump", "one two three and so on", "I am sure the", "I am sorry about it", "This is not fair", "my friend told us", "I, too, object", "Thank you again",
    ]
    FILLERS = ["We ask the office to keep the plan.", "It does not work for small mills.", "That is enough!", "In 2003, many people fell ill.", "It took 12 months to build.", "Nadie nos explicó qué pasó.", "", "", "They never measured the dust, and nobody came to see us about it."]

    @classmethod
    def vocabulary(cls) -> set[str]:
        """Lower-case words of the frames."""
        return {w for t in (*(f for fs in cls.FRAMES.values() for f in fs), *cls.NOTHING, *cls.FILLERS) for w in _words(re.sub(r"\{[^}]*\}", " ", t)) if w.islower() and len(w) > 1}

    def filled(self, frame: str) -> str:
        return re.sub(r"\{([^}]+)\}", lambda m: self.made_up(m[1] == "P") if m[1] in "Pp" else self.number(m[1]), frame)

    def one(self) -> tuple[str, list[tuple[str, int, int]]]:
        r = self.r
        text, labels = r.choice(self.FILLERS), []
        for _ in range(r.randint(1, 3)):
            text += " " if text else ""
            if r.random() < 0.5:
                kind = r.choice([*KINDS, "name"])
                left, right = map(self.filled, r.choice(self.FRAMES[kind]).split("{}"))
                value = self.span(kind)
                labels.append((kind, len(text) + len(left), len(text) + len(left) + len(value)))
                text += left + value + right
            else:
                text += self.filled(r.choice(self.NOTHING))
        tail = r.choice(self.FILLERS)
        text += f" {tail}" if tail else ""
        style = r.random()
        if style < 0.1:
            text = text.lower()
        elif style < 0.18:
            text = text.upper()
        elif style < 0.24:
            text = text.swapcase()
        return text, labels


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: np.ndarray
    words: Words


def examples(sentences: list[tuple[str, list[tuple[str, int, int]]]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the proposals: right where a labelled span of the kind overlaps for the most part."""
    x, y = [], []
    for text, labels in sentences:
        for kind, start, end in proposals(text, words):
            x.append(features(text, kind, start, end, words))
            y.append(float(any(k == kind and 2 * (min(end, b) - max(start, a)) > max(end - start, b - a) for k, a, b in labels)))
    return np.array(x, dtype=np.int64), np.array(y)


def trained(words: Words, n: int = SENTENCES) -> Model:
    """Trees from three quarters of the sentences; for each kind the threshold of best F1 on the rest, in the middle of those that tie."""
    words = Words({**{w: 2 for w in Sentences.vocabulary()}, **words.level})
    maker = Sentences()
    sentences = [maker.one() for _ in range(n)]
    x, y = examples([s for i, s in enumerate(sentences) if i % 4], words)
    trees = boosting.fit(np.minimum(x, boosting.BINS - 1), y, trees=TREES, depth=DEPTH)
    x, y = examples(sentences[::4], words)
    p = trees.probability(np.minimum(x, boosting.BINS - 1))
    thresholds = np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        grid = np.linspace(0.1, 0.9, 33)
        f1 = np.array([2 * (y[own] * (p[own] >= t)).sum() / max(1, y[own].sum() + (p[own] >= t).sum()) for t in grid])
        if own.any() and y[own].any():
            thresholds[k] = grid[f1 >= f1.max() - 1e-9].mean()
    return Model(trees, thresholds, words)


def counted_words(texts: DataFrame, rows: int) -> Words:
    """The levels of the words that stand in lower case, counted over all texts whose case tells something, of a table of `rows` rows.

    Words below the lowest share of LEVELS stay out, so what is gathered is at most the mean number of words of a text divided by that share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (shown := cased(text)) is not None:
                    total.update({w for x in set(shown.split()) if (w := x.strip(_EDGES)).islower() and w.isalpha()})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(2.0, LEVELS[0] * rows)
    found = {r[0]: r[1] for r in counted.filter(F.col("n") >= least).collect()}
    return Words({w: 1 + sum(n >= max(2.0, share * rows) for share in LEVELS[1:]) for w, n in found.items()})


def fitted(texts: DataFrame, rows: int) -> Model:
    return trained(counted_words(texts, rows))


#: Kinds in the order in which they take a span from others that overlap.
_RANK = {k: i for i, k in enumerate(("email", "address", "id_number", "phone", "name"))}


def selected(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """The spans of each text that are personal data, without overlaps, from left to right."""
    found, rows = [], []
    for i, text in enumerate(texts):
        place, row = None, []
        for kind, start, end in proposals(text, model.words):
            found.append((i, kind, start, end))
            if place != (start, end):  # the kinds proposed for one span share all features but the first
                place, row = (start, end), features(text, kind, start, end, model.words)
            rows.append([KINDS.index(kind), *row[1:]])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    x = np.array(rows, dtype=np.int64)
    p = model.trees.probability(np.minimum(x, boosting.BINS - 1))
    passed: dict[int, list] = {}
    for j in np.flatnonzero(p >= model.thresholds[x[:, 0]]):
        i, kind, start, end = found[j]
        passed.setdefault(i, []).append((kind == "name", kind != "email", start - end if kind == "name" else 0, -round(float(p[j]), 6), _RANK[kind], start, end, kind))
    for i, own in passed.items():
        taken: list[tuple[str, int, int]] = []
        for *_, start, end, kind in sorted(own):
            if not any(start < b and end > a for _, a, b in taken):
                taken.append((kind, start, end))
        out[i] = sorted(taken, key=lambda t: t[1])
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a placeholder such as [EMAIL] for each span, the rest unchanged."""
    parts, at = [], 0
    for kind, start, end in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def examined(df: DataFrame, id_column: str, text_column: str, model: Model | None = None) -> DataFrame:
    """(id, kinds array<string>, n_spans, redacted) of every row in which personal data is found.

    Null texts and ids have none; a repeated row comes out once per repeat. Each text is searched whole, in one map without shuffle.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    model = fitted(rows, df.count()) if model is None else model  # the count is read from the footers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = [(i, s, redacted(t, s)) for i, t, s in zip(ids, texts, selected(texts, model)) if s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in hit], pa.string()), pa.array([sorted({s[0] for s in h[1]}) for h in hit], pa.list_(pa.string())), pa.array([len(h[1]) for h in hit], pa.int64()), pa.array([h[2] for h in hit], pa.string())],
                names=["id", "kinds", "n_spans", "redacted"],
            )

    return rows.mapInArrow(run, "id string, kinds array<string>, n_spans bigint, redacted string")


def kinds(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pii_kind), once each."""
    return examined(df, id_column, text_column).select("id", F.explode("kinds").alias("pii_kind")).distinct()
