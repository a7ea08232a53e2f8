"""Variant spellings of the names of persons and organisations in hand-typed titles.

A title is parsed into a core (surname and place, or place, subject and kind) and, for persons, a given name. Titles are
collapsed to distinct cores first. Cores become sets of padded q-grams; MinHash bands, whose number and height follow from
the collision curve, propose pairs; Monge-Elkan similarity over the words verifies them; star clustering takes the most
frequent spelling as centre of each cluster. Within a cluster, given names, nicknames and initials are told apart.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.llm.encoding_repair import ENCODINGS, reread, unreferenced
from rulewake.session import prepare, stored

Q = 3
#: Pairs of cores this similar (Jaccard of q-grams) must meet in some band with this probability; bands are as high as that allows, up to MOST bands.
SIMILAR, RECALL, MOST = 0.6, 0.95, 24
#: Least similarity of two words, and of two cores, by which they are spellings of each other.
WORD, CORE = 0.86, 0.9
#: Titles outside the two cores, and share of those of the other word, from which on a word is no typing error of the other; share of the
#: other core's titles from which on two cores are two names.
FREQUENT, FREQUENT_SHARE, EVEN = 3, 0.02, 0.5
#: How usual in the table the rarer of two given names must be, against the other, to be none of its typing errors.
USUAL = 0.3
#: Share of organisations' titles from which on a word is vocabulary rather than a name, and what bounds the words gathered: no more can
#: reach the share, since titles have 40 words at most. A table with a handful of organisations can't tell a common subject from a common place.
VOCABULARY_SHARE, VOCABULARY = 0.02, 2000

# Words of names as people type them.
OPENINGS = "comment comments public mass campaign letter submitted electronically written sponsored on behalf by of from the re filed statement"
NOBODY = "anonymous anon anonymously citizen concerned comment comments public untitled web form proposed rule proposal agency agency's submission attachment attached docket none unknown n/a na name withheld"
TITLES = "mr mrs ms miss dr prof rev hon sir fr sr jr ii iii iv esq phd md pe rn jd dds dvm mba cpa mph dr. staff inc llc ltd et al local pc"
PLACE_WORDS = "city town village of"
ABBREVIATIONS = {
    "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "mt": "mount", "ft": "fort", "pt": "port", "gtr": "greater", "gr": "greater",
    "lwr": "lower", "low": "lower", "upr": "upper", "up": "upper", "olde": "old", "nw": "new", "hts": "heights", "hgts": "heights", "hls": "hills", "hbr": "harbor",
    "harbour": "harbor", "par": "parish", "twp": "township", "twnshp": "township", "cnty": "county", "co": "county", "crsg": "crossing", "xing": "crossing", "vly": "valley",
    "vall": "valley", "isl": "island", "is": "island", "jct": "junction", "junct": "junction", "spgs": "springs", "spr": "springs", "plns": "plains", "bsn": "basin", "by": "bay",
    "assn": "association", "assoc": "association", "soc": "society", "socy": "society", "inst": "institute", "instit": "institute", "found": "foundation", "fdn": "foundation",
    "coop": "cooperative", "co-op": "cooperative", "coun": "council", "cncl": "council", "all": "alliance", "allnce": "alliance", "comm": "committee", "cmte": "committee",
    "fed": "federation", "fedn": "federation", "corp": "corporation", "un": "union", "u": "union", "coalit": "coalition", "coal.": "coalition", "neighbours": "neighbors",
    "electrical": "electric", "elec": "electric", "fishery": "fisheries", "fish": "fisheries", "wetland": "wetlands", "hsg": "housing", "petrol": "petroleum", "mine": "mining",
}
KINDS = "association society institute foundation cooperative council alliance committee federation corporation union coalition company league network club group board authority commission"
#: Words that are kinds of organisations only at the end of a name without separators, or before `of`.
MORE_KINDS = "district department center centre university college school church trust fund bureau conservancy partnership tribe nation chamber consortium laboratory hospital library museum ranch works services farms"
SURROUNDINGS = "north south east west mount fort port greater lower upper old new heights hills harbor parish township county crossing valley island junction springs plains basin bay delta lake camp"
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex andy sandy", "andré": "andy", "benjamin": "ben benny", "charles": "charlie chuck", "christopher": "chris kit", "deborah": "deb debbie",
    "dorothy": "dot dottie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betsy betty lizzie eliza", "frances": "fran frankie fanny", "francisco": "paco pancho frank", "gregory": "greg",
    "guadalupe": "lupe lupita", "harold": "hal harry", "henrietta": "etta hattie", "ignacio": "nacho", "isabella": "izzy bella", "james": "jim jimmy", "jennifer": "jen jenny",
    "joseph": "joe joey", "josé": "pepe", "katherine": "kate katie kathy kit", "lawrence": "larry", "loretta": "lori etta", "margaret": "maggie meg peggy", "michael": "mike mick mickey",
    "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty trish", "rebecca": "becca becky", "renée": "ren", "richard": "dick rich rick", "robert": "bob bobby rob", "samuel": "sam sammy",
    "susan": "sue susie", "theodore": "ted theo", "thomas": "tom tommy", "uriah": "uri", "victoria": "tori vicky", "vincent": "vince vinny", "walter": "wally walt", "william": "bill billy will",
    "zachary": "zach zack", "anthony": "tony", "barbara": "barb babs", "catherine": "cathy kate", "daniel": "dan danny", "david": "dave", "donald": "don", "eleanor": "ellie nell", "george": "georgie",
    "henry": "hank harry", "jacob": "jake", "john": "jack johnny", "jonathan": "jon", "kenneth": "ken", "leonard": "len lenny", "matthew": "matt", "nathaniel": "nate nat", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "raymond": "ray", "ronald": "ron", "stephen": "steve", "timothy": "tim", "virginia": "ginny",
}

_opening = set(OPENINGS.split())
_nobody = set(NOBODY.split())
_title = set(TITLES.split())
_kind = set(KINDS.split())
_more_kind = set(MORE_KINDS.split())
_around = set(SURROUNDINGS.split())
_word = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*\.?|\d+")
_suffix = re.compile(r"[,\s]+(?:ph\.?\s?d\.?|m\.?d\.?|p\.?e\.?|esq\.?|j\.?d\.?|r\.?n\.?|jr\.?|sr\.?|i{2,3}|inc\.?|llc|et al\.?|staff)(?=[\s,.)/–—:-]|$)", re.IGNORECASE)


def plain(text: str) -> str:
    """Lower case without accents; garbled characters are read again first."""
    text = unreferenced(text)
    if not text.isascii():
        for e in ENCODINGS * 2:
            text = reread(text, e)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("’", "'").replace(" � ", " – ")


_formal: dict[str, list[str]] = defaultdict(list)
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _formal[plain(_s)].append(plain(_full))
_full_names = {plain(x) for x in NICKNAMES}


def words(title: str) -> list[str]:
    return [w for w in _word.findall(plain(title))]


def bare(word: str) -> str:
    return word.lower().rstrip(".").replace("'", "")


_introduced = re.compile(r"(?:(?:mass\s+comment\s+campaign|public\s+comments?|" + "|".join(sorted(_opening - {"public", "mass", "campaign"}, key=len, reverse=True)) + r")\b[\s:]*)+(?:[–—-]+\s*)?", re.IGNORECASE)
_closed = re.compile(r"\s*[–—-]+\s*(?:comments?|letter|staff)\s*$", re.IGNORECASE)


def opened(title: str) -> str:
    """The title without the words that introduce or close it."""
    t = _closed.sub("", plain(title).strip())
    m = _introduced.match(t)
    if m and m.end() < len(t):
        t = t[m.end() :]
    previous = None
    while previous != t:
        previous = t
        t = _suffix.sub("", t).strip(" .,–—-")
    return re.sub(r"\s+", " ", t)


_initials = re.compile(r"[^\W\d_]\.[^\W\d_]\.?").fullmatch


def subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and exchanges of neighbours that turn a into b; most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for j, y in enumerate(b) if used[j]))) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


@lru_cache(200_000)
def letters_of(word: str) -> int:
    """One bit per letter that a word has; an edit changes two of them at most."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(200_000)
def alike(a: str, b: str) -> float:
    """Similarity of two words: Jaro-Winkler, but 0 where more than two edits, or one in a short word, part them."""
    if a == b:
        return 1.0
    most = 2 if min(len(a), len(b)) >= 7 else 1
    if abs(len(a) - len(b)) > most or (letters_of(a) ^ letters_of(b)).bit_count() > 2 * most:
        return 0.0
    return jaro_winkler(a, b) if edits(a, b, most) <= most else 0.0


def meant(given: str) -> list[str]:
    """The full names that a given name may stand for; none for an initial."""
    return [] if len(given) < 2 else [given] if given in _full_names or given not in _formal else _formal[given]


def apart(titles_a: list[int], own_a: int, titles_b: list[int], own_b: int, givens_a: list[str], givens_b: list[str]) -> tuple[list[int], list[int]]:
    """For each word of two cores, the titles that show it to be a word of its own, from the titles of the word and of its core.

    How often a core itself is repeated shows nothing, since one writer or campaign repeats a typing error, unless both cores are
    about as frequent. Nothing does where a given name is met with both cores.
    """
    if {x for g in givens_a for x in meant(g)} & {x for g in givens_b for x in meant(g)}:
        return [1] * len(titles_a), [1] * len(titles_b)
    if min(own_a, own_b) >= EVEN * max(own_a, own_b):
        return titles_a, titles_b
    return [n - own_a for n in titles_a], [n - own_b for n in titles_b]


def monge_elkan(a: list[str], b: list[str], n_a: list[int] | None = None, n_b: list[int] | None = None) -> float:
    """The mean of the words' best similarities, from the side where it is smaller; 0 where a word has no counterpart.

    n_a and n_b say how many titles show each word to be one of its own: two words that are both frequent are two words, not spellings of one.
    """
    if not a or not b:
        return float(not a and not b)
    out = 1.0
    n_a, n_b = n_a or [1] * len(a), n_b or [1] * len(b)
    for x, m, y, n in ((a, n_a, b, n_b), (b, n_b, a, n_a)):
        best = [max(0.0 if p != q and min(k, j) >= max(FREQUENT, FREQUENT_SHARE * max(k, j)) else alike(p, q) for q, j in zip(y, n)) for p, k in zip(x, m)]
        out = min(out, sum(best) / len(best) if min(best) >= WORD else 0.0)
    return out


class Vocabulary:
    """The frequent words of organisations' names, to which abbreviations and typing errors are led back."""

    def __init__(self, counted: dict[str, int]):
        frequent = {w for w in counted if w not in ABBREVIATIONS and len(w) > 2} | _kind | _around
        joined = {w for w in frequent for i in range(3, len(w) - 2) if w[:i] in frequent and w[i:] in frequent}
        self.words = {w for w in frequent - joined if "-" not in w}
        self.known: dict[str, list[str]] = {}
        self.counted = counted

    def read(self, word: str) -> list[str]:
        """The words of the vocabulary that a word stands for, or the word itself."""
        if word not in self.known:
            self.known[word] = self._read(word)
        return self.known[word]

    def _read(self, raw: str) -> list[str]:
        dotted, word = raw.endswith("."), bare(raw)
        if dotted and f"{word}." in ABBREVIATIONS:
            return [ABBREVIATIONS[f"{word}."]]
        if word in self.words:
            return [word]
        if word in ABBREVIATIONS:
            return [ABBREVIATIONS[word]]
        if "-" in word and all(p in self.words for p in word.split("-")):
            return word.split("-")
        if word + "s" in self.words or word.rstrip("s") in self.words:
            return [word + "s" if word + "s" in self.words else word.rstrip("s")]
        for i in range(3, len(word) - 2):
            if word[:i] in self.words and word[i:] in self.words:
                return [word[:i], word[i:]]
        if dotted and len(word) > 1:
            short = [w for w in self.words if w.startswith(word)] or [w for w in self.words if w[0] == word[0] and len(w) > len(word) + 1 and subsequence(word, w) and w[-1] == word[-1]]
            if short:
                return [min(short, key=lambda w: (len(w), w))]
        if len(word) > 3:
            near = sorted((edits(word, w, 2), w) for w in self.words if (w[0] == word[0] or w[-1] == word[-1]) and abs(len(w) - len(word)) <= 2)
            if near and near[0][0] <= (1 if len(word) < 7 else 2):
                return [near[0][1]]
        return [word]


def short_name(t: str) -> re.Match | None:
    """The acronym at the end of an opened title: capitals, or, where all letters are of one case, a short last word of a name without separators."""
    if re.search(r"[,/(:–—]", t) or len(t.split()) < 2:
        return None
    return re.search(r"\b[A-Z]{3,5}$" if not (t.isupper() or t.islower()) else r"\b[A-Za-z]{3,4}$", t)


@lru_cache(100_000)
def kind_like(word: str) -> bool:
    """Whether a word is a kind of organisation with a typing error that leaves its first or its last letter."""
    return len(word) > 3 and any((word[0] == k[0] or word[-1] == k[-1]) and edits(word, k, 2) <= (1 if len(k) < 7 else 2) for k in _kind if len(k) > 4 and abs(len(k) - len(word)) <= 2)


def other_kind(t: str) -> str | None:
    """The further kind of organisation at the end of an opened title without separators, or before `of` at its beginning."""
    found = [bare(w) for w in _word.findall(t)]
    if len(found) < 3 or re.search(r"[,/(:–—]| - ", t):
        return None
    return found[-1] if found[-1] in _more_kind else found[0] if found[0] in _more_kind and found[1] == "of" else None


def organisation(title: str) -> bool:
    """Whether some word of a title is, or is short for, a kind of organisation, or an acronym stands for subject and kind."""
    t = opened(title)
    found = [bare(w) for w in _word.findall(t)]
    full = [ABBREVIATIONS.get(w, w) for w in found]
    if any(w in _kind for w in full):
        return not (len(found) <= 4 and all(len(w) == 1 for w, f in zip(found, full) if f in _kind))
    if any(kind_like(w) for w in found):
        return True
    return found[-1:] == ["coal"] or len(found) > 2 and "coal" in found or short_name(t) is not None or other_kind(t) is not None


def parsed(title: str, vocabulary: Vocabulary) -> tuple[str, list[str], str, str] | None:
    """(sort, core words, codes, given): person `p` with [surname, place] and given name, organisation `o` with its place's words and the
    codes of surroundings, subject and kind. None where the title names nobody."""
    t = opened(title)
    found = _word.findall(t)
    if not found or all(bare(w) in _nobody or bare(w) in _opening or bare(w).isdigit() for w in found):
        return None
    if organisation(title):
        return _organisation(t, vocabulary)
    return _person(t)


def _organisation(t: str, vocabulary: Vocabulary) -> tuple[str, list[str], str, str] | None:
    acronym = short_name(t)
    if acronym and vocabulary.read(acronym[0].lower())[0] in vocabulary.words:
        acronym = None
    rest = t[: acronym.start()] if acronym else t
    place, around, subject, kind = [], [], [], []
    further = other_kind(t)
    for w in _word.findall(rest):
        if bare(w) in _title or bare(w) in ("of", "for", "the", "and", "city", "town", "a"):
            continue
        for x in vocabulary.read(w.lower()):
            if x in _kind or x == further:
                kind.append(x)
            elif x in _around:
                around.append(x)
            elif x in vocabulary.words:
                subject.append(x)
            elif len(x) > 1:
                place.append(x)
    if any(len(x) > 2 for x in place):
        place = [x for x in place if len(x) > 2]
    if not place and len(set(subject)) > 1:  # a place so frequent that it passes for vocabulary, or a name of such words alone
        place = [min(subject, key=lambda w: (vocabulary.counted.get(w, 0), w))]
        subject = [w for w in subject if w != place[0]]
    if not place:
        return None
    if not kind and not acronym and bare(_word.findall(rest)[-1]) == "coal":  # the abbreviation of a coalition whose stop went with the end
        kind = ["coalition"]
        if subject.count("coal") == 1 and not {"ash"} & set(subject):
            subject.remove("coal")
    code = f"{'+'.join(sorted(set(around)))}/{'+'.join(sorted(set(subject)))}/{'+'.join(kind[-1:])}/{acronym[0].lower() if acronym else ''}"
    return "o", sorted(place), code, ""


def _person(t: str) -> tuple[str, list[str], str, str] | None:
    t = re.sub(r"\b(?:city|town|village) of\b", "", t, flags=re.IGNORECASE)
    place, name = "", t
    for pattern, p, n in ((r"^([^:]+):\s*(.+)$", 1, 2), (r"^(.+?)\s*\(([^)]*)\)?\s*$", 2, 1), (r"^(.+?)\s*/\s*([^/]+)$", 2, 1), (r"^(.+\S)\s+[–—-]+\s*(\S.*)$", 2, 1), (r"^(.+?)\s+of\s+(.+)$", 2, 1), (r"^(.+),\s*([^,]+)$", 2, 1)):
        if m := re.match(pattern, t, re.IGNORECASE):
            place, name = m[p], m[n]
            break
    where = [bare(w) for w in _word.findall(place) if bare(w) not in _title and len(bare(w)) > 1]
    if any(len(w) > 2 for w in where):  # short words are the place only where there is no other
        where = [w for w in where if len(w) > 2]
    parts = [[w for i, w in enumerate(_word.findall(p)) if i == 0 and _initials(w) or bare(w).replace(".", "") not in _title] for p in name.split(",")]
    parts = [p for p in parts if p]
    if not where or not parts:
        return None
    if len(parts) > 1:
        surname, given = parts[0][-1], parts[1]
    else:
        surname, given = parts[0][-1], parts[0][:-1]
    if len(bare(surname)) < 2:
        return None
    first = bare(given[0]).split(".")[0] if given else ""
    return "p", sorted([bare(surname), *where]), "", first


def grams(sort: str, core: list[str], code: str, ends: bool = False) -> list[str]:
    """Padded q-grams of the core's words. Each carries what the rest of the name must share: a person's the first letters of the
    other words, or, with ends, their last two letters, so that an error at a word's beginning leaves the q-grams of the others;
    an organisation's its surroundings and the first letters of its subject and kind, which an acronym shares.
    So neither one place's persons nor one place's organisations meet."""
    out = set()
    for i, w in enumerate(core):
        rest = initials(code) if code else "".join(sorted(x[-2:] + "$" if ends else x[0] for j, x in enumerate(core) if j != i))
        padded = f"{'^' * (Q - 1)}{w}{'$' * (Q - 1)}"
        out |= {f"{sort}{rest}|{padded[k : k + Q]}" for k in range(len(padded) - Q + 1)}
    return sorted(out)


def shortened(word: str) -> set[str]:
    """The word without any one or, from 7 letters on, any two letters, and the word: two words that alike() can accept share one of them."""
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | once | ({w[:i] + w[i + 1 :] for w in once for i in range(len(w))} if len(word) >= 7 else set())


def initials(code: str) -> str:
    """The surroundings and the sorted first letters of subject and kind in a code, or of the acronym in their place."""
    around, subject, kind, short = code.split("/")
    return around + "/" + "".join(sorted(short or (w[0] for part in (subject, kind) for w in part.split("+") if w)))


def curve(similarity: float, bands: int, height: int) -> float:
    """Probability that a pair of this similarity meets in some band."""
    return 1 - (1 - similarity**height) ** bands


def tuned(similarity: float = SIMILAR, recall: float = RECALL, most: int = MOST) -> tuple[int, int]:
    """The highest bands, and the fewest of them, at which pairs of the similarity meet with the recall."""
    for height in range(12, 0, -1):
        for bands in range(1, most + 1):
            if curve(similarity, bands, height) >= recall:
                return bands, height
    return most, 1


def signatures(sets: list[list[str]], bands: int, height: int) -> np.ndarray:
    """A key of 64 bits per set and band."""
    prime, rng = np.uint64((1 << 31) - 1), np.random.default_rng(20)
    a = rng.integers(1, int(prime), bands * height, dtype=np.uint64)
    b = rng.integers(0, int(prime), bands * height, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, bands * height, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(sets), bands), dtype=np.int64)
    for begin in range(0, len(sets), 500):
        part = sets[begin : begin + 500]
        h = np.array([zlib.crc32(g.encode()) & 0x7FFFFFFF for s in part for g in s], dtype=np.uint64)
        starts = np.cumsum([0, *(len(s) for s in part[:-1])])
        low = np.minimum.reduceat((h[:, None] * a + b) % prime, starts, axis=0)
        out[begin : begin + 500] = (low * mix).reshape(len(part), bands, height).sum(2, dtype=np.uint64).view(np.int64)
    return out


def same(core_a: list[str], code_a: str, core_b: list[str], code_b: str, n_a: list[int] | None = None, n_b: list[int] | None = None) -> float:
    """Similarity of two cores; the codes of organisations must agree, an acronym with the first letters of subject and kind."""
    if code_a != code_b:
        if not code_a or not code_b:
            return 0.0
        a, b = code_a.split("/"), code_b.split("/")
        if a[0] != b[0] or bool(a[3]) == bool(b[3]):
            return 0.0
        full, short = (a, b) if b[3] else (b, a)
        letters = Counter(w[0] for part in full[1:3] for w in part.split("+") if w)
        if letters != Counter(short[3]) or short[3][-1:] != full[2][:1]:
            return 0.0
    return monge_elkan(core_a, core_b, n_a, n_b)


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(core_id, centre): star clustering. nodes: (core_id, n); edges: (a, b, sim), both directions.

    In each round every undecided node that outranks its undecided neighbours (more titles, then smaller id) becomes a
    centre, and the nodes next to a centre become its satellites, of several centres the most similar. Rounds end when none
    is undecided; each round decides at least the top node of every component, and chains of falling rank are short.
    """
    rank = F.struct(F.col("n"), -F.col("core_id"))
    ranked = nodes.withColumn("rank", rank)
    links = edges.join(ranked.select(F.col("core_id").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("core_id").alias("b"), F.col("rank").alias("rank_b")), "b")
    links = stored(links, "name-links")
    open_links, decided = links, None
    while not open_links.isEmpty():
        top = open_links.groupBy("a").agg(F.max("rank_b").alias("best"), F.any_value("rank_a").alias("rank_a")).filter("rank_a > best").select(F.col("a").alias("centre"))
        satellites = open_links.join(top, open_links["b"] == top["centre"]).groupBy(F.col("a").alias("core_id")).agg(F.max_by("centre", F.struct("sim", "rank_b")).alias("centre"))
        new = satellites.unionByName(top.select(F.col("centre").alias("core_id"), "centre"))
        new = stored(new, "name-stars")
        decided = new if decided is None else decided.unionByName(new)
        gone = new.select("core_id")
        open_links = open_links.join(gone, open_links["a"] == gone["core_id"], "left_anti").join(gone, open_links["b"] == gone["core_id"], "left_anti")
        open_links = stored(open_links, "name-links")
    if decided is None:
        return nodes.select("core_id", F.col("core_id").alias("centre"))
    return nodes.select("core_id").join(decided, "core_id", "left").select("core_id", F.coalesce("centre", "core_id").alias("centre"))


def misspelt(a: str, b: str, titles_a: int = 1, titles_b: int = 1) -> bool:
    """Whether one given name is a typing error of the other: alike, not both usual in the table, and not parted by another vowel at the end alone, as many names of men and women are."""
    if alike(a, b) < WORD or min(titles_a, titles_b) >= max(FREQUENT, USUAL * max(titles_a, titles_b)):
        return False
    return a == b or len(a) != len(b) or a[:-1] != b[:-1] or not {a[-1], b[-1]} <= set("aeiouy")


def resolved(givens: list[str], counts: list[int], titles: list[int] | None = None) -> list[str]:
    """For the given names met with one surname and place, the name that each stands for.

    Full names are centres, the most frequent first; a typing error goes to the centre it is one or two edits from, a nickname,
    or the beginning of a name, to a centre it is short for, an initial to the most frequent centre with that letter. titles
    says in how many titles of the table each given name stands, apart from this surname and place.
    """
    titles = titles or [1] * len(givens)
    seen = dict(zip(givens, titles))
    order = sorted(range(len(givens)), key=lambda i: (-counts[i], givens[i]))
    centres: list[str] = []
    out = [""] * len(givens)
    # known full names first, each a centre of its own; then others, which may be typing errors of those
    for certain in (True, False):
        for i in order:
            g = givens[i]
            if out[i] or len(g) < 2 or g in _formal and g not in _full_names or (g in _full_names) != certain:
                continue
            near = [] if certain else [c for c in centres if misspelt(g, c, seen[g], seen.get(c, 1)) or len(g) > 2 and len(c) > len(g) + 2 and c.startswith(g)]
            if not near and not certain:
                near = [c for _, c in sorted((-alike(g, c), c) for c in _full_names if c[0] == g[0] and alike(g, c) >= 0.9 and misspelt(g, c, seen[g]))]
            out[i] = near[0] if near else g
            if out[i] not in centres:
                centres.append(out[i])
    for i in order:
        g = givens[i]
        if not out[i] and len(g) > 1:
            formal = [c for c in centres if c in _formal[g]]
            out[i] = formal[0] if formal else _formal[g][0]
            if not formal:
                centres.append(out[i])
    for i in order:
        if not out[i]:
            fitting = [c for c in centres if c[:1] == givens[i]]
            out[i] = fitting[0] if fitting else givens[i]
    return out


def meeting(keys: DataFrame) -> DataFrame:
    """(a, b), the smaller id first, of the cores that share the key of some band, from (core_id, band, key).

    The join is a merge join whatever the optimizer estimates: it takes the size of the cores' file for that of their keys, of which
    each core has dozens, and would gather all of them on the driver. A bucket of very many is split by the adaptive skew join,
    which parts one side by its map outputs.
    """
    x, y = keys.hint("merge").alias("x"), keys.alias("y")
    shared = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.core_id") < F.col("y.core_id")))
    return shared.select(F.col("x.core_id").alias("a"), F.col("y.core_id").alias("b")).distinct()


def linked(df: DataFrame, id_column: str, title_column: str) -> DataFrame:
    """(id, entity, sort) of every row whose title names somebody; rows of one entity have the same entity id.

    Null titles and ids, anonymous and generic titles, and persons without a place are left out. A repeated row comes out once;
    an id with two titles may stand for two entities.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(title_column).cast("string").alias("title")).filter("id IS NOT NULL AND title IS NOT NULL").distinct()
    titles = rows.groupBy("title").agg(F.count("*").alias("n"))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for t in b["title"]:
                if organisation(t):
                    found[""] += 1
                    found.update({bare(w) for w in _word.findall(opened(t)) if not w.endswith(".")})
            if found:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    counted = titles.select("title").mapInPandas(tokens, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()}
    total = top.pop("", 0)
    vocabulary = Vocabulary({w: n for w, n in top.items() if n >= max(3, VOCABULARY_SHARE * total) and w not in _nobody - {"public"} and w not in _opening - {"public"} and w not in _title})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, n in zip(b["title"], b["n"]):
                if p := parsed(t, vocabulary):
                    out.append((t, n, *p))
            if out:
                yield pd.DataFrame(out, columns=["title", "n", "sort", "core", "code", "given"])

    named = titles.mapInPandas(parse, "title string, n bigint, sort string, core array<string>, code string, given string")
    named = stored(named.withColumn("core_id", F.xxhash64("sort", "core", "code")), "names")
    cores = stored(named.groupBy("core_id", "sort", "core", "code").agg(F.sum("n").alias("n")), "cores")
    bands, height = tuned()

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = signatures([grams(s, list(c), k) for s, c, k in zip(b["sort"], b["core"], b["code"])], bands, height)
                yield pd.DataFrame({"core_id": np.repeat(b["core_id"].to_numpy(), bands), "band": np.tile(np.arange(bands), len(b)), "key": keys.ravel()})
            # an error in a single word leaves few q-grams, so names of one word also meet in all that one edit or two leave of it
            single = [(i, f"{s}{initials(k) if k else ''}|{w}") for i, s, c, k in zip(b["core_id"], b["sort"], b["core"], b["code"]) if len(c) == 1 for w in shortened(c[0])]
            if single:
                yield pd.DataFrame({"core_id": [i for i, _ in single], "band": 2 * bands, "key": [int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big", signed=True) for _, w in single]})
            long = b[(b["code"] == "") & (b["core"].str.len() > 1)]
            if len(long):
                keys = signatures([grams(s, list(c), k, True) for s, c, k in zip(long["sort"], long["core"], long["code"])], bands, height)
                yield pd.DataFrame({"core_id": np.repeat(long["core_id"].to_numpy(), bands), "band": np.tile(np.arange(bands, 2 * bands), len(long)), "key": keys.ravel()})

    keys = cores.select("core_id", "sort", "core", "code").mapInPandas(band, "core_id bigint, band int, key bigint")
    # only cores meet here, each spelling once however often it was typed, so that a bucket holds the spellings of a few names
    pairs = meeting(keys)
    each = cores.select("core_id", "n", F.posexplode("core").alias("place", "word"))
    counts = each.join(each.groupBy("word").agg(F.sum("n").alias("titles")), "word").groupBy("core_id").agg(F.array_sort(F.collect_list(F.struct("place", "titles")))["titles"].alias("titles"))
    givens = named.filter("length(given) > 1").groupBy("core_id").agg(F.collect_set("given").alias("givens"))
    known = cores.join(counts, "core_id").join(givens, "core_id", "left").withColumn("givens", F.coalesce("givens", F.array().cast("array<string>")))
    side = lambda s: known.select(F.col("core_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("sort", "core", "code", "titles", "n", "givens")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("sort_a = sort_b").select("a", "b", *(f"{c}_{s}" for s in "ab" for c in ("core", "code", "titles", "n", "givens")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = ("core_a", "code_a", "core_b", "code_b", "titles_a", "n_a", "titles_b", "n_b", "givens_a", "givens_b")
            sims = []
            for ca, ka, cb, kb, *x in zip(*(b[c] for c in columns)):
                core_a, core_b = list(ca), list(cb)
                sim = same(core_a, ka, core_b, kb)
                if sim >= CORE:  # the titles of the words can only part what is alike
                    sim = same(core_a, ka, core_b, kb, *apart(list(x[0]), x[1], list(x[2]), *x[3:]))
                sims.append(sim)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "sim": sims}).query(f"sim >= {CORE}")

    verified = stored(both.mapInPandas(verify, "a bigint, b bigint, sim double"), "name-edges")
    edges = verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    centres = stars(cores.select("core_id", "n"), edges)
    placed = named.join(centres, "core_id").select("title", "n", "sort", "given", "centre")
    # the given names met with one surname and place are few, however many rows have them
    each_given = placed.filter("sort = 'p'").groupBy("centre", "given").agg(F.sum("n").alias("n"))
    in_all = each_given.groupBy("given").agg(F.sum("n").alias("titles"))
    sets = each_given.join(in_all, "given").groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("given", "n", (F.col("titles") - F.col("n")).alias("titles")))).alias("givens"))

    @F.pandas_udf("array<string>")
    def stands_for(givens: pd.Series) -> pd.Series:
        return pd.Series([resolved(*([g[c] for g in x] for c in ("given", "n", "titles"))) for x in givens])

    named_in_full = sets.select("centre", F.explode(F.arrays_zip(F.col("givens.given").alias("given"), stands_for("givens").alias("name"))).alias("x")).select("centre", F.col("x.given").alias("given"), F.col("x.name").alias("name"))
    persons = placed.filter("sort = 'p'").join(named_in_full, ["centre", "given"]).select("title", "sort", F.xxhash64("centre", "name").alias("entity"))
    organisations = placed.filter("sort = 'o'").select("title", "sort", F.col("centre").alias("entity"))
    return rows.join(persons.unionByName(organisations), "title").select("id", "entity", "sort").distinct()


def members(entities: DataFrame) -> DataFrame:
    """(id, entity, sort, n_links): the class of each id and the number of other ids in it, instead of all pairs."""
    sizes = entities.groupBy("entity").agg(F.count("*").alias("n"))
    return entities.join(sizes, "entity").select("id", "entity", "sort", (F.col("n") - 1).alias("n_links"))


def pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b) of distinct ids of one entity, the smaller first: as many rows as the result asks for, by a join on the entity."""
    a, b = entities.select(F.col("id").alias("id_a"), "entity"), entities.select(F.col("id").alias("id_b"), "entity")
    return a.join(b, "entity").filter("id_a < id_b").select("id_a", "id_b").distinct()
