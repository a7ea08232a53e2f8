"""Structure of a text: natural prose, or a list, a table or junk.

The unit is a line. Its words are counted by the languages whose function words they are, its characters by class. Both
distributions are compared, by Jensen-Shannon divergence, with the profiles of prose in each language and of lists,
tables and junk; the nearest profile takes the line's visible characters, and a document is what most of them are.

A language without a list of function words here has the profile `prose_other`, where its function words show as short words
that are in no list (each character of a script without blanks counts as such a word), or `prose_long`, where they hang on
long words. These two are open only to a text that ends sentences in lines of no listed language.

Profiles are learnt from all lines of the table: a first pass sums the counts of the lines that plain rules recognise. Those
of prose start from a few made-up counts, so that prose of a language that the table hardly has is told too.
Only these sums, a fixed number of rows a task, are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.session import prepare

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as be on by not this from at or which are have has we i our would should will than they their was were you your an a but if so do does who what when there been can could must may its his her he she my me us them these those because about into over under how why no any all each more most other such only then also after before while since between within outside near nearby already still now yet per both either whether during through until against among every some many much few less just even please although without off out up down here again once too very own same don isn aren won doesn didn s t ve re ll d",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto mi antes algunos qué unos yo otro otras otra él tanto esa estos mucho ha han son está",
    "fr": "de la le les et des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son aux d l n s c qu j nous vous ils elle on mais comme si leur y dont sans être ont été cette ces sa ses même aussi tout fait très bien entre où après avant chaque notre à",
    "de": "der die das und ist in zu den von mit nicht auf für eine ein im dem des sich auch als an es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wir ich",
    "it": "di e il la che in un a per non è una del si con da le dei al come più ma della lo nel anche i gli sono alla se o dal questo ha ci delle nella",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso",
}
_LANGUAGES = tuple(FUNCTION_WORDS)
_masks: dict[str, int] = {}
for _i, _l in enumerate(_LANGUAGES):
    for _w in FUNCTION_WORDS[_l].split():
        _masks[_w] = _masks.get(_w, 0) | 1 << _i
_kinds = sorted(set(_masks.values()))
#: Word classes: 0 other words, 1 words with a digit, 2 gaps between cells (bars, tabs, wide blanks, leaders), 3 runs of symbols,
#: 4 other words of at most SHORT letters, then one class per set of languages.
FIRST, SHORT = 5, 3
_WORD = {w: FIRST + _kinds.index(m) for w, m in _masks.items()}
WORDS = FIRST + len(_kinds)
#: Character classes: 0 skipped, 1 letter, 2 unused, 3 digit, 4 blank, 5 sentence punctuation, 6 bracket or quote, 7 separator, 8 symbol.
#: Case is left out, for prose may be all in capitals.
CHARS = 9
_table = np.full(256, 8, dtype=np.uint8)
_table[ord("a") : ord("z") + 1] = 1
_table[ord("A") : ord("Z") + 1] = 1
_table[ord("0") : ord("9") + 1] = 3
_table[0xC3:0xE2] = 1
_table[0xE3:0xEE] = 1
_table[0x80:0xC0] = 0
for _c in " \n\r\f\v":
    _table[ord(_c)] = 4
for _c in ".,;:!?'-":
    _table[ord(_c)] = 5
for _c in "()\"[]{}":
    _table[ord(_c)] = 6
for _c in "\t|/\\=":
    _table[ord(_c)] = 7
PROSE = (*(f"prose_{x}" for x in _LANGUAGES), "prose_other", "prose_long")
PROFILES = (*PROSE, "list", "table", "junk")
_OTHER, _LONG, _LIST, _TABLE, _JUNK = (PROFILES.index(x) for x in ("prose_other", "prose_long", "list", "table", "junk"))
#: Most words to a sentence end, and most share of one language's function words, of lines that show prose of another language.
SENTENCE, LISTED = 40, 0.25
#: What such lines are farther from lists, tables and junk; shares of words with digits, and of brackets, separators and symbols, beyond which a line is no prose.
ENDED, NUMBERS, SYMBOLS = 0.1, 0.4, 0.25
#: Share of a neighbouring line's counts that a line borrows: wrapped prose has lines without a single function word.
BORROWED = 0.5
#: Weight of the words' divergence against the characters'.
WORD_WEIGHT = 2.0
#: Pseudo-counts of a profile, so that a class it never met is unlikely, not impossible.
SMOOTHING = 1e-3
CHUNK = 1 << 20
#: Words that a profile of prose starts from, and how they fall on words of no list, short ones, words with a digit and function words; the same of characters.
START, START_WORDS, START_OTHER, START_LONG, START_CHARS = 200.0, (0.5, 0.06, 0.02, 0.42), (0.5, 0.38, 0.02, 0.1), (0.85, 0.11, 0.02, 0.02), {1: 0.79, 3: 0.01, 4: 0.16, 5: 0.035, 6: 0.005}

#: Scripts without blanks between words: Han, kana, Thai, Lao, Myanmar, Khmer.
_UNSPACED = "\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: Marks that belong to the letter before them.
_MARKS = "\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0981-\u0983\u09bc-\u09cd\u0a01-\u0a03\u0a3c-\u0a4d\u0abc-\u0acd\u0b3c-\u0b4d\u0bbe-\u0bcd\u0c3e-\u0c4d\u0cbc-\u0ccd\u0d3e-\u0d4d"
_words = re.compile(rf"[{_UNSPACED}]|[^\W_](?:[^\W_]|[{_MARKS}])*" r"|[|\t]|\s{3,}|\.{4,}|[^\w\s.,;:!?'\"()–—’‘“”…-]{3,}").findall
#: Signs at which a sentence ends, in many scripts, and the end of one inside a line.
_sentence = re.compile(r"[^\s\d!-/:-@\[-`{-~][)\]”’\"»']*[.!?…。！？؟।॥][)\]”’\"»']*(?:\s|$|(?<=[。！？]))").findall


def _class(word: str) -> int:
    """The class of a word that is in no list."""
    if word.isalpha() or word[0].isalpha() and not word.isalnum() and not any(map(str.isdigit, word)):
        return 4 if len(word) <= SHORT else 0
    if word.isalnum():
        return 1
    return 2 if word[0] in "|\t." or word.isspace() else 3


_marked = re.compile(r"\s*(?:[-*•–·▪◦]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s").match
_leader = re.compile(r"\.{4,}|(?:\. ){4,}").search
_columns = re.compile(r"\S\s{3,}\S|\t|\|").findall


def counts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word classes, character classes and visible characters of each line."""
    n = len(lines)
    words, characters, visible = np.zeros((n, WORDS)), np.zeros((n, CHARS)), np.zeros(n)
    begin = 0
    while begin < n:
        end, size = begin, 0
        while end < n and (end == begin or size + len(lines[end]) <= CHUNK):
            size += len(lines[end])
            end += 1
        part = lines[begin:end]
        found = [_words(x.lower()) for x in part]
        get = _WORD.get
        flat = np.fromiter((k if (k := get(w)) else _class(w) for f in found for w in f), dtype=np.int64)
        owner = np.repeat(np.arange(len(part)), [len(f) for f in found])
        words[begin:end] = np.bincount(owner * WORDS + flat, minlength=len(part) * WORDS).reshape(-1, WORDS)
        raw = [x.encode() for x in part]
        kinds = _table[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(part)) * CHARS, [len(r) for r in raw])
        characters[begin:end] = np.bincount(owner + kinds, minlength=len(part) * CHARS).reshape(-1, CHARS)
        begin = end
    visible = characters[:, 1:].sum(1) - characters[:, 4]
    characters[:, 0] = 0
    return words, characters, visible


def languages(words: np.ndarray) -> np.ndarray:
    """Function words of each language in each line."""
    return np.stack([words[:, [FIRST + i for i, m in enumerate(_kinds) if m >> k & 1]].sum(1) for k in range(len(_LANGUAGES))], 1)


def unlisted(lines: list[str], words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of n texts ends sentences in lines of no listed language, often enough for its words, and whether each line may be of such prose."""
    total = words.sum(1) - words[:, 2:4].sum(1)
    open_to = (total > 0) & (words[:, 2:4].sum(1) <= 0.05 * total) & (languages(words).max(1) < LISTED * np.maximum(total, 1)) & (words[:, 1] <= 0.1 * total)
    ends = np.zeros(len(lines))
    for i in np.flatnonzero(open_to):
        if _marked(lines[i]):
            open_to[i] = False
        else:
            ends[i] = len(_sentence(lines[i]))
    own_words, own_ends = np.bincount(owner, open_to * total, n), np.bincount(owner, ends, n)
    return (own_ends > 0) & (own_words >= 4 * own_ends) & (own_words <= SENTENCE * own_ends), open_to


def seeds(lines: list[str], words: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """The profile that plain rules give a line, or -1. They are narrow: a line they leave out still gets a nearest profile."""
    total, function, short = words.sum(1) - words[:, 2:4].sum(1), words[:, FIRST:].sum(1), words[:, 4]
    size = np.maximum(characters.sum(1), 1)
    by_language = languages(words)
    kind = np.full(len(lines), -1)
    share = function / np.maximum(total, 1)
    prose = (total >= 8) & (share >= 0.22) & (words[:, 2:4].sum(1) <= 0.05 * total)
    kind[prose] = by_language[prose].argmax(1)
    digits, letters = characters[:, 3] / size, (characters[:, 1] + characters[:, 2]) / size
    celled = ~prose & (words[:, 2] >= 0.25 * total) & (words[:, 2] >= 2)
    kind[celled] = _TABLE
    for i in np.flatnonzero(~prose & ~celled & (total > 0) & (share < 0.1)):
        line = lines[i]
        if total[i] >= 8 and words[i, 2:4].sum() == 0 and letters[i] > 0.7 and digits[i] < 0.05 and not _marked(line) and 4 * (ends := len(_sentence(line))) <= total[i] <= SENTENCE * ends:
            kind[i] = _OTHER if short[i] + function[i] >= 0.25 * total[i] else _LONG
        elif _leader(line) or digits[i] > 0.12 and (len(_columns(line)) >= 2 or line.count(",") >= 3):
            kind[i] = _TABLE
        elif (_marked(line) or total[i] <= 6 and letters[i] > 0.7) and digits[i] < 0.1:
            kind[i] = _LIST
        elif total[i] >= 6 and share[i] == 0:
            kind[i] = _JUNK
    kind[(total == 0) & (size >= 20)] = _JUNK
    return kind


def divergence(counted: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of counts from each profile; rows without any count are 1 from all."""
    total = counted.sum(1, keepdims=True)
    p = counted / np.maximum(total, 1e-12)
    out = np.empty((len(p), len(profiles)))
    own = np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0).sum(1)
    for j, q in enumerate(profiles):
        m = (p + q) / 2
        out[:, j] = 0.5 * own + 0.5 * (q * np.log2(q)).sum() - (m * np.log2(m)).sum(1)
    out[total[:, 0] == 0] = 1
    return out


def borrow(counted: np.ndarray, first: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Adds part of the neighbours' counts, within a document and not across a blank line."""
    out = counted.copy()
    if len(counted) > 1:
        joined = (~first[1:] & ~blank[1:] & ~blank[:-1])[:, None]
        out[1:] += BORROWED * np.where(joined, counted[:-1], 0)
        out[:-1] += BORROWED * np.where(joined, counted[1:], 0)
    return out


def _lines(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lines, owner = [], []
    for i, text in enumerate(texts):
        own = text.splitlines() if text else []
        lines += own
        owner += [i] * len(own)
    return lines, np.array(owner, dtype=np.int64)


def learnt(df: DataFrame, text_column: str = "text") -> np.ndarray:
    """Profiles (rows of PROFILES, words then characters) from all lines of the table; those no line is a seed of stay even."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(PROFILES), WORDS + CHARS))
        for batch in batches:
            lines, _ = _lines(batch.column(0).to_pylist())
            if lines:
                words, characters, _ = counts(lines)
                kind = seeds(lines, words, characters)
                both = np.hstack([words, characters])
                for k in range(len(PROFILES)):
                    sums[k] += both[kind == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(PROFILES))), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["profile", "counts"])

    width = WORDS + CHARS
    summed = df.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "profile int, counts array<double>")
    rows = summed.groupBy("profile").agg(F.array(*(F.sum(F.get("counts", F.lit(i))) for i in range(width))).alias("counts")).collect()
    out = np.zeros((len(PROFILES), width))
    for r in rows:
        out[r[0]] = r[1]
    return normal(out)


def normal(sums: np.ndarray) -> np.ndarray:
    """Word and character parts as distributions. Prose starts from made-up counts; another profile without seeds is the mean of those that have some."""
    out = sums.astype(float).copy()
    for k in range(len(PROSE)):
        own = [FIRST + i for i, m in enumerate(_kinds) if k >= len(_LANGUAGES) or m >> k & 1]
        other, short, digit, function = START_OTHER if k == _OTHER else START_LONG if k == _LONG else START_WORDS
        out[k, [0, 4, 1]] += START * np.array([other, short, digit])
        out[k, own] += START * function / len(own)
        for c, share in START_CHARS.items():
            out[k, WORDS + c] += 5 * START * share
    seen = out.sum(1) > 0
    for part in (slice(0, WORDS), slice(WORDS, WORDS + CHARS)):
        block = out[:, part] / np.maximum(out[:, part].sum(1, keepdims=True), 1)
        prose = np.arange(len(PROFILES)) < len(PROSE)
        for k in np.flatnonzero(~seen):
            like = seen & (prose == prose[k])
            block[k] = block[like].mean(0) if like.any() else 1 / block.shape[1]
        block = block + SMOOTHING
        out[:, part] = block / block.sum(1, keepdims=True)
    return out


MEASURES = (
    "n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, punctuated_lines double, common_words double, "
    "prose_share double, list_share double, table_share double, junk_share double, divergence double, profile string"
)


def described(texts: list[str | None], profiles: np.ndarray) -> list[tuple]:
    """The measures of MEASURES for each text."""
    lines, owner = _lines(texts)
    n = len(texts)
    if lines:
        words, characters, visible = counts(lines)
        first = np.r_[True, owner[1:] != owner[:-1]]
        blank = visible == 0
        w, c = borrow(words, first, blank), borrow(characters, first, blank)
        far = (WORD_WEIGHT * divergence(w, profiles[:, :WORDS]) + divergence(c, profiles[:, WORDS:])) / (WORD_WEIGHT + 1)
        told, open_to = unlisted(lines, words, owner, n)
        shown = told[owner] & open_to
        far[~shown, _OTHER : _LONG + 1] = 1.0
        far[shown, _LIST:] += ENDED
        # what consists of numbers or symbols is no prose, whichever letters stand between them
        strange = (w[:, 1] > NUMBERS * (w.sum(1) - w[:, 2:4].sum(1))) | (c[:, 6:].sum(1) > SYMBOLS * (c.sum(1) - c[:, 4]))
        far[strange, : len(PROSE)] = 1.0
        nearest = far.argmin(1)
        group = np.where(nearest < len(PROSE), 0, nearest - len(PROSE) + 1)
        each = np.bincount(owner * 4 + group, weights=visible, minlength=n * 4).reshape(n, 4)
        best = np.bincount(owner, weights=far.min(1) * visible, minlength=n)
        by_profile = np.bincount(owner * len(PROFILES) + nearest, weights=visible, minlength=n * len(PROFILES)).reshape(n, -1)
        sums = np.zeros((n, WORDS + CHARS))
        np.add.at(sums, owner, np.hstack([words, characters]))
        ended = np.array([x.rstrip()[-1:] in ".!?:;…\"”’)" and not x.isspace() and x != "" for x in lines])
        kept = np.bincount(owner, weights=~blank, minlength=n)
        punctuated = np.bincount(owner, weights=ended & ~blank, minlength=n)
        letters = np.bincount(owner, weights=characters[:, 1] + characters[:, 2] + characters[:, 3], minlength=n)
    out = []
    for i in range(n):
        if not lines or each[i].sum() == 0:
            out.append((0, 0, None, None, None, None, None, None, None, None, None, None, "empty"))
            continue
        total, seen, size = sums[i, :WORDS].sum() - sums[i, 2:4].sum(), each[i].sum(), sums[i, WORDS:].sum()
        share = each[i] / seen
        k = int(share.argmax())
        name = PROFILES[int(by_profile[i, : len(PROSE)].argmax())] if share[0] >= 0.5 else ("list", "table", "junk")[k - 1] if k else ("list", "table", "junk")[int(share[1:].argmax())]
        row = (
            letters[i] / total if total else None, sums[i, WORDS + 8] / size, sums[i, WORDS + 3] / size, punctuated[i] / kept[i],
            sums[i, FIRST:WORDS].sum() / total if total else None, *share, best[i] / seen,
        )
        out.append((int(total), int(kept[i]), *(None if x is None else round(float(x), 6) for x in row), name))
    return out


def quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", profiles: np.ndarray | None = None) -> DataFrame:
    """One row per row of df: its id and MEASURES; profile names the structure of most visible characters.

    Null, empty and blank texts have 0 words, null ratios and the profile `empty`. At a tie between prose and the rest
    the text is prose. Texts are taken whole. No shuffle: two maps, between which only the sums of the profiles are gathered.
    """
    profiles = learnt(df, text_column) if profiles is None else profiles
    source = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    fields = [f.split() for f in MEASURES.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = described(batch.column(1).to_pylist(), profiles)
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields))], names=["doc_id", *(f for f, _ in fields)])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
