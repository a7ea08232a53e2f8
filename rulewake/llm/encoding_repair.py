"""Text that was decoded with the wrong character encoding.

A chain encodes the text with one encoding and decodes the bytes with another. Where the bytes were UTF-8, only runs that are
valid sequences are decoded, once or twice, so a text with one garbled spot among characters shown rightly is restored there
alone; where they were of another legacy encoding, a whole run of characters is. Numeric character references are resolved
first. Every chain that changes a spot is scored in its context by a smoothed character trigram model of the clean records,
and the likeliest is accepted if its gain exceeds a margin, validated for each family of chains on all clean records garbled on
purpose. References and replacement characters are kinds of their own: the former need no decision, and what the latter stood
for is lost.

The model counts all trigrams of all clean records in a table of fixed size, addressed by a hash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.session import prepare

#: Legacy encodings by which UTF-8 bytes may have been read, and those whose bytes may have been read by another of them.
ENCODINGS = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman")
WRITTEN = (*ENCODINGS, "koi8-r", "cp866", "cp1253")
#: Characters of context on each side of a changed spot that are scored with it.
CONTEXT = 3
#: Cells of the tables of trigrams, bigrams and characters; additive smoothing; steps per unit in which gains and scores are counted.
CELLS, ALPHA, STEPS = (1 << 20, 1 << 18, 1 << 16), 0.05, 1000
#: Where the margins lie between the gains of clean texts (0) and of texts garbled on purpose (1), for UTF-8 bytes and for others.
NEAR, NEAR_OTHER = 0.1, 0.5
#: Characters in a run from which on it may be a word of another legacy encoding.
RUN = 3
#: Distinct spots a worker remembers the decision on, and trigrams it remembers the probability of; the memory changes no result.
REMEMBERED = 100_000


def _byte_of(encoding: str) -> dict[str, int]:
    """Character to byte for the upper half; bytes without a character stand for the control of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


BYTES = {e: _byte_of(e) for e in ENCODINGS}
_CHARS = {e: {b: c for c, b in m.items()} for e, m in BYTES.items()}
_CHARS_OF = {e: {b: c for c, b in _byte_of(e).items()} for e in WRITTEN}


def _set(characters) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in sorted(characters))


#: One lead byte and one continuation byte next to each other in some encoding, a replacement character, or a reference to a character beyond ASCII.
_PAIRS = "|".join(f"[{_set(c for c, b in m.items() if 0xC2 <= b <= 0xF4)}][{_set(c for c, b in m.items() if b < 0xC0)}]" for m in BYTES.values())
REFERENCE = r"&#(?:1[2-9]\d|[2-9]\d\d|\d{4,6});"
SUSPICIOUS = f"{_PAIRS}|\\ufffd|{REFERENCE}"
BEYOND_ASCII = r"[^\x00-\x7f]"
#: What every suspicious text matches; a plain class that the JVM tests fast.
MAYBE = r"[^\x00-\x7f]{2}|\x{fffd}|&#\d{3}|\x{00c3} "
_suspicious = re.compile(SUSPICIOUS).search
_odd = re.compile(r"[^\x00-\x7f]{%d}|\u00c3 " % RUN).search
_reference = re.compile(r"&#(\d{3,6});")
_sequences = {
    e: re.compile("|".join(f"[{_set(c for c, b in m.items() if low <= b <= high)}]" + f"[{_set(c for c, b in m.items() if b < 0xC0)}]{{{n}}}" for low, high, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))))
    for e, m in BYTES.items()
}
_around = re.compile(r"[^\x00-\x7f]")


def unreferenced(text: str) -> str:
    """Numeric references to characters beyond ASCII, resolved."""
    return _reference.sub(lambda m: chr(n) if 127 < (n := int(m[1])) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0], text)


def reread(text: str, encoding: str) -> str:
    """The text with every run that is valid UTF-8 in the encoding decoded; the same text where there is none."""
    m = BYTES[encoding]

    def one(found: re.Match) -> str:
        try:
            return bytes(m[c] for c in found[0]).decode()
        except UnicodeDecodeError:
            return found[0]

    return _sequences[encoding].sub(one, text)


def garbled(text: str, encoding: str) -> str:
    """What the text looks like if its UTF-8 bytes are read in the encoding."""
    m = _CHARS[encoding]
    return "".join(c if c < "\x80" else "".join(m[b] for b in c.encode()) for c in text)


def written(text: str, read: str, wrote: str) -> str | None:
    """The text if its bytes, read as one legacy encoding, were of another; None where some character is not of the first or stays undefined."""
    m = BYTES[read]
    if not all(c < "\x80" or c in m for c in text):
        return None
    out = "".join(c if c < "\x80" else _CHARS_OF[wrote].get(m[c], "\ufffd") for c in text)
    return None if "\ufffd" in out or any("\x80" <= c < "\xa0" for c in out) else out


def legacy(text: str) -> dict[str, str]:
    """Chain to text for every pair of legacy encodings, for a run long enough to be a word; single characters tell too little."""
    out: dict[str, str] = {}
    if sum(c > "\x7f" for c in text) < RUN:
        return out
    for read in ENCODINGS:
        for wrote in WRITTEN:
            if wrote != read and (other := written(text, read, wrote)) not in (None, text) and other not in out.values():
                out[f"{read}<{wrote}"] = other
    return out


def candidates(text: str) -> dict[str, str]:
    """Chain to text, for every chain that changes the text."""
    out: dict[str, str] = {}
    plain = unreferenced(text)
    if plain != text:
        out["references"] = plain
    for first in ENCODINGS:
        once = reread(plain, first)
        if once == plain:
            continue
        out[first] = once
        for second in ENCODINGS:
            if (twice := reread(once, second)) != once:
                out[f"{first}+{second}"] = twice
    if plain.endswith("\u00c3 "):  # the second byte is a blank that doesn't break, and was made a plain one
        out["cp1252+blank"] = reread(plain[:-2], "cp1252") + "\u00e0"
    return out


def grams(text: str) -> Counter:
    """Trigrams that hold a character beyond ASCII, with the blanks around the text and case folded."""
    t = f"  {text.lower()}  "
    found: Counter = Counter()
    done = -1
    for m in _around.finditer(t):
        for i in range(max(done + 1, m.start() - 2, 0), min(m.start() + 1, len(t) - 2)):
            found[t[i : i + 3]] += 1
            done = i
    return found


def cells(counted: dict[str, float]) -> list[dict[int, float]]:
    """Cell to count of the trigrams, bigrams and characters of trigrams with their counts."""
    out: list[dict[int, float]] = [Counter(), Counter(), Counter()]
    for g, n in counted.items():
        out[0][_cell(g, 0)] += n
        for x in (g[:2], g[1:]):
            out[1][_cell(x, 1)] += n
        for c in g:
            out[2][_cell(c, 2)] += n
    return out


def _cell(gram: str, table: int) -> int:
    return zlib.crc32(gram.encode(errors="replace")) & CELLS[table] - 1


@dataclass
class Model:
    """log P of trigrams by interpolation of trigram, bigram and character shares; the margins are the gains that chains of UTF-8 and of other bytes must exceed, and least_other what a text restored by the latter must score."""

    three: np.ndarray
    two: np.ndarray
    one: np.ndarray
    total: float
    margin: float = 0.0
    margin_other: float = math.inf
    least_other: float = 0.0
    known: dict = field(default_factory=dict, repr=False, compare=False)
    logs: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, counted: dict[str, float]) -> Model:
        return cls.from_cells(cells(counted))

    @classmethod
    def from_cells(cls, each: list[dict[int, float]]) -> Model:
        tables = []
        for size, own in zip(CELLS, each):
            t = np.zeros(size, dtype=np.float32)
            t[np.fromiter(own, dtype=np.int64, count=len(own))] = np.fromiter(own.values(), dtype=np.float32, count=len(own))
            tables.append(t)
        return cls(*tables, total=max(1.0, float(sum(each[0].values()))))

    def log(self, gram: str) -> float:
        if gram not in self.logs:
            if len(self.logs) >= REMEMBERED:
                self.logs.clear()
            self.logs[gram] = self._log(gram)
        return self.logs[gram]

    def _log(self, gram: str) -> float:
        n = self.total
        one = [float(self.one[_cell(c, 2)]) for c in gram]
        character = math.prod((x + ALPHA) / (3 * n + 70_000 * ALPHA) for x in one)
        pairs = (float(self.two[_cell(gram[:2], 1)]) / (2 * n)) * (float(self.two[_cell(gram[1:], 1)]) / (2 * n)) / ((one[1] + ALPHA) / (3 * n))
        return math.log(0.8 * float(self.three[_cell(gram, 0)]) / n + 0.15 * pairs + 0.05 * character)

    def score(self, text: str) -> float:
        """Mean log probability of the trigrams with a character beyond ASCII; a text without any needs no such trigram."""
        found = grams(text)
        n = sum(found.values())
        return sum(k * self.log(g) for g, k in found.items()) / n if n else math.log(1 / self.total) / 2

    def best(self, text: str, left: str = "", right: str = "", other: bool = False) -> tuple[str, str, float] | None:
        """(chain, text, gain) of the likeliest chain, or None where none changes the text. At a tie the shorter chain stands first.
        left and right are context that stays; other: chains between legacy encodings instead of those of UTF-8 bytes."""
        own, best = None, None
        for chain, new in (legacy if other else candidates)(text).items():
            own = self.score(left + unreferenced(text) + right) if own is None else own
            gain = self.score(left + new + right) - own
            if best is None or gain > best[2] + 1e-9:
                best = (chain, new, gain)
        return best

    def accepted(self, text: str, left: str, right: str) -> tuple[str, str, float] | None:
        """The chain that passes for a spot: one of UTF-8 bytes, else references, else one between legacy encodings."""
        key = (left, text, right)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.best(text, left, right)
            if found and (found[2] > self.margin or found[0] == "references"):
                self.known[key] = found
            else:
                # the words next to a garbled one are garbled too: only what is ASCII next to it is context
                left, right = _around.split(left)[-1], _around.split(right)[0]
                found = self.best(text, left, right, True)
                self.known[key] = found if found and found[2] > self.margin_other and self.score(left + found[1] + right) >= self.least_other else None
        return self.known[key]


def _long(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    return df.select(F.col(id_column).cast("string").alias("id"), *(F.col(f).cast("string").alias(f) for f in fields)).unpivot("id", fields, "field", "text").filter("id IS NOT NULL AND text IS NOT NULL")


def trained(df: DataFrame, id_column: str, fields: list[str]) -> Model:
    """The model of all clean records (those with characters beyond ASCII and nothing suspicious), and its margins, validated on all of them."""
    prepare(df.sparkSession)
    beyond = _long(df, id_column, fields).filter(F.octet_length("text") > F.length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not _suspicious(text):
                    total.update(grams(text))
        each = [(k, cell, n) for k, own in enumerate(cells(total)) for cell, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in each], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["part", "cell", "n"])

    summed = beyond.select("text").mapInArrow(run, "part int, cell bigint, n double").groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most sum(CELLS) rows
    each: list[dict[int, float]] = [{} for _ in CELLS]
    for part, cell, n in zip(*(summed.column(i).to_pylist() for i in range(3))):
        each[part][cell] = n
    model = Model.from_cells(each)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Validation()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not _suspicious(text):
                    own.add(shared.value, text)
        counted = own.counts()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in counted], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["kind", "step", "n"])

    # copies count once; what comes back are counts by step, as many as there are steps between the least and the greatest gain
    steps = beyond.select("text").distinct().mapInArrow(tried, "kind string, step bigint, n bigint").groupBy("kind", "step").agg(F.sum("n").alias("n")).toArrow()
    whole = Validation()
    for kind, step, n in zip(*(steps.column(i).to_pylist() for i in range(3))):
        whole.kinds[kind][step] += n
    model.margin, (model.margin_other, model.least_other) = whole.margin(), whole.margin_other()
    return model


def _spots_of(text: str) -> Iterator[tuple[str, str, str]]:
    for m in _spot.finditer(text):
        yield m[0], text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]


class Validation:
    """Gains of chains over clean texts (`false`) and the same texts garbled on purpose (`true`), for both families of chains, and the scores
    of clean words, each counted by steps of 1 / STEPS."""

    def __init__(self):
        self.kinds: dict[str, Counter] = {k: Counter() for k in ("false", "true", "false_other", "true_other", "score")}

    def add(self, model: Model, text: str) -> None:
        """A clean text as it is, and garbled: as a whole by one encoding read as another, and its words by pairs of legacy encodings, in turn."""
        self._whole(model, text)
        self._words(model, text)

    def counts(self) -> list[tuple[str, int, int]]:
        return [(k, step, n) for k, own in self.kinds.items() for step, n in own.items()]

    def _whole(self, model: Model, text: str) -> None:
        if b := model.best(text):
            self._count("false", b[2])
        # which encoding is the text's own matter, so that it depends neither on order nor on partitions
        bad = garbled(text, ENCODINGS[zlib.crc32(text.encode(errors="replace")) % len(ENCODINGS)])
        if bad != text and (b := model.best(bad)):
            self._count("true", b[2])

    def _words(self, model: Model, text: str) -> None:
        for i, (run, left, right) in enumerate((r, _around.split(a)[-1], _around.split(b)[0]) for r, a, b in _spots_of(text)):
            if b := model.best(run, left, right, True):
                self._count("false_other", b[2])
            if sum(c > "\x7f" for c in run) >= RUN:
                self._count("score", model.score(left + run + right))
                for wrote, read in (("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp437", "cp1252"), ("mac_roman", "latin-1"))[i % 4 :: 4]:
                    try:
                        bad = run.encode(wrote).decode(read)
                    except UnicodeError:
                        continue
                    if bad != run and (b := model.best(bad, left, right, True)) and b[1] == run:
                        self._count("true_other", b[2])

    def _count(self, kind: str, value: float) -> None:
        self.kinds[kind][math.floor(value * STEPS)] += 1

    def _at(self, kind: str, part: int) -> float:
        """The value below which one part in so many lies; the lower end of its step."""
        own, rank = self.kinds[kind], sum(self.kinds[kind].values()) // part
        for step in sorted(own):
            rank -= own[step]
            if rank < 0:
                return step / STEPS
        return 0.0

    def _high(self, kind: str) -> float:
        """The upper end of the highest step, so that no clean text lies above."""
        return (max(self.kinds[kind]) + 1) / STEPS if self.kinds[kind] else 0.0

    def margin(self) -> float:
        """The margin above the gains of the clean texts' own chains, which must not pass, by a part of the way to those of the same texts garbled.

        It lies near the lower end, since a single garbled spot gains less than a whole garbled text.
        """
        if not self.kinds["true"]:
            return 0.0
        low, high = self._at("true", 100), self._high("false")
        return max(0.0, high + NEAR * (low - high) if low > high else min(low, high))

    def margin_other(self) -> tuple[float, float]:
        """The margin of chains between legacy encodings, above every gain of a spot of the clean texts and half of the way to the
        lowest of those of words garbled on purpose, and the score that nine of ten clean words reach. Without any such word that the
        model restores, nothing passes."""
        if not self.kinds["true_other"]:
            return math.inf, 0.0
        high, low = max(0.0, self._high("false_other")), self._at("true_other", 20)
        return high + NEAR_OTHER * (low - high) if low > high else high + abs(high) * NEAR, self._at("score", 10)


def validated_other(model: Model, clean: list[str]) -> tuple[float, float]:
    """The margin of chains between legacy encodings and the least score, from clean texts."""
    own = Validation()
    for text in clean:
        own._words(model, text)
    return own.margin_other()


def validated(model: Model, clean: list[str]) -> float:
    """The margin of chains of UTF-8 bytes, from clean texts."""
    own = Validation()
    for text in clean:
        own._whole(model, text)
    return own.margin()


def examined(df: DataFrame, id_column: str, fields: list[str], model: Model | None = None) -> DataFrame:
    """(id, field, kind, chain, restored, gain) of every garbled value. kind is `decoded`, `references` where only numeric references
    were resolved, or `lost` where only replacement characters show it; chain and gain are null for the last.

    Values without anything suspicious never leave the JVM. Null values and null ids are no cases. A repeated row comes out once.
    """
    model = trained(df, id_column, fields) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    rows = _long(df, id_column, fields).filter(((F.octet_length("text") > F.length("text")) | F.col("text").contains("&#")) & F.col("text").rlike(MAYBE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, f, text in zip(b["id"], b["field"], b["text"]):
                if (_suspicious(text) or _odd(text)) and (found := spots(text, shared.value)):
                    chain, restored, gain = found
                    out.append((i, f, "lost" if chain is None else "references" if chain == "references" else "decoded", chain, restored, gain))
            yield pd.DataFrame(out, columns=["id", "field", "kind", "chain", "restored", "gain"])

    return rows.mapInPandas(run, "id string, field string, kind string, chain string, restored string, gain double").distinct()


_spot = re.compile(f"(?:{BEYOND_ASCII}|{REFERENCE})+(?:(?<=\u00c3) (?= ))?")


def spots(text: str, model: Model) -> tuple[str | None, str, float | None] | None:
    """(chain, restored text, gain) of a text in which some spot is garbled, else None. Each run beyond ASCII is judged with its context."""
    chains: Counter = Counter()
    gains: list[float] = []
    pieces, at = [], 0
    for m in _spot.finditer(text):
        left, right = text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        found = model.accepted(m[0], left, right)
        pieces.append(text[at : m.start()])
        at = m.end()
        if found:
            chains[found[0]] += 1
            gains.append(found[2])
        pieces.append(found[1] if found else m[0])
    if not chains and "\ufffd" not in text:
        return None
    return (max(sorted(chains), key=chains.get) if chains else None, "".join(pieces) + text[at:], round(sum(gains) / len(gains), 6) if gains else None)
