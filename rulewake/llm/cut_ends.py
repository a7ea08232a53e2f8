"""Texts that lost their end at a field limit or in transfer.

Limits (`how` is `limit`): per source and column, the histogram of the lengths of distinct texts, in characters and in bytes,
is searched for peaks: lengths that stand far above their neighbours and where most texts lack terminal punctuation. A
source may have had several limits, so each peak is tested, not only one at the greatest length. Texts of such a length
without terminal punctuation are cut.

Transfer (`how` is `end`): a text may break off at any length, which no histogram shows. Its last words are then judged by an end model:
how often the corpus ends a sentence after them, by interpolated n-gram counts, and whether the last word is an unseen
beginning of words that follow the word before it. The model counts the n-grams of all texts, whose sentence boundaries are
its labels. A text counts as often as it occurs: an end that many share was not lost in transfer, which cuts anywhere. Counts
are held per MODEL_TEXTS texts, so that the bounds on them mean the same in a table of any size, and an n-gram below one of
these is unseen: so the model's size is bounded, and a cut text's own end can't vouch for it. Terminal punctuation, and a mark put after the cut, are stripped or judged first.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewake.llm.encoding_repair import ENCODINGS, reread, unreferenced
from rulewake.session import discard, prepare, stored

#: Texts per which the end model states its counts, where a table has more, and the longest n-gram it counts.
MODEL_TEXTS, ORDER = 6000, 5
#: Occurrences per MODEL_TEXTS texts below which a word is any name; strength of the shorter context; end probability below which a text is cut.
KNOWN, STRENGTH, CUT = 8, 3.0, 0.06
#: Times that longer words must outnumber a last word after the same predecessor, for some of the texts that are counted are cut too.
BROKEN = 10
#: A limit: this many distinct texts more than this many times the mean of the lengths nearby, and this share of them unterminated.
LEAST, TIMES, NEARBY, UNTERMINATED = 8, 4.0, 20, 0.5
#: Characters of the end that the end model may look at: more words than its longest n-gram.
TAIL = 600
#: Characters in which terminal punctuation or a mark is looked for.
END = 48

_LABEL = r"[^\W\d_][\w '’/-]{1,30}?\s*[:=]"
_token = re.compile(
    r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d(?:[\d.,/:–-]*\d)?|[.!?…]+[)\]”»\"’]*|\n\s*\n|\n\s*(?=[-*•—–])|\n\s*(?=" + _LABEL + r")|[;|]\s*(?=" + _LABEL + r")|[:=]"
)
_mark = re.compile(r"(?:\s*(?:[\[(<]\s*(?:\.{2,}|…|[a-z ,.]{0,12}(?:truncated|cut|cont|more|snip)[a-z ,.]{0,12})\s*[\])>]|\.{3,}|…|-{2,}))+\s*$", re.IGNORECASE)
_terminal = re.compile(r"[.!?。؟][)\]”’\"»'\s]*$")
#: For the JVM: no terminal punctuation at the end, or a mark that may stand for a lost end.
OPEN_END = r"[^.!?\s)\]”’\"»'][)\]”’\"»'\s]*$|(?:\.{3,}|…)[\])>\s]*$|\[[^\]]{0,30}\]\s*$|[)\]”’\"»']\s*$|\s{40}$"
_END = "</s>"
_NAME = "^"


def shape(token: str) -> str:
    """Lower-case words; numbers by kind, since their digits tell nothing."""
    if token[0].isdigit():
        return "#year" if len(token) == 4 and token.isdigit() else "#int" if token.isdigit() else "#other"
    return token.lower()


def tokens(text: str) -> list[str]:
    """Words and sentence ends. A stop before a lower-case word or a digit ends no sentence; a line break does before a blank line, a list item or a labelled field."""
    out, n = [], len(text)
    for m in _token.finditer(text):
        t = m[0]
        if t[0].isalnum():
            out.append(shape(t))
        elif t[0] in ".!?…":
            after = text[m.end() : m.end() + 4].lstrip()[:1]
            if not after or text[m.end()].isspace() and not (after.islower() or after.isdigit()) or m.end() == n:
                out.append(_END)
        elif t in ":=":
            out.append(":")
        else:
            out.append(_END)
    return out


@dataclass
class Ends:
    """n-gram counts, and how many of them stand before a sentence end."""

    known: list[str] = field(default_factory=list)
    seen: dict[tuple, float] = field(default_factory=dict)
    ended: dict[tuple, float] = field(default_factory=dict)
    suffixes: dict[str, float] = field(default_factory=dict)
    share: float = 0.1

    @classmethod
    def of(cls, texts: list[str]) -> Ends:
        lines = [tokens(t) for t in texts]
        words: Counter = Counter(w for line in lines for w in line)
        known = {w for w, n in words.items() if n >= KNOWN}
        seen: Counter = Counter()
        ended: Counter = Counter()
        suffixes: Counter = Counter()
        for line in lines:
            for w in line[:-1]:
                if w not in known:
                    suffixes[w[-3:]] += 1
            x = ["<s>", *(w if w in known else _NAME for w in line)]
            if x[-1] != _END:
                x.append(_END)
            for i in range(1, len(x)):
                if x[i - 1] in (_END, "<s>"):
                    continue
                end = x[i] == _END
                for n in range(1, min(ORDER, i) + 1):
                    g = tuple(x[i - n : i])
                    seen[g] += 1
                    if end:
                        ended[g] += 1
                    if g[0] in (_END, "<s>"):
                        break
        single = [(n, ended[g]) for g, n in seen.items() if len(g) == 1]
        return cls(sorted(known), dict(seen), dict(ended), dict(suffixes), sum(e for _, e in single) / max(1, sum(n for n, _ in single)))

    def broken(self, line: list[str], name: bool) -> bool:
        """Whether the last word is the beginning of another word: longer ones far outnumber it after the word before, or it is written as a name and no name ends as it does."""
        word = line[-1]
        if not word.isalpha():
            return False
        before = line[-2] if len(line) > 1 else "<s>"
        before = before if before in ("<s>", _END) or self._knows(before) else _NAME
        own = self.seen.get((before, word), 0) if self._knows(word) else 0
        longer, i = 0, bisect.bisect_left(self.known, word)
        while i < len(self.known) and self.known[i].startswith(word):
            if self.known[i] != word:
                longer += self.seen.get((before, self.known[i]), 0)
            i += 1
        if own or longer:
            usual = self.seen.get(tuple(line[-3:]), 0) >= KNOWN and self.end(line) > 0.5  # a known end of more words than one
            return longer > BROKEN * own and not usual
        return name and not self._knows(word) and bool(self.suffixes) and self.suffixes.get(word[-3:], 0) < 2

    def _knows(self, word: str) -> bool:
        i = bisect.bisect_left(self.known, word)
        return i < len(self.known) and self.known[i] == word

    def end(self, line: list[str]) -> float:
        """Probability that a sentence ends after the words."""
        x = ["<s>", *(w if w == _END or self._knows(w) else _NAME for w in line)]
        p = self.share
        for n in range(1, min(ORDER, len(x)) + 1):
            g = tuple(x[-n:])
            count = self.seen.get(g, 0)
            if not count:
                if n == 2 and self.seen.get(g[:-1], 0) >= 20:
                    p *= 0.2
                break
            p = (self.ended.get(g, 0) + STRENGTH * p) / (count + STRENGTH)
            if g[0] in (_END, "<s>"):
                break
        return p


def repaired(text: str) -> str:
    """The end with garbled characters read again, so that they don't pass for unknown words."""
    text = unreferenced(text)
    for _ in range(2):
        if text.isascii():
            break
        # of the encodings under which some run is valid, the one that covers most characters
        tried = [reread(text, e) for e in ENCODINGS]
        text = min(tried, key=len)
    return text


def own_block(text: str) -> bool:
    """Whether the end is a list item or a labelled field. Greetings and signatures are ends the model has learnt."""
    head, _, last = text.rstrip().rpartition("\n")
    last = last.strip()
    if re.match(r"(?:[-*•–—·]|\d{1,3}[.)])\s", last):
        return True
    piece = re.split(r"[;|]\s*(?=" + _LABEL + ")", last)[-1].strip()
    labelled = re.match(_LABEL + r"\s*(.*)$", piece)
    return bool(labelled) and len(labelled[1].split()) <= 8 and (bool(head) or piece != last)


def lost(tail: str, limit: bool, ends: Ends) -> bool:
    """Whether a text with this end lost more of it; limit: its length is a limit of its source."""
    return how_lost(tail, limit, ends) is not None


def how_lost(tail: str, limit: bool, ends: Ends) -> str | None:
    """`limit` or `end`, by which a text with this end is seen to be cut; None where it is complete."""
    text = repaired(tail).rstrip()
    bare = _mark.sub("", text)
    if not bare.strip() or _terminal.search(bare):
        return None
    return "limit" if limit else "end" if _broken_off(bare, ends) else None


def _broken_off(bare: str, ends: Ends) -> bool:
    """Whether the end model takes the last words for no end. A text of a single word is no sentence to be broken off."""
    line = tokens(bare)
    while line and line[-1] in (_END, ":"):
        line.pop()
    if not line or len(bare.split()) < 2 or re.search(r"https?://\S+$|\S@\S+$", bare) or bare[-1] in ")]":
        return False
    last = re.search(r"([^\W\d_]+)\W*$", bare)
    if ends.broken(line, bool(last) and last[1][0].isupper() and not last[1].isupper()):
        return True
    return ends.end(line) < CUT and not own_block(bare)


def rows(df: DataFrame, id_column: str, text_columns: list[str], source_column: str) -> DataFrame:
    """(id, source, field, text) of all texts that are not blank."""
    each = df.select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(source_column).cast("string"), F.lit("(none)")).alias("source"), *(F.col(c).cast("string").alias(f"text_{i}") for i, c in enumerate(text_columns)))
    if len(text_columns) == 1:
        long = each.select("id", "source", F.lit(text_columns[0]).alias("field"), F.col("text_0").alias("text"))
    else:
        long = each.select("id", "source", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"text_{i}").alias("text")) for i, c in enumerate(text_columns)))).alias("x")).select("id", "source", "x.*")
    return long.filter("id IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0")


def measured(texts: DataFrame) -> DataFrame:
    """(id, source, field, char, byte, h, open, tail): lengths and hash of each text, whether its end is open, and the end if so. All that later steps read."""
    near = F.substring("text", -END, END)
    open_end = near.rlike(OPEN_END)
    return texts.select(
        "id", "source", "field", F.length("text").alias("char"), F.octet_length("text").alias("byte"), F.xxhash64("text").alias("h"), open_end.alias("open"), F.when(open_end, F.substring("text", -TAIL, TAIL)).alias("tail")
    )


def limits(lengths: DataFrame) -> DataFrame:
    """(source, field, unit, length, n_texts, open_share): lengths in `char` or `byte` at which a source cuts a column, from measured()."""
    each = lengths.select("source", "field", "char", "byte", "h", F.col("open").cast("int").alias("open")).distinct()
    long = each.select("source", "field", "open", F.explode(F.create_map(F.lit("char"), "char", F.lit("byte"), "byte")).alias("unit", "length"))
    histogram = long.groupBy("source", "field", "unit", "length").agg(F.count("*").alias("n_texts"), F.avg("open").alias("open_share"))
    near = Window.partitionBy("source", "field", "unit").orderBy("length").rangeBetween(-NEARBY, NEARBY)
    around = (F.sum("n_texts").over(near) - F.col("n_texts")) / (2 * NEARBY)
    return histogram.withColumn("around", around).filter((F.col("n_texts") >= LEAST + TIMES * F.col("around")) & (F.col("open_share") >= UNTERMINATED)).drop("around")


#: Numbers of what is no word: the beginning of a text, a sentence end, a name. Words that are known come after them.
_BEGIN, _STOP, _ANY = 0, 1, 2
#: Tokens that are counted together in a task before their n-grams are passed on.
TOGETHER = 1 << 20


@lru_cache(200_000)
def _number(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as the numbers of its tokens, and, in rows of their own, the words with their number and that of those that don't end a text."""
    schema = pa.schema([("line", pa.binary()), ("word", pa.string()), ("n", pa.int64()), ("inner", pa.int64())])
    words: Counter = Counter()
    last: Counter = Counter()
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            line = tokens(text)
            words.update(line)
            last.update(line[-1:])
            out.append(np.array([_number(w) for w in line], dtype=np.int64).tobytes())
        yield pa.RecordBatch.from_pydict({"line": out, "word": [None] * len(out), "n": [None] * len(out), "inner": [None] * len(out)}, schema)
    yield pa.RecordBatch.from_pydict({"line": [None] * len(words), "word": [w.encode(errors="replace").decode() for w in words], "n": list(words.values()), "inner": [n - last[w] for w, n in words.items()]}, schema)


def _ngrams(ids: np.ndarray, orders: range, kept: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, seen, ended) of each order, from the ids of texts that begin with _BEGIN and end with _STOP. None goes beyond the
    beginning of its sentence. kept: hashes of the trigrams that an n-gram above them must be made of."""
    edge = ids <= _STOP
    ended = np.append(ids[1:] == _STOP, False)
    valid, whole = ~edge, None
    for n in range(1, min(max(orders), len(ids)) + 1):
        if n > 1:  # all words but the first are none of an edge
            valid = valid & np.append(np.zeros(n - 1, dtype=bool), ~edge[1 : len(ids) - n + 2])
        if n > 3 and whole is not None:
            valid = valid & whole & np.append(np.zeros(n - 3, dtype=bool), whole[: len(ids) - n + 3])
        if n not in orders and n != 3:
            continue
        at = np.flatnonzero(valid)
        grams = np.lib.stride_tricks.sliding_window_view(ids, n)[at - n + 1]
        h = _hashed(grams)
        if n == 3 and kept is not None:
            whole = np.zeros(len(ids), dtype=bool)
            whole[at] = np.isin(h, kept)
        if n in orders and len(at):
            _, first, own = np.unique(h, return_index=True, return_inverse=True)
            yield grams[first], np.bincount(own), np.bincount(own, weights=ended[at]).astype(np.int64)


def _hashed(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(grams), grams.shape[1], dtype=np.uint64)
    for k in range(grams.shape[1]):
        out = (out ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


_PARTS = [f"g{k}" for k in range(ORDER)]


def _counted(lines: DataFrame, numbers: np.ndarray, orders: range, least: float, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, seen, ended) of the orders that are met `least` times, filled up with -1, and in a first row of -1 alone the sum of all single words."""
    order = np.argsort(numbers)
    shared = lines.sparkSession.sparkContext.broadcast((numbers[order], order, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, place, trigrams = shared.value
        stop, begin, end = _number(_END), np.array([_BEGIN]), np.array([_STOP])

        def passed(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for grams, seen, ended in _ngrams(np.concatenate(pieces), orders, trigrams):
                columns = [grams[:, k] if k < grams.shape[1] else np.full(len(grams), -1) for k in range(ORDER)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(seen, pa.int64()), pa.array(ended, pa.int64())], names=[*_PARTS, "seen", "ended"])
                if grams.shape[1] == 1:
                    yield pa.RecordBatch.from_arrays([*(pa.array([-1], pa.int32()) for _ in _PARTS), pa.array([seen.sum()], pa.int64()), pa.array([ended.sum()], pa.int64())], names=[*_PARTS, "seen", "ended"])

        pieces, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                line = np.frombuffer(raw, dtype=np.int64)
                ids = np.full(len(line), _ANY)
                if len(ranked):
                    i = np.minimum(np.searchsorted(ranked, line), len(ranked) - 1)
                    ids = np.where(ranked[i] == line, place[i] + _ANY + 1, _ANY)
                ids[line == stop] = _STOP
                pieces += [begin, ids, end if not len(ids) or ids[-1] != _STOP else end[:0]]
                size += len(ids) + 2
            if size > TOGETHER:
                yield from passed(pieces)
                pieces, size = [], 0
        if pieces:
            yield from passed(pieces)

    schema = ", ".join(f"{g} int" for g in _PARTS) + ", seen bigint, ended bigint"
    sums = lines.mapInArrow(run, schema).groupBy(*_PARTS).agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    got = sums.filter((F.col("seen") >= least) | (F.col("g0") < 0)).toArrow()  # the bound on their number follows from `least`
    return np.stack([got[g].to_numpy() for g in _PARTS], 1), got["seen"].to_numpy(), got["ended"].to_numpy()


def fitted(texts: DataFrame) -> Ends:
    """The end model of all texts. Its words and n-grams are those met often enough per MODEL_TEXTS texts, so their number doesn't grow with the table."""
    all_rows = stored(texts.select("text").mapInArrow(_tokenised, "line binary, word string, n bigint, inner bigint"), "text-words")
    lines = all_rows.filter("line IS NOT NULL").select("line")
    scale = max(1.0, lines.count() / MODEL_TEXTS)
    words = all_rows.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner"))
    frequent = F.col("n") >= KNOWN * scale
    known = sorted(r[0] for r in words.filter(frequent).select("word").collect())
    rare = words.filter(~frequent).groupBy(F.expr("right(word, 3)").alias("suffix")).agg(F.sum("inner").alias("n")).filter(F.col("n") >= scale)
    suffixes = {r[0]: r[1] / scale for r in rare.collect()}
    numbers = np.array([_number(w) for w in known], dtype=np.int64)
    few = _counted(lines, numbers, range(1, 4), scale)
    trigrams = few[0][(few[0][:, 2] >= 0) & (few[0][:, 3] < 0)][:, :3]
    many = _counted(lines, numbers, range(4, ORDER + 1), scale, np.sort(_hashed(trigrams)))
    discard(all_rows)
    names = ["<s>", _END, _NAME, *known]
    out = Ends(known, suffixes=suffixes)
    for grams, seen, ended in (few, many):
        for g, n, e in zip(grams.tolist(), seen.tolist(), ended.tolist()):
            if g[0] < 0:
                out.share = e / max(1, n)
                continue
            key = tuple(names[x] for x in g if x >= 0)
            out.seen[key] = n / scale
            if e:
                out.ended[key] = e / scale
    return out


def judged(df: DataFrame, id_column: str, text_columns: list[str], source_column: str) -> tuple[DataFrame, DataFrame]:
    """(lengths, cut): measured() of all texts, and (id, source, field, how) of the cut ones; a repeated row comes out once.

    The texts are read once for their measures and once for the words of the end model, both written to the shared folder. Only texts with an open end reach Python, and of them only the end.
    """
    spark = df.sparkSession
    prepare(spark)
    texts = rows(df, id_column, text_columns, source_column)
    lengths = stored(measured(texts), "text-ends")
    ends = spark.sparkContext.broadcast(fitted(texts))  # its size doesn't grow with the table
    at = limits(lengths)
    chars = at.filter("unit = 'char'").select("source", "field", F.col("length").alias("char"), F.lit(True).alias("char_limit"))
    octets = at.filter("unit = 'byte'").select("source", "field", F.col("length").alias("byte"), F.lit(True).alias("byte_limit"))
    # the limits are a few rows per source, far below any broadcast bound; AQE decides by their measured size
    candidates = lengths.filter("open").select("id", "source", "field", "char", "byte", "tail").join(chars, ["source", "field", "char"], "left").join(octets, ["source", "field", "byte"], "left")
    candidates = candidates.select("id", "source", "field", "tail", F.coalesce("char_limit", "byte_limit", F.lit(False)).alias("limit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["how"] = [how_lost(t, bool(x), ends.value) for t, x in zip(b["tail"], b["limit"])]
            yield b.loc[b["how"].notna(), ["id", "source", "field", "how"]]

    return lengths, candidates.mapInPandas(run, "id string, source string, field string, how string").distinct()


def found(df: DataFrame, id_column: str, text_columns: list[str], source_column: str) -> DataFrame:
    """(id, field, how) of the cut texts: by a limit, else by their end. Null and blank texts and null ids are no cases; a null source is a source of its own."""
    return judged(df, id_column, text_columns, source_column)[1].groupBy("id", "field").agg(F.max("how").alias("how"))


def rates(df: DataFrame, id_column: str, text_columns: list[str], source_column: str) -> DataFrame:
    """(source, field, n_texts, n_cut, n_at_limit, share) of each source, `(none)` for a null one; a repeated row counts once."""
    lengths, cut = judged(df, id_column, text_columns, source_column)
    total = lengths.select("id", "source", "field").distinct().groupBy("source", "field").agg(F.count("*").alias("n_texts"))
    lost_ends = cut.groupBy("source", "field").agg(F.countDistinct("id").alias("n_cut"), F.countDistinct(F.when(F.col("how") == "limit", F.col("id"))).alias("n_at_limit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.join(lost_ends, ["source", "field"], "left").select("source", "field", "n_texts", zero("n_cut"), zero("n_at_limit"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_texts"), 6).alias("share"))
