"""Byte-level pair merges of a public tokenizer, found by a segment tree over the ranks of adjacent pairs.

Each text is split by the tokenizer's own pattern; each piece starts as single bytes. The leaves of the tree are the
ranks of neighbouring symbols, packed with their position, so that the root is always the leftmost pair of lowest rank.
A merge changes three leaves, each in logarithmic time, and the loop ends when the root holds no mergeable pair.
Pieces repeat heavily, so every Python worker keeps the results of the pieces it has seen.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewake.session import prepare

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept by one worker, and the longest that is kept. Beyond that the memory is emptied and filled anew.
KEPT_PIECES, KEPT_LENGTH = 400_000, 64
_NONE = 1 << 62
_SHIFT = 32


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece after all merges."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    find = ranks.get
    width = 1 << max(0, n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = (rank << _SHIFT) | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(position: int, key: int) -> None:
        i = width + position
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    while (best := tree[1]) != _NONE:
        at = best & ((1 << _SHIFT) - 1)
        gone = after[at]
        parts[at] = joined = parts[at] + parts[gone]
        parts[gone] = None
        follower = after[gone]
        after[at] = follower
        if gone < n - 1:
            put(gone, _NONE)
        if follower < n:
            before[follower] = at
            rank = find(joined + parts[follower])
            put(at, _NONE if rank is None else (rank << _SHIFT) | at)
        else:
            put(at, _NONE)
        if (left := before[at]) >= 0:
            rank = find(parts[left] + joined)
            put(left, _NONE if rank is None else (rank << _SHIFT) | left)
    return [ranks[p] for p in parts if p is not None]


def read_ranks(path: str, raw: bytes | None = None) -> dict[bytes, int]:
    """The rank of each token, which is also its id, from a vocabulary's bytes or else its file."""
    if raw is None:
        with open(path, "rb") as file:
            raw = file.read()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class Pieces(dict):
    """Piece to its ids as packed int32; unknown pieces are merged when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[str, Pieces] = {}
_split = regex.compile(PATTERN).findall


def pieces(path: str, raw: bytes | None = None) -> Pieces:
    """The worker's memory for one vocabulary, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(read_ranks(path, raw))
    return _loaded[path]


def shared(df: DataFrame, path: str):
    """The vocabulary's bytes, read on the driver and broadcast, so that no other machine needs the file."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(text: str | None, path: str) -> bytes:
    """Packed int32 ids of a text; nothing for null and empty. Strings that look like special tokens are ordinary text."""
    return b"".join(map(pieces(path).__getitem__, _split(text))) if text else b""


def _path(folder: str, vocabulary: str) -> str:
    return os.path.join(folder, vocabulary)


def encoded(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row per row of df, ids the list of token ids without special tokens.

    Null and empty texts have an empty list. Texts are never cut; a text without any split point is one piece whose tree
    costs n log n. There is no shuffle: a map over Arrow batches of the two columns that are read.
    """
    path = _path(folder, vocabulary)
    prepare(df.sparkSession)
    raw = shared(df, path)
    source = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces(path, raw.value)
        for batch in batches:
            packed = [encode(text, path) for text in batch.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the length of each text in tokens, 0 for null and empty."""
    path = _path(folder, vocabulary)
    prepare(df.sparkSession)
    raw = shared(df, path)
    source = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces(path, raw.value)
        for batch in batches:
            sizes = [len(encode(text, path)) // 4 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
