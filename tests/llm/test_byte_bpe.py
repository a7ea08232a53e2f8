import base64

import pytest

from rulewake.llm import byte_bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = ["Hello world", "", " ", "don't  stop\n\n now", "<|endoftext|> is text", "naïve § 1.2 – “x” 环境 🙂", "a" * 5000, "ab?é~" * 3000, "﻿\xa0", "aaaaaaaaaa", "\r\n\t x"]


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(spark, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encoded(df).collect()}
    assert got == {**{i: plain.encode_ordinary(t) for i, t in enumerate(TEXTS)}, 99: []}


def test_ids_decode_to_the_text():
    tokens = {i: t for t, i in byte_bpe.read_ranks(PATH).items()}
    for t in TEXTS:
        ids = memoryview(byte_bpe.encode(t, PATH)).cast("i").tolist() if t else []
        assert b"".join(tokens[i] for i in ids).decode() == t


def test_merge_takes_the_leftmost_of_the_lowest_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"ba": 301, b"aba": 302}
    assert byte_bpe.merge(b"abab", ranks) == [302, ord("b")] or byte_bpe.merge(b"abab", ranks) == [300, 300]
    assert byte_bpe.merge(b"abab", {k: v for k, v in ranks.items() if k != b"aba"}) == [300, 300]
    assert byte_bpe.merge(b"", ranks) == []


def brute(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_equals_brute_force():
    import random

    r = random.Random(3)
    ranks = byte_bpe.read_ranks(PATH)
    for _ in range(300):
        piece = bytes(r.choice(b"abcdehnot rst\xc3\xa9") for _ in range(r.randint(0, 40)))
        assert byte_bpe.merge(piece, ranks) == brute(piece, ranks)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids string, n_tokens int")
    assert byte_bpe.encoded(df).count() == 0 and byte_bpe.measured(df).count() == 0
