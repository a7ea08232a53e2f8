"""Clusters of copies: exact by their words, near by shared word shingles.

Copies are collapsed to one representative before anything is compared. Representatives meet in bands of MinHash values, are
verified by exact Jaccard similarity, and linked into classes by labels that spread along edges. Nothing is gathered on the
driver and no group is collected; the result has one row per document with its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.session import discard, prepare, stored

#: Words of a shingle and least similarity; bands and rows of the signature.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 6
#: Texts in a band's bucket up to which all pairs are compared.
ALL_PAIRS = 60
SEED = 20260927
#: Shingles hashed at a time, so that very long texts take no more memory than others.
PART = 1 << 15


def word_key(column: Column) -> Column:
    """Hash of the words of a text; null where it has none, so that such texts are never copies of each other."""
    words = text.tokens(column)
    return F.when(F.size(words) > 0, F.sha2(F.array_join(words, " "), 256))


def exact(df: DataFrame, id_column: str, text_column: str, scope: str | None = None) -> DataFrame:
    """(id, scope, cluster): cluster is the smallest id with the same words in the scope; texts without words are alone. Null scopes are one scope."""
    s = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    rows = df.select(F.col(id_column).alias("id"), s.alias("scope"), F.coalesce(word_key(F.col(text_column)), F.concat(F.lit("alone:"), F.col(id_column).cast("string"))).alias("k")).distinct()
    first = rows.groupBy("scope", "k").agg(F.min("id").alias("cluster"))
    return rows.join(first, ["scope", "k"]).groupBy("id", "scope").agg(F.min("cluster").alias("cluster"))


def signatures(texts: list[list[str]], values: int) -> np.ndarray:
    """The least of each of as many hash functions over the shingles of each text. A function is a multiplication and a shift of one hash of 64 bits per shingle."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, values, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, values, dtype=np.uint64)
    out = np.full((len(texts), values), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hashed = np.array([int.from_bytes(blake2b(g.encode(), digest_size=8).digest(), "little") for t in texts for g in t], dtype=np.uint64)
    for at in range(0, len(hashed), PART):
        own, part = owner[at : at + PART], hashed[at : at + PART, None]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(part * odd + plus >> np.uint64(20), first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], low)
    return out


def shingled(words: str, size: int) -> list[str]:
    """The distinct runs of `size` words, in no order; a shorter text is one."""
    parts = words.split(" ")
    return list({" ".join(parts[i : i + size]) for i in range(max(1, len(parts) - size + 1))})


def near_edges(texts: DataFrame, size: int = SHINGLE, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(scope, a, b) of different texts (scope, id, words) that share enough shingles; a < b.

    All pairs of a bucket of at most all_pairs texts are compared. In a larger one, as a campaign with small edits makes it,
    each text is compared with the first of the bucket and with its neighbours in two orders, by id and by the key of the next
    band, in which similar texts stand together: as many pairs as texts. Chains link the rest.
    """
    mix = np.random.default_rng(SEED + 1).integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for begin in range(0, len(x), 200):
                b = x.iloc[begin : begin + 200]
                keys = (signatures([shingled(w, size) for w in b["words"]], bands * rows) * mix).reshape(len(b), bands, rows).sum(2, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"scope": np.repeat(b["scope"].to_numpy(), bands), "id": np.repeat(b["id"].to_numpy(), bands), "band": np.tile(np.arange(bands), len(b)), "key": keys.ravel(), "following": np.roll(keys, -1, axis=1).ravel()})

    kind = texts.schema["id"].dataType.simpleString()
    banded = stored(texts.mapInPandas(run, f"scope string, id {kind}, band int, key bigint, following bigint"), "bands")
    bucket = ["scope", "band", "key"]
    sizes = banded.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("id").alias("anchor")).filter("n > 1")
    small = banded.join(sizes.filter(F.col("n") <= all_pairs).select(*bucket), bucket).select(*bucket, "id")
    within = small.alias("x").join(small.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket]).filter("x.id < y.id").select("x.scope", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    # a large bucket is cut into parts for the orders; the first text of the bucket joins the parts
    large = banded.join(sizes.filter(F.col("n") > all_pairs), bucket)
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("n") / 10_000))
    beside = lambda *order: F.lag("id").over(Window.partitionBy(*bucket, part(order[0])).orderBy(*order))
    others = large.select("scope", "id", F.array("anchor", beside("id"), beside("following", "id")).alias("near")).select("scope", "id", F.explode("near").alias("other")).filter("other IS NOT NULL AND other <> id")
    pairs = within.unionByName(others.select("scope", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).distinct()
    side = lambda n: texts.select("scope", F.col("id").alias(n), text.shingles(F.split("words", " "), size).alias(f"s_{n}"))
    both = pairs.join(side("a"), ["scope", "a"]).join(side("b"), ["scope", "b"])
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(shared >= similar * (F.size("s_a") + F.size("s_b") - shared)).select("scope", "a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by edges (a, b). Each round takes the least label of the neighbours and then the label of the label, so long chains halve."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stored(low.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        if new.filter("label <> old").isEmpty():
            break
        discard(labels)  # the rounds before are not read again
        labels = new
    return nodes.join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def near(df: DataFrame, id_column: str, text_column: str, scope: str | None = None, size: int = SHINGLE, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, scope, cluster): cluster is the smallest id of the texts linked, directly or in chains, to the row's own within the scope.

    Exact copies fall into one class first. Texts without words are alone; a text shorter than a shingle is one shingle. Ids
    must be unique within their scope; null ids are left out.
    """
    prepare(df.sparkSession)
    same = stored(exact(df.filter(F.col(id_column).isNotNull()), id_column, text_column, scope), "exact")
    reps = same.select(F.col("cluster").alias("id"), "scope").distinct()
    words = df.select(F.col(id_column).alias("id"), F.array_join(text.tokens(F.col(text_column)), " ").alias("words")).filter("words <> ''").groupBy("id").agg(F.min("words").alias("words"))
    texts = stored(reps.join(words, "id").select("scope", "id", "words"), "texts")
    linked = components(reps.select("id").distinct(), near_edges(texts, size, similar, bands, rows))
    return same.join(linked.withColumnRenamed("id", "cluster"), "cluster").select("id", "scope", F.col("component").alias("cluster"))
