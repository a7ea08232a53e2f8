"""Similar vectors within a key: the best of each, and what became of an item between two versions.

Vectors are packed into blocks of bounded size; blocks with the same key meet by an equi-join and are multiplied as
matrices. Each pair of blocks returns only its best candidates, so what is shuffled grows with the queries, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.session import prepare

#: Vectors of one block.
BLOCK = 1024
#: Cosines from which an item survived unchanged, was edited, or modified.
UNCHANGED, EDITED, MODIFIED = 0.95, 0.85, 0.55
#: Fixed value: least cosine of a candidate pair.
THRESHOLD = 0.3


def blocks(df: DataFrame, prefix: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, block, ids, vectors) from (key, id, vector), a key with many vectors spread over as many blocks by a hash of the ids, and (key, blocks), their number."""
    counts = df.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias(f"{prefix}_blocks"))
    placed = df.join(counts, "key").withColumn(f"{prefix}_block", F.pmod(F.xxhash64("id"), F.col(f"{prefix}_blocks")).cast("int"))
    packed = placed.groupBy("key", f"{prefix}_block").agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("rows"))
    return packed.select("key", f"{prefix}_block", F.col("rows.id").alias(f"{prefix}_ids"), F.col("rows.vector").alias(f"{prefix}_vectors")), counts


def met_blocks(queries: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of blocks with one key. Both block numbers are part of the join key, so a key with many blocks is spread over many tasks."""
    (q, n_q), (i, n_i) = blocks(queries, "q", block), blocks(items, "i", block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(n_i, "key").withColumn("i_block", every("i_blocks")).drop("i_blocks")
    right = i.join(n_q, "key").withColumn("q_block", every("q_blocks")).drop("q_blocks")
    return left.join(right, ["key", "q_block", "i_block"]).select("key", "q_ids", "q_vectors", "i_ids", "i_vectors")


def _matrix(rows) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in rows], dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best_pairs(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(key, query_id, item_id, cosine, rank): the k most similar items of each query with its key; ties go to the smaller item id.

    queries, items: (key, id, vector) with one dimension. Null keys, ids and vectors are left out; a zero vector has cosine 0.
    """
    prepare(queries.sparkSession)
    clean = lambda d: d.filter("key IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL").select("key", "id", "vector")
    met = met_blocks(clean(queries), clean(items), block)
    kinds = {n: met.schema[n].dataType for n in ("key", "q_ids", "i_ids")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, qi, qv, ii, iv in zip(b["key"], b["q_ids"], b["q_vectors"], b["i_ids"], b["i_vectors"]):
                cos = np.round(_matrix(qv) @ _matrix(iv).T, 9)
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # ids are sorted, so ties keep the smaller one
                yield pd.DataFrame({"key": key, "query_id": np.repeat(np.asarray(qi), top.shape[1]), "item_id": np.asarray(ii)[top.ravel()], "cosine": np.take_along_axis(cos, top, 1).ravel()})

    schema = f"key {kinds['key'].simpleString()}, query_id {kinds['q_ids'].elementType.simpleString()}, item_id {kinds['i_ids'].elementType.simpleString()}, cosine double"
    w = Window.partitionBy("key", "query_id").orderBy(F.desc("cosine"), "item_id")
    return met.mapInPandas(run, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidates(queries: DataFrame, items: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """best_pairs() that reach the threshold; the k best are taken first."""
    return best_pairs(queries, items, k).filter(F.col("cosine") >= threshold)


def outcomes(proposed: DataFrame, final: DataFrame, gate_on_section: bool = True) -> DataFrame:
    """(key, id, outcome_state, matched_id, best_cosine) of every proposed item and every new final one.

    Both: (key, id, vector, section). A proposed item is compared with the final ones of its key: unchanged, edited and
    modified by falling cosine, DROPPED below; with gate_on_section the first two need the same section, which must not be
    empty. A final item whose best cosine to any proposed one is below the floor is NEW. Keys that lack either side are skipped.
    """
    both = proposed.select("key").distinct().join(final.select("key").distinct(), "key", "left_semi")
    p, f = proposed.join(both, "key", "left_semi"), final.join(both, "key", "left_semi")
    plain = lambda d, s: d.select("key", F.col("id").alias(s), text.section_plain(F.col("section")).alias(f"section_{s}"))
    forth = best_pairs(p, f, 1).join(plain(p, "query_id"), ["key", "query_id"]).join(plain(f, "item_id"), ["key", "item_id"])
    same = (F.col("section_query_id") == F.col("section_item_id")) & (F.col("section_query_id") != "") if gate_on_section else F.lit(True)
    state = F.when((F.col("cosine") >= UNCHANGED) & same, "SURVIVED-unchanged").when((F.col("cosine") >= EDITED) & same, "SURVIVED-edited").when(F.col("cosine") >= MODIFIED, "MODIFIED").otherwise("DROPPED")
    old = forth.select("key", F.col("query_id").alias("id"), state.alias("outcome_state"), F.when(state != "DROPPED", F.col("item_id")).alias("matched_id"), F.col("cosine").alias("best_cosine"))
    back = best_pairs(f, p, 1).filter(F.col("cosine") < MODIFIED)
    new = back.select("key", F.col("query_id").alias("id"), F.lit("NEW").alias("outcome_state"), F.lit(None).cast(old.schema["matched_id"].dataType).alias("matched_id"), F.col("cosine").alias("best_cosine"))
    return old.unionByName(new)


def stale(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows (id, text) whose vector is not in the cache (id, content_hash) under the hash of their present text: what is left to embed."""
    return texts.withColumn("content_hash", text.content_hash(F.col("text"))).join(cache.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
