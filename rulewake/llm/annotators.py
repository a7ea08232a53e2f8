"""One label per item from annotators who disagree, how far they agree, and how reliable each of them is.

Triplet moments: for conditionally independent annotators the agreement beyond chance of two is the product of their
skills, so each skill follows from three pairwise agreements, k_ij * k_ik / k_jk, of which the median over all pairs (j, k) is
taken. Annotators also err in systematic ways (one label for everything, two labels exchanged), which one accuracy can't
tell. The same pairwise co-counts, by label, then give an accuracy per label: with the others' tables known from the
triplets, the table of an annotator is the least-squares solution of the linear equations
count(i says a, j says b) = sum_t P(t, i says a) * P(j says b | t) over all j. Votes are combined by log-odds weights.

All work on votes is done in maps over items; only co-counts by annotator and label are gathered, never votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewake.session import prepare, stored

#: Common votes below which the agreement of two annotators is not used, and agreement beyond chance too small to divide by.
COMMON, LEAST = 20, 0.05
#: Sweeps of the linear equations over all annotators; pseudo-votes of an annotator on each true label, spread as the triplets' accuracy says.
SWEEPS, PRIOR_VOTES = 3, 6.0
#: Skills are kept within this bound, so that no weight is infinite.
BOUND = 0.98


@dataclass
class Model:
    """Annotators, their skill by triplets, prior of the labels, and log P(given label | true label) by annotator."""

    raters: list[str]
    labels: list[str]
    skill: np.ndarray
    prior: np.ndarray
    weights: np.ndarray
    kappa: float | None


def normal(label: Column, labels: list[str]) -> Column:
    """The label of a list that is spelled like it but for case, blanks and the joining character; null for anything else."""
    bare = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    known = F.create_map(*(x for name in labels for x in (F.lit("".join(c for c in name.lower() if c.isalnum())), F.lit(name))))
    return F.try_element_at(known, F.coalesce(bare, F.lit("")))


def votes(long: DataFrame, labels: list[str]) -> tuple[DataFrame, list[str]]:
    """(item_id, raters array<int>, labels array<int>) from (item_id, rater, label, at): the latest known label of each rater on an item.

    Labels outside the list, null items and null raters are dropped; of labels given at the same time the last in the list counts.
    An item has at most one vote per annotator, so its arrays are bounded by their number.
    """
    index = F.array_position(F.array(*map(F.lit, labels)), normal(F.col("label"), labels)).cast("int") - 1
    rows = long.select("item_id", "rater", index.alias("label"), "at").filter(F.col("item_id").isNotNull() & F.col("rater").isNotNull() & (F.col("label") >= 0))
    latest = rows.groupBy("item_id", "rater").agg(F.max(F.struct("at", "label"))["label"].alias("label"))
    raters = sorted(r[0] for r in latest.select("rater").distinct().collect()) or ["none"]  # as many as there are annotators
    place = latest.sparkSession.createDataFrame(list(enumerate(raters)), "place int, rater string")
    pairs = latest.join(place, "rater").select("item_id", F.struct(F.col("place").alias("rater"), "label").alias("vote")).groupBy("item_id").agg(F.array_sort(F.collect_list("vote")).alias("votes"))
    return pairs.select("item_id", F.col("votes.rater").alias("raters"), F.col("votes.label").alias("labels")), raters


def _flat(raters: pd.Series, labels: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = raters.map(len).to_numpy()
    item = np.repeat(np.arange(len(sizes)), sizes)
    join = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in c]) if len(c) else np.zeros(0, dtype=np.int64)
    return item, join(raters), join(labels)


def pair_counts(table: DataFrame, k: int) -> dict[tuple[int, int], np.ndarray]:
    """(i, j) with i < j to counts[a, b]: items on which annotator i said label a and j said b, of pairs with at least COMMON items.

    Pairs that never answer the same item take no room, and those below COMMON are dropped before anything is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sizes = b["raters"].map(len).to_numpy()
            for size in np.unique(sizes[sizes > 1]):  # items of one size together, as a matrix
                own = np.flatnonzero(sizes == size)
                vote = np.stack([np.asarray(x, dtype=np.int64) for x in b["raters"].iloc[own]]) * k + np.stack([np.asarray(x, dtype=np.int64) for x in b["labels"].iloc[own]])
                for first in range(size - 1):
                    key = vote[:, first : first + 1] << 32 | vote[:, first + 1 :]
                    at, n = np.unique(key, return_counts=True)
                    yield pd.DataFrame({"x": at >> 32, "y": at & 0xFFFFFFFF, "n": n})

    cells = table.select("raters", "labels").mapInPandas(run, "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))
    of = lambda c: F.floor(F.col(c) / k)
    both = cells.groupBy(of("x").alias("i"), of("y").alias("j")).agg(F.sum("n").alias("common"), F.collect_list(F.struct(F.pmod("x", F.lit(k)).alias("a"), F.pmod("y", F.lit(k)).alias("b"), "n")).alias("cells"))  # k * k cells at most
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in both.filter(F.col("common") >= COMMON).collect():
        counts = np.zeros((k, k))
        for c in r["cells"]:
            counts[c["a"], c["b"]] = c["n"]
        out[int(r["i"]), int(r["j"])] = counts
    return out


def beyond_chance(counts: np.ndarray) -> float:
    """Agreement of two annotators corrected for chance; not a number where chance alone gives full agreement."""
    n = counts.sum()
    chance = float((counts.sum(1) * counts.sum(0)).sum()) / n**2
    return (np.trace(counts) / n - chance) / (1 - chance) if chance < 1 - 1e-9 else float("nan")


def triplets(counts: dict[tuple[int, int], np.ndarray], n: int) -> tuple[np.ndarray, float | None]:
    """Skill of each annotator (1 always right, 0 as good as chance, below 0 worse) and the mean agreement beyond chance of all pairs.

    An annotator without a triplet gets half of full skill, with one partner only the skill that both would have if equally good.
    """
    kappa = {p: value for p, c in counts.items() if not np.isnan(value := beyond_chance(c))}
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (i, j), value in kappa.items():
        near[i].append((j, value))
        near[j].append((i, value))
    # for each annotator the partners in order of their number, and the agreements with them
    others = [(np.array([j for j, _ in x], dtype=np.int64), np.array([v for _, v in x])) for x in map(sorted, near)]
    skill, own = np.full(n, 0.5), np.full(n, np.nan)
    for i, (partners, agreement) in enumerate(others):
        if not len(partners):
            continue
        own[partners] = agreement
        squares = []
        for j, k_ij in zip(partners, agreement):  # the pairs (j, m), m after j, that share items; a row at a time
            third, k_jm = others[j]
            k_im = own[third]
            use = (third > j) & ~np.isnan(k_im) & (np.abs(k_jm) >= LEAST)
            squares.append(k_ij * k_im[use] / k_jm[use])
        own[partners] = np.nan
        squares = np.concatenate(squares)
        middle = float(np.median(agreement))
        skill[i] = np.sign(middle) * np.sqrt(max(0.0, float(np.median(squares))) if len(squares) else abs(middle))
    common = sum(c.sum() for p, c in counts.items() if p in kappa)
    mean = float(sum(kappa[p] * c.sum() for p, c in counts.items() if p in kappa) / common) if common else None
    return np.clip(skill, -BOUND, BOUND), mean


def by_label(counts: dict[tuple[int, int], np.ndarray], skill: np.ndarray, k: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(prior, tables) with tables[i, t, a] = P(i says a | t is right), from the co-counts by least squares, started from the triplets' accuracies."""
    n = len(skill)
    start = np.exp(one_coin(skill, k))
    tables, prior = start.copy(), np.full(k, 1 / k)
    partners: dict[int, list[tuple[int, np.ndarray]]] = {i: [] for i in range(n)}
    for (i, j), c in counts.items():
        partners[i].append((j, c))
        partners[j].append((i, c.T))
    for _ in range(sweeps):
        new, right = start.copy(), np.zeros(k)
        for i, others in partners.items():
            if len(others) < 2:
                continue
            squares, mixed, common = np.zeros((k, k)), np.zeros((k, k)), 0.0
            for j, c in others:
                squares += c.sum() * tables[j] @ tables[j].T
                mixed += tables[j] @ c.T
                common += c.sum()
            joint = np.linalg.solve(squares + 1e-6 * np.trace(squares) * np.eye(k), mixed)  # P(t is right and i says a)
            joint = np.maximum(joint, 0.0)
            joint /= max(joint.sum(), 1e-12)
            answered = max(c.sum() for _, c in others)  # at least as many answers stand behind the equations
            new[i] = (joint * answered + PRIOR_VOTES * start[i]) / (joint.sum(1, keepdims=True) * answered + PRIOR_VOTES)
            right += common * joint.sum(1)
        tables = new
        if right.sum() > 0:
            prior = (right + 1) / (right + 1).sum()
    return prior, np.clip(tables, 1e-3, None) / np.clip(tables, 1e-3, None).sum(2, keepdims=True)


def one_coin(skill: np.ndarray, k: int) -> np.ndarray:
    """log P(given | true) where errors fall on all other labels alike."""
    right = np.clip((1 + (k - 1) * skill) / k, 1e-3, 1 - 1e-3)
    out = np.repeat(np.log((1 - right) / (k - 1))[:, None, None], k, 1).repeat(k, 2)
    for a in range(k):
        out[:, a, a] = np.log(right)
    return out


def posterior(prior: np.ndarray, weights: np.ndarray, raters: pd.Series, labels: pd.Series) -> tuple[np.ndarray, tuple]:
    item, rater, label = flat = _flat(raters, labels)
    score = np.tile(np.log(prior), (len(raters), 1))
    np.add.at(score, item, weights[rater, :, label])
    return score, flat


def _soft(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fitted(table: DataFrame, raters: list[str], labels: list[str]) -> Model:
    """The annotators' model from a table of votes."""
    counts = pair_counts(table, len(labels))
    skill, kappa = triplets(counts, len(raters))
    prior, tables = by_label(counts, skill, len(labels))
    return Model(raters, labels, skill, prior, np.log(tables), kappa)


def consensus(table: DataFrame, model: Model) -> DataFrame:
    """(item_id, label, confidence, n_votes, agreement): the best supported label, its probability, and the share of votes for it. Ties go to the label first in the list."""
    prepare(table.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            score, (item, _, label) = posterior(model.prior, model.weights, b["raters"], b["labels"])
            best = score.argmax(1)
            n = np.bincount(item, minlength=len(b))
            yield pd.DataFrame(
                {"item_id": b["item_id"], "label": np.array(model.labels, dtype=object)[best], "confidence": _soft(score).max(1).round(6), "n_votes": n, "agreement": (np.bincount(item, weights=label == best[item], minlength=len(b)) / np.maximum(n, 1)).round(6)}
            )

    return table.mapInPandas(run, "item_id string, label string, confidence double, n_votes bigint, agreement double")


def reliability(model: Model) -> list[tuple]:
    """(rater, skill, accuracy, informativeness): skill by triplets, expected accuracy, and bits an answer tells of the right label."""
    p, c = model.prior, np.exp(model.weights)
    out = []
    for i, rater in enumerate(model.raters):
        joint = p[:, None] * c[i]
        bits = float((joint * np.log2(joint / (p[:, None] * joint.sum(0)))).sum())
        out.append((rater, round(float(model.skill[i]), 6), round(float(np.trace(joint)), 6), round(max(0.0, bits), 6)))
    return out


def resolved(long: DataFrame, labels: list[str]) -> tuple[DataFrame, Model]:
    """Votes are stored once; then the model is fitted and applied."""
    table, raters = votes(long, labels)
    table = stored(table, "votes")
    return table, fitted(table, raters, labels)
