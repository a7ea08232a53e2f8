"""Statistics of contingency tables. Cells are counted in the cluster; what follows works on a handful of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def cells(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """One row (a, b, c, d): both, row only, column only, neither. Null counts as false."""
    r, c = F.coalesce(row, F.lit(False)), F.coalesce(column, F.lit(False))
    return df.agg(F.count_if(r & c).alias("a"), F.count_if(r & ~c).alias("b"), F.count_if(~r & c).alias("c"), F.count_if(~r & ~c).alias("d"))


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table with continuity correction; null where a margin is 0."""
    n = (a + b + c + d).cast("double")
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a.cast("double") * d - b.cast("double") * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * gap * gap, margins)


def cramers_v(chi2: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(chi2, n))


def two_proportions(hits_1: Column, n_1: Column, hits_2: Column, n_2: Column) -> Column:
    """z of two proportions with pooled variance; null where it is 0."""
    pooled = F.try_divide(hits_1 + hits_2, n_1 + n_2)
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_1) + F.try_divide(F.lit(1.0), n_2))
    return F.when(variance > 0, (F.try_divide(hits_1, n_1) - F.try_divide(hits_2, n_2)) / F.sqrt(variance))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion; null for no trials."""
    p = F.try_divide(hits, n)
    middle, spread = p + z * z / (2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + z * z / (4 * n * n))
    size = 1 + z * z / n
    return F.when(n > 0, (middle - spread) / size), F.when(n > 0, (middle + spread) / size)


def odds_ratio(a: Column, b: Column, c: Column, d: Column, adjusted: bool = True) -> dict[str, Column]:
    """Odds ratio with a Wald interval; 0.5 is added to every cell if any is 0 (with adjusted=False to the interval alone)."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    x = [F.when(zero, v + 0.5).otherwise(v.cast("double")) for v in (a, b, c, d)]
    ratio = x[0] * x[3] / (x[1] * x[2])
    spread = Z95 * F.sqrt(1 / x[0] + 1 / x[1] + 1 / x[2] + 1 / x[3])
    plain = F.try_divide(a.cast("double") * d, b.cast("double") * c)
    return {"odds_ratio": ratio if adjusted else plain, "ci_lo": F.exp(F.ln(ratio) - spread), "ci_hi": F.exp(F.ln(ratio) + spread)}


def normal_p(z: float) -> float:
    """Two-sided probability of a standard normal beyond |z|."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(chi2: float) -> float:
    """Probability of a chi-square of one degree of freedom beyond a value."""
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2))


def gamma_tail(k: float, x: float) -> float:
    """Probability of a chi-square with 2k degrees of freedom beyond 2x: the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < k + 1:
        term = total = 1 / k
        n = k
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + k * math.log(x) - math.lgamma(k)))
    b, c = x + 1 - k, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - k)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + k * math.log(x) - math.lgamma(k))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact probability: the tables with the same margins that are no likelier than this one."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda m: math.lgamma(m + 1)
    fixed = log(r) + log(n - r) + log(k) + log(n - k) - log(n)
    at = lambda x: fixed - log(x) - log(r - x) - log(k - x) - log(n - r - k + x)
    own = at(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, r + k - n), min(r, k) + 1) if (p := at(x)) <= own + 1e-7))


@dataclass
class Pooled:
    """Mantel-Haenszel estimate over strata."""

    odds_ratio: float | None
    ci_lo: float | None
    ci_hi: float | None
    p_null: float | None
    p_equal: float | None
    strata: int
    n: int


def mantel_haenszel(strata: list[tuple[int, int, int, int]]) -> Pooled:
    """Pooled odds ratio with Robins-Breslow-Greenland variance, the test of no association without correction, and Tarone's test of equal odds.

    Strata with fewer than two rows or an empty margin are dropped; nothing left gives nulls.
    """
    kept = [s for s in strata if sum(s) >= 2 and all((s[0] + s[1], s[2] + s[3], s[0] + s[2], s[1] + s[3]))]
    if not kept:
        return Pooled(None, None, None, None, None, 0, 0)
    a, b, c, d = np.array(kept, dtype=float).T
    n = a + b + c + d
    r, s = a * d / n, b * c / n
    p, q = (a + d) / n, (b + c) / n
    observed, expected = a.sum(), ((a + b) * (a + c) / n).sum()
    variance = ((a + b) * (c + d) * (a + c) * (b + d) / (n**2 * (n - 1))).sum()
    p_null = chi2_p((observed - expected) ** 2 / variance) if variance > 0 else None
    if r.sum() == 0 or s.sum() == 0:
        return Pooled(None, None, None, p_null, None, len(kept), int(n.sum()))
    ratio = r.sum() / s.sum()
    log_variance = (p * r).sum() / (2 * r.sum() ** 2) + (p * s + q * r).sum() / (2 * r.sum() * s.sum()) + (q * s).sum() / (2 * s.sum() ** 2)
    spread = Z95 * math.sqrt(log_variance)
    m1, m2 = a + b, a + c
    if abs(ratio - 1) < 1e-12:
        e = m1 * m2 / n
    else:
        root = n + (m1 + m2) * (ratio - 1)
        e = (root - np.sqrt(np.maximum(root**2 - 4 * m1 * m2 * ratio * (ratio - 1), 0))) / (2 * (ratio - 1))
    with np.errstate(divide="ignore"):
        v = 1 / (1 / e + 1 / (m1 - e) + 1 / (m2 - e) + 1 / (n - m1 - m2 + e))
    equal = ((a - e) ** 2 / v).sum() - (a - e).sum() ** 2 / v.sum() if v.sum() > 0 else None
    p_equal = gamma_tail((len(kept) - 1) / 2, max(equal, 0) / 2) if equal is not None and len(kept) > 1 else None
    return Pooled(ratio, ratio * math.exp(-spread), ratio * math.exp(spread), p_null, p_equal, len(kept), int(n.sum()))


def strata_cells(df: DataFrame, stratum: str, row: Column, column: Column) -> DataFrame:
    """(stratum, a, b, c, d) per stratum."""
    r, c = F.coalesce(row, F.lit(False)), F.coalesce(column, F.lit(False))
    return df.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if(r & c).alias("a"), F.count_if(r & ~c).alias("b"), F.count_if(~r & c).alias("c"), F.count_if(~r & ~c).alias("d"))


@dataclass
class Logit:
    """Coefficients with cluster-robust covariance."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    clusters: int
    converged: bool

    def ratio(self, name: str) -> tuple[float, float, float, float]:
        """(odds ratio, low, high, p) of one coefficient."""
        i = self.names.index(name)
        b, se = float(self.beta[i]), math.sqrt(max(float(self.covariance[i, i]), 0.0))
        return math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se), normal_p(b / se) if se else float("nan")

    def wald(self, names: list[str]) -> tuple[float, float]:
        """Joint test that the coefficients are 0: (chi-square, p)."""
        i = [self.names.index(n) for n in names]
        b, v = self.beta[i], self.covariance[np.ix_(i, i)]
        chi2 = float(b @ np.linalg.pinv(v) @ b)  # a covariance without rows behind it tests nothing
        return chi2, gamma_tail(len(i) / 2, chi2 / 2)


def logit(x: np.ndarray, y: np.ndarray, weights: np.ndarray, cluster: np.ndarray, names: list[str], penalty: float = 0.0, steps: int = 100) -> Logit:
    """Logistic regression by reweighted least squares on distinct design rows with counts; the sandwich sums scores by cluster.

    The covariance is scaled by G/(G-1) * (n-1)/(n-k). penalty adds penalty/2 * |beta|^2 without the first column, for separated data.
    """
    n, k = float(weights.sum()), x.shape[1]
    beta = np.zeros(k)
    ridge = np.eye(k) * penalty
    ridge[0, 0] = 0
    converged = False
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (weights * (y - p)) - ridge @ beta
        information = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.lstsq(information, gradient, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            converged = True
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
    bread = np.linalg.pinv((x * (weights * p * (1 - p))[:, None]).T @ x + ridge)
    _, index = np.unique(cluster, return_inverse=True)
    g = index.max() + 1 if len(index) else 0
    scores = np.zeros((g, k))
    np.add.at(scores, index, x * (weights * (y - p))[:, None])
    scale = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return Logit(names, beta, bread @ (scores.T @ scores) @ bread * scale, int(n), int(g), converged)


def design_counts(df: DataFrame, outcome: Column, terms: dict[str, Column], cluster: str) -> DataFrame:
    """Distinct (cluster, terms, y) with their number: what logit() needs of any number of rows. Rows with a null are dropped."""
    rows = df.select(F.col(cluster).alias("cluster"), *(c.cast("double").alias(n) for n, c in terms.items()), outcome.cast("double").alias("y")).dropna()
    return rows.groupBy("cluster", *terms, "y").agg(F.count("*").alias("n"))


def clustered_logit(df: DataFrame, outcome: Column, terms: dict[str, Column], cluster: str, fixed_effects: bool = False, penalty: float = 0.0) -> Logit:
    """logit() of an outcome on terms, by clusters, with one dummy per cluster but the first for fixed effects.

    With fixed effects, clusters in which the outcome never varies carry no information on the terms and are dropped.
    """
    rows = design_counts(df, outcome, terms, cluster).toPandas().sort_values(["cluster", *terms, "y"])
    if fixed_effects:
        varied = rows.groupby("cluster")["y"].transform("nunique") > 1
        rows = rows[varied]
    names = ["intercept", *terms]
    parts = [np.ones((len(rows), 1)), rows[list(terms)].to_numpy(float)]
    if fixed_effects:
        groups = sorted(rows["cluster"].unique())[1:]
        parts.append(np.stack([(rows["cluster"] == g).to_numpy(float) for g in groups], 1) if groups else np.zeros((len(rows), 0)))
        names += [f"cluster={g}" for g in groups]
    return logit(np.hstack(parts), rows["y"].to_numpy(float), rows["n"].to_numpy(float), rows["cluster"].to_numpy(), names, penalty)


def kappa_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows that have both labels: all that kappa needs."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, a: str, b: str, at_certainty: str = "null") -> DataFrame:
    """One row (n, observed, chance, kappa) of Cohen's kappa over all labels.

    at_certainty says what it is where chance agreement is 1: null, `one`, or `observed` (1 if all agree, else 0).
    """
    n, none = F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("a").alias("label"), n.alias("n_a"), none.alias("n_b"), F.when(F.col("a") == F.col("b"), n).otherwise(none).alias("same")),
        F.struct(F.col("b").alias("label"), none.alias("n_a"), n.alias("n_b"), none.alias("same")),
    )
    margins = kappa_table(df, a, b).select(F.explode(sides).alias("x")).select("x.*").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n_a", "n_b", "same")))
    total = margins.agg(F.sum("n_a").alias("n"), F.sum("same").alias("same"), F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("product"))
    observed, chance = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.col("product"), F.col("n").cast("double") * F.col("n"))
    certain = {"null": F.lit(None).cast("double"), "one": F.lit(1.0), "observed": F.when(observed == 1, 1.0).otherwise(0.0)}[at_certainty]
    value = F.when(F.abs(chance - 1) < 1e-12, certain).otherwise(F.try_divide(observed - chance, 1 - chance))
    return total.select(F.coalesce("n", F.lit(0)).alias("n"), observed.alias("observed"), chance.alias("chance"), value.alias("kappa"))


def kappa_by_class(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """(label, n, kappa) of each label against the rest; null where chance agreement is 1."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(*map(F.lit, labels))).alias("label"), F.col(a).alias("a"), F.col(b).alias("b"))
    x, y = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    g = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("o"), F.avg(x.cast("int")).alias("p"), F.avg(y.cast("int")).alias("q"))
    chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return g.select("label", "n", F.when(F.abs(chance - 1) >= 1e-12, (F.col("o") - chance) / (1 - chance)).alias("kappa"))


def kappa_of_counts(counts: np.ndarray) -> float:
    """Cohen's kappa of a square table of counts."""
    n = counts.sum()
    if not n:
        return float("nan")
    observed, chance = np.trace(counts) / n, float((counts.sum(0) * counts.sum(1)).sum()) / n**2
    return float("nan") if abs(chance - 1) < 1e-12 else (observed - chance) / (1 - chance)


def kappa_bootstrap(counts: np.ndarray, rounds: int = 1000, seed: int = 20260512) -> tuple[float, float]:
    """Percentile interval of kappa: tables drawn from the multinomial of the counted pairs, which is resampling their rows."""
    n = int(counts.sum())
    if not n:
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    drawn = rng.multinomial(n, counts.ravel() / n, size=rounds).reshape(rounds, *counts.shape)
    values = sorted(v for v in map(kappa_of_counts, drawn) if not math.isnan(v))
    if not values:
        return float("nan"), float("nan")
    at = lambda q: values[max(0, min(len(values) - 1, math.ceil(q * len(values)) - 1))]
    return at(0.025), at(0.975)
