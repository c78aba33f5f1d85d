"""Least squares of a measure on several categorical factors.

The normal equations of dummy-coded factors need counts only: rows of each level, rows of each pair of levels of two factors, and the measure's
sums by level. Spark adds these up with partial sums; what comes to the driver is as long as the pairs of levels, whose number is checked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of all factors together, at most: the equations are solved on the driver.
MOST_LEVELS = 2000
NAN = float("nan")


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F with d1 and d2 degrees of freedom > f)."""
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_tails(t: float, d: float) -> float:
    """P(|T| with d degrees of freedom > |t|)."""
    return beta_tail(d / 2, 0.5, d / (d + t * t))


@dataclass
class Fit:
    """Statistics by name, and a row (factor, level, estimate, error, t, p) for each coefficient: the intercept, then each factor's levels but the first.

    A level that the ones before it determine (aliased) has NaN for all; it doesn't count in ``rank``.
    """

    stats: dict[str, float]
    coefficients: list[tuple[str | None, str | None, float, float, float, float]] = field(default_factory=list)


def ols(df: DataFrame, y: str, factors: list[str], most: int = MOST_LEVELS) -> Fit:
    """Least squares of ``y`` on an intercept and the levels of ``factors``; rows with a null in any of them are left out, as are NaN.

    ``stats`` has n, rank, r2, r2_adjusted, f, p (of F), log_likelihood, aic and bic. What isn't defined is NaN: all but n and rank without a degree of freedom left or
    without variation, f and p if no factor varies. A fit without an error has r2 1, p 0, and aic and bic -inf.
    """
    known = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).dropna(subset=factors).select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(factors)])
    n, mean, spread = known.agg(F.count("*"), F.avg("y"), F.var_pop("y")).first()
    if not n:
        return Fit({"n": 0.0, "rank": 0.0} | dict.fromkeys(("r2", "r2_adjusted", "f", "p", "log_likelihood", "aic", "bic"), NAN))
    centred = known.withColumn("y", F.col("y") - F.lit(mean))
    single = centred.select("y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("a")) for i in range(len(factors))])).alias("e")) if factors else centred.limit(0).selectExpr("y", "named_struct('i', 0, 'a', '') AS e")
    levels = sorted(tuple(r) for r in single.groupBy("e.i", "e.a").agg(F.count("*").alias("n"), F.sum("y").alias("s")).limit(most + 1).collect())
    if len(levels) > most:
        raise ValueError(f"more than {most} levels")
    columns: list[tuple[int, str]] = [(-1, "")]
    for k, (i, a, _, _) in enumerate(levels):
        if k and levels[k - 1][0] == i:
            columns.append((i, a))
    at = {c: k for k, c in enumerate(columns)}
    gram, right = np.zeros((len(columns), len(columns))), np.zeros(len(columns))
    gram[0, 0] = n
    right[0] = sum(s for i, _, _, s in levels if i == 0)
    for i, a, count, s in levels:
        if (k := at.get((i, a))) is not None:
            gram[k, k] = gram[0, k] = gram[k, 0] = count
            right[k] = s
    both = [F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("a"), F.lit(j).alias("j"), F.col(f"f{j}").alias("b")) for i in range(len(factors)) for j in range(i + 1, len(factors))]
    if both:
        for r in known.select(F.explode(F.array(*both)).alias("e")).select("e.*").groupBy("i", "a", "j", "b").count().collect():
            k, m = at.get((r["i"], r["a"])), at.get((r["j"], r["b"]))
            if k is not None and m is not None:
                gram[k, m] = gram[m, k] = r["count"]
    return _solved(gram, right, columns, factors, n, mean, spread * n)


def _solved(gram: np.ndarray, right: np.ndarray, columns: list[tuple[int, str]], factors: list[str], n: int, mean: float, total: float) -> Fit:
    # Columns are taken in order; one whose length is gone once the others are swept out is aliased.
    rest, kept = gram.copy(), []
    for k in range(len(columns)):
        if rest[k, k] > 1e-9 * gram[k, k]:
            kept.append(k)
            rest -= np.outer(rest[:, k], rest[k]) / rest[k, k]
    inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
    beta = inverse @ right[kept]
    rank, explained = len(kept), float(beta @ right[kept])
    left = max(0.0, total - explained)
    beta[0] += mean
    free = n - rank
    stats = {"n": float(n), "rank": float(rank)} | dict.fromkeys(("r2", "r2_adjusted", "f", "p", "log_likelihood", "aic", "bic"), NAN)
    exact = left <= 1e-12 * total
    if free > 0 and total > 0:
        r2 = 1.0 if exact else 1 - left / total
        likelihood = math.inf if exact else -n / 2 * (math.log(2 * math.pi * left / n) + 1)
        stats |= {"r2": r2, "r2_adjusted": 1 - (1 - r2) * (n - 1) / free, "log_likelihood": likelihood, "aic": 2 * rank - 2 * likelihood, "bic": rank * math.log(n) - 2 * likelihood}
        if rank > 1:
            f = math.inf if exact else (total - left) / (rank - 1) / (left / free)
            stats |= {"f": f, "p": 0.0 if exact else f_tail(f, rank - 1, free)}
    found = dict(zip(kept, zip(beta.tolist(), np.sqrt(np.diag(inverse) * (left / free if free > 0 else NAN)).tolist(), strict=True), strict=True))
    rows = []
    for k, (i, a) in enumerate(columns):
        b, e = found.get(k, (NAN, NAN))
        t = b / e if e > 0 else NAN
        rows.append((factors[i] if i >= 0 else None, a if i >= 0 else None, b, e, t, t_tails(t, free) if t == t else NAN))
    return Fit(stats, rows)


def compare(df: DataFrame, y: str, models: dict[str, list[str]]) -> dict[str, Fit]:
    """Fits by name; of each model the factors with two levels or more are used, and models without any are left out."""
    names = sorted({c for factors in models.values() for c in factors})
    varying = df.agg(*[(F.min(F.col(c).cast("string")) < F.max(F.col(c).cast("string"))).alias(c) for c in names]).first()
    used = {m: [c for c in factors if varying[c]] for m, factors in models.items()}
    return {m: ols(df, y, factors) for m, factors in used.items() if factors}
