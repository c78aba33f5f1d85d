"""Evaluation against ground truth: confusion, precision and recall, class weights, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.graph import checkpointed


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of each pair of true and predicted label."""
    return df.groupBy(*(keys or []), truth, predicted).agg(F.count("*").alias("n"))


def scores(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class from a confusion table; zero where undefined."""
    own = pairs.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n"))), F.lit(0)).alias("hits"))
    said = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    both = own.join(said, "class", "full").na.fill(0)
    p, r = (F.when(F.col(c) > 0, F.col("hits") / F.col(c)).otherwise(0.0) for c in ("said", "support"))
    out = both.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("said", "hits")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies: all rows over (classes times the class's rows)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def moving_stats(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Mean and sample variance of the last ``n`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("variance", F.var_samp(value).over(w))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (h, groups, n, eta_squared): the Kruskal-Wallis statistic with mean ranks and the tie correction.

    Ranks come from the counts of distinct values, in ranges of the values: a window without a key sees a row for each range. Without variation, or
    with a row a group, what isn't defined is null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranged = checkpointed(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum("c").alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    before = F.col("_before") + F.sum("c").over(Window.partitionBy("_part").orderBy(value)) - F.col("c")
    ranks = ranged.join(F.broadcast(offsets), "_part").select(F.col(value), "c", (before + (F.col("c") + 1) / 2.0).alias("rank"))
    ties = ranks.agg(F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"))
    sums = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    parts = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.sum("k").alias("n"), F.count("*").alias("groups")).join(F.broadcast(ties))
    n, g, zero = F.col("n").cast("double"), F.col("groups"), F.lit(0.0)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / F.nullif(n * n * n - n, zero), zero)
    return parts.select(h.alias("h"), "groups", "n").withColumn("eta_squared", (F.col("h") - g + 1) / F.nullif(n - g, zero))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by the incomplete gamma function's series or continued fraction."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, tiny = z + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return f * scale


def least_squares(df: DataFrame, y: str, factor: str) -> dict[str, float]:
    """Least squares of a measure on one categorical factor: R², adjusted R², F, AIC and BIC, from grouped sums only."""
    row = (
        df.where(F.col(y).isNotNull() & F.col(factor).isNotNull())
        .groupBy(factor)
        .agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
        .agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
        .first()
    )
    n, p, nan = row["n"] or 0, row["groups"], float("nan")
    if n <= p or row["q"] - row["s"] ** 2 / n <= 0:  # a row a group, or no variation at all
        return {"n": float(n), "r2": nan, "r2_adjusted": nan, "f": nan, "aic": nan, "bic": nan}
    if row["q"] - row["between"] <= 0:  # the factor explains all
        return {"n": float(n), "r2": 1.0, "r2_adjusted": 1.0, "f": math.inf if p > 1 else nan, "aic": -math.inf, "bic": -math.inf}
    total, left = row["q"] - row["s"] ** 2 / n, row["q"] - row["between"]
    r2 = 1 - left / total
    likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(left / n) + 1)
    return {"n": float(n), "r2": r2, "r2_adjusted": 1 - (1 - r2) * (n - 1) / (n - p), "f": (total - left) / (p - 1) / (left / (n - p)) if p > 1 else float("nan"), "aic": 2 * p - 2 * likelihood, "bic": p * math.log(n) - 2 * likelihood}


def clock_interval(date: Column, clock: Column, begins: int = 18) -> Column:
    """The time, in microseconds, of a clock text (HH:mm:ss) in the night that began on a date: before ``begins`` o'clock it is the next day's."""
    parts = F.transform(F.split(clock, ":"), lambda x: x.cast("long"))
    seconds = F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2)
    return F.unix_micros(date.cast("timestamp_ntz").cast("timestamp")) + (seconds + F.when(F.get(parts, 0) < begins, 86400).otherwise(0)) * 1_000_000


def truth_intervals(df: DataFrame, date: str, start: str, end: str, first: Column, last: Column) -> DataFrame:
    """Ground truth with clock times as intervals start_us, end_us, clipped to the night [first, last]; empty ones are left out."""
    rows = df.withColumn("start_us", F.greatest(clock_interval(F.col(date), F.col(start)), first)).withColumn("end_us", F.least(clock_interval(F.col(date), F.col(end)), last))
    return rows.where("start_us < end_us")


def with_truth(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with the ground truth of the same file; others are left out."""
    return predicted.join(truth, keys)


def bouts_where(df: DataFrame, condition: Column, keys: list[str], us: str, order: list[str], dt: int, gap: float = 2.5) -> DataFrame:
    """Rows (keys, start_us, end_us, n_rows, hours): when a condition held (a wrong identity, a behaviour that isn't excluded, a predicted one).

    Bouts break at pauses of more than ``gap`` intervals ``dt``; a bout of n rows lasts n * dt and ends one interval after its last row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("_new", F.coalesce(F.col(us) - F.lag(us).over(w) > gap * dt, F.lit(True)).cast("int")).withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "_b").agg(F.min(us).alias("start_us"), (F.max(us) + dt).alias("end_us"), F.count("*").alias("n_rows"))
    return found.drop("_b").withColumn("hours", F.col("n_rows") * dt / F.lit(3.6e9))


def without_same_source(ranked: DataFrame, query_id: str, own_path: str, other_path: str, same_source: Column | None = None) -> DataFrame:
    """Ranked gallery rows without those of the query's own path, nor those that a condition calls its own (same identity and date); ranks close up."""
    own = F.col(own_path).eqNullSafe(F.col(other_path))
    own = own | F.coalesce(same_source, F.lit(False)) if same_source is not None else own
    return ranked.where(~own).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("rank")))


def per_class_retrieval(found: DataFrame, label: str, most: int) -> DataFrame:
    """Rows (label, n, mean_ap, rank1, within): mean average precision and shares of the queries found at rank 1 and ``most`` or before."""
    return found.groupBy(label).agg(F.count("*").alias("n"), F.avg("ap").alias("mean_ap"), F.avg((F.col("first_hit") == 1).cast("double")).alias("rank1"), F.avg((F.col("first_hit") <= most).cast("double")).alias("within"))


def top_accuracy(ranked: DataFrame, query_id: str, truth: str, said: str, k: int = 5) -> DataFrame:
    """One row (n, top1, topk): shares of the queries whose true label is first, or among the first ``k`` distinct ranks."""
    best = ranked.groupBy(query_id).agg(F.min(F.when(F.col(truth) == F.col(said), F.col("rank"))).alias("_r"))
    hit = lambda n: F.avg(F.when(F.col("_r") <= n, 1.0).otherwise(0.0))
    return best.agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(k).alias("topk"))
