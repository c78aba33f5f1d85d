"""Rasters, clusters, projections and plane fits: heat maps of positions, k-means of vectors, homographies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heat_alpha(counts: DataFrame, keys: list[str], width: int, height: int, sigma: float = 2.5) -> DataFrame:
    """Rows (keys, u, v, alpha) for every cell of a raster: the blurred logarithm of its count, scaled to [0, 1], square-rooted.

    ``counts`` has rows (keys, u, v, n); cells without one count 0. The blur is Gaussian, out to four sigmas, along one axis after the other, and
    cells beyond the edge repeat the edge. A raster without differences has alpha 0. Rasters have a fixed size, so a key is ``width`` x ``height`` rows.
    """
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)])
    cells = counts.select(*keys).distinct().withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    seen = counts.select(*keys, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "n")
    rows = cells.join(seen, [*keys, "u", "v"], "left").select(*keys, "u", "v", F.log(F.coalesce("n", F.lit(0)) + F.lit(1e-7)).alias("x"))

    def blur(df: DataFrame, axis: str, size: int) -> DataFrame:
        """Each cell gathers from its line, held as an array of the axis."""
        other = "v" if axis == "u" else "u"
        lines = df.groupBy(*keys, other).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "x"))), lambda s: s["x"]).alias("line"))
        at = lambda i: F.aggregate(kernel, F.lit(0.0), lambda s, k: s + k["w"] * F.get("line", F.greatest(F.lit(0), F.least(F.lit(size - 1), i + k["d"]))))
        return lines.select(*keys, other, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)).alias(axis, "x"))

    smooth = blur(blur(rows, "u", width), "v", height)
    w = Window.partitionBy(*keys)
    low, high = F.min("x").over(w), F.max("x").over(w)
    return smooth.select(*keys, "u", "v", F.when(high > low, F.sqrt((F.col("x") - low) / (high - low))).otherwise(0.0).alias("alpha"))


def clusters(df: DataFrame, vec: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``: k-means of the vectors."""
    rows = df.withColumn("_features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_features")


def in_two_dimensions(df: DataFrame, vec: str) -> DataFrame:
    """``df`` with ``plane``: the vectors' first two principal components, from the mean."""
    rows = df.withColumn("_features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=2, inputCol="_features", outputCol="_plane").fit(rows)
    size = model.pc.numRows
    means = rows.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()  # a row for each of the vector's elements
    centre = np.array([r["m"] for r in means]) @ model.pc.toArray() if len(means) == size else np.zeros(2)
    return model.transform(rows).withColumn("plane", F.transform(vector_to_array("_plane"), lambda x, i: x - F.get(F.array(*[F.lit(float(c)) for c in centre]), i))).drop("_features", "_plane")


def homography(pairs: list[tuple[tuple[float, float], tuple[float, float]]], limit: float | None = None, rounds: int = 500, seed: int = 0) -> list[list[float]]:
    """The 3 x 3 matrix that takes the first points of a few pairs to the second ones, with 1 in the last place.

    With ``limit``, by random samples of four pairs: the matrix that takes most pairs to within ``limit`` is fitted again to
    these. The points are a calibration's, a handful for each camera.
    """

    def fit(some: list) -> np.ndarray:
        rows = []
        for (x, y), (u, v) in some:
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        return np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)

    def errors(h: np.ndarray) -> np.ndarray:
        a, b = (np.array([p[k] for p in pairs], float) for k in (0, 1))
        q = np.c_[a, np.ones(len(a))] @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.hypot(*(q[:, :2] / q[:, 2:] - b).T), nan=np.inf)

    best = list(range(len(pairs)))
    if limit is not None:
        rnd, most = np.random.default_rng(seed), -1
        for _ in range(rounds):
            hit = errors(fit([pairs[i] for i in rnd.choice(len(pairs), 4, replace=False)])) <= limit
            if hit.sum() > most:
                most, best = int(hit.sum()), np.flatnonzero(hit).tolist()
    h = fit([pairs[i] for i in best])
    return (h / h[2, 2]).tolist()


def valid_elsewhere(df: DataFrame, other: DataFrame, keys: list[str], us: str, label: str, invalid: str, reach: int) -> DataFrame:
    """``df`` with invalid labels replaced by the most frequent valid one that the other camera has for the same keys within ``reach``; ties by label."""
    from ethospark.operators.joins import within

    bad = df.where(F.col(label) == invalid).select(*keys, "row", us)
    good = other.where(F.col(label) != invalid).select(*keys, F.col(us).alias("_us"), F.col(label).alias("_label"))
    counts = within(bad, good, keys, us, "_us", reach).groupBy("row", "_label").agg(F.count("*").alias("_n"))
    best = counts.groupBy("row").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("l"))).alias("_m"))
    return df.join(best, "row", "left").withColumn(label, F.coalesce("_m.l", label)).drop("_m")


def first_and_last(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """The first and the last value of each key."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def heat_counts(df: DataFrame, keys: list[str], x: str, y: str, matrix: list[list[float]], width: int, height: int) -> DataFrame:
    """Rows (keys, u, v, n): positions in each cell of a map, to which ``matrix`` takes (x, y, 1) by its first two rows; cut towards 0, and left out beyond the map's bounds."""
    at = lambda r: (F.lit(float(r[0])) * F.col(x) + F.lit(float(r[1])) * F.col(y) + F.lit(float(r[2]))).cast("int")
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, at(matrix[0]).alias("u"), at(matrix[1]).alias("v"))
    return cells.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)).groupBy(*keys, "u", "v").agg(F.count("*").alias("n"))
