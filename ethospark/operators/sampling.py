"""Seeded samples without replacement: the same rows whatever the partitioning.

A row's draw is a SHA-256 of the seed and its id, and a key's sample are its rows of the least draws. Draws are uniform, so where the sample ends is known
beforehand but for chance: rows are counted by key, those whose draw is above a bound with room to spare are dropped at once, and only the few that are
left are shuffled and ordered. The counts of what is left show whether a key had bad luck; such keys are done again without a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of which so many are broadcast with their bounds.
SMALL = 100_000


def draw(ids: list[Column], seed: int) -> Column:
    """64 hexadecimal digits that a row's id and the seed decide. A null id is an empty text."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids]).cast("binary"), 256)


def _room(k: Column) -> Column:
    """How many rows to keep for k that are wanted: six standard deviations more."""
    return k + 6 * F.sqrt(k) + 20


def sample(df: DataFrame, keys: list[str], ids: list[str], k: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """The ``k`` rows of each key (or floor(``share`` of its rows)) that have the least draws, ties by id; all of them where a key has fewer.

    ``ids`` tell the rows of a key apart; rows of equal keys and ids have one draw, and which of them is taken is not defined. Null keys are a key.
    """
    if (k is None) == (share is None):
        raise ValueError("give k or share")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = F.lit(k).cast("double") if k is not None else F.floor(F.col("_n") * F.lit(share))
    counts = counts.withColumn("_k", F.least(wanted.cast("long"), F.col("_n"))).where("_k > 0").withColumn("_below", _room(F.col("_k").cast("double")) / F.col("_n") * 4294967296.0)
    if counts.limit(SMALL + 1).count() <= SMALL:
        counts = F.broadcast(counts)
    names = {c: f"_key{i}" for i, c in enumerate(keys)}
    same = [df[c].eqNullSafe(F.col(n)) for c, n in names.items()]
    drawn = df.join(counts.withColumnsRenamed(names), same) if keys else df.crossJoin(counts)  # one row of counts
    drawn = drawn.drop(*names.values()).withColumn("_draw", draw([F.col(c) for c in ids], seed))
    near = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") <= F.col("_below")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(w.orderBy("_draw", *ids))
    kept = drawn.where(near)
    # A key short of rows after the bound had bad luck (about once in a thousand million keys): without a bound for it.
    left = kept.groupBy(*keys).agg(F.count("*").alias("_left"))
    all_keys = counts.join(left, [counts[c].eqNullSafe(left[c]) for c in keys], "left") if keys else counts.crossJoin(left)
    short = all_keys.where(F.coalesce("_left", F.lit(0)) < F.col("_k")).select(*[counts[c].alias(n) for c, n in names.items()], F.lit(1).alias("_short"))
    if not short.isEmpty():
        mine = lambda d: [d[c].eqNullSafe(F.col(n)) for c, n in names.items()]
        again = drawn.join(F.broadcast(short), mine(drawn), "left_semi") if keys else drawn
        kept = kept.join(F.broadcast(short), mine(kept), "left_anti").unionByName(again) if keys else again
    return kept.withColumn("_r", rank).where(F.col("_r") <= F.col("_k")).drop("_r", "_k", "_n", "_below", "_draw")
