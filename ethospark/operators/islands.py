"""Gaps and islands: runs of labels, blocks between gaps, unions of intervals.

Everything is a window over one key plus at most one grouping by the same key, so each operator shuffles once.
Times are microseconds (long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def island_ids(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers islands within ``keys``: a new one begins wherever ``starts`` is true or null (the first row)."""
    w = _ordered(keys, order)
    return df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_blocks(df: DataFrame, keys: list[str], us: str, order: list[str], gap: int, name: str = "block") -> DataFrame:
    """A new block begins after more than ``gap`` without a row."""
    before = F.lag(us).over(_ordered(keys, order))
    return island_ids(df, keys, order, F.col(us) - before > gap, name)


def label_runs(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, gap: int | None = None, name: str = "run") -> DataFrame:
    """A new run begins when the label changes or, with ``gap``, after a longer pause."""
    w = _ordered(keys, order)
    change = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    pause = F.col(us) - F.lag(us).over(w) > gap if gap is not None else F.lit(False)
    first = F.row_number().over(w) == 1
    return island_ids(df, keys, order, first | change | F.coalesce(pause, F.lit(False)), name)


def bouts(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, gap: int | None = None) -> DataFrame:
    """One row for each run of a label: start, end (last row) and number of rows."""
    runs = label_runs(df, keys, us, order, label, gap)
    return runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_rows"))


def run_lengths(df: DataFrame, keys: list[str], us: str, order: list[str], label: str) -> DataFrame:
    """Each row with the number of rows of its run."""
    runs = label_runs(df, keys, us, order, label)
    return runs.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run")))


def changes(df: DataFrame, keys: list[str], us: str, order: list[str], value: str) -> DataFrame:
    """Run-length code of a changing value: when each run begins and how long it lasts until the next."""
    w = _ordered(keys, order)
    kept = df.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kept = kept.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")
    return kept.withColumn("lasts_us", F.lead(us).over(w) - F.col(us))


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Merges intervals that overlap, touch or are ``gap`` or less apart."""
    w = _ordered(keys, [start, end])
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = island_ids(df, keys, [start, end], F.col(start) - reached > gap)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))


def snaps(df: DataFrame, keys: list[str], us: str, order: list[str], gap: int, least: int, merge: int) -> DataFrame:
    """Blocks of rows that last ``least`` or longer, merged if ``merge`` or less apart."""
    blocks = gap_blocks(df, keys, us, order, gap).groupBy(*keys, "block").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"))
    return interval_union(blocks.where(F.col("end_us") - F.col("start_us") >= least), keys, "start_us", "end_us", merge)


def merge_short(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, block: str, least: int, out: str = "smoothed") -> DataFrame:
    """A run shorter than ``least`` between two runs of one other label, in the same block, takes that label.

    One pass: decided on the runs as they were.
    """
    runs = label_runs(df, [*keys, block], us, order, label)
    inside = [*keys, block]
    # Per row the label before and after its run, from the rows at the run's edges.
    spans = runs.groupBy(*inside, "run").agg(F.first(label).alias("_own"), F.min(us).alias("_a"), F.max(us).alias("_b"))
    w = Window.partitionBy(*inside).orderBy("run")
    spans = spans.withColumn("_left", F.lag("_own").over(w)).withColumn("_right", F.lead("_own").over(w))
    short = (F.col("_b") - F.col("_a") < least) & (F.col("_left") == F.col("_right"))
    decided = spans.select(*inside, "run", F.when(short, F.col("_left")).otherwise(F.col("_own")).alias(out))
    return runs.join(decided, [*inside, "run"]).drop("run")


def longest(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The longest interval of each key; of equally long ones the first."""
    w = Window.partitionBy(*keys).orderBy((F.col(end) - F.col(start)).desc(), F.col(start))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlapping_neighbours(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Intervals of a chain that begin before the previous one has ended; of equal ones the lesser ``name`` is before the other, so each run gives the same rows.

    An interval without a start or an end comes after those that have one.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in (start, end, name)])
    return df.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))
