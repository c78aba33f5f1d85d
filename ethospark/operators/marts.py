"""Roll-ups for dashboards and the warehouse: pivots over dense grids, upserts, night reloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.graph import checkpointed
from ethospark.operators.joins import dense_grid


def label_counts(df: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """Rows of each label by key, a column for each of a fixed list of labels, named after it."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])


def over_grid(counts: DataFrame, subjects: DataFrame, keys: list[str], first: int, last: int, width: int, measures: list[str]) -> DataFrame:
    """Counts for every subject and bin, zero where nothing was seen. ``keys``: the subject's columns, then the bin."""
    grid = dense_grid(subjects, first, last, width, keys[-1])
    return grid.join(counts, keys, "left").select(*keys, *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures])


def drop_empty(df: DataFrame, measures: list[str]) -> DataFrame:
    """Rows with anything but zeros."""
    return df.where(sum((F.coalesce(F.col(m), F.lit(0)) for m in measures), F.lit(0)) > 0)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same key the last one: an upsert that overwrites."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to insert where existing keys stay as they are, and of new rows with the same key the first counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def append_unique(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``existing`` and the rows of ``new`` with keys that it doesn't have."""
    return existing.unionByName(first_wins(new, existing, keys, order), allowMissingColumns=True)


def reload_intervals(existing: DataFrame, new: DataFrame, start: str, end: str, first: int, last: int) -> DataFrame:
    """Replaces all intervals that overlap [first, last) by ``new``."""
    return existing.where(~((F.col(start) < last) & (F.col(end) > first))).unionByName(new)


def surrogate_ids(df: DataFrame, order: list[str], name: str = "id", groups: int | None = None) -> DataFrame:
    """Consecutive ids from 1 in the order of a natural key, the same in every run; rows with equal keys are told apart by all their columns.

    Rows are numbered within ranges of the key, then each range is moved up by the number of rows before it: no task
    sees all rows. The dealt rows are checkpointed, as the bounds of ranges are sampled anew in every evaluation.
    """
    rest = [c for c in df.columns if c not in order]
    keys = [*order, F.xxhash64(*rest)] if rest else order
    dealt = df.repartitionByRange(groups, *keys) if groups else df.repartitionByRange(*keys)
    marked = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    numbered = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = marked.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def night_write(df: DataFrame, path: str, partition: str = "night") -> None:
    """Writes by night; only the nights that are in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
