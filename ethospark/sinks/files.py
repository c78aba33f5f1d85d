"""Files that are written: tracks, tracklets, embeddings, summaries by night, reports.

All go through Spark's committer: a file appears under its name when its task has succeeded, and a job that fails leaves nothing
half written. A night that is written again replaces itself only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one folder in few tasks, so that a folder has few files."""
    return df.repartition(*[F.col(c) for c in columns])


def track_csv(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One folder of CSV for each track (``keys``), rows in order."""
    _by(df, keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*keys).csv(path)


def embeddings(df: DataFrame, path: str, keys: list[str]) -> None:
    """Vectors as an array column in Parquet, by camera and date."""
    _by(df, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def tracklet_json(df: DataFrame, path: str) -> None:
    """Tracklets as JSON lines, null fields included, so that every line has all keys."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_identities(tracklets: DataFrame, labels: DataFrame, key: str = "track_filename") -> DataFrame:
    """A new snapshot of tracklets whose identity is that of ``labels`` (key, identity) where there is one."""
    return tracklets.join(labels.select(key, F.col("identity").alias("_new")), key, "left").withColumn("identity_label", F.coalesce("_new", "identity_label")).drop("_new")


def night_csv(df: DataFrame, path: str, night: str, columns: list[str]) -> None:
    """A summary's columns as CSV by night; only the nights in ``df`` are replaced."""
    _by(df.select(night, *columns), [night]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(night).csv(path)


def count_log(runs: DataFrame, path: str, keys: list[str]) -> None:
    """The run-length code of a count: start_time, duration_s, track_count."""
    rows = runs.select(*keys, F.timestamp_micros("start_us").cast("timestamp_ntz").cast("string").alias("start_time"), (F.col("duration_us") / 1e6).alias("duration_s"), F.col("count").alias("track_count"))
    _by(rows, keys).sortWithinPartitions("start_time").write.mode("append").option("header", True).partitionBy(*keys).csv(path)


def grouped_export(df: DataFrame, path: str, top: str, date: str) -> None:
    """CSV by folder and date: ``path/top=../date=..``."""
    _by(df, [top, date]).write.mode("overwrite").option("header", True).partitionBy(top, date).csv(path)


def append_report(df: DataFrame, path: str) -> None:
    """Results appended to a report of JSON lines; what is there isn't read or rewritten."""
    df.write.mode("append").json(path)
