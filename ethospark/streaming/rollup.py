"""Roll-ups that a stream keeps up to date: each batch touches the bins of its own rows and no others.

Three Parquet tables under one path, all partitioned by day:

* ``seen`` (day, batch): the keys of all rows that were counted, so that a row sent again counts once;
* ``deltas`` (day, batch): what each batch adds to each bin;
* ``summary`` (day): the bins themselves, the sums of their deltas.

A batch overwrites only what it wrote under its own number before, and the days it touches are summed up from their
deltas, which are small. So a batch that is run again, or half written by a driver that was lost, changes nothing. Days that
no batch touches are neither read nor listed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import DAY, floor_to

#: Rows of a day in a batch for which it has another file.
FILE_ROWS = 500_000
#: Rows of a batch that a task compares with those that were counted, about.
TASK_ROWS = 50_000


def _days(spark: SparkSession, path: str, days: Iterable[int], schema: str) -> DataFrame:
    """The partitions of some days; empty where a day has none."""
    found = spark.createDataFrame([], f"{schema}, day long, batch long")
    for day in days:
        try:
            part = spark.read.schema(f"{schema}, day long, batch long").option("basePath", path).parquet(f"{path}/day={day}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = found.unionByName(part)
    return found


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _put(df: DataFrame, path: str, days: dict[int, int], spread: list[str], *by: str) -> None:
    """Replaces the partitions of ``df``. A day is dealt to few tasks by ``spread``, one for ``FILE_ROWS`` of its rows in the batch (``days``), so it has few files."""
    files = F.create_map(*[F.lit(x) for day, n in days.items() for x in (day, max(1, -(-n // FILE_ROWS)))])
    dealt = df.repartition(F.col("day"), F.pmod(F.xxhash64(*spread), files[F.col("day")]))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_batch(batch: DataFrame, number: int, path: str, ids: list[str], keys: list[str], us: str, label: str, labels: list[str], width: int) -> None:
    """Counts the rows of one batch in the bins of ``width`` microseconds of (keys, bin). The days of a batch come to the driver: a stream has few at a time.

    Rows whose ``ids`` were counted on the same day, in this batch or an earlier one, are left out, and so are rows without a time.
    """
    spark = batch.sparkSession
    rows = batch.where(F.col(us).isNotNull()).select(*dict.fromkeys([*ids, *keys, us, label])).withColumn("day", F.floor(F.col(us) / DAY).cast("long"))
    days = {r["day"]: r["count"] for r in rows.groupBy("day").count().sort("day").collect()}
    if not days:
        return
    seen = _days(spark, f"{path}/seen", days, _kinds(rows, ids)).where(F.col("batch") != number).select(*ids, "day", F.lit(True).alias("_seen"))
    # Rows and keys that were counted meet once, in as many tasks as there are rows for; a key counts if nothing of it was.
    both = rows.withColumn("_seen", F.lit(False)).unionByName(seen, allowMissingColumns=True).repartition(-(-sum(days.values()) // TASK_ROWS), *ids, "day")
    once = both.groupBy(*ids, "day").agg(F.max("_seen").alias("_seen"), *[F.first(c).alias(c) for c in rows.columns if c not in {*ids, "day"}])
    fresh = once.where(~F.col("_seen")).drop("_seen").withColumn("batch", F.lit(number).cast("long")).persist()
    try:
        deltas = fresh.groupBy(*keys, floor_to(F.col(us), width).alias("bin_us"), "day", "batch").agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])
        _put(deltas, f"{path}/deltas", days, [*keys, "bin_us"], "day", "batch")
        _put(fresh.select(*ids, "day", "batch"), f"{path}/seen", days, ids, "day", "batch")
        every = _days(spark, f"{path}/deltas", days, f"{_kinds(rows, keys)}, bin_us long, {', '.join(f'`{x}` long' for x in labels)}")
        summed = every.groupBy(*keys, "bin_us", "day").agg(*[F.sum(x).alias(x) for x in labels])
        _put(summed, f"{path}/summary", days, [*keys, "bin_us"], "day")
    finally:
        fresh.unpersist()


def roll_up(stream: DataFrame, path: str, ids: list[str], keys: list[str], us: str, label: str, labels: list[str], width: int) -> None:
    """Runs ``merge_batch`` over all that a stream has; called again, it goes on where it stopped."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, ids, keys, us, label, labels, width)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The bins as they stand. Before the first row there is no table: Spark's error says so."""
    return spark.read.parquet(f"{path}/summary")
