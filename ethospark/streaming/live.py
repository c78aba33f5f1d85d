"""The live path: detections as a stream to tumbling counts, track sessions and identity votes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The time of end marks, in microseconds: the year 2200.
FAR = 7_258_118_400_000_000


def detections(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 20) -> DataFrame:
    """A stream of Parquet files; the number of files a trigger takes bounds the work under way."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def flatten(messages: DataFrame, header: list[str], arrays: list[str]) -> DataFrame:
    """Messages with parallel arrays to a row for each element."""
    return messages.select(*header, F.inline(F.arrays_zip(*arrays)))


def tumbling(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window; rows later than ``late`` are dropped by the watermark."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Open, last seen and number of rows of each track, which closes after ``gap`` without a row."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.min(time).alias("opened"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
    return out.select(*keys, "opened", "last_seen", "n")


def votes(stream: DataFrame, key: str, label: str, least: int = 3, ratio: float = 0.65) -> DataFrame:
    """The identity of each track as soon as its votes decide: ``least`` votes or more, and best / (best + second) above ``ratio``.

    State is a count for each label; a track is reported whenever its decision changes.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts, decided = state.get if state.exists else ([], [], None)
        tally = dict(zip(names, counts, strict=True))
        for frame in frames:
            for x, n in frame[label].value_counts().items():
                tally[x] = tally.get(x, 0) + int(n)
        ranked = sorted(tally.items(), key=lambda x: (-x[1], x[0]))
        best, second = ranked[0][1], ranked[1][1] if len(ranked) > 1 else 0
        chosen = ranked[0][0] if best >= least and best / (best + second) > ratio else None
        state.update((list(tally), list(tally.values()), chosen))
        if chosen is not None and chosen != decided:
            yield pd.DataFrame({key: [k[0]], "identity": [chosen], "n_votes": [best]})

    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, identity string, n_votes long", "names array<string>, counts array<long>, decided string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str, numbered: bool = False, at_once: bool = True) -> DataFrame:
    """Runs a stream over what there is and returns its result, read back from ``path`` in a folder that all nodes share.

    Each batch writes its rows under its own number, so a batch that is run again replaces what it wrote. In the mode
    ``complete`` the last batch is the result, in the others all batches are; ``numbered`` keeps their numbers as ``batch``. Called again with
    the same path, the stream goes on where it stopped. Without any batch the result is empty. A source that gives a bounded part at a trigger is
    asked until it has no more (``at_once`` false).
    """
    spark = stream.sparkSession
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    sink = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    if at_once:
        sink.trigger(availableNow=True).start().awaitTermination()
    else:
        query = sink.trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    try:
        rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows if numbered else rows.drop("batch")


def end_mark(df: DataFrame, path: str, us: str, at: int = FAR) -> None:
    """Writes a row of a far time and nothing else like the rows of ``df`` into a folder that a stream reads: the watermark passes all that is open."""
    df.sparkSession.range(1).select(*[F.lit(at if f.name == us else None).cast(f.dataType).alias(f.name) for f in df.schema.fields]).coalesce(1).write.mode("append").parquet(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Appends each micro-batch as Parquet, without rows repeated within it. Spark's checkpoint makes a batch count once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows with keys that weren't seen within the watermark: messages that are sent again count once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def replay_order(df: DataFrame, time: str, skip: int, keys: list[str], gap: str = "60 seconds") -> DataFrame:
    """Rows (.., replay_us): stored frames as one replay of all cameras on a shared clock: every ``skip``-th frame of a key, and pauses longer than ``gap`` shortened to it.

    A pause counts where no camera has a frame. The clock is cut by day, so that no task sees all rows: pauses are summed by day first.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    most = F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00+00:00")) + F.expr(f"INTERVAL {gap}"))
    rows = df.withColumn("_us", us).withColumn("_day", F.floor(us / 86_400_000_000))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_us")) - 1).where(F.col("_k") % skip == 0).drop("_k")
    times = rows.select("_day", "_us").distinct()
    last = times.groupBy("_day").agg(F.max("_us").alias("_last")).withColumn("_before", F.lag("_last").over(Window.orderBy("_day"))).select("_day", "_before")
    w = Window.partitionBy("_day").orderBy("_us")
    cut = times.join(F.broadcast(last), "_day").withColumn("_pause", F.col("_us") - F.coalesce(F.lag("_us").over(w), "_before"))
    cut = cut.withColumn("_saved", F.sum(F.greatest(F.coalesce(F.col("_pause") - most, F.lit(0)), F.lit(0))).over(w))
    days = cut.groupBy("_day").agg(F.max("_saved").alias("_sum")).withColumn("_carried", F.coalesce(F.sum("_sum").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_day", "_carried")
    clock = cut.join(F.broadcast(days), "_day").select("_day", "_us", (F.col("_us") - F.col("_saved") - F.col("_carried")).alias("replay_us"))
    return rows.join(clock, ["_day", "_us"]).drop("_day", "_us")


def close_tracks(target: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Open tracks with the close events applied: end and last identity of those that were closed; a later event wins."""
    w = Window.partitionBy(*keys).orderBy(F.col("end_us").desc())
    last = closed.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col("end_us").alias("_end"), F.col("identity").alias("_identity"))
    both = target.join(last, keys, "left")
    return both.withColumn("end_us", F.coalesce("_end", "end_us")).withColumn("identity", F.coalesce("_identity", "identity")).withColumn("open", F.col("open") & F.col("_end").isNull()).drop("_end", "_identity")


def speed(progress: dict) -> float:
    """Rows a second that a batch of a stream went through, from Spark's report of it; 0 without rows."""
    return float(progress.get("processedRowsPerSecond") or 0.0)
