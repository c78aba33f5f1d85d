"""The live path with state that ends: events come in parts, one a trigger, and an end mark closes what is open."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR
from ethospark.plans.base import LABELS, OBS, observations, query
from ethospark.sources import replay
from ethospark.streaming import live, rollup, stateful

#: Parts of the table, in order of time, that a stream gets one after the other.
PARTS = 4
#: Rows of a file of a part, about.
FILE_ROWS = 1_000_000
SLOTS = 7
GAP = 6 * HOUR
PAUSE = 120_000_000


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{root.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def _in_parts(rows: DataFrame, path: str, again: Column | None = None) -> DataFrame:
    """Writes rows (event_id, us, ..) part by part, in order of time, as a stream would bring them, and returns the stream; rows of a part where ``again`` holds come with the next one too.

    A trigger takes a part: all parts have the same number of files, which grows with the rows, so no part is written by one task.
    """
    first, last, n = (x or 0 for x in rows.agg(F.min("us"), F.max("us"), F.count("*")).first())
    width = (last - first) // PARTS + 1
    part = F.floor((F.col("us") - first) / width)
    count = max(1, -(-n // (PARTS * FILE_ROWS)))
    known = 0
    for k in range(PARTS + (again is not None)):
        mine = part == k
        rows.where(mine | ((part == k - 1) & again) if again is not None else mine).repartition(count).write.mode("append").parquet(path)
        found = len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())
        for _ in range(known + count - found):  # a task without rows writes no file
            rows.where("false").coalesce(1).write.mode("append").parquet(path)
        known += count
    return live.detections(rows.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), count)


def _to_the_end(rows: DataFrame, name: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The log of a stream of ``rows`` with its batch numbers, after an end mark."""
    path = _folder(rows.sparkSession, name)
    stream = _in_parts(rows, f"{path}/in")
    live.drain(run(stream), f"{path}/out", "append")
    live.end_mark(rows, f"{path}/in", "us")
    return live.drain(run(stream), f"{path}/out", "append", numbered=True)


@query(f"""WITH {OBS}, o AS (SELECT subject, us, event_id, label = 'error' AS closes FROM obs),
m AS (SELECT *, CASE WHEN lag(closes) OVER w OR lag(us) OVER w IS NULL OR us - lag(us) OVER w >= {GAP} THEN 1 ELSE 0 END AS fresh FROM o WINDOW w AS (PARTITION BY subject ORDER BY us, closes)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us, closes ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT subject AS track, min(us) AS opened_us, max(us) FILTER (NOT closes) AS last_us, count(*) FILTER (NOT closes) AS n, max(us) AS end_us, CASE WHEN bool_or(closes) THEN 'close' ELSE 'timeout' END AS event
FROM n GROUP BY subject, k HAVING bool_or(NOT closes)""")
def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that a stream opens, extends and closes: by their close events (errors) or after six hours without a row."""
    rows = observations(spark, sf_dir).select("event_id", "subject", "us", (F.col("label") == "error").alias("closes"), F.lit("x").alias("identity"))
    log = _to_the_end(rows, "tracks", lambda s: stateful.tracks(stateful.with_time(s), ["subject"], GAP))
    return stateful.closed_tracks(log).select(F.col("subject").alias("track"), "opened_us", "last_us", "n", "end_us", "event")


@query(f"""WITH {OBS}, k AS (SELECT subject, label, row_number() OVER (PARTITION BY subject, event_id % {SLOTS} ORDER BY us DESC, event_id DESC) AS r FROM obs),
v AS (SELECT subject, label, count(*) AS n FROM k WHERE r = 1 GROUP BY ALL), t AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY subject ORDER BY n DESC, label))
SELECT subject AS track, label AS identity FROM t WHERE k = 1 AND n >= 3 AND n / (n + second) > 0.55""")
def stream_vote_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each track by the votes of the keyframes in its buffer, where a new keyframe in a slot takes back the votes of the old one."""
    rows = observations(spark, sf_dir).select("subject", "us", (F.col("event_id") % SLOTS).alias("slot"), F.array(*[(F.col("label") == x).cast("double") for x in LABELS]).alias("probs"))
    log = _to_the_end(rows, "votes", lambda s: stateful.votes(stateful.with_time(s), ["subject"], LABELS, 3, 0.55, 20_000 * HOUR))
    last = log.groupBy("subject").agg(F.max_by(F.struct("identity"), F.struct("batch", "us")).alias("v")).where("v.identity is not null")
    return last.select(F.col("subject").alias("track"), "v.identity")


@query(f"""WITH {OBS}, c AS (SELECT subject % 4 AS camera, us, floor(value / 5)::BIGINT % 3 AS count FROM obs),
g AS (SELECT camera, us, max(count) AS count FROM c GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR count <> lag(count) OVER w OR us - lag(us) OVER w > {GAP // 6} THEN 1 ELSE 0 END AS fresh, us - lag(us) OVER w > {GAP // 6} AS after_gap FROM g WINDOW w AS (PARTITION BY camera ORDER BY us)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY camera ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM m),
r AS (SELECT camera, k, min(us) AS start_us, max(us) AS last_us, min(count) AS count, bool_or(coalesce(after_gap, false) AND fresh = 1) AS after_gap FROM n GROUP BY camera, k)
SELECT camera, start_us, CASE WHEN lead(start_us) OVER w IS NULL OR lead(after_gap) OVER w THEN last_us ELSE lead(start_us) OVER w END - start_us AS duration_us, count FROM r WINDOW w AS (PARTITION BY camera ORDER BY k)""")
def stream_count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count of each camera as runs, in order of event time; the last run ends with the stream."""
    rows = observations(spark, sf_dir).select((F.col("subject") % 4).alias("camera"), "us", (F.floor(F.col("value") / 5) % 3).cast("long").alias("count"))
    log = _to_the_end(rows, "counts", lambda s: stateful.count_changes(stateful.with_time(s), ["camera"], GAP // 6))
    return log.select("camera", "start_us", "duration_us", "count")


@query(f"WITH {OBS} SELECT subject, us // {GAP} * {GAP} AS bin_us, {', '.join(f'''count(*) FILTER (label = '{x}') AS "{x}"''' for x in LABELS)} FROM obs GROUP BY ALL")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by label in bins of six hours, kept up to date batch by batch, where a third of all rows is sent twice."""
    rows = observations(spark, sf_dir).select("event_id", "subject", "us", "label")
    path = _folder(spark, "rollup")
    stream = _in_parts(rows, f"{path}/in", F.col("event_id") % 3 == 0)
    rollup.roll_up(stream, f"{path}/out", ["event_id"], ["subject"], "us", "label", LABELS, GAP)
    return rollup.summary(spark, f"{path}/out").select("subject", "bin_us", *LABELS)


@query(f"""WITH {OBS}, f AS (SELECT event_id, us, 'c' || subject % 3 AS camera FROM obs), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY us) AS r FROM f) WHERE r % 2 = 1),
p AS (SELECT us, us - lag(us) OVER (ORDER BY us) AS pause FROM (SELECT DISTINCT us FROM k)), c AS (SELECT us, us - sum(greatest(coalesce(pause, 0) - {PAUSE}, 0)) OVER (ORDER BY us) AS replay_us FROM p)
SELECT camera, event_id, us, replay_us::BIGINT AS replay_us FROM k JOIN c USING (us)""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored frames of three cameras as a stream on one clock: every second frame, pauses shortened."""
    path = _folder(spark, "replay")
    frames = observations(spark, sf_dir).select("event_id", "us", F.concat(F.lit("c"), F.col("subject") % 3).alias("camera"))
    replay.write_videos(frames, f"{path}/in", "camera", "us")
    spark.dataSource.register(replay.ReplaySource)
    options = {"path": f"{path}/in", "limit": 4000, "skip": 2, "gap": PAUSE}
    stream = spark.readStream.format("replay").options(**options).load()
    return live.drain(stream, f"{path}/out", "append", at_once=False).select("camera", "event_id", "us", "replay_us")
