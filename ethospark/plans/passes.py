"""Smoothing in passes, and tracks put together to animals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR
from ethospark.operators import grouping, islands, passes
from ethospark.plans.base import BOUTS, LABELS, OBS, H, gap_bouts, observations, query, table

KEYS, ORDER, INVALID = ["subject"], ["us", "event_id"], "error"
VALID = [x for x in LABELS if x != INVALID]


@query(f"""WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS at FROM obs),
c AS (SELECT a.event_id, b.label, count(*) AS n, min(b.at) AS first FROM n a JOIN n b ON a.subject = b.subject AND abs(a.us - b.us) <= {12 * H} AND b.label <> '{INVALID}' GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS k FROM c) SELECT event_id, coalesce(w.label, obs.label) AS label FROM obs LEFT JOIN (SELECT * FROM w WHERE k = 1) w USING (event_id)""")
def majority_first_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of the majority whose ties go to the label met first."""
    return passes.majority(observations(spark, sf_dir), KEYS, "us", ORDER, "label", VALID, 12 * HOUR, most=1).select("event_id", "label")


@query()
def majority_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority repeated until it settles."""
    return passes.majority(observations(spark, sf_dir), KEYS, "us", ORDER, "label", VALID, 12 * HOUR).select("event_id", "label")


@query()
def bout_merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short bouts merged until none is left."""
    return passes.merge_bouts(observations(spark, sf_dir), KEYS, "us", ORDER, "label", HOUR, INVALID).select("event_id", "label")


@query(f"""WITH {OBS}, m AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
b AS (SELECT subject, run, min(label) AS own, min(us) AS a, max(us) AS e FROM r GROUP BY ALL), s AS (SELECT *, (a + e) / 2.0 - {24 * H} AS lo, (a + e) / 2.0 + {24 * H} AS hi FROM b WHERE e - a < {3 * H}),
p AS (SELECT s.subject, s.run, b.own, b.run AS other, least(b.e, hi) - greatest(b.a, lo) AS inside, b.e - b.a AS len FROM s JOIN b ON s.subject = b.subject AND s.run <> b.run AND b.own <> '{INVALID}' AND least(b.e, hi) >= greatest(b.a, lo)),
d AS (SELECT subject, run, own, sum(CASE WHEN inside < 10000 THEN greatest(300000, len) ELSE inside END) AS d, min(other) AS first FROM p GROUP BY ALL),
t AS (SELECT *, sum(d) OVER (PARTITION BY subject, run) AS total, row_number() OVER (PARTITION BY subject, run ORDER BY d DESC, first) AS k FROM d)
SELECT event_id, coalesce(t.own, label) AS label FROM r LEFT JOIN (SELECT * FROM t WHERE k = 1 AND d > 0.6 * total) t USING (subject, run)""")
def bout_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short bouts take the label that fills their surroundings: one pass."""
    return passes.dominant_context(observations(spark, sf_dir), KEYS, "us", ORDER, "label", 3 * HOUR, 24 * HOUR, INVALID, most=1).select("event_id", "label")


@query()
def sleep_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sleep without sleep around it is corrected, segment after segment."""
    blocks = islands.gap_blocks(observations(spark, sf_dir), KEYS, "us", ORDER, 24 * HOUR)
    return passes.check_sleep(blocks, KEYS, "us", ORDER, "label", "block", ["view"], 24 * HOUR, INVALID).select("event_id", "label")


@query()
def bout_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short outlier bouts between two long ones, in place."""
    return passes.resolve_bouts(gap_bouts(spark, sf_dir), KEYS, "start_us", "end_us", "label", "i", 24 * HOUR, INVALID).select("subject", "run", "label")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = gap_bouts(spark, sf_dir).where("n_rows > 1")
    name = F.concat_ws("_", "subject", "run")
    return b.select((F.col("subject") % 10).alias("room"), name.alias("track"), (F.col("subject") % 2).cast("int").alias("camera"), (F.col("subject") % 3).cast("int").alias("stitched_id"), (F.col("run") % 9).cast("int").alias("cross_id"), "start_us", "end_us")


@query()
def constrained_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks joined to groups under the rule that one camera sees an animal once."""
    return grouping.constrained_groups(_tracks(spark, sf_dir), ["room"], "track")


@query()
def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups dealt to individuals."""
    tracks = _tracks(spark, sf_dir)
    return grouping.individuals(tracks.join(grouping.constrained_groups(tracks, ["room"], "track"), ["room", "track"]), ["room"], "track")


@query()
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diverse buffer of each track's frames."""
    return grouping.keyframes(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 10, 0.5)
