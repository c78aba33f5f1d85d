"""Gates over tracks and frames, and the choice of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import DAY, HOUR
from ethospark.operators import gates
from ethospark.plans.base import OBS, H, observations, query, table

KEYS, ORDER = ["subject"], ["us", "event_id"]
D = 24 * H
BAD = "(value < 10 OR label = 'error')"
KEPT = "SELECT event_id FROM obs JOIN v USING (subject) WHERE passes"


def track_sql(passes: str) -> str:
    return f"WITH {OBS}, v AS (SELECT subject, {passes} AS passes FROM obs GROUP BY subject) {KEPT}"


def bad() -> F.Column:
    return (F.col("value") < 10) | (F.col("label") == "error")


@query(track_sql(f"count(*) >= 60 AND max(us) - min(us) >= {28 * D} AND avg(CASE WHEN {BAD} THEN 1.0 ELSE 0.0 END) <= 0.3"))
def usable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of tracks that are long enough and not too bad."""
    return gates.usable_tracks(observations(spark, sf_dir), KEYS, "us", bad(), 60, 28 * 86400.0, 0.3).select("event_id")


@query(track_sql(f"count(*) >= 65 AND max(us) - min(us) >= {29 * D}"))
def long_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of long tracks."""
    return gates.long_tracks(observations(spark, sf_dir), KEYS, "us", 65, 29 * 86400.0).select("event_id")


@query(track_sql(f"avg(value) >= 50 AND bool_or(label = 'signup') AND max(us) - min(us) >= {20 * D} AND bool_and(subject % 7 <> 0)"))
def loadable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of tracks that pass the loading gate."""
    return gates.loadable_tracks(observations(spark, sf_dir), KEYS, "us", "value", F.col("label") == "signup", F.col("subject") % 7 != 0, 50.0, 20 * 86400.0).select("event_id")


@query(f"WITH {OBS}, d AS (SELECT *, us // {D} AS day FROM obs), v AS (SELECT subject, day, NOT bool_and({BAD}) AS passes FROM d GROUP BY ALL) SELECT event_id FROM d JOIN v USING (subject, day) WHERE passes")
def not_all_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of days that aren't bad altogether."""
    obs = observations(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return gates.not_all_bad(obs, ["subject", "day"], bad()).select("event_id")


@query(f"WITH {OBS}, d AS (SELECT *, us // {D} AS day FROM obs), v AS (SELECT subject, day, avg(CASE WHEN {BAD} THEN 1.0 ELSE 0.0 END) < 0.5 AND coalesce(avg(CASE WHEN label <> 'view' THEN value END) >= 40, false) AS passes FROM d GROUP BY ALL) SELECT event_id FROM d JOIN v USING (subject, day) WHERE passes")
def confident_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of days that are confident on average; days without a confidence are left out."""
    obs = observations(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY)).withColumn("confidence", F.when(F.col("label") != "view", F.col("value")))
    return gates.confident_tracks(obs, ["subject", "day"], bad(), "confidence", 0.5, 40.0).select("event_id")


@query(f"WITH {OBS} SELECT event_id FROM obs WHERE label <> 'error' AND value >= 20 AND subject % 3 <> 0")
def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid frames of good quality and confidence."""
    quality = F.when(F.col("subject") % 3 == 0, "bad").otherwise("good")
    return observations(spark, sf_dir).where(gates.good_frame(F.col("label"), quality, F.col("value"), "error", 20.0)).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND l_linenumber > 0 AND l_quantity / l_linenumber BETWEEN 1.0 / 3 AND 3")
def box_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of plausible proportions."""
    return table(spark, sf_dir, "lineitem").where(gates.plausible_box(F.col("l_quantity"), F.col("l_linenumber"))).select("l_orderkey", "l_linenumber")


@query(f"WITH {OBS} SELECT event_id, value FROM obs WHERE value >= 45")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections above a score."""
    return gates.scored(observations(spark, sf_dir), "value", 45.0).select("event_id", "value")


@query(f"""WITH {OBS}, m AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT subject, run, min(us) AS a, max(us) AS b FROM n WHERE label = 'view' GROUP BY ALL HAVING max(us) - min(us) >= {2 * H}),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY b - a DESC, a) AS k FROM r) WHERE k = 1),
t AS (SELECT event_id, subject, CASE WHEN value < 5 OR label = 'error' THEN NULL WHEN label <> 'view' AND coalesce((us >= a - {12 * H} AND us < a) OR (us > b AND us <= b + {12 * H}), false) THEN 1 WHEN label = 'purchase' THEN 2 WHEN label <> 'view' THEN 3 ELSE 4 END AS tier FROM obs LEFT JOIN s USING (subject))
SELECT event_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY subject) AS best FROM t) WHERE tier = best""")
def reid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that identify each track best."""
    base = ~((F.col("value") < 5) | (F.col("label") == "error"))
    return gates.reid_frames(observations(spark, sf_dir), KEYS, "us", ORDER, "label", base, ["view"], "purchase", 2 * HOUR, 12 * HOUR).select("event_id", "tier")


@query(f"""WITH {OBS}, p AS (SELECT event_id, subject, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM obs),
s AS (SELECT *, least(greatest(5, least(12, floor(n * 0.1)::INT)), n) AS s FROM p), picked AS (SELECT DISTINCT subject, floor(k * (n - 1) / (s - 1))::BIGINT AS i FROM (SELECT DISTINCT subject, n, s FROM s) t, LATERAL (SELECT unnest(range(0, t.s)) AS k))
SELECT event_id FROM s JOIN picked USING (subject, i)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced frames of each track."""
    return gates.even_sample(observations(spark, sf_dir), KEYS, ORDER, 0.1, 5, 12).select("event_id")


@query(f"WITH {OBS}, p AS (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)) SELECT event_id FROM p WHERE n <= 50 OR i % 10 = 0 OR i < 3 OR i >= n - 3")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame of long tracks, and their ends."""
    return gates.stride_sample(observations(spark, sf_dir), KEYS, ORDER, 50, 10, 3).select("event_id")


@query(f"WITH {OBS}, c AS (SELECT us // {D} AS night, subject % 4 AS camera, list(subject) FILTER (WHERE label = 'purchase') AS ids, count(*) AS tracks FROM obs GROUP BY ALL) SELECT night FROM c WHERE len(ids) > 0 AND tracks > 70 GROUP BY night HAVING count(*) = 4")
def valid_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights that every camera has in good order."""
    obs = observations(spark, sf_dir).withColumn("night", F.floor(F.col("us") / DAY)).withColumn("camera", F.col("subject") % 4)
    seen = obs.groupBy("night", "camera").agg(F.count_if(F.col("label") == "purchase").alias("named"), F.count("*").alias("tracks"))
    return gates.valid_nights(seen.withColumn("ids", F.when(F.col("named") > 0, F.array("named")).otherwise(F.array().cast("array<bigint>"))), "night", "camera", "ids", "tracks", 4, 70)


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 - toxic")
def correct_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that agree with the ground truth."""
    labels = table(spark, sf_dir, "labels")
    return gates.correct(labels.select("doc_id", "quality"), labels.select("doc_id", (1 - F.col("toxic")).alias("truth")), ["doc_id"], "quality", "truth").select("doc_id", "quality")
