"""Timelines and activity budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR, MINUTE, night_bounds, night_of, stamp
from ethospark.operators import timeline as tl
from ethospark.plans.base import BOUTS, LABELS, OBS, H, gap_bouts, observations, query

STEP = 10 * MINUTE
M = 60_000_000
#: Bouts of a subject lengthened by an hour at their end, so that they overlap.
WIDE = f"{BOUTS}, wide AS (SELECT subject, label, start_us, end_us + {H} AS end_us FROM bouts)"
RANK = "list_position([" + ", ".join(f"'{x}'" for x in LABELS) + "], label)"
SLOTS = f"""{WIDE}, cut AS (SELECT subject, label, unnest(generate_series(start_us - start_us % {10 * M}, (end_us - 1) - (end_us - 1) % {10 * M}, {10 * M})) AS slot_us FROM wide),
slots AS (SELECT subject, slot_us, max_by(label, {RANK}) AS label FROM cut GROUP BY ALL)"""
SEGMENTS = f"""{SLOTS}, m AS (SELECT *, CASE WHEN slot_us - lag(slot_us) OVER w <= {10 * M} AND label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM slots WINDOW w AS (PARTITION BY subject ORDER BY slot_us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY slot_us ROWS UNBOUNDED PRECEDING) AS run FROM m),
segs AS (SELECT subject, min(label) AS label, min(slot_us) AS start_us, max(slot_us) + {10 * M} AS end_us FROM s GROUP BY subject, run)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_bouts(spark, sf_dir).select("subject", "label", "start_us", (F.col("end_us") + HOUR).alias("end_us"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.timeline(_wide(spark, sf_dir), ["subject"], "start_us", "end_us", "label", LABELS, STEP)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.segments(_slots(spark, sf_dir), ["subject"], "label", STEP)


@query(f"WITH {SLOTS} SELECT subject, label, (count(*) * 600)::BIGINT AS seconds FROM slots GROUP BY ALL")
def timeline_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each label where priority decides between overlapping bouts."""
    return _slots(spark, sf_dir).groupBy("subject", "label").agg((F.count("*") * 600).alias("seconds"))


@query(f"WITH {SEGMENTS} SELECT subject, label, start_us, end_us FROM segs")
def ethogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline as segments."""
    return _segments(spark, sf_dir).select("subject", "label", "start_us", "end_us")


@query(f"WITH {SLOTS} SELECT subject, slot_us - slot_us % {12 * H} AS bin_us, {', '.join(f'''count(*) FILTER (WHERE label = '{x}') AS "{x}"''' for x in LABELS)} FROM slots GROUP BY ALL")
def activity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each label in each half day."""
    return tl.binned(_slots(spark, sf_dir), ["subject"], "label", LABELS, 12 * HOUR)


@query(f"""WITH {SEGMENTS}, spent AS (SELECT subject, label, sum(end_us - start_us) / {60 * 1_000_000}::DOUBLE AS minutes FROM segs GROUP BY ALL)
SELECT subject, label, round(minutes, 9)::DOUBLE AS minutes, round(CASE WHEN label <> 'error' THEN 100 * minutes / sum(minutes) FILTER (WHERE label <> 'error') OVER (PARTITION BY subject) END, 6)::DOUBLE AS share FROM spent""")
def activity_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and share of each behaviour."""
    out = tl.budget(_segments(spark, sf_dir), ["subject"], "label", "start_us", "end_us", "error")
    return out.select("subject", "label", F.round("minutes", 9).alias("minutes"), F.round("share", 6).alias("share"))


@query(f"""WITH {WIDE}, cut AS (SELECT *, unnest(generate_series(start_us - start_us % {H}, (end_us - 1) - (end_us - 1) % {H}, {H})) AS bin_us FROM wide)
SELECT subject, label, bin_us, round(sum(least(end_us, bin_us + {H}) - greatest(start_us, bin_us)) / {60 * 1_000_000}::DOUBLE, 9)::DOUBLE AS minutes FROM cut GROUP BY ALL""")
def hourly_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each behaviour in each hour."""
    out = tl.by_hour(_wide(spark, sf_dir), ["subject"], "label", "start_us", "end_us", HOUR)
    return out.select("subject", "label", "bin_us", F.round("minutes", 9).alias("minutes"))


PERIOD = "CASE WHEN hour(make_timestamp(us)) BETWEEN 18 AND 22 THEN 'early' WHEN hour(make_timestamp(us)) >= 23 OR hour(make_timestamp(us)) < 4 THEN 'mid' WHEN hour(make_timestamp(us)) < 8 THEN 'morning' END"


@query(f"""WITH {OBS}, p AS (SELECT *, {PERIOD} AS period FROM obs), k AS (SELECT * FROM p WHERE period IS NOT NULL)
SELECT label, period, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM k GROUP BY ALL UNION ALL SELECT label, 'overall', count(*), round(avg(value), 6) FROM k GROUP BY label""")
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of the night, and the night as a whole."""
    obs = observations(spark, sf_dir).withColumn("period", tl.period(F.col("us")))
    return tl.with_overall(obs, ["label"], "period", [F.count("*").alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value")])


@query(f"""WITH {OBS}, t AS (SELECT subject, us, event_id, value AS x, (event_id % 97)::DOUBLE AS y FROM obs),
s AS (SELECT *, least(50.0, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2)) AS step FROM t WINDOW w AS (PARTITION BY subject ORDER BY us, event_id))
SELECT subject, us - us % {12 * H} AS bin_us, round(sum(coalesce(step, 0)), 6)::DOUBLE AS way, count(*) AS n_rows, sum(coalesce(step, 0)) > 60 AS walking FROM s GROUP BY ALL""")
def walking_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way in each bin from clipped steps."""
    t = observations(spark, sf_dir).select("subject", "us", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    out = tl.walking(t, ["subject"], "us", ["us", "event_id"], "x", "y", 12 * HOUR, 50.0, 60.0)
    return out.select("subject", "bin_us", F.round("way", 6).alias("way"), "n_rows", "walking")


@query(f"""WITH {OBS}, s AS (SELECT subject, us - us % {6 * H} AS slot_us, median(value) AS v FROM obs GROUP BY ALL),
n AS (SELECT *, lead(slot_us) OVER w AS t, lead(v) OVER w AS nv FROM s WINDOW w AS (PARTITION BY subject ORDER BY slot_us)),
g AS (SELECT *, unnest(generate_series(slot_us, coalesce(t - {6 * H}, slot_us), {6 * H})) AS at_us FROM n)
SELECT subject, at_us AS slot_us, round(CASE WHEN t IS NULL THEN v ELSE v + (at_us - slot_us) / (t - slot_us) * (nv - v) END, 6)::DOUBLE AS value FROM g""")
def resample_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians on a regular grid, linear in between."""
    out = tl.resample(observations(spark, sf_dir), ["subject"], "us", "value", 6 * HOUR)
    return out.select("subject", "slot_us", F.round("value", 6).alias("value"))


@query(f"""WITH {OBS}, n AS (SELECT subject, (make_timestamp(us - {18 * H}))::DATE AS night, max(us) AS last FROM obs WHERE hour(ts) >= 18 OR hour(ts) < 8 GROUP BY ALL),
b AS (SELECT *, epoch_us(night::TIMESTAMP) AS d FROM n) SELECT subject, night, make_timestamp(d + {18 * H}) AS begins, make_timestamp(CASE WHEN last > d + {31 * H} THEN d + {32 * H} ELSE d + {31 * H} END) AS ends FROM b""")
def night_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and end of each night that a subject was seen in."""
    hour = F.hour("ts")
    nights = observations(spark, sf_dir).where((hour >= 18) | (hour < 8)).groupBy("subject", night_of(F.col("us")).alias("night")).agg(F.max("us").alias("last"))
    a, b = night_bounds(F.col("night"), F.col("last"))
    return nights.select("subject", "night", stamp(a).alias("begins"), stamp(b).alias("ends"))


@query(f"""WITH {SLOTS}, w AS (SELECT DISTINCT subject, unnest(generate_series(start_us - start_us % {10 * M}, (start_us + {H} - 1) - (start_us + {H} - 1) % {10 * M}, {10 * M})) AS slot_us FROM bouts WHERE label = 'purchase')
SELECT subject, label, count(*) AS n_slots FROM (SELECT s.subject, CASE WHEN w.subject IS NOT NULL THEN 'stereotypy' ELSE label END AS label FROM slots s LEFT JOIN w ON s.subject = w.subject AND s.slot_us = w.slot_us) GROUP BY ALL""")
def overlay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows laid over a timeline."""
    windows = gap_bouts(spark, sf_dir).where("label = 'purchase'").select("subject", "start_us", (F.col("start_us") + HOUR).alias("end_us"))
    return tl.overlay(_slots(spark, sf_dir), windows, ["subject"], "label", STEP, "stereotypy").groupBy("subject", "label").agg(F.count("*").alias("n_slots"))
