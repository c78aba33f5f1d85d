"""Summaries with their zero rows, repairs of identities, texts of dates, and files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions import text, time
from ethospark.functions.time import HOUR, floor_to
from ethospark.operators import archive, rasters, smooth
from ethospark.operators import timeline as tl
from ethospark.plans.base import BOUTS, LABELS, OBS, H, gap_bouts, observations, query, table
from ethospark.sinks import files

D = 24 * H
#: Bouts with the time at which their night began, at noon.
NIGHTS = f"{BOUTS}, nights AS (SELECT *, (start_us - {12 * H}) // {D} * {D} + {12 * H} AS night_us FROM bouts WHERE end_us > start_us)"


def _nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_bouts(spark, sf_dir).where("end_us > start_us").withColumn("night_us", floor_to(F.col("start_us") - 12 * HOUR, 24 * HOUR) + 12 * HOUR)


@query(f"""WITH {NIGHTS}, k AS (SELECT subject, count(DISTINCT night_us) AS n FROM nights GROUP BY 1), g AS (SELECT subject, n, h AS hour_idx, label FROM k, range(30) r(h), (VALUES {", ".join(f"('{x}')" for x in LABELS)}) v(label)),
m AS (SELECT subject, label, hour_idx, sum(greatest(0, least(end_us, night_us + (hour_idx + 1) * {H}) - greatest(start_us, night_us + hour_idx * {H}))) AS us FROM nights, range(30) r(hour_idx) WHERE start_us < night_us + (hour_idx + 1) * {H} AND end_us > night_us + hour_idx * {H} GROUP BY ALL)
SELECT subject, hour_idx::INT AS hour_idx, label, round(coalesce(us, 0) / 60e6 / n, 6)::DOUBLE AS minutes FROM g LEFT JOIN m USING (subject, hour_idx, label)""")
def hourly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean minutes of each label in each hour of a night over all nights, zeros included."""
    out = tl.hourly_means(_nights(spark, sf_dir), ["subject"], "night_us", "label", "start_us", "end_us", LABELS, 30, HOUR)
    return out.select("subject", "hour_idx", "label", F.round("minutes", 6).alias("minutes"))


@query(f"""WITH {NIGHTS}, p AS (SELECT subject, label, end_us - start_us AS us, CASE WHEN hour(make_timestamp(start_us)) >= 18 THEN 'early' WHEN hour(make_timestamp(start_us)) < 5 THEN 'mid' WHEN hour(make_timestamp(start_us)) < 8 THEN 'morning' END AS part FROM nights WHERE label <> 'error'),
k AS (SELECT * FROM p WHERE part IS NOT NULL), s AS (SELECT subject, part, us, label FROM k UNION ALL SELECT subject, 'overall', us, label FROM k), g AS (SELECT subject, part FROM (SELECT DISTINCT subject FROM k), (VALUES ('early'), ('mid'), ('morning'), ('overall')) v(part))
SELECT subject, part, round(coalesce(sum(us), 0) / 1e6, 6)::DOUBLE AS seconds, count(*) FILTER (label = 'view') AS bouts, round(CASE WHEN sum(us) > 0 THEN 100 * coalesce(sum(us) FILTER (label = 'view'), 0) / sum(us) ELSE 0 END, 6)::DOUBLE AS share FROM g LEFT JOIN s USING (subject, part) GROUP BY ALL""")
def period_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each part of the night, and of all of it, has a label; parts without a bout are zeros."""
    hour = F.hour(time.stamp(F.col("start_us")))
    part = F.when(hour >= 18, "early").when(hour < 5, "mid").when(hour < 8, "morning")
    out = tl.period_shares(_nights(spark, sf_dir), ["subject"], "label", "start_us", "end_us", part, ["early", "mid", "morning"], "view", "error")
    return out.select("subject", "part", F.round("seconds", 6).alias("seconds"), "bouts", F.round("share", 6).alias("share"))


@query(f"""WITH {BOUTS}, w AS (SELECT subject, start_us AS window_us, end_us FROM bouts WHERE end_us > start_us), c AS (SELECT subject, window_us, unnest(generate_series(window_us, end_us - 1, {2 * H})) AS start_us, end_us AS stop FROM w),
b AS (SELECT subject, window_us, start_us, least(start_us + {2 * H}, stop) AS end_us FROM c), t AS (SELECT subject, us, event_id, value AS x, (event_id % 97)::DOUBLE AS y FROM obs),
p AS (SELECT b.*, least(50.0, sqrt((x - lag(x) OVER q) ** 2 + (y - lag(y) OVER q) ** 2)) AS step FROM b JOIN t ON t.subject = b.subject AND us BETWEEN b.start_us AND b.end_us WINDOW q AS (PARTITION BY b.subject, window_us, b.start_us ORDER BY us, event_id)),
s AS (SELECT subject, window_us, start_us, coalesce(sum(step), 0) AS way, count(*) AS n FROM p GROUP BY ALL)
SELECT b.subject, b.window_us, b.start_us, b.end_us, coalesce(n, 0) AS n_points, round(coalesce(way, 0), 6)::DOUBLE AS way, CASE WHEN abs(b.end_us - b.start_us - {2 * H}) <= 1000000 THEN coalesce(way, 0) > 30 ELSE coalesce(way, 0) / (b.end_us - b.start_us) > 30.0 / {2 * H} END AS walking FROM b LEFT JOIN s USING (subject, window_us, start_us)""")
def walking_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches cut into bins of two hours: full ones are walks by their way, the last one by its speed."""
    points = observations(spark, sf_dir).select("subject", "us", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    out = tl.walking_bins(gap_bouts(spark, sf_dir), points, ["subject"], "start_us", "end_us", "us", ["us", "event_id"], "x", "y", 2 * HOUR, 50.0, 30.0)
    return out.select("subject", "window_us", "start_us", "end_us", "n_points", F.round("way", 6).alias("way"), "walking")


@query(f"""WITH {OBS}, c AS (SELECT event_id, us, subject % 3 AS camera, event_id // 6 AS identity FROM obs), s AS (SELECT camera, identity, min(us) AS a, max(us) AS b, count(*) AS own FROM c GROUP BY ALL),
bad AS (SELECT s.camera, s.identity FROM s JOIN c ON c.camera = s.camera AND us BETWEEN a AND b WHERE b - a < {H // 4} GROUP BY s.camera, s.identity, own HAVING count(*) - own > own) SELECT event_id FROM c ANTI JOIN bad USING (camera, identity)""")
def drop_spurious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those of identities that are there for a short time while others have more rows."""
    c = observations(spark, sf_dir).select("event_id", "us", (F.col("subject") % 3).alias("camera"), F.floor(F.col("event_id") / 6).alias("identity"))
    return smooth.drop_spurious(c, ["camera"], "us", "identity", HOUR // 4, 1).select("event_id")


@query("""WITH v AS (SELECT event_id, 30.0 + event_id % 400 AS seconds, [(event_id * 7 % 300)::DOUBLE, (event_id * 13 % 430)::DOUBLE] AS hits FROM events), h AS (SELECT event_id, seconds, unnest(list_filter(hits, lambda x: x <= seconds)) AS t FROM v),
l AS (SELECT *, greatest(0.0, t - 60) AS lo, least(seconds, t + 60) AS hi FROM h), w AS (SELECT *, CASE WHEN hi = seconds AND lo > 0 THEN greatest(0.0, seconds - 120) ELSE lo END AS a, CASE WHEN lo = 0 THEN least(seconds, 120.0) ELSE hi END AS b FROM l),
s AS (SELECT event_id, round(least(a + k * 25.0, greatest(seconds - 0.001, 0)), 3) AS t FROM w, range(6) r(k) WHERE a + k * 25.0 <= b + 1e-9) SELECT event_id, list_sort(list(DISTINCT t::DOUBLE)) AS times FROM s GROUP BY event_id""")
def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times every 25 seconds in two minutes around each hit of a video."""
    i = F.col("event_id")
    v = table(spark, sf_dir, "events").select(i, (F.lit(30.0) + i % 400).alias("seconds"), F.array((i * 7 % 300).cast("double"), (i * 13 % 430).cast("double")).alias("hits"))
    hits = F.filter("hits", lambda x: x <= F.col("seconds"))
    out = v.select("event_id", archive.dense_window(hits, F.col("seconds"), 120.0, 25.0, F.array().cast("array<double>")).alias("times"))
    return out.where(F.size("times") > 0)


MAP = [[0.4, 0.05, -3.0], [-0.02, 0.9, 4.0]]


@query(f"""WITH c AS (SELECT user_id % 4 AS camera, trunc({MAP[0][0]}::DOUBLE * value + {MAP[0][1]}::DOUBLE * (event_id % 97) + {MAP[0][2]}::DOUBLE)::INT AS u, trunc({MAP[1][0]}::DOUBLE * value + {MAP[1][1]}::DOUBLE * (event_id % 97) + {MAP[1][2]}::DOUBLE)::INT AS v FROM events WHERE value IS NOT NULL)
SELECT camera, u, v, count(*) AS n FROM c WHERE u BETWEEN 0 AND 29 AND v BETWEEN 0 AND 79 GROUP BY camera, u, v""")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the cells of a map, of each camera."""
    rows = observations(spark, sf_dir).select((F.col("subject") % 4).alias("camera"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return rasters.heat_counts(rows, ["camera"], "x", "y", MAP, 30, 80)


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(ts)::BIGINT::VARCHAR WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'never' END AS raw, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_ms(epoch(date_trunc('second', make_timestamp(epoch(s)::BIGINT * 1000000)))::BIGINT * 1000) + INTERVAL 1 HOUR * (CASE WHEN s >= TIMESTAMP '2024-03-31 01:00:00' AND s < TIMESTAMP '2024-10-27 01:00:00' THEN 2 ELSE 1 END)
WHEN 1 THEN s - INTERVAL 2 HOUR + INTERVAL 1 HOUR * (CASE WHEN s - INTERVAL 2 HOUR >= TIMESTAMP '2024-03-31 01:00:00' AND s - INTERVAL 2 HOUR < TIMESTAMP '2024-10-27 01:00:00' THEN 2 ELSE 1 END) WHEN 2 THEN s END AS at FROM t""")
def zone_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, times with an offset and naive times as times of Zurich."""
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    shown = lambda p: F.date_format(ts, p)
    raw = F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(k == 2, shown("yyyy-MM-dd HH:mm:ss")).otherwise("never")
    return table(spark, sf_dir, "events").select("event_id", time.zone_time(raw, "Europe/Zurich").alias("at"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '[0-9]{8}') THEN raw[1:4] || '-' || raw[5:6] || '-' || raw[7:8] ELSE raw END AS dashed, coalesce(nullif(replace(trim(raw), '-', ''), ''), 'unknown-date') AS key FROM t""")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of several forms as texts with dashes and as keys of folders."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 0, F.date_format(day, "yyyyMMdd")).when(k % 3 == 1, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"))).otherwise("")
    return table(spark, sf_dir, "orders").select(k, time.date_dash(raw).alias("dashed"), time.date_key(raw).alias("key"))


@query("""WITH g AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id AS subject, list(event_type ORDER BY first) AS labels FROM g GROUP BY user_id""")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each subject in the order in which they first come."""
    rows = observations(spark, sf_dir).groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "label"))), lambda s: s["label"]).alias("all"))
    return rows.select("subject", text.ordered_union(F.col("all")).alias("labels"))


def _folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_files"
    return f"{root.rstrip('/')}/{name}_{uuid.uuid4().hex}"


@query("SELECT strftime(ts, '%Y-%m-%d') AS night, event_type AS label, count(*) + CASE WHEN day(min(ts)) = 2 THEN 1000 ELSE 0 END AS n FROM events GROUP BY ALL")
def written_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as CSV by night, of which one night is then written again, read back."""
    path = _folder(spark, "nights")
    rows = observations(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("night"), "label").agg(F.count("*").alias("n"))
    files.night_csv(rows, path, "night", ["label", "n"])
    files.night_csv(rows.where(F.substring("night", 9, 2) == "02").withColumn("n", F.col("n") + 1000), path, "night", ["label", "n"])
    return spark.read.schema("label string, n long, night string").option("header", True).csv(path).select("night", "label", "n")


@query("SELECT user_id AS track, event_id, value FROM events")
def written_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as CSV, a folder each, read back."""
    path = _folder(spark, "tracks")
    files.track_csv(observations(spark, sf_dir).select(F.col("subject").alias("track"), "us", "event_id", "value"), path, ["track"], ["us"])
    return spark.read.schema("us long, event_id long, value double, track long").option("header", True).csv(path).select("track", "event_id", "value")


@query("SELECT 'f' || event_id AS track_filename, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'old' END AS identity_label FROM events")
def written_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets written as JSON lines, then given the identities of a table, written anew and read back."""
    path = _folder(spark, "tracklets")
    rows = observations(spark, sf_dir).select(F.concat(F.lit("f"), F.col("event_id")).alias("track_filename"), F.lit("old").alias("identity_label"), F.lit(None).cast("string").alias("note"))
    files.tracklet_json(rows, f"{path}/first")
    old = spark.read.schema("track_filename string, identity_label string, note string").json(f"{path}/first")
    known = observations(spark, sf_dir).where("event_id % 3 = 0").select(F.concat(F.lit("f"), F.col("event_id")).alias("track_filename"), F.col("label").alias("identity"))
    files.tracklet_json(files.with_identities(old, known), f"{path}/second")
    return spark.read.schema("track_filename string, identity_label string").json(f"{path}/second")


@query("SELECT label % 4 AS camera, vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def written_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written by camera, read back."""
    path = _folder(spark, "embeddings")
    files.embeddings(table(spark, sf_dir, "embeddings").withColumn("camera", F.col("label") % 4), path, ["camera"])
    back = spark.read.parquet(path)
    return back.select(F.col("camera").cast("long").alias("camera"), "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"""WITH {BOUTS} SELECT subject AS camera, strftime(make_timestamp(start_us // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS start_time, round((end_us - start_us) / 1e6, 3)::DOUBLE AS duration_s, n_rows AS track_count FROM bouts""")
def written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a count appended to a log by camera in two goes, read back."""
    path = _folder(spark, "counts")
    runs = gap_bouts(spark, sf_dir).select(F.col("subject").alias("camera"), "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n_rows").alias("count"))
    for part in (F.col("camera") % 2 == 0, F.col("camera") % 2 == 1):
        files.count_log(runs.where(part), path, ["camera"])
    back = spark.read.schema("start_time string, duration_s double, track_count long, camera long").option("header", True).csv(path)
    return back.select("camera", F.substring("start_time", 1, 19).alias("start_time"), F.round("duration_s", 3).alias("duration_s"), "track_count")


@query("SELECT event_type AS label, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, 'all', count(*) FROM events GROUP BY ALL")
def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts exported by label and date, and a report of totals that is appended to, read back together."""
    path = _folder(spark, "reports")
    rows = observations(spark, sf_dir).groupBy("label", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    files.grouped_export(rows, f"{path}/export", "label", "date")
    totals = rows.groupBy("label").agg(F.sum("n").alias("n"))
    for part in (F.col("label") < "p", F.col("label") >= "p"):
        files.append_report(totals.where(part), f"{path}/report")
    export = spark.read.schema("n long, label string, date string").option("header", True).csv(f"{path}/export").select("label", "date", "n")
    return export.union(spark.read.schema("label string, n long").json(f"{path}/report").select("label", F.lit("all").alias("date"), "n"))
