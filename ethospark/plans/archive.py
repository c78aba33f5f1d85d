"""Texts, rooms and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions import geometry, text
from ethospark.functions.time import HOUR, clock_text
from ethospark.operators import archive, marts, zones
from ethospark.plans.base import OBS, H, observations, query, table


@query("""WITH t AS (SELECT event_id, lpad(CAST(event_id % 26 AS VARCHAR), 2, '0') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') ELSE ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':30' END AS raw FROM events),
p AS (SELECT event_id, rpad(regexp_replace(raw, '[^0-9]', '', 'g'), 6, '0') AS d FROM t) SELECT event_id, CASE WHEN substr(d, 1, 2)::INT < 24 THEN substr(d, 1, 2) || ':' || substr(d, 3, 2) || ':' || substr(d, 5, 2) END AS clock FROM p""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day in several spellings."""
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    kind = F.col("event_id") % 3
    raw = F.concat(two(26), F.when(kind == 0, "").when(kind == 1, two(60)).otherwise(F.concat(F.lit(":"), two(60), F.lit(":30"))))
    return observations(spark, sf_dir).select("event_id", clock_text(raw).alias("clock"))


@query("SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'china' THEN 'PRC' WHEN 'united states' THEN 'USA' ELSE trim(n_name) END AS name FROM nation")
def alias_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in their canonical spelling."""
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias(F.col("n_name"), {"China": "PRC", "United States": "USA"}).alias("name"))


@query("""WITH t AS (SELECT event_id, [event_id % 7, event_id % 5, event_id % 7, 3] AS l FROM events) SELECT event_id, list_sort(list_distinct(l)) AS numbers FROM t""")
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists to distinct numbers."""
    e = F.col("event_id")
    raw = F.concat_ws(", ", (e % 7).cast("string"), F.lit("x"), (e % 5).cast("string"), (e % 7).cast("string"), F.lit("3"))
    return observations(spark, sf_dir).select("event_id", text.whole_numbers(raw).alias("numbers"))


ROOM = "CASE WHEN bool_or(value < 40) AND bool_or(value >= 150) THEN 'both' WHEN bool_or(value < 40) THEN 'with' WHEN bool_or(value >= 150) THEN 'without' ELSE 'other' END"


@query(f"SELECT CAST(ts AS DATE) AS date, user_id % 10 AS individual, {ROOM} AS room, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS notes FROM events GROUP BY ALL")
def room_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The room of each animal and day from all of the day's notes."""
    groups = observations(spark, sf_dir).groupBy(F.to_date("ts").alias("date"), (F.col("subject") % 10).alias("individual"))
    out = groups.agg(F.bool_or(F.col("value") < 40).alias("a"), F.bool_or(F.col("value") >= 150).alias("b"), F.collect_set("label").alias("labels"))
    return out.select("date", "individual", text.room_kind(F.col("a"), F.col("b")).alias("room"), text.unique_join(F.col("labels")).alias("notes"))


@query(f"""WITH r AS (SELECT CAST(ts AS DATE) AS date, user_id % 10 AS individual, {ROOM} AS room FROM events GROUP BY ALL)
SELECT date, count(DISTINCT individual) FILTER (WHERE room = 'with') AS "with", count(DISTINCT individual) FILTER (WHERE room = 'without') AS without, count(DISTINCT individual) FILTER (WHERE room = 'both') AS both_ FROM r GROUP BY date""")
def room_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many animals were in each kind of room, by day."""
    n = lambda kind: F.count_distinct(F.when(F.col("room") == kind, F.col("individual")))
    return room_sets(spark, sf_dir).groupBy("date").agg(n("with").alias("with"), n("without").alias("without"), n("both").alias("both_"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), ''), 'none') AS part FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a path by pattern, with a default."""
    part = F.nullif(F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.coalesce(part, F.lit("none")).alias("part"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of nested JSON by an explicit schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_orderkey, unnest(list_transform(generate_series(0, 4), lambda i: round(o_totalprice * (i + 0.5) / 5, 6))) AS at FROM orders")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to look into a video first."""
    times = archive.segment_midpoints(F.col("o_totalprice"), 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(times).alias("at")).select("o_orderkey", F.round("at", 6).alias("at"))


@query(f"""WITH {OBS}, s AS (SELECT subject, us / 1e6 AS t, label = 'purchase' AS hit FROM obs), h AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {1.5 * 6 * 3600} THEN 0 ELSE 1 END AS fresh FROM s WHERE hit WINDOW w AS (PARTITION BY subject ORDER BY t)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM h), l AS (SELECT subject, max(d) AS d FROM (SELECT subject, max(t) - min(t) AS d FROM c GROUP BY subject, k) GROUP BY subject),
a AS (SELECT subject, count(*) AS n, avg(hit::INT) AS ratio FROM s GROUP BY subject)
SELECT subject, n, round(ratio, 6) AS ratio, round(coalesce(d, 0), 3)::DOUBLE AS longest_span, ratio < 0.2 AND coalesce(d, 0) < 30000 AS to_delete FROM a LEFT JOIN l USING (subject)""")
def empty_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which videos show nothing."""
    s = observations(spark, sf_dir).select("subject", (F.col("us") / 1e6).alias("t"), (F.col("label") == "purchase").alias("hit"))
    out = archive.empty_videos(s, "subject", "t", "hit", 6 * 3600, span=30000)
    return out.select("subject", "n", F.round("ratio", 6).alias("ratio"), F.round("longest_span", 3).alias("longest_span"), "to_delete")


@query("""WITH n AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0), m AS (SELECT url, min(page_id) AS page_id FROM pages WHERE page_id % 2 = 1 GROUP BY url)
SELECT url, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id FROM m WHERE url NOT IN (SELECT url FROM n)""")
def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with the rows added that it doesn't have."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    return marts.append_unique(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0"), ["url"], [F.col("page_id")])


@query(f"""WITH v AS (SELECT user_id % 4 AS camera, event_id, epoch_us(ts) AS a, epoch_us(ts) + {2 * H} AS b FROM events), w AS (SELECT event_id AS event, user_id % 4 AS camera, epoch_us(ts) AS c, epoch_us(ts) + {H} AS d FROM events WHERE event_type = 'purchase')
SELECT event, count(DISTINCT event_id) AS n_videos, string_agg(DISTINCT event_id::VARCHAR, ';' ORDER BY event_id::VARCHAR) AS videos FROM v JOIN w ON v.camera = w.camera AND a < d AND c < b GROUP BY event""")
def event_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos of each event."""
    obs = observations(spark, sf_dir).withColumn("camera", F.col("subject") % 4)
    videos = obs.select("camera", F.col("event_id").cast("string").alias("path"), F.col("us").alias("start_us"), (F.col("us") + 2 * HOUR).alias("end_us"))
    windows = obs.where("label = 'purchase'").select("camera", F.col("event_id").alias("event"), F.col("us").alias("from_us"), (F.col("us") + HOUR).alias("to_us"))
    return archive.window_manifests(videos, windows, ["camera"], "event", "path")


@query("SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE n >= 15 AND k <= 20")
def prune_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small groups go, of large ones the best rows stay."""
    return archive.prune_similar(observations(spark, sf_dir), "subject", "value", "event_id", 15, 20).select("event_id")


@query("""WITH p AS (SELECT trunc(value / 10)::INT AS u, (event_id % 16)::INT AS v, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT unnest(generate_series(-2, 2)) AS d)
SELECT u + a.d AS u, v + b.d AS v, round(sum(n * exp(-(a.d * a.d + b.d * b.d) / 8.0)), 6) AS weight FROM p, o a, o b WHERE u + a.d BETWEEN 0 AND 19 AND v + b.d BETWEEN 0 AND 15 GROUP BY u + a.d, v + b.d""")
def coverage_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of blots around positions."""
    points = observations(spark, sf_dir).select((F.col("value") / 10).alias("x"), (F.col("event_id") % 16).alias("y"))
    out = archive.coverage(points, "x", "y", 20, 16, 2, 2.0)
    return out.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.round("weight", 6).alias("weight"))


ZONE = [(20.0, 5.0), (120.0, 5.0), (120.0, 60.0), (60.0, 90.0), (20.0, 60.0)]


@query("""SELECT event_id, (x BETWEEN 20 AND 120 AND y >= 5 AND y <= CASE WHEN x <= 60 THEN 60 + (x - 20) * 30 / 40 ELSE 90 - (x - 60) * 30 / 60 END) AS inside FROM (SELECT event_id, value AS x, (event_id % 100)::DOUBLE + 0.25 AS y FROM events)""")
def zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which positions are in a zone."""
    p = observations(spark, sf_dir).select("event_id", F.col("value").alias("x"), ((F.col("event_id") % 100).cast("double") + 0.25).alias("y"))
    return p.select("event_id", geometry.in_polygon(F.col("x"), F.col("y"), ZONE).alias("inside"))


@query("""WITH q AS (SELECT label, count(DISTINCT vec_id % 6) AS days, count(*) AS n FROM embeddings GROUP BY label) SELECT label, days // 2 AS query_days, days - days // 2 AS gallery_days, n AS n_rows FROM q WHERE days > 1""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of each label's dates: the lesser half are queries, the rest is the gallery, and no date is in both."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 6).alias("day"), "vec_id")
    days = lambda part: F.count_distinct(F.when(F.col("part") == part, F.col("day")))
    return archive.half_dates_split(e, "label", "day", 7).groupBy("label").agg(days("query").alias("query_days"), days("gallery").alias("gallery_days"), F.count("*").alias("n_rows"))


#: Polygons of five corners, a table with a row for each supplier, drawn in frames of 1920 x 1080.
_X, _Y = "s_suppkey * 137 % 1500", "s_suppkey * 89 % 800"
_CORNERS = [(0, 0), (200, 20), (120, 100), (210, 190), (10, 160)]
#: Positions in frames of two sizes.
_AT = "SELECT event_id, user_id % 3 AS camera, CASE WHEN event_id % 2 = 0 THEN 1920 ELSE 960 END AS width, CASE WHEN event_id % 2 = 0 THEN 1080 ELSE 540 END AS height, (event_id * 7919 % 1800)::INT AS x, (event_id * 104729 % 1000)::INT AS y FROM events"


@query(f"""WITH f AS ({_AT}), z AS (SELECT s_suppkey AS zone, s_suppkey % 3 AS camera, [{", ".join(f"{_X} + {x}" for x, _ in _CORNERS)}] AS px, [{", ".join(f"{_Y} + {y}" for _, y in _CORNERS)}] AS py FROM supplier),
e AS (SELECT zone, camera, w.width, w.height, unnest([{", ".join(f"{{'ax': trunc(px[{k}] * w.width / 1920)::BIGINT, 'ay': trunc(py[{k}] * w.height / 1080)::BIGINT, 'bx': trunc(px[{k % 5 + 1}] * w.width / 1920)::BIGINT, 'by': trunc(py[{k % 5 + 1}] * w.height / 1080)::BIGINT}}" for k in range(1, 6))}]) AS e FROM z, (VALUES (1920, 1080), (960, 540)) w(width, height)),
t AS (SELECT event_id, zone, bool_or((e.bx - e.ax) * (y - e.ay) = (e.by - e.ay) * (x - e.ax) AND x BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND y BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by)) AS on_edge,
count(*) FILTER ((e.ay > y) <> (e.by > y) AND x < e.ax + (y - e.ay) * (e.bx - e.ax)::DOUBLE / (e.by - e.ay)) % 2 = 1 AS odd FROM f JOIN e USING (camera, width, height) GROUP BY event_id, zone)
SELECT event_id, coalesce(list_sort(list(zone) FILTER (on_edge OR odd)), []) AS zones FROM f LEFT JOIN t USING (event_id) GROUP BY event_id""")
def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of its camera that each position is in, from a table of polygons rescaled to the frame."""
    k = F.col("s_suppkey")
    corners = lambda base, at: F.array(*[(base + c[at]).cast("int") for c in _CORNERS])
    drawn = table(spark, sf_dir, "supplier").select((k % 3).alias("camera"), k.alias("zone"), corners(k * 137 % 1500, 0).alias("px"), corners(k * 89 % 800, 1).alias("py"), F.lit(1920).alias("of_width"), F.lit(1080).alias("of_height"))
    i, large = F.col("event_id"), F.col("event_id") % 2 == 0
    frames = table(spark, sf_dir, "events").select(i, (F.col("user_id") % 3).alias("camera"), F.when(large, 1920).otherwise(960).alias("width"), F.when(large, 1080).otherwise(540).alias("height"), (i * 7919 % 1800).cast("int").alias("x"), (i * 104729 % 1000).cast("int").alias("y"))
    return zones.in_zones(frames, drawn, "x", "y").select("event_id", "zones")
