"""Marts and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.functions.time import DAY, HOUR, MINUTE, ceil_to, floor_to, stamp
from ethospark.operators import marts
from ethospark.operators.joins import buckets
from ethospark.plans.base import BOUTS, LABELS, OBS, H, gap_bouts, observations, query, table

COUNTS = ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS \"{x}\"" for x in LABELS)
ZERO = ", ".join(f'coalesce("{x}", 0)::BIGINT AS "{x}"' for x in LABELS)
GRID = f"""ends AS (SELECT min(us - us % {6 * H}) AS a, max(us - us % {6 * H}) AS b FROM obs),
grid AS (SELECT subject, unnest(generate_series(a, b, {6 * H})) AS bin_us FROM (SELECT DISTINCT subject FROM obs), ends)"""


def _ends(obs: DataFrame, width: int) -> tuple[int, int]:
    row = obs.agg(F.min(floor_to(F.col("us"), width)).alias("a"), F.max(floor_to(F.col("us"), width)).alias("b")).first()
    return row["a"] or 0, row["b"] or 0


@query(f"""WITH {OBS}, {GRID}, counts AS (SELECT subject, us - us % {6 * H} AS bin_us, {COUNTS} FROM obs GROUP BY ALL)
SELECT subject, make_timestamp(bin_us) AS bin, {ZERO} FROM grid LEFT JOIN counts USING (subject, bin_us)""")
def behaviour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each behaviour by subject and six hours over the dense grid."""
    obs = observations(spark, sf_dir)
    counts = marts.label_counts(obs.withColumn("bin_us", floor_to(F.col("us"), 6 * HOUR)), ["subject", "bin_us"], "label", LABELS)
    grid = marts.over_grid(counts, obs.select("subject").distinct(), ["subject", "bin_us"], *_ends(obs, 6 * HOUR), 6 * HOUR, LABELS)
    return grid.select("subject", stamp(F.col("bin_us")).alias("bin"), *LABELS)


@query(f"""WITH {BOUTS}, minutes AS (SELECT subject, label, unnest(generate_series(((start_us + {30 * 60_000_000 - 1}) // {30 * 60_000_000}) * {30 * 60_000_000}, end_us, {30 * 60_000_000})) AS bin_us FROM bouts)
SELECT subject, make_timestamp(bin_us) AS bin, {", ".join(f"max((label = '{x}')::INT)::INT AS \"{x}\"" for x in LABELS)} FROM minutes GROUP BY subject, bin_us""")
def ethogram_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which behaviours a subject's bouts cover at each half hour, both ends included."""
    width = 30 * MINUTE
    cut = gap_bouts(spark, sf_dir).withColumn("first", ceil_to(F.col("start_us"), width)).where("first <= end_us")
    bins = cut.select("subject", "label", F.explode(buckets(F.col("first"), F.col("end_us"), width)).alias("bin_us"))
    flags = bins.groupBy("subject", "bin_us").agg(*[F.max((F.col("label") == x).cast("int")).alias(x) for x in LABELS])
    return flags.select("subject", stamp(F.col("bin_us")).alias("bin"), *LABELS)


@query(f"""WITH {OBS}, tracks AS (SELECT subject % 10 AS identity, subject AS track, subject % 4 AS camera, us - us % {6 * H} AS bin_us, count(*) AS n, avg(value) AS location, max(us) - min(us) AS span FROM obs GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY identity, bin_us ORDER BY track) AS k FROM tracks WHERE n > 1 AND span > 1000000)
SELECT identity, make_timestamp(bin_us) AS bin, camera, track, n, round(location, 6) AS location FROM kept WHERE k = 1""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an identity was seen in each bin: tracks of more than a row and a second, the least track of each bin."""
    obs = observations(spark, sf_dir).withColumn("bin_us", floor_to(F.col("us"), 6 * HOUR))
    tracks = obs.groupBy((F.col("subject") % 10).alias("identity"), F.col("subject").alias("track"), (F.col("subject") % 4).alias("camera"), "bin_us").agg(
        F.count("*").alias("n"), F.avg("value").alias("location"), (F.max("us") - F.min("us")).alias("span")
    )
    kept = marts.last_wins(tracks.where((F.col("n") > 1) & (F.col("span") > 1_000_000)), ["identity", "bin_us"], [-F.col("track")])
    return kept.select("identity", stamp(F.col("bin_us")).alias("bin"), "camera", "track", "n", F.round("location", 6).alias("location"))


@query(f"""WITH {OBS}, bins AS (SELECT subject, us - us % {6 * H} AS bin_us, count(*) FILTER (WHERE label IN ('click', 'view')) AS n FROM obs GROUP BY ALL)
SELECT subject, make_timestamp(bin_us - bin_us % {24 * H}) AS day, sum(CASE WHEN n >= 1 THEN 6.0 ELSE 0 END)::DOUBLE AS hours FROM bins GROUP BY ALL""")
def hourly_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each day in whose bins a subject showed one of two behaviours."""
    obs = observations(spark, sf_dir)
    bins = obs.groupBy("subject", floor_to(F.col("us"), 6 * HOUR).alias("bin_us")).agg(F.count_if(F.col("label").isin("click", "view")).alias("n"))
    days = bins.groupBy("subject", floor_to(F.col("bin_us"), DAY).alias("day_us")).agg(F.sum(F.when(F.col("n") >= 1, 6.0).otherwise(0.0)).alias("hours"))
    return days.select("subject", stamp(F.col("day_us")).alias("day"), "hours")


@query(f"""WITH {OBS}, {GRID}, seen AS (SELECT DISTINCT subject, us - us % {6 * H} AS bin_us, 1 AS one FROM obs)
SELECT subject, make_timestamp(bin_us) AS bin, coalesce(one, 0)::INT AS observed FROM grid LEFT JOIN seen USING (subject, bin_us)""")
def observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a subject was seen, for every bin of the grid."""
    obs = observations(spark, sf_dir)
    seen = obs.select("subject", floor_to(F.col("us"), 6 * HOUR).alias("bin_us")).distinct().withColumn("observed", F.lit(1))
    grid = marts.over_grid(seen, obs.select("subject").distinct(), ["subject", "bin_us"], *_ends(obs, 6 * HOUR), 6 * HOUR, ["observed"])
    return grid.select("subject", stamp(F.col("bin_us")).alias("bin"), F.col("observed").cast("int").alias("observed"))


@query(f"""WITH {OBS} SELECT subject, count(*) FILTER (WHERE label = 'click') AS n_left, count(*) FILTER (WHERE label = 'view') AS n_right,
round((count(*) FILTER (WHERE label = 'click'))::DOUBLE / nullif(count(*) FILTER (WHERE label IN ('click', 'view')), 0), 6) AS left_share FROM obs GROUP BY subject""")
def laterality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a subject lay on either side, and the left side's share."""
    left, right = F.count_if(F.col("label") == "click"), F.count_if(F.col("label") == "view")
    out = observations(spark, sf_dir).groupBy("subject").agg(left.alias("n_left"), right.alias("n_right"))
    both = F.col("n_left") + F.col("n_right")
    return out.withColumn("left_share", F.when(both > 0, F.round(F.col("n_left") / both, 6)))


@query("SELECT coalesce(max(ts), TIMESTAMP '1970-01-01') + INTERVAL 1 SECOND AS next_time FROM events")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when on a roll-up has to go on."""
    return observations(spark, sf_dir).agg(stamp(F.coalesce(F.max("us"), F.lit(0)) + F.lit(1_000_000)).alias("next_time"))


@query("""SELECT subject, day, label, event_id FROM (SELECT user_id AS subject, date_trunc('day', ts) AS day, event_type AS label, event_id,
row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each subject and day: the last written."""
    obs = observations(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return marts.last_wins(obs, ["subject", "day"], [F.col("event_id")]).select("subject", "day", "label", "event_id")


@query("""WITH e AS (SELECT user_id AS subject, CAST(ts AS DATE) AS day, event_id, event_type AS label FROM events),
old AS (SELECT DISTINCT subject, day FROM e WHERE event_id % 5 = 0),
new AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY event_id) AS k FROM e WHERE event_id % 5 <> 0)
SELECT subject, day, event_id, label FROM new ANTI JOIN old USING (subject, day) WHERE k = 1""")
def insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert that leaves existing keys alone adds."""
    e = observations(spark, sf_dir).withColumn("day", F.to_date("ts"))
    new, old = e.where("event_id % 5 <> 0"), e.where("event_id % 5 = 0")
    return marts.first_wins(new, old, ["subject", "day"], [F.col("event_id")]).select("subject", "day", "event_id", "label")


@query(f"""WITH {BOUTS}, span AS (SELECT (min(start_us) - min(start_us) % {24 * H}) + {5 * 24 * H} AS a FROM bouts)
SELECT subject, label, start_us, end_us FROM bouts, span WHERE NOT (start_us < a + {14 * H} AND end_us > a)
UNION ALL SELECT -1, 'reloaded', a, a + {14 * H} FROM span""")
def delete_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A night's reload: all bouts that overlap it go, the new ones come."""
    bouts = gap_bouts(spark, sf_dir).select("subject", "label", "start_us", "end_us")
    first = (bouts.agg(F.min(floor_to(F.col("start_us"), DAY)).alias("a")).first()["a"] or 0) + 5 * DAY
    new = spark.createDataFrame([(-1, "reloaded", first, first + 14 * HOUR)], "subject long, label string, start_us long, end_us long")
    return marts.reload_intervals(bouts, new, "start_us", "end_us", first, first + 14 * HOUR)


@query("""SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive ids in the order of a natural key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return marts.surrogate_ids(orders, ["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice", "id")


@query("""SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their dimensions, which have a fixed number of rows and are broadcast by Spark's own estimate."""
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = table(spark, sf_dir, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("""SELECT user_id AS subject, count(*) AS n_rows FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200) GROUP BY user_id""")
def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the ids that a subquery gives."""
    obs = observations(spark, sf_dir)
    ids = obs.where((F.col("label") == "purchase") & (F.col("value") > 200)).select("subject").distinct()
    return obs.join(ids, "subject", "left_semi").groupBy("subject").agg(F.count("*").alias("n_rows"))


@query("""WITH t AS (SELECT user_id AS subject, event_type AS label, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT subject, count(*) AS n_rows FROM t WHERE ts IS DISTINCT FROM before GROUP BY subject""")
def skip_repeated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't have the time of the row before."""
    w = Window.partitionBy("subject").orderBy("us", "event_id")
    out = observations(spark, sf_dir).withColumn("before", F.lag("us").over(w)).where(~F.col("us").eqNullSafe(F.col("before")))
    return out.groupBy("subject").agg(F.count("*").alias("n_rows"))
