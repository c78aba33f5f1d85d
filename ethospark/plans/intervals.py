"""Islands, intervals and joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR, floor_to, micros
from ethospark.operators import islands, joins
from ethospark.plans.base import BOUTS, OBS, H, gap_bouts, observations, query, table

KEYS, ORDER = ["subject"], ["us", "event_id"]


def islands_sql(start: str, source: str, order: str = "us, event_id", keys: str = "subject", marked: str = "marked", numbered: str = "numbered") -> str:
    """SQL of two tables that number the islands of ``source``."""
    return f"""{marked} AS (SELECT *, CASE WHEN {start} THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{numbered} AS (SELECT *, (sum(fresh) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM {marked})"""


BLOCKS = islands_sql(f"us - lag(us) OVER w <= {6 * H}", "obs")
RUNS = islands_sql("label = lag(label) OVER w", "obs")


def union_sql(source: str, gap: int) -> str:
    return f"""reach AS (SELECT *, max(end_us) OVER (PARTITION BY subject ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}),
cut AS (SELECT *, (sum(CASE WHEN start_us - far <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM reach)"""


@query(f"WITH {BOUTS} SELECT subject, run, label, start_us, end_us, n_rows FROM bouts")
def bouts_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a label, also broken by pauses."""
    return gap_bouts(spark, sf_dir).select("subject", "run", "label", "start_us", "end_us", "n_rows")


@query(f"WITH {OBS}, {RUNS} SELECT subject, island AS run, min(label) AS label, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM numbered GROUP BY subject, island")
def bouts_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a label."""
    return islands.bouts(observations(spark, sf_dir), KEYS, "us", ORDER, "label").select("subject", "run", "label", "start_us", "end_us", "n_rows")


@query(f"WITH {OBS}, {RUNS} SELECT event_id, count(*) OVER (PARTITION BY subject, island) AS run_length FROM numbered")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the length of its run."""
    return islands.run_lengths(observations(spark, sf_dir), KEYS, "us", ORDER, "label").select("event_id", "run_length")


@query(f"WITH {OBS}, {BLOCKS} SELECT subject, island AS block, count(*) AS n_rows, min(us) AS start_us, max(us) AS end_us FROM numbered GROUP BY subject, island")
def gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of rows without a pause of more than six hours."""
    blocks = islands.gap_blocks(observations(spark, sf_dir), KEYS, "us", ORDER, 6 * HOUR)
    return blocks.groupBy("subject", "block").agg(F.count("*").alias("n_rows"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query(f"""WITH {OBS}, c AS (SELECT *, lag(label) OVER w AS before, row_number() OVER w AS k FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
kept AS (SELECT * FROM c WHERE k = 1 OR label IS DISTINCT FROM before) SELECT subject, us, label, lead(us) OVER (PARTITION BY subject ORDER BY us, event_id) - us AS lasts_us FROM kept""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length code of a changing value."""
    return islands.changes(observations(spark, sf_dir), KEYS, "us", ORDER, "label").select("subject", "us", "label", "lasts_us")


@query(f"WITH {BOUTS}, {union_sql('bouts', H)} SELECT subject, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged FROM cut GROUP BY subject, island")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts merged if an hour or less apart."""
    return islands.interval_union(gap_bouts(spark, sf_dir), KEYS, "start_us", "end_us", HOUR).select("subject", "start_us", "end_us", "n_merged")


@query(f"""WITH {OBS}, {BLOCKS}, blocks AS (SELECT subject, min(us) AS start_us, max(us) AS end_us FROM numbered GROUP BY subject, island HAVING max(us) - min(us) >= {H}),
{union_sql('blocks', 12 * H)} SELECT subject, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged FROM cut GROUP BY subject, island""")
def snap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long blocks, merged if near each other."""
    return islands.snaps(observations(spark, sf_dir), KEYS, "us", ORDER, 6 * HOUR, HOUR, 12 * HOUR).select("subject", "start_us", "end_us", "n_merged")


OVERLAP_SQL = f"""WITH {BOUTS}, long AS (SELECT *, subject % 10 AS room, start_us AS a, end_us + {6 * H} AS b FROM bouts)
SELECT x.subject AS subject, y.subject AS other, (sum(least(x.b, y.b) - greatest(x.a, y.a)))::BIGINT AS overlap_us FROM long x JOIN long y ON x.room = y.room AND x.subject < y.subject AND x.a < y.b AND y.a < x.b GROUP BY ALL"""


@query(OVERLAP_SQL)
def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the intervals of two subjects in one room overlap."""
    long = gap_bouts(spark, sf_dir).select((F.col("subject") % 10).alias("room"), "subject", F.col("start_us").alias("a"), (F.col("end_us") + 6 * HOUR).alias("b"))
    return joins.overlap_totals(long, ["room"], "subject", "a", "b").select("subject", "other", "overlap_us")


@query(f"""WITH {BOUTS}, bins AS (SELECT DISTINCT subject % 10 AS room, subject, unnest(generate_series(start_us - start_us % {H}, end_us - end_us % {H}, {H})) AS bin_us FROM bouts),
counts AS (SELECT room AS subject, bin_us AS us, bin_us AS event_id, count(*) AS n FROM bins GROUP BY ALL HAVING count(*) > 1), {islands_sql(f"us - lag(us) OVER w <= {H}", "counts", marked="m", numbered="runs")}
SELECT subject AS room, min(us) AS start_us, max(us) + {H} AS end_us, max(n) AS most FROM runs GROUP BY subject, island""")
def concurrency_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When more subjects than allowed are in a room at once."""
    bins = gap_bouts(spark, sf_dir).select((F.col("subject") % 10).alias("room"), "subject", F.explode(joins.buckets(F.col("start_us"), F.col("end_us"), HOUR)).alias("us")).distinct()
    over = bins.groupBy("room", "us").agg(F.count("*").alias("n")).where("n > 1")
    return islands.gap_blocks(over, ["room"], "us", ["us"], HOUR).groupBy("room", "block").agg(F.min("us").alias("start_us"), (F.max("us") + HOUR).alias("end_us"), F.max("n").alias("most")).drop("block")


@query(f"""WITH {BOUTS}, bins AS (SELECT unnest(generate_series(start_us - start_us % {H}, ((end_us + {H - 1}) // {H}) * {H}, {H})) AS us FROM bouts) SELECT us, count(*) AS n_active FROM bins GROUP BY us""")
def activity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts under way at each hour, both ends included."""
    ends = F.sequence(floor_to(F.col("start_us"), HOUR), floor_to(F.col("end_us") + (HOUR - 1), HOUR), F.lit(HOUR))
    return gap_bouts(spark, sf_dir).select(F.explode(ends).alias("us")).groupBy("us").agg(F.count("*").alias("n_active"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, sf_dir)
    return obs.where("label = 'purchase'").select("event_id", "subject", "us"), obs.where("label = 'view'").select("subject", "us", F.col("event_id").alias("other"))


@query(f"""WITH {OBS}, l AS (SELECT * FROM obs WHERE label = 'purchase'), r AS (SELECT * FROM obs WHERE label = 'view'),
pairs AS (SELECT l.event_id, r.event_id AS matched, r.us AS matched_us, abs(l.us - r.us) AS d, (r.us > l.us)::INT AS ahead FROM l JOIN r ON l.subject = r.subject AND abs(l.us - r.us) <= {6 * H}),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ahead, CASE WHEN ahead = 0 THEN -matched ELSE matched END) AS k FROM pairs)
SELECT l.event_id, matched, matched_us FROM l LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (event_id)""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row of another stream within six hours."""
    left, right = _sides(spark, sf_dir)
    return joins.asof(left, right, KEYS, "us", "other", 6 * HOUR).select("event_id", "matched", "matched_us")


@query(f"""WITH {OBS}, l AS (SELECT * FROM obs WHERE label = 'purchase'), r AS (SELECT * FROM obs WHERE label = 'view'),
best AS (SELECT l.event_id, max(r.us) AS matched_us, max_by(r.event_id, (r.us, r.event_id)) AS matched FROM l JOIN r ON l.subject = r.subject AND r.us <= l.us AND l.us - r.us <= {12 * H} GROUP BY l.event_id)
SELECT l.event_id, matched, matched_us FROM l LEFT JOIN best USING (event_id)""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of another stream in the twelve hours before."""
    left, right = _sides(spark, sf_dir)
    return joins.asof(left, right, KEYS, "us", "other", 12 * HOUR, "backward").select("event_id", "matched", "matched_us")


@query(f"""WITH {BOUTS}, wide AS (SELECT subject, run, label AS bout_label, start_us - {3 * H} AS a, end_us + {3 * H} AS b FROM bouts WHERE label IN ('click', 'error'))
SELECT event_id, count(*) AS n_intervals, max_by(bout_label, (CASE WHEN bout_label = 'error' THEN 1 ELSE 0 END, run)) AS chosen FROM obs JOIN wide ON obs.subject = wide.subject AND us BETWEEN a AND b WHERE label = 'view' GROUP BY event_id""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals around a point, and the one of highest priority."""
    wide = gap_bouts(spark, sf_dir).where("label in ('click', 'error')").select("subject", "run", F.col("label").alias("bout_label"), (F.col("start_us") - 3 * HOUR).alias("a"), (F.col("end_us") + 3 * HOUR).alias("b"))
    met = joins.point_in_interval(observations(spark, sf_dir).where("label = 'view'"), wide, KEYS, "us", "a", "b", 6 * HOUR)
    rank = F.struct((F.col("bout_label") == "error").cast("int"), F.col("run"))
    return met.groupBy("event_id").agg(F.count("*").alias("n_intervals"), F.max_by("bout_label", rank).alias("chosen"))


#: Truths by animal and time of day: each order is an interval of an animal's day, later orders override earlier ones.
TRUTHS = f"gt AS (SELECT o_custkey % 100 AS subject, o_orderkey AS seq, o_orderkey * 7919 % 86400 * 1000000 AS a, (o_orderkey * 7919 + (o_orderkey % 5 + 1) * 180) % 86400 * 1000000 AS b, o_orderstatus AS gt_label FROM orders)"


@query(f"""WITH {OBS}, {TRUTHS}, hits AS (SELECT event_id, max_by(gt_label, seq) AS gt_label FROM obs JOIN gt ON obs.subject = gt.subject
AND CASE WHEN a > b THEN us % {24 * H} >= a OR us % {24 * H} <= b ELSE us % {24 * H} BETWEEN a AND b END GROUP BY event_id)
SELECT event_id, coalesce(gt_label, 'standing') AS gt_label FROM obs LEFT JOIN hits USING (event_id)""")
def gt_time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a table gives each animal at times of day, which may wrap midnight; a later interval overrides."""
    k = F.col("o_orderkey")
    clock = lambda c: c % 86400 * 1_000_000
    truths = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("subject"), k.alias("seq"), clock(k * 7919).alias("a"), clock(k * 7919 + (k % 5 + 1) * 180).alias("b"), F.col("o_orderstatus").alias("gt_label"))
    return joins.at_time_of_day(observations(spark, sf_dir), truths, ["subject"], "us", "a", "b", "gt_label", "seq", "standing").select("event_id", "gt_label")


@query(f"""WITH {OBS}, a AS (SELECT subject, us // {6 * H} AS bin, count(*) AS n FROM obs WHERE subject % 2 = 0 GROUP BY ALL), b AS (SELECT subject - 1 AS partner, us // {6 * H} AS bin, count(*) AS n FROM obs WHERE subject % 2 = 1 GROUP BY ALL)
SELECT a.subject, a.bin AS bin, b.bin AS other_bin, a.n AS n, b.n AS other_n FROM a JOIN b ON a.subject = b.partner AND abs(a.bin - b.bin) <= 1""")
def neighbour_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two streams in the same or the next bin."""
    bins = observations(spark, sf_dir).groupBy("subject", F.floor(F.col("us") / (6 * HOUR)).alias("bin")).agg(F.count("*").alias("n"))
    b = bins.where("subject % 2 = 1").select((F.col("subject") - 1).alias("subject"), "bin", F.col("n").alias("other_n"))
    return joins.neighbour_bins(bins.where("subject % 2 = 0"), b, KEYS, "bin", 1).select("subject", "bin", "other_bin", "n", "other_n")


@query("SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 3 = 0)")
def anti_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an earlier scan hasn't seen."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url").distinct(), "url", "left_anti").select("page_id", "url")


@query(f"""WITH {OBS} SELECT l.event_id, r.event_id AS other, r.us - l.us AS apart_us FROM obs l JOIN obs r ON l.subject = r.subject - 1 AND abs(l.us - r.us) <= {H} WHERE l.subject % 2 = 0""")
def paired_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the paired camera within an hour."""
    obs = observations(spark, sf_dir).select("event_id", "subject", "us")
    other = obs.select((F.col("subject") - 1).alias("subject"), F.col("event_id").alias("other"), F.col("us").alias("other_us"))
    met = joins.within(obs.where("subject % 2 = 0"), other, KEYS, "us", "other_us", HOUR)
    return met.select("event_id", "other", (F.col("other_us") - F.col("us")).alias("apart_us"))


@query("""WITH b AS (SELECT user_id, date_trunc('second', ts) AS s, event_type AS behaviour FROM events WHERE event_id % 2 = 0), t AS (SELECT event_id, user_id, date_trunc('second', ts) AS s FROM events)
SELECT event_id, coalesce(behaviour, '00_invalid') AS behaviour FROM t LEFT JOIN b USING (user_id, s)""")
def track_behaviour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their behaviours by the floored time; what has none is invalid."""
    t = observations(spark, sf_dir).select("event_id", "subject", floor_to(F.col("us"), 1_000_000).alias("s"), "label")
    b = t.where("event_id % 2 = 0").select("subject", "s", F.col("label").alias("behaviour"))
    return t.join(b, ["subject", "s"], "left").select("event_id", F.coalesce("behaviour", F.lit("00_invalid")).alias("behaviour"))


@query("""SELECT d.doc_id, coalesce(quality, 0)::INT AS quality, (coalesce(quality, 1) = 1) AS kept FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def quality_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup with a default; rows without a verdict are kept."""
    out = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(0)).cast("int").alias("quality"), (F.coalesce("quality", F.lit(1)) == 1).alias("kept"))


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS a, epoch_us(max(l_shipdate)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
c AS (SELECT *, lag(b) OVER (PARTITION BY o_custkey ORDER BY a, b) AS previous_end FROM t) SELECT o_orderkey, o_custkey, previous_end FROM c WHERE a < previous_end""")
def chain_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a chain that begin before the previous one has ended; rows of one order, customer and date are one interval."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    t = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("a")).agg(micros(F.max("shipped")).alias("b"))
    return islands.overlapping_neighbours(t, ["o_custkey"], "a", "b", "o_orderkey").select("o_orderkey", "o_custkey", "previous_end")


@query(f"""WITH {BOUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY end_us - start_us DESC, start_us) AS n FROM bouts WHERE label = 'view') SELECT subject, run, start_us, end_us FROM k WHERE n = 1""")
def longest_bout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest bout of a label, the first of equally long ones."""
    return islands.longest(gap_bouts(spark, sf_dir).where("label = 'view'"), KEYS, "start_us", "end_us").select("subject", "run", "start_us", "end_us")


@query(f"""WITH {OBS}, d AS (SELECT subject, us - lag(us) OVER (PARTITION BY subject ORDER BY us, event_id) AS d FROM obs), m AS (SELECT subject, median(d)::DOUBLE AS med FROM d WHERE d > 0 GROUP BY subject)
SELECT subject, CASE WHEN med BETWEEN {0.25 * 4 * H} AND {10 * 4 * H} THEN med ELSE {4 * H} END::DOUBLE AS interval_us FROM m""")
def sampling_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median step between rows, or a default where that is implausible."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy("subject").orderBy(*ORDER))
    med = observations(spark, sf_dir).withColumn("d", step).where("d > 0").groupBy("subject").agg(F.median("d").alias("med"))
    return med.select("subject", F.when(F.col("med").between(0.25 * 4 * HOUR, 10 * 4 * HOUR), F.col("med")).otherwise(F.lit(float(4 * HOUR))).alias("interval_us"))


