"""Identities between cameras, conflicts, social groups and occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import DAY, HOUR, MINUTE
from ethospark.operators import transfer
from ethospark.plans.base import OBS, H, observations, query

D, M = 24 * H, 60_000_000
ALLOWED = ["click", "purchase", "view"]
GROUPS = {"click": 1, "purchase": 1, "view": 2, "signup": 3}
IN = "('click', 'purchase', 'view')"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select((F.col("subject") % 3).alias("camera"), "subject", "label", (F.col("value") / 50).alias("d"))


@query(f"WITH {OBS}, c AS (SELECT subject, label, count(*) AS n FROM obs WHERE label IN {IN} GROUP BY ALL) SELECT subject, label, n FROM c")
def allowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the labels that are allowed."""
    out = transfer.allowed_counts(observations(spark, sf_dir), ["subject"], "label", ALLOWED)
    return out.select("subject", F.explode("counts").alias("label", "n"))


CANDIDATES = f"""{OBS}, s AS (SELECT subject, label, count(*) AS votes, avg(value / 50) AS mean_distance, sum(exp(-value / 50)) AS score FROM obs GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS margin FROM s WINDOW w AS (PARTITION BY subject ORDER BY score DESC, label))"""


@query(f"WITH {CANDIDATES} SELECT subject, label, votes, round(mean_distance, 6) AS mean_distance, round(score, 6) AS score, rank, round(margin, 6) AS margin FROM r WHERE rank <= 3")
def identity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best identities of each track by distance-weighted votes."""
    out = transfer.candidates(_matches(spark, sf_dir), ["subject"], "label", "d", 1.0, 5, 3)
    return out.select("subject", "label", "votes", *[F.round(c, 6).alias(c) for c in ("mean_distance", "score", "margin")], F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {CANDIDATES} SELECT subject, label = 'view' OR (votes >= 8 AND margin >= 0.5 AND mean_distance <= 1.0) AS taken FROM r WHERE rank = 1""")
def identity_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best identity takes the place of the original one."""
    best = transfer.candidates(_matches(spark, sf_dir), ["subject"], "label", "d", 1.0, 5, 1)
    return best.select("subject", transfer.accepted(F.lit("view"), F.col("label"), F.col("votes"), F.col("margin"), F.col("mean_distance"), most_distance=1.0).alias("taken"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY value / 50, label) AS k FROM obs) SELECT subject, label, round(sum(1 / (value / 50 + 1e-6)), 4) AS score FROM r WHERE k <= 9 GROUP BY ALL""")
def nearest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by inverse distances of the nearest matches."""
    return transfer.nearest_score(_matches(spark, sf_dir), ["subject"], "label", "d", 9).select("subject", "label", F.round("score", 4).alias("score"))


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'signup' THEN '' WHEN event_type = 'view' THEN NULL ELSE event_type END AS label, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'other' END AS voted FROM events)
SELECT event_id, coalesce(CASE WHEN coalesce(label, '') NOT IN ('', 'invalid') THEN label END, 'confused') AS two, coalesce(CASE WHEN coalesce(label, '') NOT IN ('', 'invalid') THEN label END, CASE WHEN voted = 'click' THEN voted ELSE 'unknown' END) AS one,
coalesce(CASE WHEN coalesce(label, '') NOT IN ('', 'invalid') THEN label END, 'unknown') AS none FROM l""")
def fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a track without a label, by how many animals are known."""
    kind = F.when(F.col("label") == "error", "invalid").when(F.col("label") == "signup", "").when(F.col("label") == "view", None).otherwise(F.col("label"))
    voted = F.when(F.col("event_id") % 2 == 0, "click").otherwise("other")
    named = {"two": ["click", "view"], "one": ["click"], "none": []}
    return observations(spark, sf_dir).select("event_id", *[transfer.fallback_label(kind, voted, k).alias(n) for n, k in named.items()])


@query(f"""WITH {OBS}, b AS (SELECT subject, us // {6 * H} AS bin, median(value) AS x, median(value / 2) AS y FROM obs GROUP BY ALL),
n AS (SELECT a.subject AS a, o.subject AS b, sqrt((a.x - o.x) ** 2 + (a.y - o.y) ** 2) AS d FROM b a JOIN b o ON a.bin = o.bin AND a.subject % 10 = o.subject % 10 AND a.subject % 20 < 10 AND o.subject % 20 >= 10)
SELECT a, b, count(*) AS bins, CASE WHEN count(*) >= 3 THEN round(median(d), 6) END AS distance FROM n WHERE d <= 40 GROUP BY a, b""")
def overlap_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near tracks of two cameras are to each other."""
    at = observations(spark, sf_dir).groupBy("subject", F.floor(F.col("us") / (6 * HOUR)).alias("bin")).agg(F.median("value").alias("x"), F.median(F.col("value") / 2).alias("y")).withColumn("room", F.col("subject") % 10)
    left, right = at.where("subject % 20 < 10").withColumnRenamed("subject", "a"), at.where("subject % 20 >= 10").withColumnRenamed("subject", "b")
    return transfer.overlap_distances(left, right, ["room"], "bin", "x", "y", "a", "b", 40.0, 3).select("a", "b", "bins", F.round("distance", 6).alias("distance"))


@query(f"""WITH {OBS}, f AS (SELECT *, us // {30 * M} AS bin, subject % 3 AS camera FROM obs), n AS (SELECT a.event_id, b.label, sqrt((a.value - b.value) ** 2 + (a.value / 2 - b.value / 2) ** 2) AS d FROM f a JOIN f b ON a.camera = b.camera AND abs(a.bin - b.bin) <= 1 AND a.label = 'view' AND b.label <> 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, label) AS k FROM n WHERE d <= 30) SELECT f.event_id, r.label AS matched_identity, round(d, 6) AS match_distance FROM f LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (event_id) WHERE f.label = 'view'""")
def nearest_in_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest detection of another camera in neighbouring bins."""
    obs = observations(spark, sf_dir).select((F.col("subject") % 3).alias("camera"), F.col("event_id").alias("frame"), "us", "label", F.col("value").alias("x"), (F.col("value") / 2).alias("y"))
    out = transfer.nearest_in_bins(obs.where("label = 'view'").drop("label"), obs.where("label <> 'view'"), ["camera"], "us", "x", "y", "label", 30 * MINUTE, 1, 30.0)
    return out.select(F.col("frame").alias("event_id"), "matched_identity", F.round("match_distance", 6).alias("match_distance"))


CONFLICTS = f"""{OBS}, c AS (SELECT DISTINCT x.subject % 5 AS room, x.label, x.subject AS a, y.subject AS b FROM obs x JOIN obs y ON x.subject % 5 = y.subject % 5 AND x.label = y.label AND x.subject < y.subject AND abs(x.us - y.us) <= {600 * 1000000} AND x.label <> 'error')"""


@query(f"WITH {CONFLICTS} SELECT room, label, a, b FROM c")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that bear one label at the same time."""
    obs = observations(spark, sf_dir).withColumn("room", F.col("subject") % 5)
    return transfer.label_conflicts(obs, ["room"], "us", "label", "subject", 10 * MINUTE, "error")


@query(f"""WITH {CONFLICTS}, v AS (SELECT subject, label, count(*) AS n FROM obs GROUP BY ALL), l AS (SELECT DISTINCT c.label, CASE WHEN x.n >= y.n THEN b ELSE a END AS subject FROM c JOIN v x ON x.subject = a AND x.label = c.label JOIN v y ON y.subject = b AND y.label = c.label)
SELECT event_id, CASE WHEN l.subject IS NULL THEN obs.label ELSE 'invalid' END AS label FROM obs LEFT JOIN l ON l.subject = obs.subject AND l.label = obs.label""")
def conflict_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after those of the subjects with fewer votes are made invalid."""
    obs = observations(spark, sf_dir).withColumn("room", F.col("subject") % 5)
    return transfer.lose_meetings(obs, ["room"], "us", "label", "subject", 10 * MINUTE, "error").select("event_id", "label")


@query()
def id_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of one camera's tracks from another camera's, without two at a time."""
    obs = observations(spark, sf_dir).select((F.col("subject") % 3).alias("camera"), F.floor(F.col("us") / (5 * DAY)).alias("night"), "subject", "us", "label", (F.col("value") / 50).alias("d"))
    tracks = obs.groupBy("camera", "night", "subject").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("label").alias("original"))
    return transfer.transfer(tracks, obs, ["camera", "night"], "subject", "label", "d")


GROUPED = f"""{OBS}, g AS (SELECT us // {D} AS night, CASE WHEN subject % 2 = 0 THEN 'mit' ELSE 'ohne' END AS room, CASE label WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 END AS grp, value FROM obs),
s AS (SELECT night, room, grp, count(*) AS votes FROM g WHERE grp IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY night, room ORDER BY votes DESC, grp) AS rank FROM s)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select(F.floor(F.col("us") / DAY).alias("night"), F.when(F.col("subject") % 2 == 0, "mit").otherwise("ohne").alias("room"), "label", F.lit(1).alias("n"))
    return transfer.group_votes(obs, ["night"], "room", "label", "n", GROUPS)


@query(f"WITH {GROUPED} SELECT night, room, grp AS \"group\", votes, rank FROM r")
def group_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for social groups by room and night."""
    return _groups(spark, sf_dir).select("night", "room", F.col("group").cast("int").alias("group"), "votes", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {GROUPED}, f AS (SELECT night, max(CASE WHEN room = 'mit' THEN grp END) AS m, max(CASE WHEN room = 'mit' THEN votes END) AS mv, max(CASE WHEN room = 'ohne' THEN grp END) AS o, max(CASE WHEN room = 'ohne' THEN votes END) AS ov FROM r WHERE rank = 1 GROUP BY night),
n AS (SELECT night, room, min_by(grp, rank) AS second FROM r WHERE rank > 1 GROUP BY ALL), t AS (SELECT f.*, (SELECT second FROM n WHERE n.night = f.night AND room = 'mit') AS m2, (SELECT second FROM n WHERE n.night = f.night AND room = 'ohne') AS o2 FROM f),
w AS (SELECT *, CASE WHEN o IS NULL OR o <> m OR mv >= ov THEN m ELSE coalesce((SELECT min_by(grp, rank) FROM r WHERE r.night = t.night AND room = 'mit'), NULL) END AS mg FROM t WHERE m IS NOT NULL)
SELECT night, 'mit' AS room, mg AS "group" FROM w UNION ALL SELECT t.night, 'ohne', CASE WHEN t.m IS NULL OR t.o <> w.mg THEN t.o ELSE t.o2 END FROM t LEFT JOIN w USING (night) WHERE t.o IS NOT NULL""")
def rooms_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which group is in which room."""
    return transfer.rooms_of_groups(_groups(spark, sf_dir).withColumn("group", F.col("group").cast("int")), ["night"], "room")


@query(f"""WITH {OBS}, o AS (SELECT us // {2 * H} AS hour, subject % 20 AS room, subject, label, value FROM obs), a AS (SELECT room, hour, count(DISTINCT subject) AS n FROM o WHERE value >= 10 GROUP BY ALL),
g AS (SELECT o.*, coalesce(a.n, 1) AS n FROM o LEFT JOIN a USING (room, hour) WHERE value >= 20 AND value < 90), p AS (SELECT room, subject, max(n) AS present FROM g GROUP BY ALL),
c AS (SELECT room, subject, label, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT c.*, present, row_number() OVER (PARTITION BY room, subject ORDER BY (CASE WHEN present <= 1 THEN label = 'signup' ELSE label IN ('click', 'purchase') END) DESC, n DESC, label) AS k FROM c JOIN p USING (room, subject))
SELECT room, subject, label, present FROM r WHERE k = 1""")
def occupancy_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's label among those that may be there, by how many are seen; fewer frames vote than are seen."""
    obs = observations(spark, sf_dir).withColumn("at", F.floor(F.col("us") / (2 * HOUR))).withColumn("room", F.col("subject") % 20)
    return transfer.occupancy_votes(obs, ["room"], "subject", "at", "label", F.col("value") >= 10, (F.col("value") >= 20) & (F.col("value") < 90), ["signup"], ["click", "purchase"])


@query(f"""WITH {OBS}, c AS (SELECT us // {D} AS night, CASE subject % 5 WHEN 0 THEN 'c0' WHEN 1 THEN 'c1' WHEN 2 THEN 'c2' WHEN 3 THEN 'c3' ELSE 'c4' END AS camera, count(*) AS n FROM obs WHERE label = 'purchase' GROUP BY ALL),
p AS (SELECT *, CASE camera WHEN 'c0' THEN 'c3' WHEN 'c3' THEN 'c0' WHEN 'c1' THEN 'c2' WHEN 'c2' THEN 'c1' END AS other FROM c), q AS (SELECT night, least(camera, other) AS pair, min(camera) AS camera1 FROM p WHERE other IS NOT NULL GROUP BY ALL)
SELECT q.night, camera1, a.n AS tracks1, a.other AS camera2, coalesce(b.n, 0) AS tracks2 FROM q JOIN p a ON a.night = q.night AND a.camera = camera1 LEFT JOIN p b ON b.night = q.night AND b.camera = a.other""")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of both cameras of a pair side by side."""
    obs = observations(spark, sf_dir).where("label = 'purchase'").select(F.floor(F.col("us") / DAY).alias("night"), F.concat(F.lit("c"), F.col("subject") % 5).alias("camera"))
    return transfer.paired_summary(obs.groupBy("night", "camera").agg(F.count("*").alias("n")), ["night"], "camera", "n", {"c0": "c3", "c3": "c0", "c1": "c2", "c2": "c1"})
