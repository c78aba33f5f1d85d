"""Heat maps, clusters and what another camera knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import MINUTE
from ethospark.operators import rasters
from ethospark.plans.base import OBS, observations, query, table


@query("""WITH c AS (SELECT event_type AS label, least(19, trunc(value / 25))::INT AS u, (event_id % 12)::INT AS v, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT label, u, v FROM (SELECT DISTINCT label FROM c), (SELECT unnest(range(20))::INT AS u), (SELECT unnest(range(12))::INT AS v)),
l AS (SELECT g.*, ln(coalesce(n, 0) + 1e-7) AS x FROM g LEFT JOIN c USING (label, u, v)), k AS (SELECT d, exp(-d * d / 12.5) / sum(exp(-d * d / 12.5)) OVER () AS w FROM (SELECT unnest(range(-10, 11)) AS d)),
a AS (SELECT g.label, g.u, g.v, sum(w * x) AS x FROM g, k, l WHERE l.label = g.label AND l.v = g.v AND l.u = greatest(0, least(19, g.u + d)) GROUP BY ALL), b AS (SELECT g.label, g.u, g.v, sum(w * x) AS x FROM g, k, a WHERE a.label = g.label AND a.u = g.u AND a.v = greatest(0, least(11, g.v + d)) GROUP BY ALL)
SELECT label, u, v, round(sqrt((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w)), 5) AS alpha FROM b WINDOW w AS (PARTITION BY label)""")
def heat_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blurred heat maps of positions by label."""
    cells = observations(spark, sf_dir).groupBy("label", F.least(F.lit(19), (F.col("value") / 25).cast("int")).alias("u"), (F.col("event_id") % 12).cast("int").alias("v")).agg(F.count("*").alias("n"))
    return rasters.heat_alpha(cells, ["label"], 20, 12).withColumn("alpha", F.round("alpha", 5))


@query(f"""WITH {OBS}, b AS (SELECT event_id, us, subject % 5 AS room FROM obs WHERE label = 'error' AND subject % 2 = 0), g AS (SELECT us, label, subject % 5 AS room FROM obs WHERE label <> 'error' AND subject % 2 = 1),
c AS (SELECT event_id, g.label, count(*) AS n FROM b JOIN g ON b.room = g.room AND abs(b.us - g.us) <= {30 * 60 * 1000000} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, label) AS k FROM c)
SELECT obs.event_id, coalesce(r.label, obs.label) AS label FROM obs LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (event_id) WHERE subject % 2 = 0""")
def valid_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid labels by what another camera of the room has at the time."""
    obs = observations(spark, sf_dir).select(F.col("event_id").alias("row"), (F.col("subject") % 5).alias("room"), (F.col("subject") % 2).alias("side"), "us", "label")
    out = rasters.valid_elsewhere(obs.where("side = 0"), obs.where("side = 1"), ["room"], "us", "label", "error", 30 * MINUTE)
    return out.select(F.col("row").alias("event_id"), "label")


@query("SELECT user_id AS subject, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last label of each track."""
    return rasters.first_and_last(observations(spark, sf_dir), ["subject"], F.struct("us", "event_id"), "label")


@query()
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors, with their place in the plane of most variance."""
    found = rasters.in_two_dimensions(rasters.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 5), "embedding")
    return found.select("vec_id", "cluster", F.get("plane", F.lit(0)).alias("x"), F.get("plane", F.lit(1)).alias("y"))
