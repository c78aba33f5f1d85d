"""Vectors, retrieval, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR
from ethospark.operators import evaluate, regression, vectors
from ethospark.plans.base import BOUTS, OBS, H, gap_bouts, observations, query, table

SIM = "list_dot_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])))"
RANKED = f"""pairs AS (SELECT q.vec_id AS query_id, g.vec_id AS gallery_id, q.label AS own, g.label AS other, {SIM} AS similarity FROM embeddings q JOIN embeddings g ON q.vec_id % 50 = 0 AND g.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, gallery_id) AS rank FROM pairs)"""


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The queries are the rows whose id is divisible by 50, the gallery all rows but the query itself."""
    e = table(spark, sf_dir, "embeddings")
    gallery = e.withColumnRenamed("vec_id", "gallery_id")
    found = vectors.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), gallery, k)
    own, other = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), gallery.select("gallery_id", F.col("label").alias("other"))
    return found.join(own, "query_id").join(other, "gallery_id")


@query(f"WITH {RANKED} SELECT query_id, gallery_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar gallery rows of each query row."""
    return _ranked(spark, sf_dir, 5).select("query_id", "gallery_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {RANKED}, v AS (SELECT query_id, other, count(*) AS n, min(rank) AS first FROM ranked WHERE rank <= 15 GROUP BY ALL)
SELECT query_id, other AS label, n, round(n / 15, 6)::DOUBLE AS share FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, other) AS k FROM v) WHERE k = 1""")
def vote_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity that most of the fifteen nearest neighbours have; ties go to the nearer one."""
    votes = vectors.vote(_ranked(spark, sf_dir, 15), ["query_id"], "other", "rank").where("rank = 1")
    return votes.select("query_id", F.col("other").alias("label"), F.col("count").alias("n"), F.round("share", 6).alias("share"))


@query(f"""WITH {RANKED}, h AS (SELECT query_id, rank, sum((own = other)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits, own = other AS hit FROM ranked)
SELECT query_id, min(rank) AS first_hit, round(avg(hits / rank), 6) AS ap FROM h WHERE hit GROUP BY query_id""")
def cmc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first match and average precision of each query."""
    e = table(spark, sf_dir, "embeddings")
    found = vectors.full_retrieval(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "gallery_id"), "label")
    return found.select("query_id", "first_hit", F.round("ap", 6).alias("ap"))


@query("""WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY ALL)
SELECT label, list(round(m, 6) ORDER BY i) AS embedding FROM m GROUP BY label""")
def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each identity."""
    out = vectors.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS up, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS down FROM embeddings),
c AS (SELECT label, up <= 5 AS h, down <= 5 AS t, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM n), m AS (SELECT label, i, avg(x) FILTER (WHERE h) AS a, avg(x) FILTER (WHERE t) AS b FROM c GROUP BY ALL)
SELECT label, round(sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)), 6) AS similarity FROM m GROUP BY label""")
def head_tail_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the beginning and the end of a track are."""
    p = vectors.prototypes(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 5)
    return p.select("label", F.round(vectors.dot(F.col("head"), F.col("tail")), 6).alias("similarity"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each pair of labels."""
    return evaluate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH p AS (SELECT quality AS t, 1 - toxic AS s FROM labels), c AS (SELECT unnest([0, 1]) AS class)
SELECT class, round(prec, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1, support FROM (
SELECT class, coalesce((SELECT count(*) FROM p WHERE t = class AND s = class) / nullif((SELECT count(*) FROM p WHERE s = class), 0), 0) AS prec,
coalesce((SELECT count(*) FROM p WHERE t = class AND s = class) / nullif((SELECT count(*) FROM p WHERE t = class), 0), 0) AS rec, (SELECT count(*) FROM p WHERE t = class) AS support FROM c)""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    pairs = evaluate.confusion(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("said")), "quality", "said")
    out = evaluate.scores(pairs, "quality", "said")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT event_type AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM events GROUP BY event_type")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse class frequencies."""
    return evaluate.class_weights(observations(spark, sf_dir), "label").select("label", "n", F.round("weight", 6).alias("weight"))


@query(f"WITH {BOUTS} SELECT subject, label, round(sum(end_us - start_us) / {H}::DOUBLE, 6)::DOUBLE AS hours, count(*) AS n_bouts FROM bouts GROUP BY ALL")
def hours_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of bouts of each label."""
    return gap_bouts(spark, sf_dir).groupBy("subject", "label").agg(F.round(F.sum(F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR)), 6).alias("hours"), F.count("*").alias("n_bouts"))


KRUSKAL = """WITH k AS (SELECT event_type AS g, value AS v FROM events), c AS (SELECT v, count(*) AS c FROM k GROUP BY v), r AS (SELECT v, c, sum(c) OVER (ORDER BY v) - c + (c + 1) / 2.0 AS rank FROM c),
s AS (SELECT g, sum(rank) AS r, count(*) AS n FROM k JOIN r USING (v) GROUP BY g), p AS (SELECT sum(r * r / n)::DOUBLE AS s, sum(n)::DOUBLE AS n, count(*) AS groups FROM s), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS ties FROM c)"""


@query(f"{KRUSKAL}, h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, groups, n FROM p, t) SELECT round(h, 6) AS h, groups, n::BIGINT AS n, round((h - groups + 1) / (n - groups), 6) AS eta_squared FROM h")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kruskal-Wallis test of a measure by label, with its effect size."""
    return evaluate.kruskal(observations(spark, sf_dir), "label", "value").select(F.round("h", 6).alias("h"), "groups", "n", F.round("eta_squared", 6).alias("eta_squared"))


@query("""WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS p, sum(q) - sum(s) ** 2 / sum(n) AS total, sum(q) - sum(s * s / n) AS rest FROM g)
SELECT round(1 - rest / total, 6) AS r2, round((total - rest) / (p - 1) / (rest / (n - p)), 6) AS f FROM t""")
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of a measure on the label."""
    fit = evaluate.least_squares(observations(spark, sf_dir), "value", "label")
    return spark.createDataFrame([(fit["r2"], fit["f"])], "r2 double, f double").select(F.round("r2", 6).alias("r2"), F.round("f", 6).alias("f"))


@query("""WITH e AS (SELECT event_type AS a, (user_id % 2)::DOUBLE AS b, value AS y FROM events), w AS (SELECT y - avg(y) OVER (PARTITION BY a) AS y, b - avg(b) OVER (PARTITION BY a) AS b, y AS raw FROM e),
t AS (SELECT count(*)::DOUBLE AS n, var_pop(raw) * count(*) AS total, sum(y * y) - sum(y * b) ** 2 / sum(b * b) AS rest, sum(y * b) / sum(b * b) AS beta, (SELECT count(DISTINCT a) FROM e) + 1 AS p FROM w),
s AS (SELECT *, -n / 2 * (ln(2 * pi() * rest / n) + 1) AS l FROM t)
SELECT n::BIGINT AS n, p::BIGINT AS rank, round(1 - rest / total, 6) AS r2, round(1 - rest / total * (n - 1) / (n - p), 6) AS r2_adjusted, round((total - rest) / (p - 1) / (rest / (n - p)), 6) AS f, round(2 * p - 2 * l, 4) AS aic, round(p * ln(n) - 2 * l, 4) AS bic, round(beta, 6) AS estimate FROM s""")
def ols_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of a measure on two factors, and the estimate of the second one's level."""
    fit = regression.ols(observations(spark, sf_dir).withColumn("half", F.col("subject") % 2), "value", ["label", "half"])
    names = ["r2", "r2_adjusted", "f", "aic", "bic"]
    rows = [(int(fit.stats["n"]), int(fit.stats["rank"]), *[fit.stats[k] for k in names], fit.coefficients[-1][2])]
    out = spark.createDataFrame(rows, f"n long, rank long, {', '.join(f'{k} double' for k in names)}, estimate double")
    return out.select("n", "rank", *[F.round(k, 4 if k in ("aic", "bic") else 6).alias(k) for k in (*names, "estimate")])


@query(f"WITH {OBS} SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(var_samp(value) OVER w, 8) AS variance FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def moving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of the last ten rows."""
    out = evaluate.moving_stats(observations(spark, sf_dir), ["subject"], ["us", "event_id"], "value", 10)
    return out.select("event_id", F.round("mean", 6).alias("mean"), F.round("variance", 8).alias("variance"))


@query(f"WITH {OBS}, d AS (SELECT subject, us - lag(us) OVER (PARTITION BY subject ORDER BY us, event_id) AS d FROM obs) SELECT subject, round(1e6 * count(d) / sum(d), 9)::DOUBLE AS rate FROM d GROUP BY subject HAVING count(d) > 0")
def arrival_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a second from the steps between them."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy("subject").orderBy("us", "event_id"))
    out = observations(spark, sf_dir).withColumn("d", step).where("d is not null").groupBy("subject")
    return out.agg(F.round(1e6 * F.count("d") / F.sum("d"), 9).alias("rate"))


@query("SELECT trunc(value / 10)::INT AS u, (event_id % 7)::INT AS v, count(*) AS n, round(ln(1 + count(*)), 6) AS heat FROM events GROUP BY ALL")
def heat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of positions in the cells of a raster."""
    cells = observations(spark, sf_dir).groupBy((F.col("value") / 10).cast("int").alias("u"), (F.col("event_id") % 7).cast("int").alias("v")).agg(F.count("*").alias("n"))
    return cells.withColumn("heat", F.round(F.log1p("n"), 6))


@query("SELECT user_id % 4 AS camera, (hour(ts) * 2 + minute(ts) // 30)::INT AS slot, count(*) AS n FROM events GROUP BY ALL")
def day_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each half hour of the day."""
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int")
    return observations(spark, sf_dir).groupBy((F.col("subject") % 4).alias("camera"), slot.alias("slot")).agg(F.count("*").alias("n"))
