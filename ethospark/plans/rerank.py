"""Re-ranked nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.operators import rerank
from ethospark.plans.base import query, table

K, K1, K2, WEIGHT = 10, 6, 3, 0.3


@query(f"""WITH n AS (SELECT vec_id * 2 + CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 1 END AS i, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.i, b.i AS j, power(list_distance(a.v, b.v), 2) AS d2 FROM n a, n b),
m AS (SELECT i, max(d2) AS m FROM d GROUP BY i),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) - 1 AS r FROM d),
own AS (SELECT a.i, a.j FROM r a JOIN r b ON a.i = b.j AND a.j = b.i WHERE a.r <= {K1} AND b.r <= {K1}),
half AS (SELECT a.i, a.j FROM r a JOIN r b ON a.i = b.j AND a.j = b.i WHERE a.r <= {K1 // 2} AND b.r <= {K1 // 2}),
agree AS (SELECT o.i, o.j FROM own o JOIN half h ON h.i = o.j LEFT JOIN own s ON s.i = o.i AND s.j = h.j GROUP BY o.i, o.j HAVING count(s.j) * 3 > count(*) * 2),
grown AS (SELECT i, j FROM own UNION SELECT a.i, h.j FROM agree a JOIN half h ON h.i = a.j),
w AS (SELECT g.i, g.j, exp(-d.d2 / m.m) AS w FROM grown g JOIN d USING (i, j) JOIN m ON m.i = g.i),
own_w AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w),
mean AS (SELECT r.i, o.j, sum(o.w) / {K2} AS w FROM r JOIN own_w o ON o.i = r.j WHERE r.r < {K2} GROUP BY r.i, o.j),
s AS (SELECT a.i, b.i AS g, sum(least(a.w, b.w)) AS s FROM mean a JOIN mean b USING (j) WHERE a.i % 2 = 0 AND b.i % 2 = 1 GROUP BY a.i, b.i),
f AS (SELECT d.i, d.j AS g, {1 - WEIGHT} * (1 - coalesce(s, 0) / (2 - coalesce(s, 0))) + {WEIGHT} * d2 / m AS far FROM d JOIN m USING (i) LEFT JOIN s ON s.i = d.i AND s.g = d.j WHERE d.i % 2 = 0 AND d.j % 2 = 1)
SELECT i // 2 AS query_id, g // 2 AS gallery_id, round(far, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY far, g) AS rank FROM f) WHERE rank <= {K}""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest gallery rows of each query row after re-ranking by k-reciprocal neighbourhoods."""
    e = table(spark, sf_dir, "embeddings")
    mine = F.col("vec_id") % 50 == 0
    found = rerank.rerank(e.where(mine).withColumnRenamed("vec_id", "query_id"), e.where(~mine).withColumnRenamed("vec_id", "gallery_id"), K, K1, K2, WEIGHT)
    return found.select("query_id", "gallery_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
