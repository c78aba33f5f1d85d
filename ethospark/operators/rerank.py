"""Nearest neighbours re-ranked by k-reciprocal neighbourhoods, as sparse tables.

Two vectors are close if each is among the other's nearest and their neighbourhoods agree. Neighbourhoods are tables with a bounded number of rows a
vector, and every step is a join or a grouped sum of them: nothing has a row or a cell for each pair of vectors.

1. Rank lists (i, j, d2, r) of the ``k1 + 1`` nearest of every vector, itself included.
2. Mutual neighbours: the lists joined with themselves, turned round.
3. A neighbourhood takes in that of a member, at half the depth, if more than two thirds of that are its own already.
4. Weights exp(-d / largest d), summing to one; then the mean over the ``k2`` nearest.
5. Jaccard distance 1 - s / (2 - s), where s is the sum of the lesser weights of shared members: a join on the member.

The new distance of a pair without a shared member is 1 - weight + weight * d. It grows with d, so of these only the ``k`` nearest by d can be among
the best ``k``: candidates are the pairs with a shared member and the old best ``k``, which is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators import vectors
from ethospark.operators.graph import checkpointed


def mutual(lists: DataFrame, k: int) -> DataFrame:
    """Pairs (i, j) that are among each other's ``k + 1`` first."""
    near = lists.where(F.col("r") <= k).select("i", "j")
    return near.join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")


def neighbourhoods(lists: DataFrame, k1: int) -> DataFrame:
    """Pairs (i, j) of mutual neighbours, grown by the neighbourhoods of members that agree with them."""
    own = mutual(lists, k1)
    half = mutual(lists, max(1, round(k1 / 2)))
    sets = own.groupBy("i").agg(F.collect_list("j").alias("own"))  # k1 + 1 members at most
    others = half.groupBy("i").agg(F.collect_list("j").alias("other")).withColumnRenamed("i", "j")
    both = own.join(sets, "i").join(others, "j")
    agree = both.where(F.size(F.array_intersect("own", "other")) * 3 > F.size("other") * 2)
    return own.union(agree.select("i", F.explode("other").alias("j"))).distinct()


def memberships(nodes: DataFrame, near: DataFrame, k1: int, k2: int) -> DataFrame:
    """Rows (i, j, w): how much of i's neighbourhood j is. ``nodes`` has (i, v), ``near`` is the result of ``vectors.nearest`` for ``k1 + 1``."""
    lists = near.where("j is not null")
    grown = neighbourhoods(lists, k1).join(lists.select("i", "j", "d2"), ["i", "j"], "left")
    # Members that a member brought in aren't in the rank list; their distance is worked out.
    brought = grown.where("d2 is null").select("i", "j").join(nodes, "i").join(nodes.select(F.col("i").alias("j"), F.col("v").alias("u")), "j")
    grown = grown.where("d2 is not null").select("i", "j", "d2").union(brought.select("i", "j", vectors.squared(F.col("v"), F.col("u"))))
    w = F.exp(-F.col("d2") / F.greatest("m", F.lit(1e-12)))
    raw = grown.join(widest(near), "i").select("i", "j", w.alias("w"))
    own = checkpointed(raw.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("w")))
    if k2 < 2:
        return own
    first = lists.where(F.col("r") < k2).select("i", F.col("j").alias("l"), F.count("*").over(Window.partitionBy("i")).alias("n"))
    mean = first.join(own.select(F.col("i").alias("l"), "j", "w"), "l").groupBy("i", "j").agg((F.sum("w") / F.first("n")).alias("w"))
    return checkpointed(mean)


def widest(near: DataFrame) -> DataFrame:
    return near.where("j is null").select("i", F.col("d2").alias("m"))


def rerank(queries: DataFrame, gallery: DataFrame, k: int, k1: int = 20, k2: int = 6, weight: float = 0.3, vec: str = "embedding", query_id: str = "query_id", gallery_id: str = "gallery_id") -> DataFrame:
    """Rows (query_id, gallery_id, distance, rank): the ``k`` gallery rows of each query that are nearest by ``weight`` of the squared distance (as a
    share of the largest) and the rest of the Jaccard distance; rank from 1, ties by gallery id.

    Ids are integers, unique in their table; the tables may share ids. Rows without a vector are left out. Of equal distances in rank lists the lesser id is first, and a query before a gallery row.
    """
    node = lambda df, c, side: df.where(F.col(vec).isNotNull()).select((F.col(c).cast("long") * 2 + side).alias("i"), F.col(vec).alias("v"))
    ask, held = node(queries, query_id, 0), node(gallery, gallery_id, 1)
    nodes = checkpointed(ask.unionByName(held))
    near = checkpointed(vectors.nearest(nodes, nodes.withColumnRenamed("i", "j"), k1 + 1))
    member = memberships(nodes, near, k1, k2)

    is_query = F.col("i") % 2 == 0
    left, right = member.where(is_query).select("i", F.col("j").alias("l"), "w"), member.where(~is_query).select(F.col("i").alias("g"), F.col("j").alias("l"), F.col("w").alias("u"))
    shared = left.join(right, "l").groupBy("i", "g").agg(F.sum(F.least("w", "u")).alias("s"))
    old = vectors.nearest(nodes.where(is_query), nodes.where(~is_query).withColumnRenamed("i", "g"), k, right_id="g").where("g is not null")
    pairs = checkpointed(shared.join(old.select("i", "g", "d2"), ["i", "g"], "full"))
    lacking = pairs.where("d2 is null").drop("d2").join(nodes, "i").join(nodes.select(F.col("i").alias("g"), F.col("v").alias("u")), "g")
    every = pairs.where("d2 is not null").select("i", "g", "s", "d2").union(lacking.select("i", "g", "s", vectors.squared(F.col("v"), F.col("u"))))
    s = F.coalesce("s", F.lit(0.0))
    far = (1 - weight) * (1 - s / (2 - s)) + weight * F.col("d2") / F.greatest("m", F.lit(1e-12))
    found = every.join(widest(near), "i").select("i", "g", far.alias("distance"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "g"))).where(F.col("rank") <= k)
    return found.select(F.shiftright("i", 1).alias(query_id), F.shiftright("g", 1).alias(gallery_id), "distance", "rank")
