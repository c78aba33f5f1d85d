"""Connected components of links between tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the session's shared folder; tests without one get a folder in the warehouse."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


#: A node is a hub from so many links on, and from this share of all links.
HUB_ROWS, HUB_SHARE = 1000, 10_000


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (a, b) with ``m`` of ``least`` (a, m, n: the node's links), where the links of a hub are dealt to several tasks by their other end.

    Hubs have a ``HUB_SHARE``-th of all links or more, so there are ``HUB_SHARE`` at most, and they can be broadcast.
    """
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(HUB_ROWS, total // HUB_SHARE)
    hubs = least.where(F.col("n") > bound)
    if hubs.isEmpty():
        return links.join(least.drop("n"), "a")
    parts = F.ceil(F.col("n") / bound).cast("int")
    dealt = links.join(F.broadcast(hubs.select("a", parts.alias("_parts"))), "a", "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int")).otherwise(0)).drop("_parts")
    each = least.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > bound, parts - 1).otherwise(0)))).drop("n")
    return dealt.join(each, ["a", "_part"]).drop("_part")


def _stamp(links: DataFrame) -> tuple:
    """What tells sets of links apart without comparing them row by row: their number, and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): the least id that each id reaches, by large-star and small-star until nothing changes.

    Large-star hangs all larger neighbours of a node onto the least one, small-star the smaller ones; rounds grow with
    the logarithm of a chain's length. Lineage is cut by a checkpoint in every round. Minima are merged before each shuffle, and a hub's links go to several tasks.
    """
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).where("id is not null").distinct()
    links = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _stamp(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = checkpointed(_with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = _with_least(large, least)
        links = checkpointed(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        after = _stamp(links)
        if after == before:
            break
        before = after
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return ids.join(roots, ids["id"] == roots["a"], "left").select("id", F.coalesce("component", "id").alias("component"))
