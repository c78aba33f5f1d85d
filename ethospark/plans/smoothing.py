"""Smoothing of label sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import HOUR, floor_to
from ethospark.operators import islands, smooth
from ethospark.plans.base import LABELS, OBS, H, observations, query, table
from ethospark.plans.intervals import BLOCKS, KEYS, ORDER

INVALID = "error"
VALID = [x for x in LABELS if x != INVALID]


def counts_sql(frame: str, labels: list[str] = VALID) -> str:
    return ", ".join(f"count(*) FILTER (WHERE label = '{x}') OVER {frame} AS c_{x}" for x in labels)


def winner_sql(labels: list[str] = VALID) -> str:
    most = f"greatest({', '.join(f'c_{x}' for x in labels)})"
    return f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN c_{x} = {most} THEN '{x}'" for x in labels) + " END"


WINDOW = f"(PARTITION BY subject ORDER BY us RANGE BETWEEN {12 * H} PRECEDING AND {12 * H} FOLLOWING)"


@query(f"""WITH {OBS}, c AS (SELECT *, count(*) OVER {WINDOW} AS n, {counts_sql(WINDOW)} FROM obs)
SELECT event_id, CASE WHEN n < 5 THEN label ELSE coalesce({winner_sql()}, '{INVALID}') END AS smoothed FROM c""")
def rolling_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred rolling majority that ignores invalid labels."""
    return smooth.rolling_majority(observations(spark, sf_dir), KEYS, "us", "label", VALID, 12 * HOUR, 5, INVALID).select("event_id", "smoothed")


@query(f"""WITH {OBS}, {BLOCKS}, b AS (SELECT event_id, subject, us, label, island AS block FROM numbered),
m AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY subject, block ORDER BY us, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, block ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
s AS (SELECT subject, block, run, min(label) AS own, max(us) - min(us) AS lasts FROM r GROUP BY ALL),
n AS (SELECT *, lag(own) OVER w AS l, lead(own) OVER w AS rr FROM s WINDOW w AS (PARTITION BY subject, block ORDER BY run))
SELECT event_id, CASE WHEN lasts < {H} AND l = rr THEN l ELSE own END AS smoothed FROM r JOIN n USING (subject, block, run)""")
def merge_short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short segments between two equal neighbours take their label, within a block."""
    blocks = islands.gap_blocks(observations(spark, sf_dir), KEYS, "us", ORDER, 6 * HOUR)
    return islands.merge_short(blocks, KEYS, "us", ORDER, "label", "block", HOUR).select("event_id", "smoothed")


@query(f"WITH {OBS}, c AS (SELECT *, {counts_sql(WINDOW)} FROM obs) SELECT event_id, CASE WHEN label = '{INVALID}' THEN coalesce({winner_sql()}, label) ELSE label END AS filled FROM c")
def fill_invalid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid labels take the majority around them."""
    return smooth.fill_from_window(observations(spark, sf_dir), KEYS, "us", "label", VALID, 12 * HOUR, INVALID).select("event_id", "filled")


@query(f"""WITH {OBS}, l AS (SELECT *, last_value(CASE WHEN label <> '{INVALID}' THEN us END IGNORE NULLS) OVER w AS since, last_value(CASE WHEN label <> '{INVALID}' THEN label END IGNORE NULLS) OVER w AS was
FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN label <> '{INVALID}' THEN label WHEN us - since <= {8 * H} THEN was ELSE 'view' END AS filled FROM l""")
def fill_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid labels take the last valid one, if it isn't too old."""
    return smooth.fill_from_last(observations(spark, sf_dir), KEYS, "us", ORDER, "label", 8 * HOUR, INVALID, "view").select("event_id", "filled")


@query(f"""WITH {OBS}, c AS (SELECT *, subject % 30 AS animal, subject % 4 AS camera, us - us % {6 * H} AS bin FROM obs), g AS (SELECT animal, bin, max((label = 'view')::INT) AS any_, min(camera) AS a, max(camera) AS b FROM c GROUP BY ALL)
SELECT event_id, CASE WHEN any_ = 1 AND a < b THEN 'view' ELSE label END AS smoothed FROM c JOIN g USING (animal, bin)""")
def standing_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One behaviour prevails where several cameras see an animal."""
    c = observations(spark, sf_dir).select("event_id", "label", (F.col("subject") % 30).alias("animal"), (F.col("subject") % 4).alias("camera"), floor_to(F.col("us"), 6 * HOUR).alias("bin"))
    return smooth.dominant_when_seen_twice(c, ["animal", "bin"], "label", "view", "camera").select("event_id", "smoothed")


@query(f"""WITH {OBS}, m AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), s AS (SELECT subject, run, min(label) AS own, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT *, lag(own) OVER w AS l, lead(own) OVER w AS rr FROM s WINDOW w AS (PARTITION BY subject ORDER BY run)) SELECT event_id, CASE WHEN n <= 1 AND l = rr THEN l ELSE own END AS smoothed FROM r JOIN k USING (subject, run)""")
def spike_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a row between two equal neighbours take their label."""
    return smooth.remove_spikes(observations(spark, sf_dir), KEYS, "us", ORDER, "label", 1).select("event_id", "smoothed")


IDS = [0, 1, 2, 3]
ID_WINDOW = f"(PARTITION BY camera ORDER BY us RANGE BETWEEN {H} PRECEDING AND {H} FOLLOWING)"


@query(f"""WITH {OBS}, c AS (SELECT event_id, us, subject % 10 AS camera, subject // 10 % 4 AS identity FROM obs),
w AS (SELECT *, count(*) OVER (PARTITION BY camera, us) AS alone, {", ".join(f"count(*) FILTER (WHERE identity = {i}) OVER {ID_WINDOW} AS c{i}" for i in IDS)} FROM c),
o AS (SELECT *, CASE identity {" ".join(f"WHEN {i} THEN c{i}" for i in IDS)} END AS own, greatest({", ".join(f"CASE WHEN identity = {i} THEN 0 ELSE c{i} END" for i in IDS)}) AS most FROM w)
SELECT event_id, CASE WHEN alone = 1 AND most > own THEN CASE {" ".join(f"WHEN identity <> {i} AND c{i} = most THEN {i}" for i in IDS)} END ELSE identity END::INT AS fixed FROM o""")
def identity_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone rows take the identity that dominates around them."""
    c = observations(spark, sf_dir).select("event_id", "us", (F.col("subject") % 10).alias("camera"), (F.floor(F.col("subject") / 10) % 4).cast("int").alias("identity"))
    return smooth.fix_identity_switches(c, ["camera"], "us", "identity", IDS, HOUR).select("event_id", "fixed")


@query(f"""WITH {OBS}, s AS (SELECT *, avg((label IN ('view', 'click'))::INT) OVER (PARTITION BY subject ORDER BY us RANGE BETWEEN {24 * H} PRECEDING AND 1 PRECEDING) AS b,
avg((label IN ('view', 'click'))::INT) OVER (PARTITION BY subject ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {24 * H} FOLLOWING) AS a FROM obs)
SELECT event_id, CASE WHEN label IN ('view', 'click') AND coalesce(b, 0) < 0.3 AND coalesce(a, 0) < 0.3 THEN 'signup' ELSE label END AS smoothed FROM s""")
def isolated_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sleep with hardly any sleep before and after isn't sleep."""
    return smooth.suppress_isolated(observations(spark, sf_dir), KEYS, "us", "label", ["view", "click"], 24 * HOUR, 24 * HOUR, 0.3, "signup").select("event_id", "smoothed")


@query("SELECT event_id, CASE WHEN value < 50 THEN '00_invalid' ELSE event_type END AS label FROM events")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of low confidence become invalid."""
    return observations(spark, sf_dir).select("event_id", smooth.gate_by_confidence(F.col("label"), F.col("value"), 50, "00_invalid").alias("label"))


@query("""SELECT vec_id, CASE WHEN s[1] - s[2] >= 0.05 THEN list_position(e, s[1]) - 1 ELSE 0 END::INT AS class FROM (SELECT vec_id, e, list_reverse_sort(e) AS s FROM (SELECT vec_id, list_slice(embedding, 1, 4)::DOUBLE[] AS e FROM embeddings))""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of four scores, if it leads clearly."""
    scores = F.slice("embedding", 1, 4).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", smooth.gate_by_margin(scores, 0.05).alias("class"))


@query()
def outlier_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure labels that are rare among the twenty around them, where those before have their new labels already."""
    rows = observations(spark, sf_dir).withColumn("confidence", F.col("value") / 100)
    return smooth.outliers(rows, ["subject"], ["us", "event_id"], "label", "confidence").select("event_id", "label", "smoothed")
