"""What the registered queries share: tables under their domain names and the registration itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import micros

LABELS = ["click", "error", "purchase", "signup", "view"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the DuckDB SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: subject, time (naive and in microseconds), label, measure."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), "ts", micros(F.col("ts")).alias("us"), F.col("event_type").alias("label"), "value")


#: The same in DuckDB.
OBS = "obs AS (SELECT event_id, user_id AS subject, ts, epoch_us(ts) AS us, event_type AS label, value FROM events)"
H = 3_600_000_000
#: Label runs with breaks after six hours without a row, as used by several queries.
BOUTS = f"""{OBS},
marked AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR label IS DISTINCT FROM lag(label) OVER w OR us - lag(us) OVER w > {6 * H} THEN 1 ELSE 0 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
bouts AS (SELECT subject, run::BIGINT AS run, min(label) AS label, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM numbered GROUP BY subject, run)"""


def gap_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ethospark.operators.islands import bouts

    return bouts(observations(spark, sf_dir), ["subject"], "us", ["us", "event_id"], "label", 6 * H)
