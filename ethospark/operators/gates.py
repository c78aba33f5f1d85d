"""Quality gates over frames and tracks, and the choice of frames for identification.

A track's verdict is an aggregate over its frames, merged before the shuffle; its frames are kept by a semi-join with the
tracks that pass. Times are microseconds (long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.time import MINUTE, SECOND
from ethospark.operators.islands import label_runs


def seconds_of(us: str) -> Column:
    """Seconds from a track's first frame to its last, as an aggregate."""
    return (F.max(us) - F.min(us)) / F.lit(float(SECOND))


def share(condition: Column) -> Column:
    """Share of the rows where a condition holds, null counting as not, as an aggregate."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def tracks_where(frames: DataFrame, keys: list[str], passes: Column) -> DataFrame:
    """The frames of the tracks for which an aggregate condition is true."""
    verdict = frames.groupBy(*keys).agg(passes.alias("_passes"))
    return frames.join(verdict.where("_passes").select(*keys), keys, "left_semi")


def usable_tracks(frames: DataFrame, keys: list[str], us: str, bad: Column, rows: int = 100, seconds: float = 90.0, most_bad: float = 0.7) -> DataFrame:
    """Tracks of enough frames and seconds, without too many bad or invalid frames."""
    return tracks_where(frames, keys, (F.count("*") >= rows) & (seconds_of(us) >= seconds) & (share(bad) <= most_bad))


def long_tracks(frames: DataFrame, keys: list[str], us: str, rows: int = 20, seconds: float = 60.0) -> DataFrame:
    """Tracks of enough frames and seconds."""
    return tracks_where(frames, keys, (F.count("*") >= rows) & (seconds_of(us) >= seconds))


def loadable_tracks(frames: DataFrame, keys: list[str], us: str, score: str, featured: Column, named: Column, least: float = 0.85, seconds: float = 60.0) -> DataFrame:
    """Tracks with a good mean score, features, enough seconds and a name that parses to an id that isn't -1."""
    return tracks_where(frames, keys, (F.avg(score) >= least) & F.bool_or(F.coalesce(featured, F.lit(False))) & (seconds_of(us) >= seconds) & F.bool_and(F.coalesce(named, F.lit(False))))


def not_all_bad(frames: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Tracks with a frame that isn't bad."""
    return tracks_where(frames, keys, ~F.bool_and(F.coalesce(bad, F.lit(False))))


def confident_tracks(frames: DataFrame, keys: list[str], bad: Column, confidence: str, most_bad: float = 0.8, least: float = 0.7, keep_unknown: bool = False) -> DataFrame:
    """Tracks with fewer bad frames than ``most_bad`` and a mean confidence of ``least``; without any confidence by ``keep_unknown``."""
    return tracks_where(frames, keys, (share(bad) < most_bad) & F.coalesce(F.avg(confidence) >= least, F.lit(keep_unknown)))


def good_frame(label: Column, quality: Column, confidence: Column, invalid: str, least: float = 0.7) -> Column:
    """Whether a frame is valid, of good quality and confident; nulls are not."""
    return F.coalesce((label != invalid) & (quality == "good") & (confidence >= least), F.lit(False))


def plausible_box(width: Column, height: Column, most: float = 3.0) -> Column:
    """Whether a box's sides are within a factor of each other; a side of zero isn't."""
    return F.coalesce((width > 0) & (height > 0) & (width / height).between(1 / most, most), F.lit(False))


def scored(df: DataFrame, score: str, least: float) -> DataFrame:
    """Detections with a score of ``least`` or more."""
    return df.where(F.col(score) >= least)


def reid_frames(frames: DataFrame, keys: list[str], us: str, order: list[str], label: str, base: Column, sleep: list[str], preferred: str, longest: int = 30 * MINUTE, edge: int = 15 * MINUTE) -> DataFrame:
    """The frames of each track that identify it best: the first of these choices that has any.

    1: waking frames within ``edge`` before or after the track's longest sleep (the first of equal ones, ``longest`` at
    least); 2: frames of the preferred label; 3: waking frames; 4: any. All must satisfy ``base``.
    """
    runs = label_runs(frames, keys, us, order, label, name="_run")
    asleep = F.col(label).isin(sleep)
    of_run = Window.partitionBy(*keys, "_run")
    whole = Window.partitionBy(*keys)
    runs = runs.withColumn("_from", F.min(us).over(of_run)).withColumn("_to", F.max(us).over(of_run))
    bout = F.when(asleep & (F.col("_to") - F.col("_from") >= longest), F.struct((F.col("_to") - F.col("_from")).alias("d"), (-F.col("_from")).alias("s"), F.col("_to").alias("e")))
    runs = runs.withColumn("_bout", F.max(bout).over(whole))
    begins, ends = -F.col("_bout.s"), F.col("_bout.e")
    at_edge = (F.col(us) >= begins - edge) & (F.col(us) < begins) | (F.col(us) > ends) & (F.col(us) <= ends + edge)
    tier = F.when(F.coalesce(at_edge, F.lit(False)) & ~asleep, 1).when(F.col(label) == preferred, 2).when(~asleep, 3).otherwise(4)
    tiers = runs.withColumn("_tier", F.when(F.coalesce(base, F.lit(False)), tier)).withColumn("_best", F.min("_tier").over(whole))
    return tiers.where("_tier = _best").withColumn("tier", F.col("_tier")).drop("_run", "_from", "_to", "_bout", "_tier", "_best")


def _placed(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return frames.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))


def even_sample(frames: DataFrame, keys: list[str], order: list[str], rate: float = 0.1, least: int = 10, most: int = 100) -> DataFrame:
    """Evenly spaced frames of each track, the first and the last included: a share of them within bounds.

    Frame floor(k (n - 1) / (s - 1)) is taken for each k below s.
    """
    rows = _placed(frames, keys, order)
    s = F.least(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("_n") * rate).cast("int"))), F.col("_n"))
    rows = rows.withColumn("_s", s.cast("long")).withColumn("_k", F.when(F.col("_s") > 1, F.ceil(F.col("_i") * (F.col("_s") - 1) / (F.col("_n") - 1))).otherwise(0))
    hit = F.when(F.col("_s") > 1, F.floor(F.col("_k") * (F.col("_n") - 1) / (F.col("_s") - 1)) == F.col("_i")).otherwise(F.col("_i") == 0)
    return rows.where(hit).drop("_i", "_n", "_s", "_k")


def stride_sample(frames: DataFrame, keys: list[str], order: list[str], above: int = 1000, stride: int = 100, ends: int = 25) -> DataFrame:
    """All frames of short tracks; of longer ones every ``stride``-th, the first and the last ``ends``."""
    i, n = F.col("_i"), F.col("_n")
    return _placed(frames, keys, order).where((n <= above) | (i % stride == 0) | (i < ends) | (i >= n - ends)).drop("_i", "_n")


def valid_nights(df: DataFrame, night: str, camera: str, ids: str, tracks: str, cameras: int = 4, more_than: int = 10) -> DataFrame:
    """The nights that all cameras have with enough tracks and a list of ids."""
    rows = df.where((F.size(ids) > 0) & (F.col(tracks) > more_than)).groupBy(night).agg(F.count_distinct(camera).alias("_n"))
    return rows.where(F.col("_n") == cameras).select(night)


def correct(predicted: DataFrame, truth: DataFrame, keys: list[str], said: str, is_: str) -> DataFrame:
    """The predictions that agree with the ground truth of the same key."""
    return predicted.join(truth, keys).where(F.col(said) == F.col(is_))
