"""Timelines, activity budgets and movement.

A timeline is rows (subject, slot, label), a slot being a fixed step of time; it is exploded from intervals and stays
rows until the end. Where intervals overlap, priority decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.time import SECOND, floor_to, stamp
from ethospark.operators.joins import buckets


def timeline(intervals: DataFrame, keys: list[str], start: str, end: str, label: str, priority: list[str], step: int) -> DataFrame:
    """Rows (keys, slot_us, label): for each slot that an interval touches the label that comes last in ``priority``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(label))
    slots = intervals.where(F.col(end) > F.col(start)).select(*keys, label, F.explode(buckets(F.col(start), F.col(end) - 1, step)).alias("slot_us"))
    return slots.groupBy(*keys, "slot_us").agg(F.max_by(label, rank).alias(label))


def segments(slots: DataFrame, keys: list[str], label: str, step: int) -> DataFrame:
    """Timeline rows back to intervals: runs of one label without a missing slot."""
    w = Window.partitionBy(*keys).orderBy("slot_us")
    fresh = (F.col("slot_us") - F.lag("slot_us").over(w) > step) | ~F.col(label).eqNullSafe(F.lag(label).over(w))
    marked = slots.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.first(label).alias(label), F.min("slot_us").alias("start_us"), (F.max("slot_us") + step).alias("end_us")).drop("_run")


def overlay(slots: DataFrame, windows: DataFrame, keys: list[str], label: str, step: int, value: str) -> DataFrame:
    """Slots within any of ``windows`` (start_us, end_us) take another label."""
    covered = windows.where("end_us > start_us").select(*keys, F.explode(buckets(F.col("start_us"), F.col("end_us") - 1, step)).alias("slot_us")).distinct().withColumn("_hit", F.lit(True))
    return slots.join(covered, [*keys, "slot_us"], "left").withColumn(label, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(label))).drop("_hit")


def binned(slots: DataFrame, keys: list[str], label: str, labels: list[str], width: int) -> DataFrame:
    """Slots of each label in each bin of ``width``."""
    return slots.groupBy(*keys, floor_to(F.col("slot_us"), width).alias("bin_us")).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])


def budget(intervals: DataFrame, keys: list[str], label: str, start: str, end: str, unseen: str) -> DataFrame:
    """Minutes of each label and its share, in percent, of all that was seen."""
    minutes = intervals.groupBy(*keys, label).agg((F.sum(F.col(end) - F.col(start)) / F.lit(60.0 * SECOND)).alias("minutes"))
    seen = F.sum(F.when(F.col(label) != unseen, F.col("minutes"))).over(Window.partitionBy(*keys))
    return minutes.withColumn("share", F.when((F.col(label) != unseen) & (seen > 0), 100 * F.col("minutes") / seen))


def by_hour(intervals: DataFrame, keys: list[str], label: str, start: str, end: str, hour: int) -> DataFrame:
    """Minutes of each label in each hour that an interval touches."""
    cut = intervals.where(F.col(end) > F.col(start)).withColumn("bin_us", F.explode(buckets(F.col(start), F.col(end) - 1, hour)))
    inside = F.least(F.col(end), F.col("bin_us") + hour) - F.greatest(F.col(start), F.col("bin_us"))
    return cut.groupBy(*keys, label, "bin_us").agg((F.sum(inside) / F.lit(60.0 * SECOND)).alias("minutes"))


def period(us: Column) -> Column:
    """early (18-23), mid (23-4) or morning (4-8) by the hour; null by day."""
    hour = F.hour(stamp(us))
    return F.when(hour.between(18, 22), "early").when((hour >= 23) | (hour < 4), "mid").when(hour < 8, "morning")


def with_overall(df: DataFrame, keys: list[str], part: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates by part, and over all parts as ``overall``: grouping sets, so the rows are read once."""
    total = df.where(F.col(part).isNotNull()).rollup(*keys, part).agg(*aggregates, F.grouping_id().alias("_set"))
    return total.where("_set in (0, 1)").withColumn(part, F.when(F.col("_set") == 1, F.lit("overall")).otherwise(F.col(part))).drop("_set")


def resample(df: DataFrame, keys: list[str], us: str, value: str, step: int) -> DataFrame:
    """A value on a regular grid: the median of each slot, linear in between."""
    slots = df.groupBy(*keys, floor_to(F.col(us), step).alias("slot_us")).agg(F.median(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("slot_us")
    nxt = slots.withColumn("_to", F.lead("slot_us").over(w)).withColumn("_next", F.lead("_v").over(w))
    grid = nxt.withColumn("at_us", F.explode(F.sequence(F.col("slot_us"), F.coalesce(F.col("_to") - step, F.col("slot_us")), F.lit(step))))
    share = (F.col("at_us") - F.col("slot_us")) / (F.col("_to") - F.col("slot_us"))
    return grid.select(*keys, F.col("at_us").alias("slot_us"), F.when(F.col("_to").isNull(), F.col("_v")).otherwise(F.col("_v") + share * (F.col("_next") - F.col("_v"))).alias(value))


def walking(df: DataFrame, keys: list[str], us: str, order: list[str], x: str, y: str, width: int, clip: float, least: float) -> DataFrame:
    """Way of each bin, steps longer than ``clip`` cut to it, and whether it is a walk."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.least(F.lit(clip), F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    steps = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return steps.groupBy(*keys, floor_to(F.col(us), width).alias("bin_us")).agg(F.sum("_step").alias("way"), F.count("*").alias("n_rows")).withColumn("walking", F.col("way") > least)


def hourly_means(intervals: DataFrame, keys: list[str], night_us: str, label: str, start: str, end: str, labels: list[str], hours: int, hour: int) -> DataFrame:
    """Rows (keys, hour_idx, label, minutes): mean minutes of each label in each hour of a night, over all of a key's nights.

    ``night_us`` is when an interval's night began. A night counts with 0 minutes where a label has none, and hours and labels that never occur are rows with 0.
    """
    nights = intervals.groupBy(*keys).agg(F.count_distinct(night_us).alias("_nights"))
    cut = by_hour(intervals, [*keys, night_us], label, start, end, hour).withColumn("hour_idx", F.floor((F.col("bin_us") - F.col(night_us)) / hour).cast("int"))
    sums = cut.where((F.col("hour_idx") >= 0) & (F.col("hour_idx") < hours)).groupBy(*keys, "hour_idx", label).agg(F.sum("minutes").alias("_m"))
    grid = nights.withColumn("hour_idx", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).withColumn(label, F.explode(F.array(*[F.lit(x) for x in labels])))
    return grid.join(sums, [*keys, "hour_idx", label], "left").select(*keys, "hour_idx", label, (F.coalesce("_m", F.lit(0.0)) / F.col("_nights")).alias("minutes"))


def period_shares(intervals: DataFrame, keys: list[str], label: str, start: str, end: str, part: Column, parts: list[str], wanted: str, unseen: str) -> DataFrame:
    """Rows (keys, part, seconds, label_seconds, share, bouts) for each part of the night and ``overall``: how much of what was seen has the label ``wanted``.

    A bout belongs to the part in which it begins; those that begin outside of ``parts``, and unseen ones, are left out. Parts without a bout are rows of zeros for each key that has any.
    """
    seconds = (F.col(end) - F.col(start)) / F.lit(float(SECOND))
    seen = intervals.withColumn("part", part).where(F.col("part").isin(parts) & (F.col(label) != unseen)).withColumn("_s", seconds)
    hit = F.col(label) == wanted
    found = with_overall(seen, keys, "part", [F.sum("_s").alias("seconds"), F.sum(F.when(hit, F.col("_s")).otherwise(0.0)).alias("label_seconds"), F.count_if(hit).alias("bouts")])
    grid = found.select(*keys).distinct().withColumn("part", F.explode(F.array(*[F.lit(p) for p in [*parts, "overall"]])))
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    out = grid.join(found, [*keys, "part"], "left").select(*keys, "part", zero("seconds", "double"), zero("label_seconds", "double"), zero("bouts", "bigint"))
    return out.withColumn("share", F.when(F.col("seconds") > 0, 100 * F.col("label_seconds") / F.col("seconds")).otherwise(0.0))


def walking_bins(windows: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, us: str, order: list[str], x: str, y: str, width: int, clip: float, least: float, slack: int = 1_000_000) -> DataFrame:
    """Rows (keys, window start, start_us, end_us, n_points, way, walking): each window (a stretch of standing) cut into bins of ``width`` from its start.

    The way in a bin is the sum of its steps, each cut to ``clip``; points at both ends count. A full bin is a walk with a way above ``least``; the last one, if it is
    shorter by more than ``slack``, by its speed, above ``least`` over ``width``. Windows and points of different keys may be many: they meet in buckets of time.
    """
    from ethospark.operators.joins import point_in_interval

    cut = windows.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("window_us"), F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(width))).alias("start_us"), F.col(end).alias("_end"))
    bins = cut.withColumn("end_us", F.least(F.col("start_us") + width, "_end")).drop("_end")
    met = point_in_interval(points.select(*keys, us, *[c for c in order if c != us], x, y), bins, keys, us, "start_us", "end_us", width)
    w = Window.partitionBy(*keys, "window_us", "start_us").orderBy(*order)
    step = F.least(F.lit(float(clip)), F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    ways = met.withColumn("_step", step).groupBy(*keys, "window_us", "start_us").agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("way"), F.count("*").alias("n_points"))
    out = bins.join(ways, [*keys, "window_us", "start_us"], "left").withColumn("way", F.coalesce("way", F.lit(0.0))).withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    lasts = F.col("end_us") - F.col("start_us")
    return out.withColumn("walking", F.when(F.abs(lasts - width) <= slack, F.col("way") > least).otherwise(F.col("way") / lasts > F.lit(float(least)) / width))
