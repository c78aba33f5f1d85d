"""Further runs and series: recurrent bins, motion periods, trajectory breaks, clock offsets, ranks. Times are microseconds (long)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.time import SECOND
from ethospark.operators.islands import island_ids


def recurrent_bins(bins: DataFrame, keys: list[str], start: str, end: str, flag: str, least: int = 2, default: int = 120 * SECOND) -> DataFrame:
    """Rows (keys, start, end, n_bins): runs of ``least`` or more flagged bins, merged.

    Bins belong together if the next begins no later than a quarter of the key's median bin length, one second at least, after
    the end of the one before. A median that isn't positive counts as ``default``.
    """
    length = F.median(F.col(end) - F.col(start)).over(Window.partitionBy(*keys))
    gap = F.greatest(F.lit(float(SECOND)), F.when(length > 0, length).otherwise(default) * 0.25)
    rows = bins.withColumn("_gap", gap).where(F.col(flag))
    w = Window.partitionBy(*keys).orderBy(start, end)
    runs = island_ids(rows, keys, [start, end], F.col(start) > F.lag(end).over(w) + F.col("_gap"), "_run")
    merged = runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_bins"))
    return merged.where(F.col("n_bins") >= least).drop("_run")


def motion_periods(signal: DataFrame, keys: list[str], us: str, value: str, above: float) -> DataFrame:
    """Rows (keys, start, end, n): stretches of a signal above a threshold.

    A period ends with the first row that isn't above, and one that is still open with the last row.
    """
    w = Window.partitionBy(*keys).orderBy(us)
    rows = signal.withColumn("_on", F.coalesce(F.col(value) > above, F.lit(False))).withColumn("_next", F.coalesce(F.lead(us).over(w), F.col(us)))
    runs = island_ids(rows, keys, [us], ~F.col("_on").eqNullSafe(F.lag("_on").over(w)), "_run").where("_on")
    return runs.groupBy(*keys, "_run").agg(F.min(us).alias("start_us"), F.max("_next").alias("end_us"), F.count("*").alias("n")).drop("_run")


def trajectory_parts(points: DataFrame, keys: list[str], us: str, order: list[str], x: str, y: str, gap: int, jump: float, name: str = "part") -> DataFrame:
    """Numbers the parts of a trajectory, which breaks at a pause longer than ``gap`` or a step longer than ``jump``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return island_ids(points, keys, order, (F.col(us) - F.lag(us).over(w) > gap) | (step > jump), name)


def clock_offset(a: DataFrame, b: DataFrame, keys: list[str], second: str, value: str, most: int = 60, least: int = 60) -> DataFrame:
    """Rows (keys, offset, score): by how many places ``b`` lags behind ``a``, from their common seconds.

    The seconds that both have are put next to each other; for each shift of ``most`` places or less the score is the sum of products of
    deviations from the means of what overlaps, ``least`` places at least. The greatest score wins, of equal ones the least shift; without
    variation or common seconds the offset is 0.
    """
    both = a.select(*keys, second, F.col(value).cast("double").alias("_a")).join(b.select(*keys, second, F.col(value).cast("double").alias("_b")), [*keys, second])
    place = both.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(second)))
    left = place.select(*keys, "_a", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("offset"), "_i").withColumn("_i", F.col("_i") + F.col("offset"))
    pairs = left.join(place.select(*keys, "_i", "_b"), [*keys, "_i"]).groupBy(*keys, "offset").agg(F.count("*").alias("_n"), (F.covar_pop("_a", "_b") * F.count("*")).alias("score")).where(F.col("_n") >= least)
    best = pairs.groupBy(*keys).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("offset")).alias("o"))).alias("_m"))
    flat = place.groupBy(*keys).agg(F.count("*").alias("_all"), (F.max(F.abs("_a")) > 0).alias("_x"), (F.max(F.abs("_b")) > 0).alias("_y"))
    usable = (F.col("_all") >= least) & F.col("_x") & F.col("_y") & F.col("_m").isNotNull()
    return flat.join(best, keys, "left").select(*keys, F.when(usable, -F.col("_m.o")).otherwise(0).alias("offset"), F.when(usable, F.col("_m.score")).alias("score"))


def percent_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds ``<column>_rank``: the mean rank of each value among the key's, as a share of their number; nulls have none."""
    for c in columns:
        w = Window.partitionBy(*keys)
        first, same = F.rank().over(w.orderBy(F.col(c).asc_nulls_last())), F.count("*").over(Window.partitionBy(*keys, c))
        df = df.withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), (first + (same - 1) / 2.0) / F.count(c).over(w)))
    return df


def weighted_score(weights: dict[str, float], confidence: Column) -> Column:
    """The weighted sum of ranks, lowered where a confidence in [0, 1] is low."""
    total = F.lit(0.0)
    for c, weight in weights.items():
        total = total + weight * F.col(f"{c}_rank")
    return total * (0.55 + 0.45 * confidence)


def above_quantile(df: DataFrame, keys: list[str], column: str, q: float, least: float, name: str) -> DataFrame:
    """Adds whether a value reaches the key's quantile (linear interpolation), or ``least`` where that is more."""
    cut = F.greatest(F.lit(least), F.percentile(column, F.lit(q)).over(Window.partitionBy(*keys)))
    return df.withColumn(name, F.col(column) >= cut)


def trajectory_metrics(points: DataFrame, keys: list[str], us: str, order: list[str], x: str, y: str, cell: float, width: float, height: float) -> DataFrame:
    """Rows (keys, n, coverage, elongation, revisit_ratio, reversals): how a track moves within its area.

    Coverage: visited cells of side ``cell`` over all cells of the area. Elongation: square root of the ratio of the variances along
    the two principal axes, from the 2 x 2 covariance; 0 without spread. Revisit ratio: rows a visited cell.
    Reversals: changes of sign of the step along x.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = points.withColumn("_c", F.floor(F.col(x) / cell) * 1_000_003 + F.floor(F.col(y) / cell)).withColumn("_s", F.signum(F.col(x) - F.lag(x).over(w)))
    moved = rows.withColumn("_p", F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    sums = moved.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("_c").alias("_cells"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"), F.count_if(F.col("_s") * F.col("_p") < 0).alias("reversals")
    )
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, F.lit(2.0)) + F.col("_xy") * F.col("_xy"))
    all_cells = float(max(1, int(width / cell) * int(height / cell)))
    return sums.select(
        *keys, "n", (F.col("_cells") / all_cells).alias("coverage"), F.when(half - root > 1e-12, F.sqrt((half + root) / (half - root))).otherwise(0.0).alias("elongation"), (F.col("n") / F.col("_cells")).alias("revisit_ratio"), "reversals"
    )


def hex_density(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Rows (q, r, n, log_n): points in hexagons whose sides are ``size`` long, by axial coordinates, with log10(n).

    A point belongs to the hexagon whose cube coordinates are the nearest: rounded, and the one farthest from its integer put right.
    """
    q, r = F.col(x) * (3**0.5 / 3) / size - F.col(y) / (3 * size), F.col(y) * 2 / (3 * size)
    c = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(q.alias("q"), r.alias("r"))
    c = c.withColumn("s", -F.col("q") - F.col("r")).select(*[F.col(n) for n in "qrs"], *[F.round(n).alias(f"r{n}") for n in "qrs"])
    d = {n: F.abs(F.col(f"r{n}") - F.col(n)) for n in "qrs"}
    cq = F.when((d["q"] > d["r"]) & (d["q"] > d["s"]), -F.col("rr") - F.col("rs")).otherwise(F.col("rq"))
    cr = F.when((d["q"] > d["r"]) & (d["q"] > d["s"]), F.col("rr")).when(d["r"] > d["s"], -F.col("rq") - F.col("rs")).otherwise(F.col("rr"))
    return c.groupBy(cq.cast("long").alias("q"), cr.cast("long").alias("r")).agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))
