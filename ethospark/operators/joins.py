"""Joins in time that Spark has no operator for: as-of, interval, overlap and neighbouring bins.

A range condition alone would make Spark compare all pairs. Here both sides are dealt into buckets of time, so that the
join is an equi-join on (keys, bucket), which shuffles and splits as any other; the exact condition is checked on what meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.time import floor_to

#: Rows and tracks of a block, at most as far as hashes deal them evenly. A row is shuffled once for each block of its key.
BLOCK_ROWS, BLOCK_TRACKS = 524288, 4096
#: Tracks of a block whose totals are worked out at once, and cells of time of these in all.
TRACKS_AT_ONCE, CELLS_AT_ONCE = 1024, 2_000_000


def asof(left: DataFrame, right: DataFrame, keys: list[str], us: str, value: str, tolerance: int, direction: str = "nearest") -> DataFrame:
    """``left`` with ``value`` and the time of the last (or nearest) row of ``right`` within ``tolerance``.

    A union of both sides and two windows, so one shuffle and no pairs. At equal distance the earlier row wins; of
    rows at the same time the greatest value (before) or the least (after).
    """
    marked = left.withColumn("_side", F.lit(1)).withColumn("_pick", F.lit(None).cast(f"struct<us:bigint,v:{right.schema[value].dataType.simpleString()}>"))
    other = right.select(*keys, us, F.lit(0).alias("_side"), F.struct(F.col(us).alias("us"), F.col(value).alias("v")).alias("_pick"))
    both = marked.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(us)
    at_or_before = F.max("_pick").over(w.rangeBetween(Window.unboundedPreceding, 0))
    at_or_after = F.min("_pick").over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_before", at_or_before)
    if direction == "nearest":
        both = both.withColumn("_after", at_or_after)
        back, ahead = F.col(us) - F.col("_before.us"), F.col("_after.us") - F.col(us)
        both = both.withColumn("_hit", F.when(back.isNull() | (ahead < back), F.col("_after")).otherwise(F.col("_before"))).drop("_after")
    else:
        both = both.withColumn("_hit", F.col("_before"))
    near = F.abs(F.col(us) - F.col("_hit.us")) <= tolerance
    return both.where("_side = 1").withColumn("matched_us", F.when(near, F.col("_hit.us"))).withColumn("matched", F.when(near, F.col("_hit.v"))).drop("_side", "_pick", "_before", "_hit")


def buckets(start: Column, end: Column, width: int) -> Column:
    """The starts of all buckets that an interval touches."""
    return F.sequence(floor_to(start, width), floor_to(end, width), F.lit(width))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], us: str, start: str, end: str, width: int) -> DataFrame:
    """All pairs of a point and an interval of the same keys with start <= point <= end."""
    cut = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(buckets(F.col(start), F.col(end), width)))
    return points.withColumn("_bucket", floor_to(F.col(us), width)).join(cut, [*keys, "_bucket"]).where(F.col(us).between(F.col(start), F.col(end))).drop("_bucket")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int) -> DataFrame:
    """All pairs of intervals of the same keys that overlap (half-open), each once, with the overlap in microseconds."""
    left = a.where(F.col(a_start) < F.col(a_end)).withColumn("_bucket", F.explode(buckets(F.col(a_start), F.col(a_end) - 1, width)))
    right = b.where(F.col(b_start) < F.col(b_end)).withColumn("_bucket", F.explode(buckets(F.col(b_start), F.col(b_end) - 1, width)))
    met = left.join(right, [*keys, "_bucket"]).where((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    first = F.col("_bucket") == floor_to(F.greatest(a_start, b_start), width)  # the bucket where the overlap begins
    return met.where(first).drop("_bucket").withColumn("overlap_us", F.least(a_end, b_end) - F.greatest(a_start, b_start))


def neighbour_bins(a: DataFrame, b: DataFrame, keys: list[str], bin_col: str, reach: int) -> DataFrame:
    """All pairs of rows of the same keys whose bins (long) are ``reach`` or less apart. ``b``'s bin is ``other_bin``."""
    dealt = b.withColumnRenamed(bin_col, "other_bin").withColumn(bin_col, F.explode(F.sequence(F.col("other_bin") - reach, F.col("other_bin") + reach)))
    return a.join(dealt, [*keys, bin_col])


def within(a: DataFrame, b: DataFrame, keys: list[str], us: str, other: str, reach: int) -> DataFrame:
    """All pairs of rows of the same keys that are ``reach`` or less apart in time."""
    width = max(reach, 1)
    left = a.withColumn("_bucket", floor_to(F.col(us), width))
    right = b.withColumn("_bucket", F.explode(F.array(*[floor_to(F.col(other), width) + k * width for k in (-1, 0, 1)])))
    return left.join(right, [*keys, "_bucket"]).where(F.abs(F.col(us) - F.col(other)) <= reach).drop("_bucket")


def dense_grid(subjects: DataFrame, first: int, last: int, width: int, name: str = "bin_us") -> DataFrame:
    """Each subject with each bin start from ``first`` to ``last``: an explode, as the grid is the same for all."""
    return subjects.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(width))))


def at_time_of_day(rows: DataFrame, truths: DataFrame, keys: list[str], us: str, start: str, end: str, label: str, seq: str, default: str | None = None, width: int = 3_600_000_000) -> DataFrame:
    """``rows`` with the label that ``truths`` give their keys at their time of day, or ``default``.

    ``start`` and ``end`` are microseconds of the day, both inside; an interval that ends before it starts goes over midnight. Of several the greatest
    ``seq`` counts (then the greatest label). The day is a ring of buckets of ``width``: an interval over midnight is cut in two, and the
    intervals of a bucket are one row with a list of them, so the join adds no rows and a bucket's list is as long as that animal's intervals there. Intervals with a null are left out; rows with
    a null key or time get the default.
    """
    day = 86_400_000_000
    known = truths.dropna(subset=[*keys, start, end, label, seq]).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(label).alias("_label"), F.col(seq).alias("_seq"))
    ring = F.when(F.col("_a") <= F.col("_b"), F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")))).otherwise(F.array(F.struct(F.col("_a").alias("a"), F.lit(day).cast("long").alias("b")), F.struct(F.lit(0).cast("long").alias("a"), F.col("_b").alias("b"))))
    cut = known.select(*keys, "_label", "_seq", F.explode(ring).alias("_i")).withColumn("_bucket", F.explode(buckets(F.col("_i.a"), F.col("_i.b"), width)))
    by_bucket = cut.groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(F.struct("_seq", "_label", F.col("_i.a").alias("a"), F.col("_i.b").alias("b"))), asc=False).alias("_truths"))
    at = F.pmod(F.col(us), F.lit(day))
    joined = rows.withColumn("_at", at).withColumn("_bucket", floor_to(at, width)).join(by_bucket, [*keys, "_bucket"], "left")
    first = F.get(F.filter("_truths", lambda t: F.col("_at").between(t["a"], t["b"])), F.lit(0))["_label"]
    return joined.withColumn(label, F.coalesce(first, F.lit(default))).drop("_at", "_bucket", "_truths")


def blocks_of(df: DataFrame, keys: list[str], track: str, name: str) -> DataFrame:
    """Rows (keys, name): into how many blocks of whole tracks the rows of each key are dealt."""
    counts = df.groupBy(*keys, track).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count("*").alias("_t"))
    return counts.select(*keys, F.greatest(F.ceil(F.col("_n") / BLOCK_ROWS), F.ceil(F.col("_t") / BLOCK_TRACKS)).cast("int").alias(name))


def in_many_tasks(df: DataFrame, group: list[str]) -> DataFrame:
    """``df`` dealt by ``group`` to as many tasks as the session has for a shuffle: groups of few bytes and much work would be put together otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)


def _steps(who: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """How many intervals ``n`` tracks have open where each cell of time begins, the integral of what changes inside of it, and the changes there.

    The changes are (track, time left in the cell, 1 or -1, whether the track's first there) in order of cell and track, with the places where cells begin.
    """
    cells = len(cuts) - 1
    at, who, by = np.concatenate([start, end]), np.concatenate([who, who]), np.repeat([1, -1], len(who))
    k = np.searchsorted(cuts[:-1], at, "left")  # the first cell that doesn't begin before
    opened = np.cumsum(np.bincount(who * (cells + 1) + k, by, n * (cells + 1)).reshape(n, cells + 1)[:, :cells], axis=1)
    inside = np.flatnonzero((k == cells) | (cuts[k] != at))
    cell, who, by, left = k[inside] - 1, who[inside], by[inside], cuts[k[inside]] - at[inside]
    changed = np.bincount(who * cells + cell, by * left, n * cells).reshape(n, cells)
    order = np.lexsort((who, cell))
    cell, who = cell[order], who[order]
    fresh = np.ones(len(cell), bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (who[1:] != who[:-1])
    return opened, changed, np.searchsorted(cell, np.arange(cells + 1)), (who, left[order], by[order], fresh)


def _totals(left: tuple, right: tuple, widths: np.ndarray) -> np.ndarray:
    """The overlaps of each track of one side with each of the other (results of ``_steps``): products of what is open, and cell by cell of what changes on both sides."""
    (g, v, begin, points), (h, u, other_begin, other) = left, right
    x, y = np.hstack([g * widths + v, g]), np.hstack([h, u])
    if (np.abs(x).max(axis=0) * np.abs(y).max(axis=0)).sum() >= 2.0**53:  # beyond what floating point holds exactly
        x, y = x.astype(np.int64), y.astype(np.int64)
    total = (x @ y.T).astype(np.int64)
    for k in np.flatnonzero((begin[1:] > begin[:-1]) & (other_begin[1:] > other_begin[:-1])):
        (a, p, d, new), (b, q, e, other_new) = ([c[lo[k] : lo[k + 1]] for c in side] for side, lo in ((points, begin), (other, other_begin)))
        both = np.minimum.outer(p, q) * np.multiply.outer(d, e)
        if not new.all():
            both, a = np.add.reduceat(both, np.flatnonzero(new), axis=0), a[new]
        if not other_new.all():
            np.add.at(total, (a[:, None], b[~other_new]), both[:, ~other_new])
            both, b = both[:, other_new], b[other_new]
        total[a[:, None], b] += both
    return total


def _overlapping(left: tuple, right: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields arrays (track, other, overlap) of two sides (track numbers, starts, ends), or of the pairs of one, for some tracks at a time."""
    sides = [left] if right is None else [left, right]
    if not all(len(side[0]) for side in sides):
        return
    points = np.sort(np.concatenate([c for side in sides for c in side[1:]]))
    named = [np.unique(side[0]) for side in sides]
    cells = max(16, 4 * len(points) // sum(map(len, named)) * 2)  # so that few cells have changes of two given tracks
    cuts = np.unique(points[np.linspace(0, len(points) - 1, cells + 1).astype(np.int64)])
    step = max(1, min(TRACKS_AT_ONCE, CELLS_AT_ONCE // len(cuts)))
    most = max(map(len, named))
    step = -(-most // -(-most // step))

    def parts(side: tuple, names: np.ndarray, first: int = 0) -> Iterator[tuple]:
        order = np.argsort(side[0], kind="stable")
        who, start, end = (c[order] for c in side)
        for k in range(first, len(names), step):
            mine = names[k : k + step]
            lo, hi = np.searchsorted(who, mine[0], "left"), np.searchsorted(who, mine[-1], "right")
            yield k, mine, _steps(np.searchsorted(mine, who[lo:hi]), start[lo:hi], end[lo:hi], cuts, len(mine))

    for k, mine, one in parts(sides[0], named[0]):
        for j, theirs, two in parts(sides[-1], named[-1], k if right is None else 0):
            total = _totals(one, two, np.diff(cuts))
            i, at = np.nonzero(np.triu(total, 1) > 0 if right is None and j == k else total > 0)
            yield mine[i], theirs[at], total[i, at]


def overlap_totals(df: DataFrame, keys: list[str], track: str, start: str, end: str, other: str = "other") -> DataFrame:
    """Rows (keys, track, other, overlap_us): how long the half-open intervals of two tracks, track < other, overlap in all; pairs that don't are left out.

    A total is the integral of how many intervals of one are open times those of the other, so pairs of intervals aren't made. Tracks are dealt into
    blocks, every pair of blocks is a group, and only its totals leave it, a part of its tracks at a time: the shuffle has a row for each interval and block.
    """
    rows = df.where((F.col(start) < F.col(end)) & F.col(track).isNotNull()).select(*keys, F.col(track).alias("_t"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    dealt = rows.join(blocks_of(rows, keys, "_t", "_of"), keys).withColumn("_own", F.pmod(F.xxhash64("_t"), F.col("_of")).cast("int"))
    dealt = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    dealt = dealt.select(*keys, F.least("_own", "_k").alias("_p"), F.greatest("_own", "_k").alias("_q"), "_own", "_t", "_s", "_e")
    kinds = dict(rows.dtypes)
    names = [*keys, track, other, "overlap_us"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = pd.concat(frames, ignore_index=True)
        codes, tracks = pd.factorize(one["_t"], sort=True)
        every = (codes.astype(np.int64), one["_s"].to_numpy(np.int64), one["_e"].to_numpy(np.int64))
        mine, alone = (one["_own"] == one["_p"]).to_numpy(), one["_p"].iloc[0] == one["_q"].iloc[0]
        same = {k: one[k].iloc[0] for k in keys}
        for a, b, total in _overlapping(every, None) if alone else _overlapping(*(tuple(c[side] for c in every) for side in (mine, ~mine))):
            out = pd.DataFrame({track: tracks[np.minimum(a, b)], other: tracks[np.maximum(a, b)], "overlap_us": total})
            yield out.assign(**same)[names]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{track}` {kinds['_t']}, `{other}` {kinds['_t']}, overlap_us long"
    return in_many_tasks(dealt, [*keys, "_p", "_q"]).groupBy(*keys, "_p", "_q").applyInPandas(run, schema)
