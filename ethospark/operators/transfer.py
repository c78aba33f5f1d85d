"""Identities carried from one camera to another, and conflicts between them.

Scores and gates are grouped sums and windows; only the resolution of conflicts, whose steps depend on each other, is a
call for each night of a camera. Times are microseconds (long).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.time import SECOND, floor_to
from ethospark.operators.joins import blocks_of, in_many_tasks

#: Neighbouring bins that are searched in one group.
BINS = 16
#: Subjects of a block whose meetings with those of another block are a group.
SUBJECTS = 4096


def allowed_counts(df: DataFrame, keys: list[str], label: str, allowed: list[str]) -> DataFrame:
    """Rows (keys, counts): how many rows each allowed label has, as a map; foreign labels are left out."""
    counts = df.where(F.col(label).isin(allowed)).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_n")))).alias("counts"))


def candidates(matches: DataFrame, keys: list[str], identity: str, distance: str, sigma: float = 1.0, least: int = 5, most: int = 5) -> DataFrame:
    """Rows (keys, identity, votes, mean_distance, score, rank, margin): the best identities of each track.

    A match scores exp(-distance / sigma); identities with fewer than ``least`` matches are left out. The margin is the
    score's lead over the next identity, or the score itself; ties go by identity.
    """
    rows = matches.where(F.col(identity).isNotNull() & F.col(distance).isNotNull())
    sums = rows.groupBy(*keys, identity).agg(F.count("*").alias("votes"), F.avg(distance).alias("mean_distance"), F.sum(F.exp(-F.col(distance) / max(sigma, 1e-6))).alias("score")).where(F.col("votes") >= least)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), identity)
    ranked = sums.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where(F.col("rank") <= most)


def nearest_score(matches: DataFrame, keys: list[str], identity: str, distance: str, k: int) -> DataFrame:
    """Rows (keys, identity, score): the sum of inverse distances over the ``k`` nearest matches."""
    w = Window.partitionBy(*keys).orderBy(distance, identity)
    near = matches.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return near.groupBy(*keys, identity).agg(F.sum(1 / (F.col(distance) + 1e-6)).alias("score"))


def accepted(original: Column, best: Column, votes: Column, margin: Column, mean_distance: Column, least_votes: int = 8, least_margin: float = 0.5, most_distance: float = 2.0) -> Column:
    """Whether the best identity takes the place of the original one; an equal one always does."""
    clear = (votes >= least_votes) & (margin >= least_margin) & (mean_distance <= most_distance)
    return F.coalesce(best.isNotNull() & (best.eqNullSafe(original) | clear), F.lit(False))


def fallback_label(label: Column, voted: Column, known: list[str]) -> Column:
    """A label that was found, or what is left to say: confused between two known animals, the vote for a single known one."""
    found = F.when(~F.coalesce(label, F.lit("")).isin("unknown", "invalid", "spurious", "confused", ""), label)
    rest = F.lit("confused") if len(known) == 2 else F.when(voted == known[0], voted).otherwise("unknown") if len(known) == 1 else F.lit("unknown")
    return F.coalesce(found, rest)


def _near_in_bins(i: np.ndarray, left_bin: np.ndarray, left: np.ndarray, j: np.ndarray, right_bin: np.ndarray, right: np.ndarray, limit: float, most: int = 2_000_000, tracks: int = 1024):
    """Yields arrays (i, j, bins, median distance) of the tracks, numbered from 0, that are near each other, some at a time.

    Where a track has one position a bin at most, the distances of a few tracks ``i`` to some ``tracks`` others are cells of a table with a place for each bin that two tracks can share,
    ``most`` cells at once, if pairs of positions fill a tenth of it. All others are put in order as a list, ``most`` pairs of positions or one track ``i`` at a time.
    """
    sides = []
    for who, at, xy in ((i, left_bin, left), (j, right_bin, right)):
        order = np.lexsort((who, at))
        sides.append((who[order], at[order], xy[order]))
    (i, left_bin, left), (j, right_bin, right) = sides
    once = all(not ((who[1:] == who[:-1]) & (at[1:] == at[:-1])).any() for who, at, _ in sides)
    shared = min((int(np.bincount(who).max(initial=0)) for who, _, _ in sides), default=0) + 1
    n, m = (int(who.max(initial=-1)) + 1 for who, _, _ in sides)
    pairs = int((np.searchsorted(right_bin, left_bin, "right") - np.searchsorted(right_bin, left_bin, "left")).sum())
    if not once or shared * tracks > most or shared * n * m > 10 * pairs:
        yield from _near_in_lists(i, left_bin, left, j, right_bin, right, limit, most)
        return
    step = max(1, most // (shared * min(tracks, m)))
    for k in range(0, m, tracks):
        some = (j >= k) & (j < k + tracks)
        other, other_bin, other_at, wide = j[some] - k, right_bin[some], right[some], min(tracks, m - k)
        for lo in range(0, n, step):
            mine = (i >= lo) & (i < lo + step)
            who, at, xy, high = i[mine] - lo, left_bin[mine], left[mine], min(step, n - lo)
            cells, found = np.full(high * wide * shared, np.inf), np.zeros(high * wide, np.int64)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            first, last = np.searchsorted(other_bin, at[cuts], "left"), np.searchsorted(other_bin, at[cuts], "right")
            for s, e, b, c in zip(cuts, [*cuts[1:], len(at)], first, last, strict=True):
                pair = (who[s:e, None] * wide + other[b:c]).ravel()
                far = np.sqrt((xy[s:e, :1] - other_at[b:c, 0]) ** 2 + (xy[s:e, 1:] - other_at[b:c, 1]) ** 2).ravel()
                near = far <= limit
                pair, far = pair[near], far[near]
                had = found[pair]
                cells[pair * shared + had] = far
                found[pair] = had + 1
            hit = np.flatnonzero(found)
            if not len(hit):
                continue
            size = found[hit]
            far = np.sort(cells.reshape(-1, shared)[hit, : size.max()], axis=1)
            row = np.arange(len(hit))
            yield hit // wide + lo, hit % wide + k, size, (far[row, (size - 1) // 2] + far[row, size // 2]) / 2


def _near_in_lists(i: np.ndarray, left_bin: np.ndarray, left: np.ndarray, j: np.ndarray, right_bin: np.ndarray, right: np.ndarray, limit: float, most: int):
    """What ``_near_in_bins`` yields, by sorting the distances of all near positions. The right side comes in order of its bins."""
    order = np.argsort(i, kind="stable")
    i, left_bin, left = i[order], left_bin[order], left[order]
    low = np.searchsorted(right_bin, left_bin, "left")
    counts = np.searchsorted(right_bin, left_bin, "right") - low
    ends = np.append(np.flatnonzero(i[1:] != i[:-1]) + 1, len(i))  # where a track ends
    done = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(i):
        fit = ends[(ends > at) & (done[ends] - done[at] <= most)]
        stop = int(fit[-1] if len(fit) else ends[ends > at][0])
        n = counts[at:stop]
        rows = np.repeat(np.arange(at, stop), n)
        others = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:stop], n)
        far = np.sqrt((left[rows, 0] - right[others, 0]) ** 2 + (left[rows, 1] - right[others, 1]) ** 2)
        near = far <= limit
        p, q, d = i[rows[near]].astype(np.int64), j[others[near]].astype(np.int64), far[near]
        order = np.lexsort((d, q, p))
        p, q, d = p[order], q[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(p)))
        yield p[first], q[first], size, (d[first + (size - 1) // 2] + d[first + size // 2]) / 2
        at = stop


def overlap_distances(binned: DataFrame, other: DataFrame, keys: list[str], bin_col: str, x: str, y: str, a: str, b: str, limit: float = 2.0, least: int = 8) -> DataFrame:
    """Rows (keys, a, b, bins, distance): in how many bins two tracks are within ``limit``, and their median distance there.

    Below ``least`` bins the distance is null. ``other`` has its columns under the same names, its track as ``b``. Tracks are dealt into blocks and every pair of
    blocks is a group: the shuffle has a row for each track, bin and block, and pairs of positions never leave their task; pairs of tracks leave it some at a time.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, names in ((binned, [*keys, a]), (other, [b])) for c in names}
    held = kinds[a] if kinds[a] == kinds[b] else "string"
    rows = lambda df, track, side: df.where(F.col(bin_col).isNotNull()).select(*keys, F.lit(side).alias("_side"), F.col(track).cast(held).alias("_track"), F.col(bin_col).alias("_t"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    one, two = rows(binned, a, 0), rows(other, b, 1)
    sizes = blocks_of(one, keys, "_track", "_na").join(blocks_of(two, keys, "_track", "_nb"), keys)
    own = lambda n: F.pmod(F.xxhash64("_track"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = one.join(sizes, keys).withColumn("_a", own("_na")).withColumn("_b", each("_nb")).drop("_na", "_nb")
    right = two.join(sizes, keys).withColumn("_b", own("_nb")).withColumn("_a", each("_na")).drop("_na", "_nb")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(frames, ignore_index=True)
        l, r = (every[every["_side"] == side] for side in (0, 1))
        if not len(l) or not len(r):
            return
        (i, mine), (j, theirs) = (pd.factorize(f["_track"], use_na_sentinel=False) for f in (l, r))
        same = {k: every[k].iloc[0] for k in keys}
        for p, q, n, d in _near_in_bins(i, l["_t"].to_numpy(), l[["_x", "_y"]].to_numpy(float), j, r["_t"].to_numpy(), r[["_x", "_y"]].to_numpy(float), limit):
            yield pd.DataFrame({a: mine[p], b: theirs[q], "bins": n, "distance": d}).assign(**same)[[*keys, a, b, "bins", "distance"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{a}` {held}, `{b}` {held}, bins long, distance double"
    out = in_many_tasks(left.unionByName(right), [*keys, "_a", "_b"]).groupBy(*keys, "_a", "_b").applyInPandas(run, schema)
    out = out.withColumn("distance", F.when(F.col("bins") >= least, F.col("distance")))
    return out if held == kinds[a] == kinds[b] else out.withColumn(a, F.col(a).cast(kinds[a])).withColumn(b, F.col(b).cast(kinds[b]))


def nearest_in_bins(frames: DataFrame, other: DataFrame, keys: list[str], us: str, x: str, y: str, identity: str, width: int, reach: int, limit: float) -> DataFrame:
    """``frames`` with the identity and distance of the nearest detection of the other camera, ``reach`` bins away at most.

    Frames without one within ``limit`` have nulls; ties go by identity. ``frames`` has a column ``frame`` that names a row. ``BINS`` bins of a key are a group: rows are
    shuffled once for each group in reach, and distances never leave their task.
    """
    at = [F.col(c).cast("double").alias(f"_{n}") for n, c in (("x", x), ("y", y))]
    left = frames.select(*keys, "frame", F.floor(F.col(us) / width).alias("_bin"), *at).dropna()
    right = other.select(*keys, F.floor(F.col(us) / width).alias("_bin"), *at, F.col(identity).alias("matched_identity")).dropna(subset=[*keys, "_bin", "_x", "_y"])
    block = lambda c: F.floor(c / BINS)
    left = left.withColumn("_block", block(F.col("_bin")))
    right = right.withColumn("_block", F.explode(F.sequence(block(F.col("_bin") - reach), block(F.col("_bin") + reach))))
    kinds = {**dict(left.dtypes), **dict(right.dtypes)}
    names = [*keys, "frame", "match_distance", "matched_identity"]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """Bin by bin, a slice of frames at a time; what is in reach is put in order of identity, so that the first of equally near ones is the answer."""
        if not len(one) or not len(two):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        one = one.sort_values("_bin", kind="stable")
        two = two.sort_values("matched_identity", na_position="first", kind="stable").reset_index(drop=True)
        two = two.sort_values("_bin", kind="stable")
        bins, theirs, rank = one["_bin"].to_numpy(), two["_bin"].to_numpy(), two.index.to_numpy()
        x1, y1, x2, y2 = (f[c].to_numpy() for f in (one, two) for c in ("_x", "_y"))
        best, far = np.zeros(len(one), np.int64), np.full(len(one), np.inf)
        cuts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])).tolist()
        for start, stop in zip(cuts, [*cuts[1:], len(one)], strict=True):
            low, high = np.searchsorted(theirs, [bins[start] - reach, bins[start] + reach + 1])
            if low == high:
                continue
            near = low + np.argsort(rank[low:high])
            step = max(1, 2_000_000 // len(near))
            for k in range(start, stop, step):
                e = min(k + step, stop)
                d = np.hypot(x1[k:e, None] - x2[near], y1[k:e, None] - y2[near])
                at = d.argmin(axis=1)
                best[k:e], far[k:e] = near[at], d[np.arange(e - k), at]
        named = pd.Series(two["matched_identity"].to_numpy(object)[best], index=one.index, dtype=object)
        out = one[[*keys, "frame"]].assign(match_distance=far, matched_identity=named)
        return out[far <= limit]

    group = [*keys, "_block"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both may come from one table
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names))
    best = found.groupBy(*keys, "frame").agg(F.min_by("matched_identity", F.struct("match_distance", "matched_identity")).alias("matched_identity"), F.min("match_distance").alias("match_distance"))
    return frames.join(best, [*keys, "frame"], "left")


def label_conflicts(frames: DataFrame, keys: list[str], us: str, label: str, subject: str, window: int = SECOND, invalid: str = "invalid") -> DataFrame:
    """Rows (keys, label, a, b): pairs of subjects, a < b, that bear one label within ``window`` of each other.

    Subjects of a label are dealt into blocks of ``SUBJECTS`` and every pair of blocks is a group, which marks the pairs that meet in a table of its own: the shuffle has the times of a
    subject once for each block, and pairs never leave their task but as its result, a slice at a time.
    """
    rows = frames.where(F.col(label) != invalid).dropna(subset=[*keys, us, subject]).select(*keys, label, subject, F.col(us).alias("_us"))
    times = rows.groupBy(*keys, label, subject, F.floor(F.col("_us") / (1000 * window)).alias("_part")).agg(F.collect_set("_us").alias("_at"))
    sizes = rows.groupBy(*keys, label).agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(subject) / SUBJECTS)).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64(subject), F.col("_n")).cast("int")
    dealt = times.join(sizes, [*keys, label]).withColumn("_own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select(*keys, label, F.least("_own", "_k").alias("_p"), F.greatest("_own", "_k").alias("_q"), "_own", F.col(subject).alias("_s"), "_at")
    names, kinds = [*keys, label], dict(rows.dtypes)
    kind = lambda c: None if kinds[c] in ("int", "bigint") else object  # noqa: E731  # of pandas: texts stay objects

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = pd.concat(frames, ignore_index=True)
        n = one["_at"].map(len).to_numpy()
        codes, subjects = pd.factorize(one["_s"], sort=True)
        at, who, left = np.concatenate(one["_at"].tolist()), np.repeat(codes, n), np.repeat((one["_own"] == one["_p"]).to_numpy(), n)
        alone = one["_p"].iloc[0] == one["_q"].iloc[0]
        sides = [(at, who)] * 2 if alone else [(at[side], who[side]) for side in (left, ~left)]
        for a, b in _met(*sides, window):
            k = a < b if alone else slice(None)
            a, b = a[k], b[k]
            same = {c: pd.Series(np.full(len(a), one[c].iloc[0]), dtype=kind(c)) for c in names}
            yield pd.DataFrame({**same, "a": pd.Series(subjects[np.minimum(a, b)], dtype=kind(subject)), "b": pd.Series(subjects[np.maximum(a, b)], dtype=kind(subject))})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", a {kinds[subject]}, b {kinds[subject]}"
    return dealt.groupBy(*names, "_p", "_q").applyInPandas(run, schema)


def _met(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], window: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields arrays of the numbers (a, b) of two sides (times, numbers) that have times within ``window`` of each other, each pair once, about ``most`` at a time."""
    (at, who), (other, whom) = left, right
    if not len(at) or not len(other):
        return
    order = np.argsort(other, kind="stable")
    other, whom = other[order], whom[order]
    low = np.searchsorted(other, at - window, "left")
    n = np.searchsorted(other, at + window, "right") - low
    (mine, who), (theirs, whom) = (np.unique(x, return_inverse=True) for x in (who, whom))
    met = np.zeros((len(mine), len(theirs)), bool)
    many = n > most
    for i in np.flatnonzero(many):
        met[who[i], whom[low[i] : low[i] + n[i]]] = True
    at_rows, low, n = np.flatnonzero(~many), low[~many], n[~many]
    done = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
        m = n[start:stop]
        places = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[start:stop], m)
        met[np.repeat(who[at_rows[start:stop]], m), whom[places]] = True
        start = stop
    step = max(1, most // len(theirs))
    for k in range(0, len(mine), step):
        a, b = np.nonzero(met[k : k + step])
        yield mine[a + k], theirs[b]


def lose_conflicts(tracks: DataFrame, conflicts: DataFrame, keys: list[str], label: str, subject: str, invalid: str = "invalid") -> DataFrame:
    """``tracks`` with the label of every subject that loses a conflict made invalid: it has fewer tracks of that label.

    Of equally many the lesser subject keeps the label. A subject loses by any of its conflicts.
    """
    votes = tracks.groupBy(*keys, label, subject).agg(F.count("*").alias("_n"))
    sides = [votes.select(*keys, label, F.col(subject).alias(s), F.col("_n").alias(f"_{s}")) for s in ("a", "b")]
    met = conflicts.join(sides[0], [*keys, label, "a"]).join(sides[1], [*keys, label, "b"])
    lost = met.select(*keys, label, F.when(F.col("_a") >= F.col("_b"), F.col("b")).otherwise(F.col("a")).alias(subject)).distinct()
    return _without_lost(tracks, lost, keys, label, subject, invalid)


def lose_meetings(frames: DataFrame, keys: list[str], us: str, label: str, subject: str, window: int = SECOND, left_out: str = "invalid", invalid: str = "invalid") -> DataFrame:
    """``lose_conflicts`` of ``frames`` by their own ``label_conflicts``, without the pairs; rows of the label ``left_out`` take no part.

    Subjects of a label have an order: more rows first, of equally many the lesser. One loses if any row within ``window`` of one of its own is of a subject
    before it, which a least over a range of times tells. The time is cut into parts that overlap by ``window``, so no task sees all rows of a label.
    """
    rows = frames.where(F.col(label) != left_out).dropna(subset=[*keys, us, label, subject]).select(*keys, us, label, subject)
    votes = frames.groupBy(*keys, label, subject).agg(F.count("*").alias("_n"))
    rows = rows.join(votes, [*keys, label, subject]).withColumn("_o", F.struct(-F.col("_n"), F.col(subject)))
    part = lambda c: F.floor(c / (100 * window))
    dealt = rows.withColumn("_part", F.explode(F.sequence(part(F.col(us) - window), part(F.col(us) + window))))
    w = Window.partitionBy(*keys, label, "_part").orderBy(us).rangeBetween(-window, window)
    lost = dealt.withColumn("_first", F.min("_o").over(w)).where(F.col("_first") < F.col("_o")).select(*keys, label, subject).distinct()
    return _without_lost(frames, lost, keys, label, subject, invalid)


def _without_lost(tracks: DataFrame, lost: DataFrame, keys: list[str], label: str, subject: str, invalid: str) -> DataFrame:
    marked = tracks.join(lost.withColumn("_lost", F.lit(True)), [*keys, label, subject], "left")
    return marked.withColumn(label, F.when(F.col("_lost"), F.lit(invalid)).otherwise(F.col(label))).drop("_lost")


def resolve_group(frame: pd.DataFrame, least_overlap: int = SECOND, passes: int = 10) -> list[str]:
    """Labels of one night's tracks of a camera without two at a time that bear the same one, in at most ``passes`` passes.

    Columns: start_us, end_us, label, original, quality, ranked (other identities, best first). Of tracks that overlap under one label,
    that of best quality keeps it, then the longest; the others take the first ranked identity that is free at their time, else
    their original one, else ``unknown``.
    """
    start, end, label = frame["start_us"].tolist(), frame["end_us"].tolist(), frame["label"].tolist()
    original, quality, ranked = frame["original"].tolist(), frame["quality"].tolist(), [list(x) if x is not None else [] for x in frame["ranked"]]
    n = len(label)
    order = sorted(range(n), key=lambda i: (start[i], i))
    begins = [start[i] for i in order]
    place = {i: k for k, i in enumerate(order)}
    long = [end[i] - start[i] >= least_overlap for i in range(n)]
    held: dict[str, _LatestEnds] = {}  # the tracks that bear a label, without those too short to overlap any

    def hold(i: int) -> None:
        if long[i]:
            held.setdefault(label[i], _LatestEnds(n)).put(place[i], end[i])

    def free(i: int, name: str) -> bool:
        """Whether no other track of that label overlaps: one that begins early enough and ends late enough."""
        if not long[i] or name not in held:
            return True
        before, ends, k = bisect.bisect_right(begins, end[i] - least_overlap), held[name], place[i]
        return max(ends.latest(0, min(k, before)), ends.latest(k + 1, before)) < start[i] + least_overlap

    for i in range(n):
        hold(i)
    for _ in range(passes):
        changed, holders = False, {}
        for i in order:
            holders.setdefault(label[i], []).append(i)
        for name, mine in holders.items():
            # A group is a run of tracks each of which overlaps an earlier one that lasts until then.
            groups: list[list[int]] = []
            reach = None
            for i in mine:
                if reach is not None and long[i] and reach - start[i] >= least_overlap:
                    groups[-1].append(i)
                    reach = max(reach, end[i])
                else:
                    groups.append([i])
                    reach = end[i]
            for group in groups:
                if len(group) == 1:
                    continue
                _, *others = sorted(group, key=lambda i: (-quality[i], start[i] - end[i], i))
                # Losers are held against the labels as they were when the group's turn came.
                given = {i: next((x for x in ranked[i] if x and x != name and free(i, x)), original[i] if free(i, original[i]) else "unknown") for i in others}
                for i, x in given.items():
                    if long[i]:
                        held[label[i]].drop(place[i])
                    label[i] = x
                    hold(i)
                changed = True
        if not changed:
            break
    return label


class _LatestEnds:
    """The ends of a label's tracks by their place in order of start; the latest of a range of places in logarithmic time (a sparse tree of maxima)."""

    def __init__(self, n: int) -> None:
        self.size, self.tree = 1 << max(n - 1, 0).bit_length(), {}

    def put(self, place: int, end: int) -> None:
        k = place + self.size
        while k and self.tree.get(k, -math.inf) < end:
            self.tree[k] = end
            k //= 2

    def drop(self, place: int) -> None:
        k = place + self.size
        del self.tree[k]
        while (k := k // 2) and k in self.tree:
            both = max(self.tree.get(2 * k, -math.inf), self.tree.get(2 * k + 1, -math.inf))
            if both == -math.inf:
                del self.tree[k]
            elif both == self.tree[k]:
                break
            else:
                self.tree[k] = both

    def latest(self, low: int, high: int) -> float:
        """The latest end at the places from ``low`` to ``high``, that one left out."""
        found, low, high = -math.inf, low + self.size, high + self.size
        while low < high:
            if low & 1:
                found, low = max(found, self.tree.get(low, -math.inf)), low + 1
            if high & 1:
                high -= 1
                found = max(found, self.tree.get(high, -math.inf))
            low, high = low // 2, high // 2
        return found


def resolve(tracks: DataFrame, keys: list[str], track: str) -> DataFrame:
    """Rows (keys, track, label): the labels of ``resolve_group`` for each night of a camera (``keys``)."""
    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    columns = [*keys, track, "start_us", "end_us", "label", "original", "quality", "ranked"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(track).reset_index(drop=True)
        return frame[[*keys, track]].assign(label=resolve_group(frame))

    return tracks.select(*columns).groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, track]) + ", label string")


def transfer(tracks: DataFrame, matches: DataFrame, keys: list[str], track: str, identity: str, distance: str) -> DataFrame:
    """Rows (keys, track, label): identities of one camera's tracks from the matches with another camera, without conflicts.

    ``tracks`` has original (label), start_us and end_us; ``matches`` a row for each frame that was matched.
    """
    best = candidates(matches, [*keys, track], identity, distance)
    names = F.array_sort(F.collect_list(F.struct("rank", F.col(identity).alias("name"))))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    found = best.groupBy(*keys, track).agg(names.alias("_names"), *[first(c).alias(f"_{c}") for c in (identity, "votes", "margin", "mean_distance", "score")])
    rows = tracks.join(found, [*keys, track], "left")
    takes = accepted(F.col("original"), F.col(f"_{identity}"), F.col("_votes"), F.col("_margin"), F.col("_mean_distance"))
    rows = rows.withColumn("label", F.when(takes, F.col(f"_{identity}")).otherwise(F.col("original"))).withColumn("quality", F.coalesce("_score", F.lit(0.0)))
    return resolve(rows.withColumn("ranked", F.coalesce(F.transform("_names", lambda x: x["name"]), F.array().cast("array<string>"))), keys, track)


def group_votes(votes: DataFrame, keys: list[str], room: str, individual: str, count: str, groups: dict[str, int]) -> DataFrame:
    """Rows (keys, room, group, votes, rank): votes for the members of each social group; ties by group."""
    number = F.coalesce(*[F.when(F.col(individual) == k, F.lit(v)) for k, v in groups.items()])
    sums = votes.withColumn("group", number).where("`group` is not null").groupBy(*keys, room, "group").agg(F.sum(count).alias("votes"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, room).orderBy(F.col("votes").desc(), "group")))


def rooms_of_groups(ranked: DataFrame, keys: list[str], room: str) -> DataFrame:
    """Rows (keys, room, group): one group a room and one room a group, for each night; null where none is left.

    Rooms are taken in order of name. A room has its first group unless another room has it first with more votes (or as many
    and a lesser name) or it is given away; then the next one that is free.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = {r: list(zip(f["group"], f["votes"], strict=True)) for r, f in frame.sort_values("rank").groupby(room)}
        taken: set = set()
        out = []
        for r in sorted(order):
            first, votes = order[r][0]
            rivals = [(v[0][1], q) for q, v in order.items() if q != r and v[0][0] == first]
            wins = all((votes, r) > (n, r) or votes == n and r < q for n, q in rivals)
            chosen = first if wins and first not in taken else next((g for g, _ in order[r] if g not in taken), None)
            if chosen is not None:
                taken.add(chosen)
            out.append((*[frame.iloc[0][k] for k in keys], r, chosen))
        return pd.DataFrame(out, columns=[*keys, room, "group"])

    return ranked.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, room]) + ", `group` int")


def occupancy_votes(frames: DataFrame, keys: list[str], track: str, us: str, label: str, seen: Column, votes: Column, single: list[str], several: list[str]) -> DataFrame:
    """Rows (keys, track, label, present): each track's label of most votes among those that may be there.

    Two conditions: ``seen`` frames tell who is there, ``votes`` frames (as a rule fewer, of surer frames) vote. ``present`` is the greatest number of
    tracks seen at one time of the track's voting frames, 1 where nobody is seen. A track that is always alone may be one of ``single``, else one of
    ``several``; without a vote for these all votes count. Ties by label; tracks without a vote are left out.
    """
    at = frames.where(seen).select(*keys, us, track).distinct().groupBy(*keys, us).agg(F.count("*").alias("_present"))
    voting = frames.where(votes).groupBy(*keys, us, track, label).agg(F.count("*").alias("_n")).join(at, [*keys, us], "left")
    voting = voting.withColumn("present", F.max(F.coalesce("_present", F.lit(1))).over(Window.partitionBy(*keys, track)))
    counts = voting.where(F.col(label).isNotNull()).groupBy(*keys, track, label).agg(F.sum("_n").alias("_n"), F.max("present").alias("present"))
    fits = F.when(F.col("present") <= 1, F.col(label).isin(single)).otherwise(F.col(label).isin(several))
    w = Window.partitionBy(*keys, track).orderBy(fits.desc(), F.col("_n").desc(), label)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, track, label, "present")


def paired_summary(df: DataFrame, keys: list[str], camera: str, tracks: str, partner: dict[str, str]) -> DataFrame:
    """Rows (keys, camera1, tracks1, camera2, tracks2): a row for each pair of cameras; camera1 is the lesser one that has rows."""
    other = F.coalesce(*[F.when(F.col(camera) == k, F.lit(v)) for k, v in partner.items()])
    rows = df.withColumn("_other", other).where("_other is not null").withColumn("_pair", F.least(F.col(camera), F.col("_other")))
    per = rows.groupBy(*keys, "_pair", camera, "_other").agg(F.sum(F.coalesce(tracks, F.lit(0))).alias("_n"))
    first = per.groupBy(*keys, "_pair").agg(F.min(F.struct(F.col(camera).alias("c"), F.col("_other").alias("o"), F.col("_n").alias("n"))).alias("_a"), F.max(F.struct(F.col(camera).alias("c"), F.col("_n").alias("n"))).alias("_b"))
    return first.select(*keys, F.col("_a.c").alias("camera1"), F.col("_a.n").alias("tracks1"), F.col("_a.o").alias("camera2"), F.when(F.col("_b.c") == F.col("_a.o"), F.col("_b.n")).otherwise(0).alias("tracks2"))
