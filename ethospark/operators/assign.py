"""Assignment and sequential decisions on small groups: matching, stitching, exclusive labels.

Each rule depends on the order of its steps, so a group (a bin, a night of a room or a camera) is one call of
``applyInPandas``. Groups are bounded by what a night and a room hold: tens of animals, hundreds of tracks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORBIDDEN = 1e9


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost, each row and column once: shortest augmenting paths with potentials."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], free = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while row_of[free]:
            used[free] = True
            r = row_of[free]
            reduced = np.where(used[1:], np.inf, c[r - 1] - u[r] - v[1:])
            better = reduced < least[1:]
            least[1:][better], way[1:][better] = reduced[better], free
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(open_.argmin()) + 1
            delta = open_[nxt - 1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            free = nxt
        while free:
            row_of[free] = row_of[way[free]]
            free = int(way[free])
    pairs = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def _best_pairs(rows: list[tuple]) -> list[tuple]:
    """Of (a, b, distance) the one-to-one pairs of least total distance; of repeated pairs the nearest counts."""
    if len({r[0] for r in rows}) == 1 or len({r[1] for r in rows}) == 1:
        return [min(rows, key=lambda r: (r[2], r[0], r[1]))]
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at = {x: n for n, x in enumerate(left)}, {x: n for n, x in enumerate(right)}
    cost = np.full((len(left), len(right)), FORBIDDEN)
    for x, y, d in rows:
        cost[at[0][x], at[1][y]] = min(d, cost[at[0][x], at[1][y]])
    return [(left[i], right[j], cost[i, j]) for i, j in hungarian(cost) if cost[i, j] < FORBIDDEN]


def match_in_bins(pairs: DataFrame, keys: list[str], a: str, b: str, distance: str, limit: float) -> DataFrame:
    """In each bin the one-to-one pairs of least total distance, none farther than ``limit``.

    Bins are many and small, so a task takes them one after the other from its sorted rows; the last bin of a batch waits for the next.
    """
    near = pairs.where(F.col(distance) <= limit).select(*keys, a, b, distance)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bin_, held = None, []
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                if row[: len(keys)] != bin_:
                    out += [(*bin_, *p) for p in _best_pairs(held)] if held else []
                    bin_, held = row[: len(keys)], []
                held.append(row[len(keys) :])
            yield pd.DataFrame(out, columns=[*keys, a, b, distance])
        yield pd.DataFrame([(*bin_, *p) for p in _best_pairs(held)] if held else [], columns=[*keys, a, b, distance])

    return near.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInPandas(run, schema)


def line_pairs(x: np.ndarray, y: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Of two sorted lists of numbers the most one-to-one pairs none farther apart than ``limit``, and of these the ones of least total distance.

    Exchanging the ends of two pairs that cross makes neither the farther nor the total worse, so pairs in order suffice: a table over both lists, a row at a
    time. Each place has the most pairs and their total; which step led there is two bits.
    """
    n, m = len(x), len(y)
    big = limit * (min(n, m) + 1) + 1.0  # a pair more is worth any distance
    best = np.zeros(m + 1)
    steps = np.zeros((n, (m + 8) // 8), np.uint8), np.zeros((n, (m + 8) // 8), np.uint8)
    for i in range(n):
        d = np.abs(y - x[i])
        paired = np.where(d <= limit, best[:-1] + d - big, np.inf)
        up = best.copy()
        took = paired < up[1:]
        up[1:][took] = paired[took]
        best = np.minimum.accumulate(up)
        steps[0][i], steps[1][i] = np.packbits(np.r_[False, took]), np.packbits(up <= best)
    pairs, i, j = [], n - 1, m
    while i >= 0 and j > 0:
        byte, bit = j >> 3, 128 >> (j & 7)
        if not steps[1][i, byte] & bit:
            j -= 1
        elif steps[0][i, byte] & bit:
            pairs.append((i, j - 1))
            i, j = i - 1, j - 1
        else:
            i -= 1
    return pairs[::-1]


def match_on_line(positions: DataFrame, keys: list[str], side: str, track: str, x: str, a: str, b: str, distance: str, limit: float) -> DataFrame:
    """What ``match_in_bins`` gives where the distance is that of two numbers ``x``: rows (keys, a, b, distance), side 0 matched to side 1, without a row for each pair.

    Sums on a line tie often; of the pairs of least total distance those in order are taken, of equal numbers by name. Rows come sorted by bin, and a task holds a bin at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in positions.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{a}` {kinds[track]}, `{b}` {kinds[track]}, `{distance}` double"])
    known = positions.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*keys, F.col(side).cast("int").alias("_side"), track, F.col(x).cast("double").alias("_x"))

    def of_bin(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = frame[frame["_side"] == 0], frame[frame["_side"] == 1]
        u, v = one["_x"].to_numpy(), two["_x"].to_numpy()
        found = np.array(line_pairs(u, v, limit), np.int64).reshape(-1, 2)
        i, j = found[:, 0], found[:, 1]
        out = one[keys].iloc[i].reset_index(drop=True)
        return out.assign(**{a: one[track].to_numpy()[i], b: two[track].to_numpy()[j], distance: np.abs(u[i] - v[j])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            both = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(both):
                continue
            fresh = np.flatnonzero(np.r_[True, (both[keys].to_numpy()[1:] != both[keys].to_numpy()[:-1]).any(axis=1)])
            done = [of_bin(both.iloc[lo:hi]) for lo, hi in zip(fresh[:-1], fresh[1:], strict=True)]
            held = both.iloc[fresh[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield of_bin(held)

    sides = known.withColumn("_both", F.min("_side").over(Window.partitionBy(*keys)) != F.max("_side").over(Window.partitionBy(*keys))).where("_both").drop("_both")
    many = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.repartition(many, *keys).sortWithinPartitions(*keys, "_side", "_x", track).mapInPandas(run, schema)


def match_tracks(matched: DataFrame, keys: list[str], bins: str, a: str, b: str, distance: str, least_bins: int) -> DataFrame:
    """One-to-one track pairs of most votes, a vote being a bin in which both are matched.

    Rows (keys, a, b, votes, distance, cross_id): numbered within each group by votes, then names.
    """
    votes = matched.groupBy(*keys, a, b).agg(F.count_distinct(bins).alias("votes"), F.median(distance).alias(distance)).where(F.col("votes") >= least_bins)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in votes.schema.fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, columns = sorted(frame[a].unique()), sorted(frame[b].unique())
        weight = frame.pivot(index=a, columns=b, values="votes").reindex(index=rows, columns=columns).fillna(0).to_numpy(float)
        pairs = {(rows[i], columns[j]) for i, j in hungarian(weight.max() - weight) if weight[i, j] > 0}
        return frame[[(x, y) in pairs for x, y in zip(frame[a], frame[b], strict=True)]]

    chosen = votes.groupBy(*keys).applyInPandas(run, schema)
    return chosen.withColumn("cross_id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), a, b)))


def number_tracks(matched: DataFrame, tracks: DataFrame, keys: list[str], a: str, b: str, track: str) -> DataFrame:
    """Rows (keys, track, cross_id): the numbers of matched pairs for both tracks; unmatched tracks follow in order of name."""
    pairs = matched.select(*keys, F.explode(F.array(a, b)).alias(track), "cross_id")
    rows = tracks.select(*keys, track).distinct().join(pairs, [*keys, track], "left")
    w = Window.partitionBy(*keys)
    later = F.row_number().over(w.orderBy(F.col("cross_id").isNotNull(), track)) + F.coalesce(F.max("cross_id").over(w), F.lit(0))
    return rows.withColumn("cross_id", F.coalesce("cross_id", later))


def exclusive_labels(groups: DataFrame, keys: list[str], subject: str, votes: str, start: str, end: str, allowed: list[str]) -> DataFrame:
    """Each group of tracks gets its best label that no overlapping group has yet; groups of most evidence come first.

    ``groups`` has a row for each subject with its ``votes`` (map of label to count) and its whole interval in
    microseconds. Evidence is all votes for allowed labels plus a thousandth of the duration in seconds. Labels are tried by
    votes, then those without votes in the order of ``allowed``. Rows (keys, subject, label, n_conflicts, conflicts): each conflict
    names the label, the subject that keeps it, the overlap in microseconds and what came of it; a subject without an
    interval or a free label is ``unknown``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    conflict = f"array<struct<label:string,kept:{kinds[subject]},overlap_us:bigint,resolution:string>>"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{subject}` {kinds[subject]}", "label string, n_conflicts long", f"conflicts {conflict}"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, v, a, b in zip(frame[subject], frame[votes], frame[start], frame[end], strict=True):
            mine = {x: int(n) for x, n in dict(v or {}).items() if x in allowed}
            known = not (pd.isna(a) or pd.isna(b))
            rows.append((sum(mine.values()) + (0.001 * (b - a) / 1e6 if known else 0.0), s, mine, a, b, known))
        taken: list[tuple[str, int, int, object]] = []
        out = []
        for _, s, mine, a, b, known in sorted(rows, key=lambda r: (-r[0], r[1])):
            label, lost = "unknown", []
            if known:
                for x in sorted(mine, key=lambda x: (-mine[x], allowed.index(x))) + [x for x in allowed if x not in mine]:
                    met = [(c, d, other) for y, c, d, other in taken if x == y and c < b and a < d]
                    if not met:
                        label = x
                        taken.append((x, a, b, s))
                        break
                    lost += [{"label": x, "kept": other, "overlap_us": int(min(b, d) - max(a, c)), "resolution": "try_next"} for c, d, other in met]
                if label == "unknown" and lost:
                    lost[-1]["resolution"] = "set_unknown"
            out.append((*[frame.iloc[0][k] for k in keys], s, label, len(lost), lost))
        return pd.DataFrame(out, columns=[*keys, subject, "label", "n_conflicts", "conflicts"])

    return groups.select(*keys, subject, votes, start, end).groupBy(*keys).applyInPandas(run, schema)


@dataclass(frozen=True)
class StitchParams:
    """Limits and rules of the stitching; gaps in frames of ``fps``.

    ``members`` says against which members of an identity overlap and gap are checked: ``every`` one (gaps to each), the
    ``retained`` ones of the gallery (nearest gap), or only the identity's ``last`` end. ``consistency_by`` is how a tracklet
    is held against a gallery of three or more. With ``sequential`` a refused choice leads on to the next rule,
    otherwise a strong local match that is refused leads straight to the forced choice, which checks nothing.
    """

    n_identities: int = 4
    local: float = 0.5
    gallery: float = 0.45
    local_gap: int = 600
    identity_gap: int = 45_000
    gallery_size: int = 10
    fps: float = 25.0
    ramp: bool = True
    short: int = 50
    long: int = 100
    short_factor: float = 1.2
    local_penalty: float = 0.3
    identity_penalty: float = 0.0
    recent: bool = True
    members: str = "every"
    consistency: float = 0.35
    consistency_by: str | None = "weighted"
    sequential: bool = True


_OPEN = {"local_penalty": 0.0, "recent": False, "members": "last", "consistency_by": None, "sequential": False}
#: The rules by name; ``strict`` is the default.
STITCHING = {
    "plain": StitchParams(ramp=False, short_factor=1.0, **_OPEN),
    "dynamic": StitchParams(**_OPEN),
    "robust": StitchParams(members="retained", identity_penalty=0.4, consistency_by="median"),
    "strict": StitchParams(),
}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) or 1.0)


class _Identities:
    """The identities under way on one camera, and the rules for joining one."""

    def __init__(self, p: StitchParams, starts: list[int], ends: list[int], means: list[np.ndarray]):
        self.p, self.starts, self.ends, self.means = p, starts, ends, means
        self.members: list[list[int]] = []
        self.galleries: list[list[np.ndarray]] = []
        self.of: dict[int, int] = {}

    def frames(self, us: int) -> int:
        return math.trunc(us / 1e6 * self.p.fps)

    def gap(self, i: int, k: int) -> float | None:
        """Frames to the nearest member that counts, or None where tracklet ``i`` can't join identity ``k``."""
        p, members = self.p, self.members[k]
        if p.members == "last":
            return None if self.starts[i] < max(self.ends[j] for j in members) else 0
        checked = members[-p.gallery_size :] if p.members == "retained" else members
        gaps = []
        for j in checked:
            if self.ends[i] > self.starts[j] and self.starts[i] < self.ends[j]:
                return None
            gaps.append(self.frames(self.starts[j] - self.ends[i] if self.ends[i] <= self.starts[j] else self.starts[i] - self.ends[j]))
        worst = max(gaps) if p.members == "every" else min(gaps)
        return min(gaps) if worst <= p.identity_gap else None

    def likeness(self, i: int, k: int) -> float:
        """How a tracklet's mean fits an identity's gallery; recent members weigh more, or all the same."""
        near = [float(self.means[i] @ g) for g in self.galleries[k]]
        return float(np.average(near, weights=np.exp(np.linspace(-0.5, 0, len(near))) if self.p.recent else None))

    def consistent(self, i: int, k: int) -> bool:
        if self.p.consistency_by is None or len(self.galleries[k]) < 3:
            return True
        fit = self.likeness(i, k) if self.p.consistency_by == "weighted" else float(np.median([float(self.means[i] @ g) for g in self.galleries[k]]))
        return fit >= self.p.consistency

    def join(self, i: int, k: int, check: bool = True) -> bool:
        if check and (self.gap(i, k) is None or not self.consistent(i, k)):
            return False
        self.members[k].append(i)
        self.galleries[k] = (self.galleries[k] + [self.means[i]])[-self.p.gallery_size :]
        self.of[i] = k
        return True

    def open(self, i: int) -> None:
        self.of[i] = len(self.members)
        self.members.append([i])
        self.galleries.append([self.means[i]])


def stitch_group(frame: pd.DataFrame, p: StitchParams) -> list[int]:
    """Identities of one camera's tracklets, given in order of start with columns start_us, end_us, head, tail, mean, n_features.

    Local likeness is that of a tracklet's head to the tail of an earlier one that ended within ``local_gap``; scanning
    backwards from the latest start ends at the first that is farther away. A strong one decides; else the best sum of local and gallery
    likeness; else a new identity is opened while there are fewer than ``n_identities``; else the best is taken in spite of the
    thresholds, and where that is refused, or no identity is admissible, one more is opened.
    """
    if p.n_identities <= 1:
        return [0] * len(frame)
    starts, ends, sizes = (frame[c].tolist() for c in ("start_us", "end_us", "n_features"))
    heads, tails, means = ([_unit(np.asarray(v, float)) for v in frame[c]] for c in ("head", "tail", "mean"))
    known = _Identities(p, starts, ends, means)
    for i in range(len(frame)):
        if not known.members:
            known.open(i)
            continue
        ramp = 0.8 - 0.4 * min(1.0, max(0.0, (sizes[i] - p.short) / (p.long - p.short)))
        weight = ramp if p.ramp else 0.6
        local, near = -1.0, None
        for j in range(i - 1, -1, -1):
            gap = known.frames(starts[i] - ends[j])
            if gap < 0:
                continue
            if gap > p.local_gap:
                break
            s = float(tails[j] @ heads[i]) * (1 - p.local_penalty * gap / p.local_gap)
            if s > local:
                local, near = s, known.of[j]
        scored = []
        for k in range(len(known.members)):
            gap = known.gap(i, k)
            if gap is None:
                continue
            fit = known.likeness(i, k) * (1 - p.identity_penalty * gap / p.identity_gap)
            scored.append((weight * (local if near == k and local > 0 else 0.0) + (1 - weight) * fit, -k))
        if not scored and p.sequential:
            known.open(i)
            continue
        score, best = max(scored, default=(-1e6, 0))
        best = -best
        strong = near is not None and local >= p.local * (p.short_factor if sizes[i] < p.short else 1.0)
        done = strong and known.join(i, near)
        if not done and (p.sequential or not strong):
            if score >= weight * p.local + (1 - weight) * p.gallery:
                done = known.join(i, best, p.sequential)
            if not done and len(known.members) < p.n_identities:
                known.open(i)
                done = True
        if not done and not known.join(i, best, p.sequential):
            known.open(i)
    return [known.of[i] for i in range(len(frame))]


def stitch(tracklets: DataFrame, keys: list[str], track: str, params: StitchParams | None = None) -> DataFrame:
    """Rows (keys, track, stitched_id): each camera's tracklets put together to identities.

    ``keys`` name a camera and a night, so that a group doesn't grow with the archive. Tracklets without vectors get ids of their own after all others.
    """
    p = params or STITCHING["strict"]
    kinds = {f.name: f.dataType.simpleString() for f in tracklets.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{track}` {kinds[track]}", "stitched_id int"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start_us", track]).reset_index(drop=True)
        usable = frame["mean"].map(lambda v: v is not None and len(v) > 0)
        good, rest = frame[usable], frame[~usable]
        ids = stitch_group(good.reset_index(drop=True), p)
        first = max(ids, default=-1) + 1
        later = [0] * len(rest) if p.n_identities <= 1 else range(first, first + len(rest))
        return pd.concat([good[[*keys, track]].assign(stitched_id=ids), rest[[*keys, track]].assign(stitched_id=list(later))])

    return tracklets.groupBy(*keys).applyInPandas(run, schema)


def stitch_windows(tracklets: DataFrame, keys: list[str], track: str, width: int, params: StitchParams | None = None) -> DataFrame:
    """The same by windows: a tracklet belongs to the window of ``width`` microseconds that holds its start, and each window is stitched for itself.

    Ids are unique within ``keys``: windows follow each other.
    """
    cut = tracklets.withColumn("_window", F.floor(F.col("start_us") / width))
    found = stitch(cut, [*keys, "_window"], track, params)
    most = found.groupBy(*keys, "_window").agg((F.max("stitched_id") + 1).alias("_n"))
    before = most.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_window")) - F.col("_n")).drop("_n")
    return found.join(before, [*keys, "_window"]).select(*keys, track, (F.col("stitched_id") + F.col("_before")).cast("int").alias("stitched_id"))


def rerank_labels(counts: dict[int, dict[str, int]], labels: list[str]) -> dict[int, str]:
    """One label for each of a few identities: the assignment of most votes in total, ties in the labels' order."""
    ids = sorted(counts)
    votes = np.array([[counts[i].get(x, 0) for x in labels] for i in ids], float)
    bonus = np.array([[(len(labels) - n) * 1e-6 / (k + 1) for n in range(len(labels))] for k in range(len(ids))])
    return {ids[i]: labels[j] for i, j in hungarian(-(votes + bonus))}


def assign_labels(counts: DataFrame, keys: list[str], identity: str, label: str, n: str, known: list[str]) -> DataFrame:
    """Rows (keys, identity, label, score): the label of each identity of a key from votes (keys, identity, label, n).

    A score is a label's share of all of an identity's votes. Two identities of a key and two known labels get one label each, so that the scores' sum is greatest (equal sums: the first
    identity gets the lesser label). Otherwise each identity gets its best label, ties in the order of ``known``; several may get the same. An
    identity without votes for known labels has score 0.
    """
    total = F.sum(n).over(Window.partitionBy(*keys, identity))
    shares = counts.where(F.col(n) > 0).withColumn("_s", F.col(n) / total).groupBy(*keys, identity).agg(*[F.coalesce(F.sum(F.when(F.col(label) == x, F.col("_s"))), F.lit(0.0)).alias(f"_s{k}") for k, x in enumerate(known)])
    every = counts.select(*keys, identity).distinct().join(shares, [*keys, identity], "left").na.fill(0.0, [f"_s{k}" for k in range(len(known))])
    best = F.greatest(*[F.col(f"_s{k}") for k in range(len(known))]) if len(known) > 1 else F.col("_s0")
    own = F.coalesce(*[F.when(F.col(f"_s{k}") == best, F.lit(x)) for k, x in enumerate(known)])
    if len(known) != 2:
        return every.select(*keys, identity, own.alias(label), best.alias("score"))
    lesser, other = sorted(range(2), key=lambda k: known[k])
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(identity)) == 1
    ranked = every.withColumn("_first", first).withColumn("_two", F.count("*").over(w) == 2)
    straight = F.sum(F.when(F.col("_first"), F.col(f"_s{lesser}")).otherwise(F.col(f"_s{other}"))).over(w)
    crossed = F.sum(F.when(F.col("_first"), F.col(f"_s{other}")).otherwise(F.col(f"_s{lesser}"))).over(w)
    takes = F.when(F.col("_first") == (straight >= crossed - 1e-12), lesser).otherwise(other)
    pick = lambda k, a, b: F.when(k == 0, a).otherwise(b)
    one = ranked.withColumn("_k", takes)
    return one.select(*keys, identity, F.when(F.col("_two"), pick(F.col("_k"), F.lit(known[0]), F.lit(known[1]))).otherwise(own).alias(label), F.when(F.col("_two"), pick(F.col("_k"), F.col("_s0"), F.col("_s1"))).otherwise(best).alias("score"))
