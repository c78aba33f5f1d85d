"""Operators on small tables: edge cases, sequential rules and invariants."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ethospark.functions import geometry, text
from ethospark.functions.time import HOUR, clock_text, in_clock_window
from ethospark.operators import archive, assign, evaluate, graph, islands, joins, marts, rasters, smooth, timeline, transfer, vectors

S = 1_000_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_gap_of_exactly_the_limit_does_not_break(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3 * S), ("a", 6 * S + 1), ("b", 0)], "k string, us long")
    got = islands.gap_blocks(df, ["k"], "us", ["us"], 3 * S)
    assert rows(got, "k", "us", "block") == [("a", 0, 1), ("a", 3 * S, 1), ("a", 6 * S + 1, 2), ("b", 0, 1)]


def test_runs_treat_null_as_a_label(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "x")], "us long, label string").withColumn("k", F.lit(1))
    assert rows(islands.bouts(df, ["k"], "us", ["us"], "label"), "start_us", "end_us", "n_rows") == [(1, 1, 1), (2, 3, 2), (4, 4, 1)]


def test_union_merges_touching_and_contained(spark):
    df = spark.createDataFrame([(0, 10), (2, 5), (10, 12), (13, 14), (13, 14)], "a long, b long").withColumn("k", F.lit(1))
    assert rows(islands.interval_union(df, ["k"], "a", "b"), "a", "b", "n_merged") == [(0, 12, 3), (13, 14, 2)]


def test_asof_prefers_the_earlier_row_at_equal_distance(spark):
    left = spark.createDataFrame([(1, 10), (1, 100), (2, 5)], "k int, us long")
    right = spark.createDataFrame([(1, 8, "early"), (1, 12, "late"), (1, 103, "after")], "k int, us long, v string")
    got = joins.asof(left, right, ["k"], "us", "v", 2)
    assert rows(got, "k", "us", "matched")[0] == (1, 10, "early")
    assert [r["matched"] for r in got.where("us in (100, 5)").collect()] == [None, None]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    a = [(i, s := rnd.randrange(100), s + rnd.randrange(0, 30)) for i in range(40)]
    b = [(i, s := rnd.randrange(100), s + rnd.randrange(0, 30)) for i in range(40)]
    left = spark.createDataFrame(a, "i int, a long, b long").withColumn("k", F.lit(1))
    right = spark.createDataFrame(b, "j int, c long, d long").withColumn("k", F.lit(1))
    got = rows(joins.overlaps(left, right, ["k"], "a", "b", "c", "d", 16), "i", "j", "overlap_us")
    want = sorted((i, j, min(y, q) - max(x, p)) for i, x, y in a for j, p, q in b if x < y and p < q and x < q and p < y)
    assert got == want


def test_rolling_majority_ties_and_small_windows(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "bad"), (3, "bad"), (4, "a"), (5, "b")], "us long, label string").withColumn("k", F.lit(1))
    got = rows(smooth.rolling_majority(df, ["k"], "us", "label", ["a", "b"], 10, 5, "bad"), "us", "smoothed")
    assert [x for _, x in got] == ["a"] * 6
    few = rows(smooth.rolling_majority(df, ["k"], "us", "label", ["a", "b"], 10, 7, "bad"), "us", "smoothed")
    assert [x for _, x in few] == ["b", "a", "bad", "bad", "a", "b"]
    none = df.withColumn("label", F.lit("bad"))
    assert {x for _, x in rows(smooth.rolling_majority(none, ["k"], "us", "label", ["a", "b"], 10, 2, "bad"), "us", "smoothed")} == {"bad"}


def test_short_segment_needs_equal_neighbours(spark):
    df = spark.createDataFrame([(0, "a"), (5, "a"), (6, "b"), (7, "a"), (20, "a"), (21, "c"), (22, "b")], "us long, label string").withColumn("k", F.lit(1)).withColumn("block", F.lit(1))
    got = dict(rows(islands.merge_short(df, ["k"], "us", ["us"], "label", "block", 2), "us", "smoothed"))
    assert got[6] == "a" and got[21] == "c" and got[22] == "b"


def test_hungarian_is_optimal():
    rnd = np.random.default_rng(5)
    for n, m in [(1, 1), (2, 3), (4, 4), (5, 3), (3, 6)]:
        cost = rnd.integers(0, 20, (n, m)).astype(float)
        got = sum(cost[i, j] for i, j in assign.hungarian(cost))
        small, large = (cost, m) if n <= m else (cost.T, n)
        assert got == min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))


def test_stitched_chains_do_not_overlap():
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(3, 8))
    start = np.sort(rnd.integers(0, 4000, 60)) * S
    v = [base[i % 3] + rnd.normal(scale=0.2, size=8) for i in range(60)]
    frame = pd.DataFrame({"start_us": start, "end_us": start + rnd.integers(30, 300, 60) * S, "head": v, "tail": v, "mean": v, "n_features": 60})
    ids = assign.stitch_group(frame, assign.StitchParams())
    for k in set(ids):
        own = frame[[x == k for x in ids]].sort_values("start_us")
        assert (own["start_us"].to_numpy()[1:] >= own["end_us"].to_numpy()[:-1]).all()
    assert assign.stitch_group(frame, assign.StitchParams(n_identities=1)) == [0] * 60


def strict_ids(f: pd.DataFrame, most: int) -> list[int]:
    """The strict rules, written down plainly: 25 frames a second, 600 frames local, 45,000 within an identity."""
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    ids: dict[int, list[int]] = {}
    out: list[int] = []

    def ok(i, k):
        for j in ids[k]:
            apart = f.start_us[j] - f.end_us[i] if f.end_us[i] <= f.start_us[j] else f.start_us[i] - f.end_us[j]
            if apart < 0 or int(apart / 1e6 * 25) > 45000:
                return False
        return True

    def gallery(i, k):
        near = [unit(f["mean"][i]) @ unit(f["mean"][j]) for j in ids[k][-10:]]
        w = np.exp(np.linspace(-0.5, 0, len(near)))
        return float(near @ w / w.sum())

    def add(i, k):
        if not ok(i, k) or len(ids[k]) >= 3 and gallery(i, k) < 0.35:
            return False
        ids[k].append(i)
        out.append(k)
        return True

    def new(i):
        out.append(len(ids))
        ids[len(ids)] = [i]

    for i in range(len(f)):
        n = f.n_features[i]
        w = 0.8 if n < 50 else 0.4 if n > 100 else 0.8 - 0.4 * (n - 50) / 50
        best, mine = -1.0, None
        for j in reversed(range(i)):
            gap = int((f.start_us[i] - f.end_us[j]) / 1e6 * 25)
            if gap > 600:
                break
            if gap >= 0 and (s := unit(f["tail"][j]) @ unit(f["head"][i]) * (1 - 0.3 * gap / 600)) > best:
                best, mine = s, out[j]
        scores = {k: w * (best if mine == k and best > 0 else 0) + (1 - w) * gallery(i, k) for k in ids if ok(i, k)}
        if not scores:
            new(i)
            continue
        top = max(scores, key=lambda k: (scores[k], -k))
        if mine is not None and best >= 0.5 * (1.2 if n < 50 else 1) and add(i, mine):
            continue
        if scores[top] >= w * 0.5 + (1 - w) * 0.45 and add(i, top):
            continue
        if len(ids) < most or not add(i, top):
            new(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_strict_stitching_equals_the_plain_rules(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(4, 6))
    start = np.sort(rnd.integers(0, 9000, 80)) * S
    v = lambda: [base[i % 4] + rnd.normal(scale=0.9, size=6) for i in range(80)]
    frame = pd.DataFrame({"start_us": start, "end_us": start + rnd.integers(20, 200, 80) * S, "head": v(), "tail": v(), "mean": v(), "n_features": rnd.integers(20, 130, 80)})
    assert assign.stitch_group(frame, assign.StitchParams()) == strict_ids(frame, 4)
    for name, p in assign.STITCHING.items():
        ids = assign.stitch_group(frame, p)
        assert len(ids) == 80 and set(ids) == set(range(max(ids) + 1)), name


def test_stitching_variants_differ_where_they_should():
    one, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    f = lambda times, vs: pd.DataFrame({"start_us": [a * S for a, _ in times], "end_us": [b * S for _, b in times], "head": vs, "tail": vs, "mean": vs, "n_features": 120})
    # The second overlaps the first, the third matches the first's tail while the identity's last end is later.
    far = f([(0, 100), (2000, 2100), (3000, 3100)], [one, one, one])
    assert assign.stitch_group(far, assign.STITCHING["strict"]) == [0, 1, 1]  # more than 30 minutes to the first
    assert assign.stitch_group(far, assign.STITCHING["dynamic"]) == [0, 0, 0]
    both = f([(0, 100), (50, 150)], [one, other])
    assert {n: assign.stitch_group(both, p) for n, p in assign.STITCHING.items()} == {"plain": [0, 1], "dynamic": [0, 1], "robust": [0, 1], "strict": [0, 1]}
    crowded = assign.StitchParams(**{**assign.STITCHING["plain"].__dict__, "n_identities": 2})
    assert assign.stitch_group(f([(0, 100), (10, 90), (20, 80)], [one, other, one]), crowded) == [0, 1, 0]  # forced, unchecked


def test_exclusive_labels_hold_at_all_times(spark):
    data = [("r", 1, {"x": 9, "y": 1}, 0, 100), ("r", 2, {"x": 8, "y": 2, "foreign": 99}, 50, 150), ("r", 3, {"x": 1}, 200, 300), ("r", 4, {}, 60, 90), ("r", 5, None, 210, 220), ("r", 6, {"x": 1}, None, None)]
    df = spark.createDataFrame(data, "room string, s int, votes map<string,int>, a long, b long")
    out = assign.exclusive_labels(df, ["room"], "s", "votes", "a", "b", ["x", "y"])
    assert rows(out, "s", "label", "n_conflicts") == [(1, "x", 0), (2, "y", 1), (3, "x", 0), (4, "unknown", 2), (5, "y", 1), (6, "unknown", 0)]
    assert [(c["label"], c["kept"], c["overlap_us"], c["resolution"]) for c in out.where("s = 4").first()["conflicts"]] == [("x", 1, 30, "try_next"), ("y", 2, 30, "set_unknown")]


def test_surrogate_ids_with_other_columns_and_repeated_keys(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("t"))
    got = marts.surrogate_ids(df, ["k"], groups=7).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 3001))
    assert [r["k"] for r in sorted(got, key=lambda r: r["id"])] == sorted(i % 700 for i in range(3000))


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=(40, 5))
    m[8] = m[9]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "gallery_id int, embedding array<float>")
    unit = m.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = rows(vectors.top_k(df.withColumnRenamed("gallery_id", "query_id"), df, 3), "query_id", "rank", "gallery_id")
    assert got == [(q, r + 1, int(g)) for q in range(40) for r, g in enumerate(sorted((x for x in range(40) if x != q), key=lambda x: (-round(unit[q] @ unit[x], 9), x))[:3])]


def test_reranked_labels():
    assert assign.rerank_labels({0: {"A": 8, "B": 7}, 1: {"A": 10}}, ["A", "B"]) == {0: "B", 1: "A"}
    assert assign.rerank_labels({0: {"A": 20, "B": 11}, 1: {"A": 20, "B": 6}}, ["A", "B"]) == {0: "B", 1: "A"}


def test_components_of_a_path_and_a_pair(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert rows(graph.components(df), "id", "component") == [(i, 1) for i in range(1, 41)] + [(100, 100), (101, 100)]


def test_components_of_a_long_shuffled_chain(spark):
    names = random.Random(7).sample(range(10_000), 1000)
    df = spark.createDataFrame([*zip(names, names[1:], strict=False), (20_000, 20_001)], "a long, b long")
    found = {r[0]: r[1] for r in graph.components(df).collect()}
    assert {found.get(x, x) for x in names} == {min(names)} and found[20_001] == 20_000


def test_timeline_seconds_and_segments_agree(spark):
    df = spark.createDataFrame([("a", 0, 100 * S, "rest"), ("a", 40 * S, 60 * S, "walk"), ("a", 150 * S, 150 * S, "walk")], "k string, s long, e long, label string")
    slots = timeline.timeline(df, ["k"], "s", "e", "label", ["rest", "walk"], S)
    assert rows(timeline.segments(slots, ["k"], "label", S), "start_us", "end_us", "label") == [(0, 40 * S, "rest"), (40 * S, 60 * S, "walk"), (60 * S, 100 * S, "rest")]
    assert slots.count() == 100


def test_resampling_is_linear(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 4, 5.0)], "k string, us long, v double")
    assert rows(timeline.resample(df, ["k"], "us", "v", 1), "slot_us", "v") == [(i, i + 1.0) for i in range(5)]


def test_first_and_last_wins(spark):
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, n int")
    old = spark.createDataFrame([(2, "old", 0)], "k int, v string, n int")
    assert rows(marts.first_wins(new, old, ["k"], [F.col("n")]), "k", "v") == [(1, "a")]
    assert rows(marts.last_wins(new, ["k"], [F.col("n")]), "k", "v") == [(1, "b"), (2, "c")]
    assert rows(marts.append_unique(new, old, ["k"], [F.col("n")]), "k", "v") == [(1, "a"), (2, "old")]


def test_night_write_replaces_only_its_nights(spark, tmp_path):
    path = str(tmp_path / "mart")
    marts.night_write(spark.createDataFrame([("n1", 1), ("n2", 2)], "night string, v int"), path)
    marts.night_write(spark.createDataFrame([("n2", 3)], "night string, v int"), path)
    assert rows(spark.read.parquet(path), "night", "v") == [("n1", 1), ("n2", 3)]


def test_votes_tie_by_first_seen_or_name(spark):
    df = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("t", "b", 3), ("t", "a", 4)], "k string, label string, n int")
    assert [r["label"] for r in vectors.vote(df, ["k"], "label", "n").orderBy("rank").collect()] == ["b", "a"]
    assert [r["label"] for r in vectors.vote(df, ["k"], "label").orderBy("rank").collect()] == ["a", "b"]


def test_chi_squared_tail():
    assert evaluate.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert evaluate.chi2_tail(0.0, 3) == 1.0
    assert evaluate.chi2_tail(40.0, 4) == pytest.approx(4.3284e-8, rel=1e-3)


def test_polygon_edges_are_inside(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 0.5), (1.5, 0.5), (0.5, -0.1)], "x double, y double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert [r[0] for r in df.select(geometry.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, True, True, False, False]


def test_clock_texts(spark):
    df = spark.createDataFrame([("18",), ("1800",), ("180000",), ("18:00:00",), ("2500",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(clock_text(F.col("t"))).collect()] == ["18:00:00"] * 4 + [None] * 3
    night = spark.createDataFrame([(23 * HOUR,), (2 * HOUR,), (12 * HOUR,)], "us long").select(in_clock_window(F.col("us"), 22 * HOUR, 4 * HOUR))
    assert [r[0] for r in night.collect()] == [True, True, False]


def test_texts(spark):
    df = spark.createDataFrame([("b, a ,b",)], "t string")
    assert df.select(text.sorted_names(F.col("t"))).first()[0] == "a, b"
    note = spark.createDataFrame([("Anna und Bo, nicht Bob",)], "t string")
    assert note.select(text.found_names(F.col("t"), ["Bo", "Anna", "Cleo"])).first()[0] == ["Bo", "Anna"]


def test_empty_videos(spark):
    hits = [("empty", i * 120.0, False) for i in range(5)] + [("busy", i * 120.0, i < 3) for i in range(20)]
    df = spark.createDataFrame(hits, "v string, t double, d boolean")
    assert rows(archive.empty_videos(df, "v", "t", "d", 120.0), "v", "to_delete") == [("busy", False), ("empty", True)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, us long, label string")
    assert islands.bouts(df, ["k"], "us", ["us"], "label").count() == 0
    assert smooth.rolling_majority(df, ["k"], "us", "label", ["a"], 5, 1, "bad").count() == 0


def test_homography_without_and_with_wrong_pairs():
    h = [[1.2, 0.1, 5.0], [-0.2, 0.9, 3.0], [0.001, 0.002, 1.0]]
    at = lambda x, y: tuple((r[0] * x + r[1] * y + r[2]) / (h[2][0] * x + h[2][1] * y + h[2][2]) for r in h[:2])
    pairs = [((x, y), at(x, y)) for x, y in itertools.product((0, 40, 90), (0, 30, 70))]
    assert np.allclose(rasters.homography(pairs), h)
    assert np.allclose(rasters.homography([*pairs, ((10, 10), (900, 900)), ((20, 5), (-300, 4))], 0.5), h)


def test_clusters_and_plane(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(size=4) * 0.01 + (i % 2) * np.array([5.0, 0, 0, 0])]) for i in range(40)]
    got = rasters.in_two_dimensions(rasters.clusters(spark.createDataFrame(rows, "id int, v array<float>"), "v", 2), "v").collect()
    assert len({(r["id"] % 2, r["cluster"]) for r in got}) == 2
    assert abs(sum(r["plane"][0] for r in got)) < 1e-3 and abs(abs(got[0]["plane"][0]) - 2.5) < 0.1


def test_unmatched_tracks_are_numbered_last(spark):
    matched = spark.createDataFrame([("r", "a2", "b1", 1), ("r", "a1", "b3", 2)], "room string, a string, b string, cross_id int")
    tracks = spark.createDataFrame([("r", t) for t in ("a1", "a2", "a3", "b1", "b2", "b3")] + [("s", "x")], "room string, track string")
    got = assign.number_tracks(matched, tracks, ["room"], "a", "b", "track")
    assert rows(got, "room", "track", "cross_id") == [("r", "a1", 2), ("r", "a2", 1), ("r", "a3", 3), ("r", "b1", 1), ("r", "b2", 4), ("r", "b3", 2), ("s", "x", 1)]


def test_conflicts_are_resolved():
    f = lambda data: pd.DataFrame(data, columns=["start_us", "end_us", "label", "original", "quality", "ranked"])
    best = f([(0, 100 * S, "x", "x", 1.0, []), (50 * S, 150 * S, "x", "y", 2.0, ["x"]), (60 * S, 90 * S, "x", "z", 0.5, ["x", "w"]), (99.5 * S, 300 * S, "q", "q", 0.1, [])])
    assert transfer.resolve_group(best) == ["unknown", "x", "w", "q"]
    apart = f([(0, 100 * S, "x", "x", 1.0, []), (99.5 * S, 200 * S, "x", "x", 1.0, [])])
    assert transfer.resolve_group(apart) == ["x", "x"]  # half a second isn't an overlap
    rnd = random.Random(8)
    for _ in range(30):
        data = []
        for _ in range(rnd.randint(1, 14)):
            a = rnd.randint(0, 400)
            data.append((a * S, (a + rnd.randint(1, 200)) * S, rnd.choice("xyz"), rnd.choice("xyzu"), rnd.random(), rnd.sample("xyzw", rnd.randint(0, 4))))
        got = transfer.resolve_group(f(data))
        for i, j in itertools.combinations(range(len(data)), 2):
            met = min(data[i][1], data[j][1]) - max(data[i][0], data[j][0]) >= S
            assert not met or got[i] != got[j] or got[i] == "unknown"


def test_statistics_of_constants(spark):
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    assert evaluate.kruskal(same, "g", "v").first()["h"] is None
    assert math.isnan(evaluate.least_squares(same, "v", "g")["r2"])
    single = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    assert evaluate.kruskal(single, "g", "v").first()["eta_squared"] is None and math.isnan(evaluate.least_squares(single, "v", "g")["r2"])
    clean = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert evaluate.least_squares(clean, "v", "g")["r2"] == 1.0


def test_matches_in_bins_cost_least(spark):
    rnd = random.Random(3)
    data = [(b, x, 10 + y, float(rnd.randint(0, 9))) for b in range(40) for x in range(rnd.randint(1, 4)) for y in range(rnd.randint(1, 4))]
    got = assign.match_in_bins(spark.createDataFrame(data, "bin int, a int, b int, d double"), ["bin"], "a", "b", "d", 8.0).collect()
    for k in range(40):
        mine, found = [r[1:] for r in data if r[0] == k and r[3] <= 8], [r for r in got if r["bin"] == k]
        best = None
        for n in range(min(len({r[0] for r in mine}), len({r[1] for r in mine})), 0, -1):
            costs = [sum(r[2] for r in some) for some in itertools.combinations(mine, n) if len({r[0] for r in some}) == len({r[1] for r in some}) == n]
            if costs:
                best = n, min(costs)
                break
        assert (len(found), sum(r["d"] for r in found)) == (best or (0, 0))


@pytest.mark.parametrize(("k1", "k2"), [(6, 3), (20, 6), (4, 1)])
def test_sparse_rerank_equals_the_matrices(spark, k1, k2):
    from ethospark.operators import grouping, rerank

    rnd = np.random.default_rng(k1)
    centres = rnd.normal(size=(8, 5))
    points = [(centres[i % 8] + rnd.normal(size=5) * 0.3).tolist() for i in range(130)]
    points[40] = points[41] = points[8]  # equal vectors
    ids = [3 * i for i in range(20)], [2 * i + 1 for i in range(110)]
    q = spark.createDataFrame(list(zip(ids[0], points[:20], strict=True)) + [(999, None)], "query_id long, embedding array<double>")
    g = spark.createDataFrame(list(zip(ids[1], points[20:], strict=True)) + [(998, None)], "gallery_id long, embedding array<double>")
    far = grouping.rerank(np.array(points[:20]), np.array(points[20:]), k1, k2)
    want = {(ids[0][i], r + 1): round(float(far[i, j]), 9) for i in range(20) for r, j in enumerate(np.argsort(far[i].round(12), kind="stable")[:15])}
    got = {(r["query_id"], r["rank"]): round(r["distance"], 9) for r in rerank.rerank(q, g, 15, k1, k2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert rerank.rerank(q.limit(0), g, 3).count() == 0


def test_ols_equals_least_squares_of_the_full_matrix(spark):
    from ethospark.operators import regression

    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), rnd.choice(["x", "y"]), rnd.choice("pqrs"), rnd.gauss(0, 1)) for _ in range(300)]
    rows = [(a, b, c, v + {"a": 0, "b": 1, "c": -2}[a] + (b == "y") * 0.5) for a, b, c, v in rows] + [(None, "x", "p", 1.0), ("a", "x", "p", None), ("a", "x", "p", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, c string, v double").selectExpr("*", "concat(a, '!') AS same")
    known = [r for r in rows if r[0] is not None and r[3] is not None and not math.isnan(r[3])]
    for factors in (["a"], ["a", "b"], ["a", "b", "c"]):
        names = [sorted({r["abc".index(f)] for r in known})[1:] for f in factors]
        x = np.array([[1.0, *[float(r["abc".index(f)] == level) for f, ls in zip(factors, names, strict=True) for level in ls]] for r in known])
        y = np.array([r[3] for r in known])
        beta, left, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        n, left = len(y), float(left[0])
        fit = regression.ols(df, "v", factors)
        total = ((y - y.mean()) ** 2).sum()
        f = (total - left) / (rank - 1) / (left / (n - rank))
        likelihood = -n / 2 * (math.log(2 * math.pi * left / n) + 1)
        want = {"n": n, "rank": rank, "r2": 1 - left / total, "f": f, "aic": 2 * rank - 2 * likelihood, "bic": rank * math.log(n) - 2 * likelihood}
        assert all(math.isclose(fit.stats[k], v, rel_tol=1e-9) for k, v in want.items())
        errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * left / (n - rank))
        assert np.allclose([c[2] for c in fit.coefficients], beta) and np.allclose([c[3] for c in fit.coefficients], errors)
        # p by adding up the density of F.
        d1, d2, grid = rank - 1, n - rank, np.linspace(0, f, 400_001)[1:]
        logs = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2) + (d1 / 2 - 1) * np.log(grid) - (d1 + d2) / 2 * np.log1p(d1 / d2 * grid)
        assert abs((1 - float(np.trapezoid(np.exp(logs), grid))) - fit.stats["p"]) < (0.02 if d1 < 3 else 1e-4)
    aliased = regression.ols(df, "v", ["a", "same"])
    assert aliased.stats["rank"] == 3 and sum(math.isnan(c[2]) for c in aliased.coefficients) == 2
    assert math.isclose(aliased.stats["aic"], regression.ols(df, "v", ["a"]).stats["aic"])
    assert abs(regression.t_tails(2.228, 10) - 0.05) < 1e-4 and abs(regression.f_tail(4.10, 2, 10) - 0.05) < 1e-3 and regression.f_tail(0.0, 2, 10) == 1.0
    fits = regression.compare(df.withColumn("one", F.lit("k")), "v", {"group": ["a"], "flat": ["one"], "all": ["a", "one", "b"]})
    assert set(fits) == {"group", "all"} and fits["all"].stats["rank"] == 4


def test_ols_without_error_or_variation(spark):
    from ethospark.operators import regression

    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 5.0), ("b", 3.0, 5.0), ("b", 3.0, 5.0)], "g string, v double, k double")
    exact = regression.ols(df, "v", ["g"]).stats
    assert (exact["r2"], exact["p"], exact["f"], exact["aic"]) == (1.0, 0.0, math.inf, -math.inf)
    assert math.isnan(regression.ols(df, "k", ["g"]).stats["r2"]) and math.isnan(regression.ols(df.limit(2), "v", ["g"]).stats["f"])
    assert regression.ols(df.limit(0), "v", ["g"]).stats["n"] == 0
    with pytest.raises(ValueError, match="levels"):
        regression.ols(df, "v", ["g"], most=1)


def test_zones_equal_all_tests(spark):
    from ethospark.operators import zones

    rnd = random.Random(12)
    shapes = [(k % 2, k, [rnd.randrange(0, 400) for _ in range(n)], [rnd.randrange(-20, 300) for _ in range(n)], 400, 300) for k, n in enumerate([3, 4, 5, 7, 3, 6])]
    shapes += [(0, 90, [0, 100, 100, 0], [0, 0, 100, 100], 400, 300), (0, 91, [5, 5], [1, 2], 400, 300), (1, 92, [1, None, 3], [1, 2, 3], 400, 300)]
    table = spark.createDataFrame(shapes, "camera int, zone int, px array<int>, py array<int>, of_width int, of_height int")
    rows = [(i, rnd.randrange(3), w, h, rnd.randrange(-9, w + 9), rnd.randrange(-9, h + 9)) for i, (w, h) in enumerate(rnd.choices([(400, 300), (200, 150), (800, 450)], k=1500))]
    rows += [(9000, 0, 400, 300, 100, 100), (9001, 0, 400, 300, 50, 0), (9002, None, 400, 300, 1, 1), (9003, 0, 400, 300, None, 1)]
    frames = spark.createDataFrame(rows, "id int, camera int, width int, height int, x int, y int")

    def within(px, py, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(zip(px, py, strict=True), zip(px[1:] + px[:1], py[1:] + py[:1], strict=True), strict=True):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    want = {}
    for i, camera, w, h, x, y in rows:
        found = [z for c, z, px, py, ow, oh in shapes if c == camera and z < 91 and x is not None and within([int(v * w / ow) for v in px], [int(v * h / oh) for v in py], x, y)]
        want[i] = found
    for cell in (16, 64, 1000):
        got = {r["id"]: r["zones"] for r in zones.in_zones(frames, table, "x", "y", cell).collect()}
        assert got == want
    assert want[9000] and want[9001] and zones.outside(frames, table, "x", "y").count() == sum(not z for z in want.values())
    assert zones.in_zones(frames, table.limit(0), "x", "y").where("size(zones) > 0").count() == 0


def test_time_of_day_equals_a_loop_over_intervals(spark):
    rnd = random.Random(14)
    day = 86_400_000_000
    truths = [(rnd.choice("ab"), rnd.randrange(day), rnd.randrange(day), rnd.choice(["s", "t"]), k) for k in range(25)] + [("a", None, 5, "s", 99), ("a", 5, 5, "point", 98), (None, 1, day - 1, "s", 97), ("b", 0, day - 1, "u", 4)]
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.randrange(-3 * day, 3 * day)) for i in range(600)] + [(900, None, 7), (901, "a", None), (902, "a", 5), (903, "a", day + 5)]
    df = spark.createDataFrame(rows, "id int, animal string, us long")
    t = spark.createDataFrame(truths, "animal string, a long, b long, gt string, seq int")
    got = {r["id"]: r["gt"] for r in joins.at_time_of_day(df, t, ["animal"], "us", "a", "b", "gt", "seq", "standing").collect()}
    want = {}
    for i, animal, us in rows:
        want[i] = "standing"
        for who, a, b, label, seq in sorted((x for x in truths if None not in x), key=lambda x: (x[4], x[3])):
            at = us % day if us is not None else None
            if who == animal and at is not None and (a <= at <= b if a <= b else at >= a or at <= b):
                want[i] = label
    assert got == want and got[902] == got[903] == "point"


@pytest.mark.parametrize("rows_a_batch", [7, 10_000])
def test_outliers_equal_the_loop(spark, rows_a_batch):
    rnd = random.Random(rows_a_batch)
    blocks = {f"b{n}": n for n in (1, 20, 21, 22, 60, 133)}
    rows, want = [], {}
    for key, n in blocks.items():
        labels, base = [], "x"
        for _ in range(n):
            base = rnd.choice("xyz") if rnd.random() < 0.1 else base
            labels.append(rnd.choice(["x", "y", "z", None]) if rnd.random() < 0.3 else base)
        sure = [rnd.choice([None, 0.2, 0.5, 0.69, 0.7, 0.98, 1.0]) for _ in range(n)]
        rows += [(key, i, labels[i], sure[i], f"{key}{i}") for i in range(n)]
        new = list(labels)
        if n >= 21:
            for i in range(n):
                if sure[i] is None or sure[i] >= 0.99 or new[i] is None:
                    continue
                around = [x for x in new[max(0, i - 10) : i] + new[i + 1 : i + 11] if x is not None]
                most = min(set(around), key=lambda x: (-around.count(x), x), default=None)
                if most is not None and around.count(new[i]) / len(around) < 0.3 and around.count(most) >= 2 and new[i] != most and sure[i] < 0.7:
                    new[i] = most
        want |= {(key, i): new[i] for i in range(n)}
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = smooth.outliers(spark.createDataFrame(rows, "block string, i int, label string, sure double, extra string"), ["block"], ["i"], "label", "sure").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["block"], r["i"]): r["smoothed"] for r in got} == want and len(got) == len(rows)
    assert all(r["extra"] == f"{r['block']}{r['i']}" for r in got)
    assert sum(want[k, i] != x for k, i, x, _, _ in rows) > 5


def test_samples_are_the_rows_of_least_draws(spark, monkeypatch):
    import hashlib

    from ethospark.operators import sampling

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]) if i % 3 else "a", i, f"v{i}") for i in range(900)] + [("tiny", 5000, "v"), ("c", None, "w")]
    df = spark.createDataFrame(rows, "k string, id int, v string").selectExpr("*", "id AS _count")
    drawn = lambda i: hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    by = lambda key: sorted((drawn(i), i) for k, i, _ in rows if k == key)

    def check(got, n):
        for key in {k for k, _, _ in rows}:
            assert sorted(r["id"] or -1 for r in got if r["k"] == key) == sorted(i or -1 for _, i in by(key)[: n(len(by(key)))])

    for frame in (df, df.repartition(7), df.coalesce(1).orderBy(F.desc("id"))):
        check(sampling.sample(frame, ["k"], ["id"], k=25, seed=7).collect(), lambda n: 25)
    check(sampling.sample(df, ["k"], ["id"], share=0.1, seed=7).collect(), lambda n: int(0.1 * n))
    every = sorted((drawn(i), i) for _, i, _ in rows if i is not None)
    assert {r["id"] for r in sampling.sample(df.where("id is not null"), [], ["id"], k=12, seed=7).collect()} == {i for _, i in every[:12]}
    monkeypatch.setattr(sampling, "_room", lambda k: k * 0.2)  # bad luck for every key
    check(sampling.sample(df, ["k"], ["id"], k=25, seed=7).collect(), lambda n: 25)
    assert sampling.sample(df.limit(0), ["k"], ["id"], k=3).count() == 0


def test_occupancy_votes_equal_two_passes(spark):
    rnd = random.Random(21)
    rows = [(rnd.choice("rs"), rnd.choice("abc"), rnd.randrange(40), rnd.choice(["p", "q", "z", None]), rnd.choice([0.5, 0.7, 0.8, 0.9, 1.0]), rnd.random() < 0.8) for _ in range(300)] + [("solo", "a", 1, "p", 0.9, True), ("solo", "a", 2, "q", 0.9, True), ("solo", "b", 9, "z", 0.5, True)]
    df = spark.createDataFrame(rows, "room string, track string, us int, label string, conf double, good boolean")
    votes = F.col("good") & (F.col("conf") >= 0.9)
    got = {(r["room"], r["track"]): (r["label"], r["present"]) for r in transfer.occupancy_votes(df, ["room"], "track", "us", "label", F.col("good") & (F.col("conf") >= 0.7), votes, ["z"], ["p", "q"]).collect()}
    counts: dict = {}
    for room, track, us in {(r[0], r[1], r[2]) for r in rows if r[5] and r[4] >= 0.7}:
        counts[room, us] = counts.get((room, us), 0) + 1
    want = {}
    for room, track in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == (room, track) and r[5] and r[4] >= 0.9]
        voted = [r[3] for r in mine if r[3] is not None]
        if not voted:
            continue
        present = max(counts.get((room, r[2]), 1) for r in mine)
        able = [x for x in voted if x in (["z"] if present <= 1 else ["p", "q"])] or voted
        want[room, track] = min(set(able), key=lambda x: (-able.count(x), x)), present
    assert got == want and got["solo", "a"] == ("p", 1)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_ROWS", 5)
    monkeypatch.setattr(graph, "HUB_SHARE", 4)
    rnd = random.Random(2)
    edges = [(500, i) for i in range(0, 60)] + [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(25)] + [(7, 7), (900, 901)]
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_labels_of_identities(spark):
    rnd = random.Random(31)
    rows = [(room, i, x, rnd.choice([0, 1, 2, 5])) for room in range(40) for i in range(rnd.choice([1, 2, 2, 3])) for x in ("b", "a", "other")] + [(99, 0, "a", 8), (99, 0, "b", 7), (99, 1, "a", 10)]
    df = spark.createDataFrame(rows, "room int, id int, label string, n int")
    for known in (["b", "a"], ["b", "a", "other"], ["a"]):
        got = {(r["room"], r["id"]): (r["label"], round(r["score"], 9)) for r in assign.assign_labels(df, ["room"], "id", "label", "n", known).collect()}
        for room in {r[0] for r in rows}:
            ids = sorted({r[1] for r in rows if r[0] == room})
            share = {}
            for i in ids:
                mine = {r[2]: r[3] for r in rows if r[:2] == (room, i)}
                total = sum(mine.values())
                share[i] = {x: mine.get(x, 0) / total if total else 0.0 for x in known}
            if len(known) == len(ids) == 2:
                best = max(itertools.permutations(known), key=lambda p: (round(share[ids[0]][p[0]] + share[ids[1]][p[1]], 9), [-ord(c) for c in p[0]]))
                want = dict(zip(ids, best, strict=True))
            else:
                want = {i: max(known, key=lambda x: share[i][x]) for i in ids}
            assert {i: got[room, i] for i in ids} == {i: (x, round(share[i][x], 9)) for i, x in want.items()}
    assert got


def test_constrained_groups_equal_sets_of_tracks(spark):
    from ethospark.operators import grouping

    rnd = random.Random(41)
    for _ in range(6):
        rows = [("n", f"t{i:02d}", rnd.choice("ab"), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, 0, 1, 2]), a := rnd.randrange(100), a + rnd.randrange(1, 25)) for i in range(22)]
        df = spark.createDataFrame(rows, "night string, track string, camera string, stitched_id int, cross_id int, start_us int, end_us int")
        got = {r["track"]: r["group_id"] for r in grouping.constrained_groups(df, ["night"], "track").collect()}
        by = {r[1]: r for r in rows}
        sets = [{t} for t in sorted(by)]
        home = lambda t, s: next(x for x in s if t in x)

        def join(t, u, sets):
            a, b = home(t, sets), home(u, sets)
            if a is not b:
                sets.remove(b)
                a |= b

        for camera, stitched in {(r[2], r[3]) for r in rows if r[3] is not None}:
            own = sorted(t for t, r in by.items() if (r[2], r[3]) == (camera, stitched))
            for t in own[1:]:
                join(own[0], t, sets)
        for cross in sorted({r[4] for r in rows if r[4] is not None}):
            own = sorted(t for t, r in by.items() if r[4] == cross)
            for t in own[1:]:
                a, b = home(own[0], sets), home(t, sets)
                if a is not b and not any(by[x][2] == by[y][2] and by[x][5] < by[y][6] and by[y][5] < by[x][6] for x in a for y in b):
                    join(own[0], t, sets)
        want = {t: n for n, s in enumerate(sorted(sets, key=min)) for t in s}
        assert got == want


def test_keyframes_equal_the_loop(spark):
    from ethospark.operators import grouping

    rnd = np.random.default_rng(17)
    centres = rnd.normal(size=(12, 5))
    rows = [("ab"[i % 2], i, (centres[rnd.integers(12)] + rnd.normal(size=5) * 0.4).tolist()) for i in range(160)]
    got = {(r["track"], r["i"]) for r in grouping.keyframes(spark.createDataFrame(rows, "track string, i int, v array<double>"), ["track"], "i", "v", size=4, alike=0.85).collect()}
    want = set()
    for key in "ab":
        held: list = []
        for _, i, v in (r for r in rows if r[0] == key):
            v = np.array(v) / np.linalg.norm(v)
            near = max((float(u @ v) for _, u in held), default=-1)
            if near > 0.85:
                continue
            if len(held) < 4:
                held.append((i, v))
                continue
            alike = [max(float(u @ w) for m, (_, w) in enumerate(held) if m != n) for n, (_, u) in enumerate(held)]
            if near < max(alike):
                held[alike.index(max(alike))] = (i, v)
        want |= {(key, i) for i, _ in held}
    assert got == want


def test_overlap_totals_make_no_pairs_of_intervals(spark, monkeypatch):
    """Totals of pairs of tracks over many blocks are those of all pairs of intervals."""
    monkeypatch.setattr(joins, "BLOCK_TRACKS", 4)
    rnd = random.Random(5)
    data = [(k % 2, k, s := rnd.randrange(3000), s + rnd.randrange(-2, 60)) for k in range(25) for _ in range(12)] + [(0, None, 1, 9), (None, 3, 1, 9), (1, 1, None, 5)]
    got = {(r["room"], r["t"], r["other"]): r["overlap_us"] for r in joins.overlap_totals(spark.createDataFrame(data, "room int, t int, a long, b long"), ["room"], "t", "a", "b").collect()}
    want: dict = {}
    known = [r for r in data if None not in r and r[2] < r[3]]
    for room, x, a, b in known:
        for other, y, c, d in known:
            if room == other and x < y and (over := min(b, d) - max(a, c)) > 0:
                want[room, x, y] = want.get((room, x, y), 0) + over
    assert got == want


def test_overlap_distances_in_blocks(spark, monkeypatch):
    """Tracks in many blocks have the bins and medians of all pairs of positions."""
    monkeypatch.setattr(joins, "BLOCK_TRACKS", 3)
    rnd = random.Random(6)
    make = lambda n: [(k % 2, k, t, float(rnd.randrange(9)), float(rnd.randrange(9))) for k in range(n) for t in rnd.sample(range(8), 6)]
    ones, twos = make(14) + [(0, 90, None, 1.0, 1.0), (0, 91, 2, None, 1.0), (5, 92, 1, 1.0, 1.0)], make(11)
    frame = lambda data, name: spark.createDataFrame(data, f"room int, {name} int, bin int, x double, y double")
    got = {(r["a"], r["b"]): (r["bins"], r["distance"]) for r in transfer.overlap_distances(frame(ones, "a"), frame(twos, "b"), ["room"], "bin", "x", "y", "a", "b", 5.0, 3).collect()}
    far: dict = {}
    for room, a, t, x, y in ones:
        for other, b, u, v, w in twos:
            if room == other and t == u and x is not None and math.hypot(x - v, y - w) <= 5:
                far.setdefault((a, b), []).append(math.hypot(x - v, y - w))
    assert got == {k: (len(d), pytest.approx(float(np.median(d))) if len(d) >= 3 else None) for k, d in far.items()}


def test_nearest_in_bins_makes_no_pairs(spark):
    """The nearest detections are those of all pairs, ties by identity, and the plan joins no detections with each other."""
    rnd = random.Random(8)
    make = lambda n: [(k % 2, k, rnd.randrange(100), float(rnd.randrange(12)), float(rnd.randrange(12)), rnd.choice("abc")) for k in range(n)]
    ones, twos = make(40) + [(0, 90, 5, None, 1.0, "a"), (0, 91, None, 1.0, 1.0, "a"), (7, 92, 5, 1.0, 1.0, "a")], make(60) + [(0, 93, 5, None, 1.0, "a")]
    frame = lambda data: spark.createDataFrame(data, "room int, frame int, us long, x double, y double, name string")
    out = transfer.nearest_in_bins(frame(ones).drop("name"), frame(twos), ["room"], "us", "x", "y", "name", 10, 1, 4.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {r["frame"]: (r["match_distance"], r["matched_identity"]) for r in out.collect()}
    for room, k, us, x, y, _ in ones:
        far = [] if us is None or x is None else [(math.hypot(x - v, y - w), n) for r, _, t, v, w, n in twos if r == room and abs(t // 10 - us // 10) <= 1 and v is not None]
        assert got[k] == min((p for p in far if p[0] <= 4), default=(None, None))


def test_resolving_many_tracks_at_once():
    """Thousands of tracks that all overlap, whose labels are held by one each: the whole list isn't searched for every loser."""
    n = 4000
    data = [(k, 10**9 + k, "ab"[k % 2], "ab"[k % 2], float(k), ["a", "b", "c"]) for k in range(n)]
    frame = pd.DataFrame(data, columns=["start_us", "end_us", "label", "original", "quality", "ranked"])
    ends = transfer._LatestEnds.latest
    calls = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(transfer._LatestEnds, "latest", lambda self, low, high: calls.append(1) or ends(self, low, high))
        got = transfer.resolve_group(frame, 1, 2)
    assert sorted(set(got)) == ["a", "b", "c", "unknown"] and got.count("a") == got.count("b") == 1
    assert len(calls) < 40 * n


def test_all_ranks_come_in_bounded_blocks(spark, monkeypatch):
    """With every rank asked for, a pair of blocks still gives a bounded number of rows, and all ranks are there."""
    monkeypatch.setattr(vectors, "FOUND", 60)
    rnd = np.random.default_rng(4)
    data = [(i, rnd.normal(size=3).tolist()) for i in range(30)]
    df = spark.createDataFrame(data, "gallery_id long, embedding array<double>")
    out = vectors.top_k(df.withColumnRenamed("gallery_id", "query_id"), df, 2**31 - 1)
    assert "sequence(0, 14" in out._jdf.queryExecution().analyzed().toString()  # 15 blocks of two queries
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["gallery_id"] for r in out.collect()}
    near = m @ m.T
    assert got == {(q, k + 1): g for q in range(30) for k, g in enumerate(sorted((x for x in range(30) if x != q), key=lambda x: -near[q, x]))}


def test_losers_are_found_without_pairs(spark):
    """The labels are those that the pairs of conflicting subjects give, and frames aren't joined with each other."""
    rnd = random.Random(12)
    data = [(k % 2, rnd.randrange(12), rnd.randrange(6000), rnd.choice(["x", "y", "error"])) for k in range(300)] + [(0, None, 5, "x"), (None, 3, 5, "x"), (1, 3, None, "x"), (1, 3, 9, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(data)], "id int, room int, s int, us long, label string")
    met = transfer.label_conflicts(df, ["room"], "us", "label", "s", 7, "error")
    want = rows(transfer.lose_conflicts(df, met, ["room"], "label", "s"), "id", "label")
    out = transfer.lose_meetings(df, ["room"], "us", "label", "s", 7, "error")
    assert rows(out, "id", "label") == want and len({x for _, x in want}) == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_meetings_of_labels_are_marked_in_blocks(spark, monkeypatch):
    """The pairs are those of the rule for any size of blocks; no pair of frames is joined or shuffled to become distinct."""
    rnd = random.Random(31)
    for kind in ("int", "string"):
        data = [(k % 2, s if kind == "int" else f"s{s:02d}", rnd.randrange(-1500, 1500), rnd.choice(["x", "y", "error"])) for k in range(400) for s in [rnd.randrange(25)]]
        data += [(None, data[0][1], 5, "x"), (1, None, 5, "x"), (1, data[0][1], None, "x"), (1, data[0][1], 9, None)]
        df = spark.createDataFrame(data, f"room int, s {kind}, us long, label string")
        good = [r for r in data if None not in r and r[3] != "error"]
        want = sorted({(r, n, a, b) for r, a, s, n in good for q, b, t, m in good if (r, n) == (q, m) and a < b and abs(s - t) <= 7})
        for size in (4096, 6, 1):
            monkeypatch.setattr(transfer, "SUBJECTS", size)
            met = transfer.label_conflicts(df, ["room"], "us", "label", "s", 7, "error")
            assert rows(met, "room", "label", "a", "b") == want and len(want) > 20
            plan = met._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join") == 1 and plan.index("FlatMapGroupsInPandas") < plan.index("Aggregate")
    at, who = np.array([0, 5, 9, 30]), np.array([3, 1, 3, 2])
    for most in (1, 2, 100):
        assert sorted((int(x), int(y)) for a, b in transfer._met((at, who), (at, who), 5, most) for x, y in zip(a, b, strict=True)) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]


def test_window_manifests_equal_the_join_of_pairs(spark):
    rnd = random.Random(21)
    hour = 3_600_000_000
    videos = [(rnd.randrange(2), rnd.choice([f"v{k}", f"v{k % 7}", None] if k % 9 == 0 else [f"v{k}"]), s := rnd.randrange(-30, 90) * hour // 3, s + rnd.choice([0, 1, hour, 2 * hour, 40 * hour])) for k in range(300)]
    windows = [(rnd.randrange(3), 10**6 + (k if k % 5 else k % 2), s := rnd.randrange(-30, 90) * hour // 3 + rnd.randrange(3), s + rnd.choice([0, 1, hour // 2, hour, 7 * hour, 2 * hour + 1])) for k in range(120)]
    v = spark.createDataFrame(videos, "camera int, path string, start_us long, end_us long")
    w = spark.createDataFrame(windows, "camera int, event long, from_us long, to_us long")
    want = {r["event"]: (r["n_videos"], r["videos"]) for r in archive.manifest(archive.overlapping_videos(v.where("start_us < end_us"), w.where("from_us < to_us"), ["camera"]), ["event"], "path").collect()}
    for at_once in (1, 50, 500_000):
        archive.AT_ONCE = at_once
        rows = archive.window_manifests(v, w, ["camera"], "event", "path").collect()
        assert len(rows) == len(want) > 50 and {r["event"]: (r["n_videos"], r["videos"]) for r in rows} == want
    assert archive.window_manifests(v.limit(0), w, ["camera"], "event", "path").count() == 0


def test_a_position_in_zones_is_tested_once(spark):
    from ethospark.operators import zones

    table = spark.createDataFrame([(0, 7, [0, 100, 100, 0], [0, 0, 100, 100], 400, 300)], "camera int, zone int, px array<int>, py array<int>, of_width int, of_height int")
    frames = spark.range(500).selectExpr("id", "0 camera", "400 width", "300 height", "int(id % 2 * 200) x", "5 y")
    found = zones.in_zones(frames, table, "x", "y")
    assert re.search(r"Deduplicate \[[^\]]*x#\d+", found._jdf.queryExecution().analyzed().toString())
    assert {(r["x"], tuple(r["zones"])) for r in found.collect()} == {(0, (7,)), (200, ())} and found.count() == 500


def test_matches_on_a_line_cost_as_little_as_any(spark):
    rnd = random.Random(22)
    rows = [(k, s, 100 * s + t, rnd.choice([rnd.random() * 60, float(rnd.randrange(40))])) for k in range(60) for s in (0, 1) for t in range(rnd.randrange(9))]
    rows += [(70, 0, 1, None), (70, 1, 101, 3.0), (71, 0, 1, float("nan")), (71, 1, 101, 3.0), (72, 0, 5, 10.0), (72, 1, 105, 18.0), (73, 0, 5, 10.0), (73, 1, 105, 18.5)]
    placed = spark.createDataFrame(rows, "bin int, side int, track int, x double")
    pairs = placed.where("side = 0").selectExpr("bin", "track a", "x xa").join(placed.where("side = 1").selectExpr("bin", "track b", "x xb"), "bin").selectExpr("bin", "a", "b", "abs(xa - xb) d")
    got = assign.match_on_line(placed, ["bin"], "side", "track", "x", "a", "b", "d", 8.0).collect()
    total = lambda found: {k: (len(own := [r["d"] for r in found if r["bin"] == k]), round(sum(own), 6)) for k in range(80)}
    assert total(got) == total(assign.match_in_bins(pairs.where("d is not null and not isnan(d)"), ["bin"], "a", "b", "d", 8.0).collect())
    where = {(r[0], r[2]): r[3] for r in rows}
    assert all(abs(where[r["bin"], r["a"]] - where[r["bin"], r["b"]]) == r["d"] <= 8 for r in got)
    assert len({(r["bin"], r["a"]) for r in got}) == len({(r["bin"], r["b"]) for r in got}) == len(got) > 60


def test_equal_neighbours_come_in_order_of_name(spark):
    chain = [(1, k, 0, 10) for k in range(6)] + [(1, 9, 5, 20)]
    want = [(k, 10) for k in (1, 2, 3, 4, 5, 9)]
    for order in (chain, chain[::-1], chain[3:] + chain[:3]):
        assert rows(islands.overlapping_neighbours(spark.createDataFrame(order, "k int, name int, a int, b int"), ["k"], "a", "b", "name"), "name", "previous_end") == want


def test_large_rooms_are_grouped_without_a_look_at_every_track_for_each(spark):
    import time

    from ethospark.operators import grouping

    tracks = spark.range(20000).selectExpr("1 room", "id track", "int(id % 2) camera", "int(id % 3) stitched_id", "int(id % 9) cross_id", "id * 7919 % 100000 start_us", "id * 7919 % 100000 + 40 end_us")
    began = time.time()
    got = grouping.constrained_groups(tracks, ["room"], "track").collect()
    assert len(got) == 20000 and len({r["group_id"] for r in got}) == 3 and time.time() - began < 20


def test_identity_switches_are_counted_by_running_sums(spark):
    rnd = random.Random(23)
    data = [(k, rnd.choice([None, 0, 1]), rnd.choice([None, *[rnd.randrange(-900, 900) for _ in range(9)]]), rnd.choice([0, 1, 2, None])) for k in range(700)]
    found = smooth.fix_identity_switches(spark.createDataFrame(data, "id int, c int, us long, i int"), ["c"], "us", "i", [0, 1, 2], 7)
    assert "RangeFrame" not in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        beside = [d for d in data if d[1] == r["c"] and (d[2] == r["us"] if None in (d[2], r["us"]) else abs(d[2] - r["us"]) <= 7)]
        n = [sum(d[3] == x for d in beside) for x in (0, 1, 2)]
        own, others = (0 if r["i"] is None else n[r["i"]]), [0 if x == r["i"] else n[x] for x in (0, 1, 2)]
        alone = sum(d[1] == r["c"] and d[2] == r["us"] for d in data) == 1
        assert r["fixed"] == (others.index(max(others)) if alone and max(others) > own else r["i"])
    assert found.count() == 700


def test_companions_shuffle_no_lists(spark):
    from ethospark.operators import datasets

    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "a"), (1, 1, None), (1, None, "c"), (1, None, "d"), (2, 1, "e")], "night int, room int, s string")
    out = datasets.companions(df, ["night", "room"], "s", F.lit("alone"))
    want = [(1, None, "c", "alone"), (1, None, "d", "alone"), (1, 1, None, "alone"), (1, 1, "a", "b"), (1, 1, "b", "a"), (2, 1, "e", "alone")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_chain_conflicts_equal_sql_on_repeated_orders_and_missing_dates(spark, tmp_path):
    import datetime

    import duckdb

    from ethospark.plans.registry import ORACLES, QUERIES

    day = lambda n: None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    # An order twice, one without a date before others, two of one date of which one has no item that was shipped.
    orders = [(1, 1, 0), (1, 1, 0), (2, 1, 5), (3, 1, None), (4, 1, 8), (5, 1, 8), (6, 2, None), (7, 2, 3), (8, None, 1), (9, None, 2)]
    items = [(1, 6), (2, 9), (2, 20), (3, 30), (4, None), (5, 12), (6, 50), (7, 4), (8, 9), (9, 9)]
    spark.createDataFrame([(k, c, day(d)) for k, c, d in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, day(d)) for k, d in items], "l_orderkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["chain_conflicts"]).fetchall(), key=str)
    assert len(want) == 4
    assert sorted(map(tuple, QUERIES["chain_conflicts"](spark, str(tmp_path)).collect()), key=str) == want


def test_full_retrieval_equals_sql_without_a_row_for_each_pair(spark, tmp_path, monkeypatch):
    import duckdb

    from ethospark.plans import metrics, sequences
    from ethospark.plans.registry import ORACLES

    rng = np.random.default_rng(8)
    made = [(k, rng.normal(size=4).round(3).tolist(), ["a", "b", "c", None][int(rng.integers(4))]) for k in range(420)]
    for k in (0, 7, 55, 100, 300):  # no vector, one of zeros, no query's label among others
        made[k] = (k, None, made[k][2] or "a")
    for k in (50, 200, 201):
        made[k] = (k, [0.0] * 4, "b")
    made[150] = (150, made[150][1], "alone")
    made += [(k + 420, made[k][1], ["a", "b", "c"][k % 3]) for k in range(0, 400, 3)]  # equal vectors of several labels
    table = [(k, v, x) for k, v, x in made if k != 250]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for sizes in ((1024, 16_000_000, 8192), (3, 900, 64)):
        for name, size in zip(("QUERIES", "HELD", "BLOCK"), sizes, strict=True):
            monkeypatch.setattr(vectors, name, size)
        for module, name in ((metrics, "cmc_map"), (sequences, "per_class_retrieval")):
            found = getattr(module, name)(spark, str(tmp_path))
            assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()  # was a row for each pair of a query and a gallery row
            want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
            text_ = lambda r: tuple(None if v is None else v if isinstance(v, str) else round(float(v), 5) for v in r)
            assert sorted(map(text_, map(tuple, found.collect())), key=str) == sorted(map(text_, want), key=str)


def test_overlap_totals_shuffle_a_row_a_block_and_hold_parts_of_tracks(spark, monkeypatch):
    """Totals are exact where a track's intervals lie over each other, begin and end at once and are long; 3,000 tracks of a room are one block."""
    rnd = random.Random(9)
    for far, parts in ((40, 2), (10**13, 3), (10**15, 1024)):
        monkeypatch.setattr(joins, "TRACKS_AT_ONCE", parts)
        sides = [[(i, s := rnd.randrange(far), s + rnd.randrange(1, far // 2)) for i in range(k, k + 7) for _ in range(rnd.randrange(1, 25))] for k in (0, 7)]
        for right in (sides[1], None):
            want: dict = {}
            for i, a, b in sides[0]:
                for j, c, d in right or sides[0]:
                    if (right or i < j) and (over := min(b, d) - max(a, c)) > 0:
                        want[i, j] = want.get((i, j), 0) + over
            left, other = (tuple(np.array(c) for c in zip(*side, strict=True)) if side else None for side in (sides[0], right))
            got = {(i, j): n for part in joins._overlapping(left, other) for i, j, n in zip(*(c.tolist() for c in part), strict=True)}
            assert got == want
    wide = spark.range(3000).select(F.lit(1).alias("room"), F.col("id").alias("t"))
    assert joins.blocks_of(wide, ["room"], "t", "n").first()["n"] == 1  # was 3, and so many rows were shuffled for one


def test_near_in_bins_by_table_and_by_list(spark, monkeypatch):
    """Both ways give the bins and medians of all pairs; the table is taken where tracks have one position a bin, and a block's pairs leave it in parts."""
    rnd = random.Random(10)
    lists = transfer._near_in_lists
    taken = []
    monkeypatch.setattr(transfer, "_near_in_lists", lambda *a: taken.append(1) or lists(*a))
    for once in (True, False):
        make = lambda n: [(k, t, float(rnd.randrange(9)), float(rnd.randrange(9))) for k in range(n) for t in (rnd.sample(range(9), 6) if once else rnd.choices(range(9), k=6))]  # noqa: B023, E731
        ones, twos = make(23), make(17)
        far: dict = {}
        for i, t, x, y in ones:
            for j, u, v, w in twos:
                if t == u and math.hypot(x - v, y - w) <= 5:
                    far.setdefault((i, j), []).append(math.hypot(x - v, y - w))
        sides = [c for side in (ones, twos) for c in (np.array([r[0] for r in side]), np.array([r[1] for r in side]), np.array([r[2:] for r in side]))]
        for most, tracks in ((2_000_000, 1024), (100, 5)):
            parts = list(transfer._near_in_bins(*sides, 5.0, most, tracks))
            got = {(p, q): (n, d) for part in parts for p, q, n, d in zip(*(c.tolist() for c in part), strict=True)}
            assert got == {k: (len(d), pytest.approx(float(np.median(d)))) for k, d in far.items()} and sum(len(p[0]) for p in parts) == len(far)
            assert len(parts) > 1 or most > 100
        assert bool(taken) != once
    at = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 1, 3.0, 4.0)], "t string, bin int, x double, y double").withColumn("room", F.lit(1))
    other = at.select("room", "bin", "x", "y", F.length("t").cast("long").alias("u"))  # a track of another kind, twice in a bin
    assert rows(transfer.overlap_distances(at, other, ["room"], "bin", "x", "y", "t", "u", 4.0, 1), "t", "u", "bins", "distance") == [("a", 1, 1, 0.0), ("b", 1, 1, 0.0)]


def test_nearest_works_distances_out_once_and_exactly(spark, monkeypatch):
    """Equal vectors, close ones and great lengths: the nearest and the farthest are those of all pairs, and the plan has the blocks' pairs once."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(11)
    for scale in (1.0, 1e18):
        v = rng.normal(size=(150, 6)) + 100  # far from zero, so that the rounded product is rough
        v[50:75] = v[:25]
        v[75:100] = v[:25] + 1e-7
        v *= scale
        ids = [int(k) for k in rng.permutation(150)]
        df = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, v, strict=True)], "i long, v array<double>")
        out = vectors.nearest(df, df.withColumnRenamed("i", "j"), 4)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1  # was 2
        got = {(r["i"], r["r"]): (r["j"], r["d2"]) for r in out.collect()}
        assert len(got) == 150 * 5
        far = ((v[:, None] - v[None]) ** 2).sum(axis=2)
        for n, i in enumerate(ids):
            for r, at in enumerate(np.lexsort((ids, far[n]))[:4]):
                assert got[i, r] == (ids[at], pytest.approx(far[n][at], rel=1e-12))
            assert got[i, None] == (None, pytest.approx(far[n].max(), rel=1e-12))
