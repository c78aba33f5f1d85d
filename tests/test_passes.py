"""Smoothing in passes and grouping of tracks."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ethospark.operators import grouping, passes


def labels(df, order="us"):
    return [r["label"] for r in df.orderBy(order).collect()]


def frame(spark, text):
    return spark.createDataFrame([(1, n * 10, x) for n, x in enumerate(text)], "k int, us long, label string")


def test_majority_settles_like_a_loop(spark):
    rnd = random.Random(3)
    text = [rnd.choice("aab!") for _ in range(120)]
    want = list(text)
    for _ in range(10):
        new = list(want)
        for i in range(len(want)):
            seen = [x for x in want[max(0, i - 3) : i + 4] if x != "!"]
            if seen:
                new[i] = max(dict.fromkeys(seen), key=seen.count)
        if new == want:
            break
        want = new
    assert labels(passes.majority(frame(spark, text), ["k"], "us", ["us"], "label", ["a", "b"], 30)) == want


def test_bouts_merge_repeatedly(spark):
    assert "".join(labels(passes.merge_bouts(frame(spark, "aaaabaaaccccbbcccc"), ["k"], "us", ["us"], "label", 15, "!"))) == "aaaaaaaacccccccccc"
    assert "".join(labels(passes.merge_bouts(frame(spark, "!!b!!"), ["k"], "us", ["us"], "label", 15, "!"))) == "!!b!!"


def test_dominant_context(spark):
    df = spark.createDataFrame([(1, n * 1_000_000, x) for n, x in enumerate("aaaaaaaabaaaaaaa")], "k int, us long, label string")
    assert set(labels(passes.dominant_context(df, ["k"], "us", ["us"], "label", 3_000_000, 20_000_000, "!"))) == {"a"}
    even = spark.createDataFrame([(1, n * 1_000_000, x) for n, x in enumerate("aaaaaabcccccc")], "k int, us long, label string")
    assert "".join(labels(passes.dominant_context(even, ["k"], "us", ["us"], "label", 3_000_000, 20_000_000, "!"))) == "aaaaaabcccccc"


def test_sleep_needs_sleep_around(spark):
    df = frame(spark, "wwwwwswwwwwssssssss").withColumn("block", F.lit(1))
    assert "".join(labels(passes.check_sleep(df, ["k"], "us", ["us"], "label", "block", ["s"], 30, "!"))) == "wwwwwwwwwwwssssssss"


def test_bout_conflicts(spark):
    data = [(1, 0, 100, "sleep_left"), (1, 110, 120, "sleep_right"), (1, 130, 300, "sleep_left"), (1, 400, 410, "sleep_right"), (1, 900, 999, "sleep_left")]
    df = spark.createDataFrame(data, "k int, us long, e long, label string")
    assert labels(passes.resolve_bouts(df, ["k"], "us", "e", "label", "sleep", 100, "!")) == ["sleep_left"] * 3 + ["sleep_right", "sleep_left"]


def test_groups_and_individuals(spark):
    data = [("a1", 1, 0, 7, 0, 10), ("a2", 1, 0, None, 20, 30), ("a3", 1, 1, 8, 5, 9), ("b1", 2, 0, 7, 0, 12), ("b2", 2, 1, 8, 4, 9), ("b3", 2, 2, 7, 5, 8)]
    df = spark.createDataFrame([("r", *x) for x in data], "room string, track string, camera int, stitched_id int, cross_id int, start_us long, end_us long")
    groups = grouping.constrained_groups(df, ["room"], "track")
    got = {r["track"]: r["group_id"] for r in groups.collect()}
    assert got == {"a1": 0, "a2": 0, "b1": 0, "a3": 1, "b2": 1, "b3": 2}
    who = {r["track"]: r["individual"] for r in grouping.individuals(df.join(groups, ["room", "track"]), ["room"], "track").collect()}
    assert who["a1"] == who["a2"] == who["b1"] != who["a3"] == who["b2"]


def test_rerank_and_keyframes(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(3, 6)) * 3
    gallery = np.concatenate([c + rnd.normal(scale=0.3, size=(10, 6)) for c in centre])
    found = grouping.rerank(centre, gallery, 6, 3)
    assert (found.argmin(axis=1) // 10 == np.arange(3)).all() and found.shape == (3, 30)
    df = spark.createDataFrame([(1, i, [float(x) for x in np.eye(4)[i % 4]]) for i in range(20)], "k int, n int, v array<double>")
    assert sorted(r["n"] for r in grouping.keyframes(df, ["k"], "n", "v").collect()) == [0, 1, 2, 3]
