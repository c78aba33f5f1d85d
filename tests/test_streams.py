"""Stateful stream operators against plain loops, with rows out of order, and their state against the watermark."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest

from ethospark.operators import islands
from ethospark.streaming import live, rollup, stateful

S = 1_000_000
T0 = 1_700_000_000 * S


def feed(spark, path, schema, batches):
    """Writes each batch as a file of its own, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return live.detections(spark, path, schema, 1)


def to_the_end(spark, tmp_path, schema, batches, run):
    path = str(tmp_path / "in")
    stream = feed(spark, path, schema, batches)
    live.drain(run(stream), str(tmp_path / "out"), "append")
    live.end_mark(spark.createDataFrame([], schema), path, "us")
    return live.drain(run(stream), str(tmp_path / "out"), "append", numbered=True)


def shuffled(rnd, rows, near, size):
    """Rows in an order in which none is overtaken by one more than ``near`` later, cut into batches."""
    rows = sorted(rows, key=lambda r: r[1] + rnd.randrange(near))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_tracks_open_extend_and_close(spark, tmp_path):
    rnd = random.Random(1)
    rows, t = [], T0
    for i in range(240):
        t += rnd.choice([1, 2, 5, 40]) * S
        rows.append((rnd.choice("abc"), t + i, False, None))
    batches = shuffled(rnd, rows, 20 * S, 80)
    end = max(r[1] for r in rows)
    batches[-1] += [("a", end + 5 * S, True, "Ann"), ("late", end, True, "Bo")]
    run = lambda s: stateful.tracks(stateful.with_time(s, late="30 seconds"), ["track"], 60 * S)
    log = to_the_end(spark, tmp_path, "track string, us long, closes boolean, identity string", batches, run)
    want = []
    for key in "abc":
        cur = None
        for us in sorted(r[1] for r in rows if r[0] == key):
            if cur and us < cur[1] + 60 * S:
                cur = [cur[0], us, cur[2] + 1]
                want[-1] = (key, *cur)
            else:
                cur = [us, us, 1]
                want.append((key, *cur))
    closed = stateful.closed_tracks(log).collect()
    assert sorted((r["track"], r["opened_us"], r["last_us"], r["n"]) for r in closed) == sorted(want)
    last = max(w[2] for w in want if w[0] == "a")
    by_event = [(r["track"], r["last_us"], r["end_us"], r["identity"]) for r in closed if r["event"] == "close"]
    assert by_event == ([("a", last, end + 5 * S, "Ann")] if end + 5 * S < last + 60 * S else [])
    assert [r["identity"] for r in log.where("event = 'late_close' and track = 'late'").collect()] == ["Bo"]
    assert all(r["end_us"] == r["last_us"] for r in closed if r["event"] == "timeout")
    opened = {(r["track"], r["opened_us"]) for r in log.where("event in ('open', 'extend')").collect()}
    assert {(r["track"], r["opened_us"]) for r in closed if r["event"] == "timeout"} <= opened


def test_state_is_given_up(spark, tmp_path):
    """Keys that come once don't stay: the number of rows in state follows the last hour, not the stream."""
    path, schema = str(tmp_path / "in"), "track long, us long, closes boolean, identity string"
    stream = feed(spark, path, schema, [[(100 * b + i, T0 + b * 3600 * S + i, False, None) for i in range(50)] for b in range(6)])
    query = stateful.tracks(stateful.with_time(stream), ["track"], 60 * S).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in (x if isinstance(x, dict) else __import__("json").loads(x.json) for x in query.recentProgress) if p["stateOperators"]]
    assert held and max(held) <= 2 * 50 * 4 and held[-1] <= 50 * 4


def test_a_batch_of_tracks_is_few_calls_to_the_state():
    """What a key holds is read and written at once, however many tracks are open."""
    calls = []

    class Handle:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                return {"getValueState": self, "getMapState": self, "get": self.value, "exists": self.value is not None, "iterator": iter(())}.get(name)

            return call

    made = stateful._Tracks(["track"], 60 * S)
    made.init(Handle())
    batch = lambda hours: list(made.handleInputRows(("a",), iter([{"us": T0 + h * 3600 * S, "closes": False, "identity": None} for h in hours]), None))
    assert len(batch(range(40))) == 40
    calls.clear()
    assert len(batch(range(40, 80))) == 40 and len(calls) <= 4


def test_parts_of_a_stream_have_several_files(spark, tmp_path, monkeypatch):
    """Each trigger takes one part whole, an empty part too, though many tasks write it."""
    from pyspark.sql import functions as F

    from ethospark.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 12)
    data = [(i, us) for i, us in enumerate([*range(100), *range(100, 103), *range(300, 400)])]
    df = spark.createDataFrame(data, "event_id long, us long")
    for again in (None, F.col("event_id") % 3 == 0):
        path, got = str(tmp_path / f"in{again is None}"), []
        stream = streams._in_parts(df, path, again)
        stream.writeStream.foreachBatch(lambda b, n: got.append(sorted(tuple(r) for r in b.collect()))).option("checkpointLocation", path + "_c").trigger(availableNow=True).start().awaitTermination()
        parts = [[r for r in data if r[1] // 100 == k] for k in range(4)]
        more = [[], *[[r for r in p if r[0] % 3 == 0] for p in parts]]
        assert got == (parts if again is None else [sorted(p + m) for p, m in zip([*parts, []], more, strict=True)])
    assert len(list((tmp_path / "inTrue").glob("*.parquet"))) == 4 * 5


def test_votes_are_taken_back(spark, tmp_path):
    rnd = random.Random(2)
    names = ["x", "y", "z"]
    rows = [(rnd.choice("ab"), T0 + i * S, rnd.randrange(5), [rnd.choice([0.0, 0.25, 0.5, 1.0]) for _ in names]) for i in range(200)]
    batches = [rows[i : i + 45] for i in range(0, len(rows), 45)]
    run = lambda s: stateful.votes(stateful.with_time(s), ["track"], names, 3, 0.6, 3600 * S)
    log = to_the_end(spark, tmp_path, "track string, us long, slot long, probs array<double>", batches, run)
    want = []
    for key in "ab":
        slots: dict = {}
        said = None
        for _, us, slot, probs in (r for r in rows if r[0] == key):
            slots[slot] = probs
            tally = [sum(p[i] for p in slots.values()) for i in range(3)]  # from the buffer alone: quarters are exact
            best, second = sorted(tally, reverse=True)[:2]
            now = names[tally.index(best)] if best >= 3 and best / (best + second) > 0.6 else None
            if now != said:
                want.append((key, us, now, best))
            said = now
    assert len(want) > 10 and any(w[2] is None for w in want)
    assert sorted((r["track"], r["us"], r["identity"] or "", r["votes"]) for r in log.collect()) == sorted((k, u, n or "", v) for k, u, n, v in want)


def test_keyframes_and_votes_in_one_stream(spark, tmp_path):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(9, 6))
    rows = []
    for i in range(150):
        v = centres[rnd.integers(9)] + rnd.normal(size=6) * 0.4
        rows.append(("ab"[i % 2], T0 + i * S, v.tolist(), [float(x) for x in np.eye(2)[rnd.integers(2)]]))
    run = lambda s: stateful.votes(stateful.keyframe_slots(stateful.with_time(s), ["track"], 4, 0.9), ["track"], ["x", "y"], 2, 0.6)
    log = to_the_end(spark, tmp_path, "track string, us long, vec array<double>, probs array<double>", [rows[:60], rows[60:61], rows[61:]], run)
    want = []
    for key in "ab":
        held, votes, said = [], [], None
        for _, us, v, probs in (r for r in rows if r[0] == key):
            v = np.array(v) / np.linalg.norm(v)
            near = max((h @ v for h in held), default=-1)
            if near > 0.9:
                continue
            if len(held) < 4:
                held.append(v)
                votes.append(probs)
            else:
                pairs = [max(h @ g for j, g in enumerate(held) if j != i) for i, h in enumerate(held)]
                if near >= max(pairs):
                    continue
                at = pairs.index(max(pairs))
                held[at], votes[at] = v, probs
            now = stateful.decided(np.sum(votes, axis=0).tolist(), ["x", "y"], 2, 0.6)
            if now != said:
                want.append((key, us, now or ""))
            said = now
    assert len(want) > 4
    assert sorted((r["track"], r["us"], r["identity"] or "") for r in log.collect()) == sorted(want)


def test_count_changes_in_order_of_event_time(spark, tmp_path):
    rnd = random.Random(4)
    rows, t = [], T0
    for i in range(250):
        t += rnd.choice([1, 1, 2, 90]) * S
        rows.append((rnd.choice("ab"), t + i, rnd.randrange(3)))
    rows += [(k, us, n + 1) for k, us, n in rows[::40]]  # two counts at one time: the greater one stands
    run = lambda s: stateful.count_changes(stateful.with_time(s, late="60 seconds"), ["camera"], 10**6 * S)
    got = to_the_end(spark, tmp_path, "camera string, us long, count long", shuffled(rnd, rows, 50 * S, 90), run).collect()
    greatest: dict = {}
    for k, us, n in rows:
        greatest[k, us] = max(n, greatest.get((k, us), 0))
    df = spark.createDataFrame([(k, us, n) for (k, us), n in greatest.items()], "camera string, us long, count long")
    want = islands.changes(df, ["camera"], "us", ["us"], "count").collect()
    last = {k: max(us for c, us in greatest if c == k) for k in "ab"}
    assert sorted((r["camera"], r["start_us"], r["duration_us"], r["count"]) for r in got) == sorted((r["camera"], r["us"], r["lasts_us"] if r["lasts_us"] is not None else last[r["camera"]] - r["us"], r["count"]) for r in want)


def test_count_runs_end_at_a_gap(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + 5 * S, 1), ("a", T0 + 100 * S, 1), ("a", T0 + 101 * S, 2), (None, T0, 7), ("b", None, 1)]
    run = lambda s: stateful.count_changes(stateful.with_time(s, late="0 seconds"), ["camera"], 50 * S)
    got = to_the_end(spark, tmp_path, "camera string, us long, count long", [rows], run).collect()
    assert sorted((r["start_us"] - T0, r["duration_us"], r["count"]) for r in got) == [(0, 5 * S, 1), (100 * S, S, 1), (101 * S, 0, 2)]


def test_a_day_of_a_batch_has_few_files(spark, tmp_path, monkeypatch):
    day = 86_400 * S
    frame = spark.createDataFrame([(i, f"w{i % 50}", i % 3 * day + i * 7 * S, "uv"[i % 2]) for i in range(300)], "id long, who string, us long, label string").repartition(4)
    for most, files in ((100, {1}), (25, {2, 3, 4})):
        monkeypatch.setattr(rollup, "FILE_ROWS", most)
        out = tmp_path / f"out{most}"
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            rollup.merge_batch(frame, 0, str(out), ["id"], ["who"], "us", "label", ["u", "v"], 3600 * S)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.enabled")
        folders = [d for name in ("seen/day=*/batch=0", "deltas/day=*/batch=0", "summary/day=*") for d in out.glob(name)]
        assert len(folders) == 9 and {len(list(d.glob("*.parquet"))) for d in folders} <= files
        assert rollup.summary(spark, str(out)).selectExpr("sum(u + v)").first()[0] == 300


def test_roll_up_of_batches_sent_again(spark, tmp_path):
    rnd = random.Random(5)
    day = 86_400 * S
    rows = [(i, rnd.choice("ab"), rnd.randrange(3) * day + rnd.randrange(day), rnd.choice(["u", "v"])) for i in range(300)] + [(900, "a", None, "u"), (901, None, 5, "v"), (901, None, 5, "v")]
    schema, out = "id long, who string, us long, label string", str(tmp_path / "out")
    args = (out, ["id"], ["who"], "us", "label", ["u", "v"], 3600 * S)
    parts = [rows[:120], rows[80:220], rows[200:]]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    read = lambda: sorted((r["who"] or "", r["bin_us"], r["u"], r["v"]) for r in rollup.summary(spark, out).collect())
    for n, frame in enumerate(frames):
        rollup.merge_batch(frame, n, *args)
    first = read()
    want: dict = {}
    for _, who, us, label in {r[0]: r for r in rows if r[2] is not None}.values():
        cell = want.setdefault((who or "", us // (3600 * S) * 3600 * S), [0, 0])
        cell["uv".index(label)] += 1
    assert first == sorted((*k, *v) for k, v in want.items())
    for n in (2, 1, 0):  # run again in any order, nothing changes
        rollup.merge_batch(frames[n], n, *args)
    assert read() == first
    rollup.merge_batch(frames[0].limit(0), 3, *args)
    # A batch of one day writes that day alone.
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "summary").rglob("*.parquet")}
    rollup.merge_batch(spark.createDataFrame([(5000, "a", day + 7, "u")], schema), 4, *args)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "summary").rglob("*.parquet")}
    assert {p.parent.name for p in before.keys() ^ after.keys()} == {"day=1"}


def test_stream_without_data(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = live.detections(spark, str(tmp_path / "in"), "id long, v string")
    assert live.drain(stream, str(tmp_path / "out"), "append").collect() == []
    assert live.drain(stream, str(tmp_path / "out2"), "append", numbered=True).columns == ["id", "v", "batch"]


def test_replay_on_one_clock(spark, tmp_path):
    """A replay that is stopped and goes on gives each frame once, in the order and on the clock of ``replay_order``, 20 frames of a camera at a time."""
    from pyspark.sql import functions as F

    from ethospark.sources import replay

    rnd = random.Random(8)
    rows, t = [], T0
    for i in range(330):
        t += rnd.choice([1, 3, 3] * 30 + [90]) * S
        rows.append((i, rnd.choice(["c1", "c2", "c2", "c2"]), t))
    rows += [(900 + k, c, t + 2 * S) for k, c in enumerate(["c1", "c2"])] + [(990, None, t), (991, "c1", None)]
    frames = spark.createDataFrame(rows, "id long, camera string, us long")
    path = str(tmp_path / "in")
    replay.write_videos(frames, path, "camera", "us", rows=50)
    groups = replay.row_groups(path, "camera", "us")
    assert max(g.rows for g in groups) <= 50 and sum(g.rows for g in groups) == len(rows) - 2
    spark.dataSource.register(replay.ReplaySource)
    stream = spark.readStream.format("replay").options(path=path, limit=20, skip=2, gap=60 * S).load()
    assert stream.columns == ["id", "us", "camera", "replay_us"]

    out = str(tmp_path / "out")
    first = []

    def write(batch, number):
        if number == 4 and not first:
            first.append(number)
            raise RuntimeError("lost driver")
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").start()
    with pytest.raises(Exception, match="lost driver"):
        query.processAllAvailable()
    again = spark.readStream.format("replay").options(path=path, limit=20, skip=2, gap=60 * S).load()
    got = live.drain(again, out, "append", numbered=True, at_once=False).collect()
    want = live.replay_order(frames.where("camera is not null and us is not null").withColumn("t", F.timestamp_micros("us")), "t", 2, ["camera"], "60 seconds").collect()
    assert sorted((r["id"], r["replay_us"]) for r in got) == sorted((r["id"], r["replay_us"]) for r in want)
    in_order = [(r["batch"], r["us"]) for r in sorted(got, key=lambda r: r["us"])]
    assert in_order == sorted(in_order)
    per: dict = {}
    for r in got:
        per[r["batch"], r["camera"]] = per.get((r["batch"], r["camera"]), 0) + 1
    assert max(per.values()) == 20 and len({b for b, _ in per}) > 6


def test_replay_refuses_frames_out_of_order(spark, tmp_path):
    from ethospark.sources import replay

    for us in ([1, 9], [5]):
        spark.createDataFrame([("c", u) for u in us], "camera string, us long").coalesce(1).write.mode("append").partitionBy("camera").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="in order"):
        replay.row_groups(str(tmp_path / "in"), "camera", "us")


class _State:
    """A map or value state in memory that counts its calls, each of which is a round trip in Spark."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        held = self.held
        return {
            "containsKey": lambda k: k in held,
            "getValue": held.get,
            "updateValue": held.__setitem__,
            "removeKey": held.pop,
            "keys": lambda: iter(list(held)),
            "iterator": lambda: iter(list(held.items())),
            "exists": lambda: bool(held),
            "get": lambda: held.get(0),
            "update": lambda v: held.__setitem__(0, v),
            "clear": held.clear,
        }[name]


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *kinds):  # noqa: N802
        return self.states.setdefault(name, _State())

    def getValueState(self, name, *kinds):  # noqa: N802
        return self.states.setdefault(name, _State())

    def registerTimer(self, at):  # noqa: N802
        pass

    deleteTimer = registerTimer  # noqa: N815


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now // 1000


def test_calls_of_state_do_not_grow_with_rows():
    """Thousands of rows of one batch need a few round trips to the state, and give the same runs and votes."""
    counts, handle = stateful._Changes(["k"], 60_000_000), _Handle()
    counts.init(handle)
    rows = [{"us": us, "count": us // 1_000_000 // 100 % 3} for us in range(0, 1_500_000_000, 500_000)]
    out = list(counts.handleInputRows((1,), iter(rows[::-1]), _Clock(0)))
    out += list(counts.handleExpiredTimer((1,), _Clock(10**15), None))
    assert [(r["start_us"], r["duration_us"], r["count"]) for r in out] == [(k * 100_000_000, 100_000_000 if k < 14 else 99_500_000, k % 3) for k in range(15)]
    assert sum(s.calls for s in handle.states.values()) < 60

    voting, handle = stateful._Votes(["k"], ["x", "y"], 1, 0.5, 60_000_000), _Handle()
    voting.init(handle)
    said = list(voting.handleInputRows((1,), iter({"us": us, "slot": us % 5, "probs": [us < 1000, us >= 1000]} for us in range(2000)), _Clock(0)))
    assert [r["identity"] for r in said if r["us"] in (0, 1002)] == ["x", "y"]
    assert handle.states["said"].held[0][0] == [0, 5]
    assert sum(s.calls for s in handle.states.values()) < 20
