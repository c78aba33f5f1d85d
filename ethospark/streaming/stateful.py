"""Keyed state of the live path that ends: tracks that close, votes that are taken back, counts put in order of event time.

Each operator is a ``StatefulProcessor`` with event-time timers. What a key holds is given up when the watermark has passed the
time until which it can matter, so state doesn't grow with the length of the stream. Rows carry their time twice: as a
timestamp for the watermark and as microseconds (``us``), which the operators work on. Nothing depends on how rows are dealt to batches, as long as none is later
than the watermark; such rows are dropped by Spark.

A stream that stops leaves keys open. ``live.drain`` with an end mark (a row of a far time, in a folder that is part of the stream) moves
the watermark past all timers, so that everything is closed.

State lies in RocksDB, checkpointed with the query: building an operator sets that provider for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Rows that wait for the watermark lie together by so many microseconds.
SPAN = 600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(us: int) -> int:
    """The first millisecond that isn't before a time in microseconds: timers know no less."""
    return -(-us // 1000)


def _watermark(timers) -> int:
    return timers.getCurrentWatermarkInMs() * 1000


def _apply(stream: DataFrame, keys: list[str], make: Callable[[list[str]], StatefulProcessor], extra: str, time_out: str = "") -> DataFrame:
    """``make`` gets the names of the key columns; rows without a key (end marks) form a key of their own, and processors leave them out."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    more = {"eventTimeColumnName": time_out} if time_out else {}
    return stream.groupBy(*keys).transformWithState(make(keys), StructType.fromDDL(f"{kinds}, {extra}"), "Append", "EventTime", **more)


class _Keyed(StatefulProcessor):
    """A processor whose timers are renewed: a key has one timer, for the end of what it holds."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "at long")

    def wake(self, us: int) -> None:
        at = _millis(us)
        if self.alarm.exists():
            before = self.alarm.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def row(self, key: tuple, **values) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **values)

    def close(self) -> None:
        pass


class _Tracks(_Keyed):
    def __init__(self, keys: list[str], gap: int) -> None:
        super().__init__(keys)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # All of a key, its timer too, in one value: each call to the state is a round trip, whatever it carries.
        self.state = handle.getValueState("tracks", "start array<long>, last array<long>, n array<long>, alarm long")

    def _held(self) -> tuple[dict[int, tuple[int, int]], int | None]:
        """What is open, by its start, and the time of the timer, if any."""
        got = self.state.get()
        return ({}, None) if got is None else ({s: (last, n) for s, last, n in zip(got[0], got[1], got[2], strict=True)}, got[3])

    def _hold(self, held: dict[int, tuple[int, int]], alarm: int | None) -> None:
        """Keeps what is open, with a timer for the end of the first to end in place of ``alarm``; nothing open, nothing kept."""
        at = _millis(min(last for last, _ in held.values()) + self.gap) if held else None
        if alarm != at:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            if at is not None:
                self.handle.registerTimer(at)
        if held:
            self.state.update((list(held), [last for last, _ in held.values()], [n for _, n in held.values()], at))
        else:
            self.state.clear()

    def _row(self, key: tuple, event: str, start: int | None, last: int | None, n: int, end: int | None = None, identity: str | None = None) -> Row:
        return self.row(key, event=event, opened_us=start, last_us=last, n=n, end_us=end, identity=identity)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = [r for r in rows if r["us"] is not None]
        if not rows or any(k is None for k in key):
            return
        before, alarm = self._held()
        # What is open, single rows and close events, in order of time; at one time a row comes before the event.
        items = sorted([(s, 0, last, n, None) for s, (last, n) in before.items()] + [(r["us"], 1, r["us"], 1, None) if not r["closes"] else (r["us"], 2, r["us"], 0, r["identity"]) for r in rows], key=lambda x: x[:4])
        held: list[list[int]] = []
        current: list[int] | None = None
        for at, kind, last, n, identity in items:
            if kind == 2:
                if current is not None and at < current[1] + self.gap:
                    yield self._row(key, "close", *current, end=at, identity=identity)
                    held.remove(current)
                else:
                    yield self._row(key, "late_close", None, None, 0, end=at, identity=identity)
                current = None
            elif current is not None and at < current[1] + self.gap:
                current[1], current[2] = max(current[1], last), current[2] + n
            else:
                current = [at, last, n]
                held.append(current)
        after = {s: (last, n) for s, last, n in held}
        for s, (last, n) in sorted(after.items()):
            if before.get(s) != (last, n):
                yield self._row(key, "extend" if s in before else "open", s, last, n)
        if after or before:
            self._hold(after, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, left = _watermark(timerValues), {}
        for s, (last, n) in sorted(self._held()[0].items()):
            if last + self.gap <= now:
                yield self._row(key, "timeout", s, last, n, end=last)
            else:
                left[s] = (last, n)
        self._hold(left, None)


def tracks(stream: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """A log of tracks: rows (keys, event, opened_us, last_us, n, end_us, identity) of tracks that open, are extended and close.

    ``stream`` has the keys, ``us``, and for close events ``closes`` true and an ``identity``. A track opens with its first row and takes in all rows less than
    ``gap`` after its last one. It ends with a close event (``close``: its time and identity), which comes after the track's rows, or when the watermark has passed
    its last row by ``gap`` (``timeout``: at its last row), and is forgotten; later rows open another one. A close event without an open track is a
    ``late_close``. An ``open`` or ``extend`` row is given once a batch, and those of an earlier start replace those of the tracks they join.
    """
    return _apply(stream, keys, lambda k: _Tracks(k, gap), "event string, opened_us long, last_us long, n long, end_us long, identity string")


def closed_tracks(log: DataFrame) -> DataFrame:
    """The tracks that have ended, from a log of ``tracks``."""
    return log.where("event in ('close', 'timeout')")


class _Votes(_Keyed):
    def __init__(self, keys: list[str], names: list[str], least: float, ratio: float, gap: int) -> None:
        super().__init__(keys)
        self.names, self.least, self.ratio, self.gap = names, least, ratio, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.slots = handle.getMapState("slots", "slot long", "probs array<double>")
        self.said = handle.getValueState("said", "tally array<double>, identity string, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = sorted((r["us"], r["slot"], tuple(r["probs"])) for r in rows if r["us"] is not None and r["slot"] is not None and r["probs"] is not None)
        if not rows or any(k is None for k in key):
            return
        held = {k[0]: list(v[0]) for k, v in self.slots.iterator()}  # read and written once a batch: each call is a round trip
        changed: set[int] = set()
        tally, identity, last = self.said.get() if self.said.exists() else ([0.0] * len(self.names), None, rows[0][0])
        tally = list(tally)
        for us, slot, probs in rows:
            if slot in held:
                tally = [t - p for t, p in zip(tally, held[slot], strict=True)]
            tally = [t + p for t, p in zip(tally, probs, strict=True)]
            held[slot] = list(probs)
            changed.add(slot)
            last = max(last, us)
            chosen = decided(tally, self.names, self.least, self.ratio)
            if chosen != identity:
                identity = chosen
                yield self.row(key, us=us, identity=identity, votes=max(tally))
        for slot in sorted(changed):
            self.slots.updateValue((slot,), (held[slot],))
        self.said.update((tally, identity, last))
        self.wake(last + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.alarm.clear()
        self.slots.clear()
        self.said.clear()
        yield from ()


def decided(tally: list[float], names: list[str], least: float = 3, ratio: float = 0.65) -> str | None:
    """The name of most votes if it has ``least`` or more and a share above ``ratio`` of its own and the second's; of equal ones the first."""
    order = sorted(range(len(tally)), key=lambda i: -tally[i])
    best, second = tally[order[0]], tally[order[1]] if len(order) > 1 else 0.0
    return names[order[0]] if best >= least and best / (best + second) > ratio else None


def votes(stream: DataFrame, keys: list[str], names: list[str], least: float = 3, ratio: float = 0.65, gap: int = 3_600_000_000) -> DataFrame:
    """Rows (keys, us, identity, votes) whenever a track's identity by votes changes; null when the votes no longer decide.

    ``stream`` has the keys, ``us``, ``slot`` (the place in the track's bounded buffer of keyframes) and ``probs``, a vote for each of ``names``. A row in a
    slot that is taken replaces the keyframe there: its votes are taken back, then the new ones count. Rows of a track are taken in order of
    time within a batch. A track is forgotten when the watermark has passed its last row by ``gap``.
    """
    return _apply(stream, keys, lambda k: _Votes(k, names, least, ratio, gap), "us long, identity string, votes double")


class _Keyframes(_Keyed):
    def __init__(self, keys: list[str], size: int, alike: float, gap: int) -> None:
        super().__init__(keys)
        self.size, self.alike, self.gap = size, alike, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.slots = handle.getMapState("vectors", "slot long", "v array<double>")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        import numpy as np

        rows = sorted((r for r in rows if r["us"] is not None and r["vec"] is not None), key=lambda r: r["us"])
        if not rows or any(k is None for k in key):
            return
        held = {k[0]: np.array(v[0]) for k, v in self.slots.iterator()}
        for r in rows:
            v = np.array(r["vec"], float)
            v = v / max(np.linalg.norm(v), 1e-12)
            slot = place(held, v, self.size, self.alike)
            if slot is None:
                continue
            held[slot] = v
            self.slots.updateValue((slot,), (v.tolist(),))
            yield self.row(key, time=r["time"], us=r["us"], slot=slot, probs=r["probs"])
        last = max(rows[-1]["us"], self.last.get()[0] if self.last.exists() else rows[-1]["us"])
        self.last.update((last,))
        self.wake(last + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.alarm.clear()
        self.slots.clear()
        self.last.clear()
        yield from ()


def place(held: dict, v, size: int, alike: float) -> int | None:
    """The slot that a unit vector takes in a buffer of ``size`` diverse ones: a free one; in a full buffer that of the vector most alike to another, if ``v`` is less
    alike to all. None if it is as alike as ``alike`` to one that is held."""
    import numpy as np

    slots = sorted(held)
    near = max((float(held[s] @ v) for s in slots), default=-1.0)
    if near > alike:
        return None
    if len(slots) < size:
        return len(slots)
    m = np.stack([held[s] for s in slots])
    among = m @ m.T - 2 * np.eye(len(slots))
    return slots[int(among.max(axis=1).argmax())] if near < among.max() else None


def keyframe_slots(stream: DataFrame, keys: list[str], size: int = 40, alike: float = 0.8, gap: int = 3_600_000_000) -> DataFrame:
    """Rows (keys, time, us, slot, probs) of the frames that enter their track's buffer of diverse keyframes, for ``votes``.

    ``stream`` has the keys, ``time``, ``us``, ``vec`` and ``probs``. The buffer holds ``size`` vectors a track and is forgotten like a track's votes.
    """
    return _apply(stream, keys, lambda k: _Keyframes(k, size, alike, gap), "time timestamp, us long, slot long, probs array<double>", "time")


class _Changes(_Keyed):
    def __init__(self, keys: list[str], gap: int) -> None:
        super().__init__(keys)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "span long", "us array<long>, count array<long>")
        self.run = handle.getValueState("run", "start long, count long, last long")

    def _released(self, key: tuple, now: int) -> Iterator[Row]:
        """Takes what the watermark has passed, in order, and closes a run that has lasted too long without a row."""
        run = tuple(self.run.get()) if self.run.exists() else None
        rest = None
        for span in sorted(k[0] for k in self.waiting.keys()):
            if span * SPAN > now:
                rest = min(self.waiting.getValue((span,))[0])
                break
            rows = sorted(zip(*self.waiting.getValue((span,)), strict=True))
            left = [r for r in rows if r[0] > now]
            if not left:
                self.waiting.removeKey((span,))
            elif len(left) < len(rows):
                self._put(span, left)
            for us, count in rows[: len(rows) - len(left)]:
                if run is not None and us - run[2] > self.gap:
                    yield self._row(key, run, run[2])
                    run = None
                if run is not None and count != run[1]:
                    yield self._row(key, run, us)
                    run = None
                run = (us, count, us) if run is None else (run[0], run[1], us)
            if left:
                rest = left[0][0]
                break
        if run is not None and rest is None and run[2] + self.gap < now:
            yield self._row(key, run, run[2])
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
        ends = [x for x in (rest, run[2] + self.gap + 1 if run else None) if x is not None]
        if ends:
            self.wake(max(min(ends), now + 1))

    def _put(self, span: int, rows) -> None:
        us, counts = zip(*rows, strict=True)
        self.waiting.updateValue((span,), (list(us), list(counts)))

    def _row(self, key: tuple, run: tuple[int, int, int], end: int) -> Row:
        return self.row(key, start_us=run[0], duration_us=end - run[0], count=run[1])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if any(k is None for k in key):
            return
        # Rows wait together in spans of time: a row of its own in the state would be a round trip each.
        new: dict[int, dict[int, int]] = {}
        for r in rows:
            us, count = r["us"], r["count"]
            if us is not None and count is not None:
                span = new.setdefault(us // SPAN, {})
                span[us] = max(span.get(us, count), count)
        for span, counts in new.items():
            if self.waiting.containsKey((span,)):
                for us, count in zip(*self.waiting.getValue((span,)), strict=True):
                    counts[us] = max(counts.get(us, count), count)
            self._put(span, counts.items())
        yield from self._released(key, _watermark(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.alarm.clear()
        yield from self._released(key, _watermark(timerValues))


def count_changes(stream: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Rows (keys, start_us, duration_us, count): a changing count as runs, in order of event time whatever the order of arrival.

    ``stream`` has the keys, ``us`` and ``count``; of rows of one time the greatest count stands. Rows wait in state until the watermark has passed them. A run lasts until
    the row that changes the count, or until its last row where nothing comes for more than ``gap`` and at the stream's end mark.
    """
    return _apply(stream, keys, lambda k: _Changes(k, gap), "start_us long, duration_us long, count long")


def with_time(stream: DataFrame, us: str = "us", late: str = "10 minutes") -> DataFrame:
    """The stream with the column ``time`` of its microseconds and a watermark on it."""
    return stream.withColumn("time", F.timestamp_micros(us)).withWatermark("time", late)
