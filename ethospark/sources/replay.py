"""Stored frames as a stream: all cameras on one clock, a bounded number of frames of each at a time.

    spark.dataSource.register(ReplaySource)
    stream = spark.readStream.format("replay").option("path", path).option("limit", 20).load()

``path`` holds Parquet files by camera (``write_videos`` makes them). The offset of the stream is the clock: the time of the last frame given out, and by
how much pauses were shortened so far. A trigger takes frames up to the time at which the first camera has ``limit`` of them, and the next trigger comes when these
are worked off; nothing is dropped. Row groups are read by the tasks, one each; the driver reads their statistics and the times of the next few frames.

Options: ``camera`` and ``time`` name the columns (time in microseconds), ``skip`` takes every so-manieth frame of a camera, ``gap`` is the
longest pause, in microseconds, that the replay keeps: where no camera has a frame for longer, the clock jumps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ethospark.functions.time import DAY

#: Before all times.
NEVER = -(2**62)


def write_videos(df: DataFrame, path: str, camera: str, time: str, rows: int = 100_000) -> None:
    """Writes frames as files of a camera's day, in order of time, in row groups of ``rows`` rows at most. Frames without a camera or a time are left out."""
    day = F.floor(F.col(time) / DAY).cast("long")
    dealt = df.where(F.col(camera).isNotNull() & F.col(time).isNotNull()).withColumn("day", day).repartition(camera, "day").sortWithinPartitions(camera, "day", time)
    dealt.write.option("parquet.block.row.count.limit", rows).partitionBy(camera, "day").parquet(path)


@dataclass
class RowGroup(InputPartition):
    """A row group: its camera, times, and the number of the camera's frames before it; and what of it a trigger takes."""

    path: str
    number: int
    camera: str
    first: int
    last: int
    before: int
    rows: int
    after: int = NEVER
    until: int = NEVER
    saved: int = 0


def row_groups(path: str, camera: str, time: str) -> list[RowGroup]:
    """All row groups in order of time, from the statistics in the files' footers. Those of a camera may not overlap."""
    store, root = fs.FileSystem.from_uri(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        name = info.path.rpartition("/")[2]
        if info.type != fs.FileType.File or not name.endswith(".parquet") or name.startswith((".", "_")):
            continue
        whose = next(part.partition("=")[2] for part in info.path.split("/") if part.startswith(f"{camera}="))
        with store.open_input_file(info.path) as f:
            meta = pq.read_metadata(f)
        column = meta.schema.names.index(time)
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(column).statistics
            found.append(RowGroup(info.path, k, whose, stats.min, stats.max, 0, meta.row_group(k).num_rows))
    found.sort(key=lambda g: (g.camera, g.first, g.number))
    for a, b in zip(found, found[1:], strict=False):
        if a.camera == b.camera:
            if a.last > b.first:
                raise ValueError(f"frames of camera {a.camera} aren't in order of time: {a.path}, {b.path}")
            b.before = a.before + a.rows
    return found


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        """The files' columns, the camera as text, and ``replay_us``."""
        from pyspark.sql.pandas.types import from_arrow_schema

        camera, time = self.options.get("camera", "camera"), self.options.get("time", "us")
        groups = row_groups(self.options["path"], camera, time)
        if not groups:
            raise ValueError(f"no frames in {self.options['path']}")
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_file(groups[0].path) as f:
            own = from_arrow_schema(pq.read_schema(f))
        return own.add(camera, "string").add("replay_us", "long")

    def streamReader(self, schema: StructType) -> ReplayReader:  # noqa: N802
        return ReplayReader(dict(self.options), schema)


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.camera, self.time = low["path"], low.get("camera", "camera"), low.get("time", "us")
        self.limit, self.skip, self.gap = int(low.get("limit", 20)), int(low.get("skip", 1)), int(low.get("gap", 60_000_000))
        self.columns = schema.fieldNames()
        self.groups = row_groups(self.path, self.camera, self.time)
        self.at: dict | None = None

    def _times(self, group: RowGroup) -> np.ndarray:
        """The times of a row group, and of which of its frames are taken."""
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(group.path) as f:
            return pq.ParquetFile(f).read_row_group(group.number, columns=[self.time]).column(0).to_numpy()

    def _kept(self, group: RowGroup, times: np.ndarray) -> np.ndarray:
        return (group.before + np.arange(len(times))) % self.skip == 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"clock": NEVER, "saved": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The clock after the next frames; where it stands if there are none."""
        self.at = self.at or self.initialOffset()
        clock, saved = self.at["clock"], self.at["saved"]
        ahead: dict[str, np.ndarray] = {}
        for g in self.groups:
            mine = ahead.get(g.camera, np.empty(0, np.int64))
            if g.last <= clock or len(mine) >= self.limit:
                continue
            times = self._times(g)
            ahead[g.camera] = np.concatenate([mine, times[self._kept(g, times) & (times > clock)]])
        ahead = {c: t for c, t in ahead.items() if len(t)}
        if not ahead:
            return self.at
        full = [int(t[self.limit - 1]) for t in ahead.values() if len(t) >= self.limit]
        times = np.unique(np.concatenate(list(ahead.values())))
        times = times[times <= min(full)] if full else times
        if clock != NEVER:
            saved += max(0, int(times[0]) - clock - self.gap)
        pauses = np.flatnonzero(np.diff(times) > self.gap)
        self.at = {"clock": int(times[pauses[0] if len(pauses) else -1]), "saved": saved}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        self.at = self.at or end  # after a restart, the last batch of the log is planned before anything else
        return [RowGroup(g.path, g.number, g.camera, g.first, g.last, g.before, g.rows, start["clock"], end["clock"], end["saved"]) for g in self.groups if g.last > start["clock"] and g.first <= end["clock"]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        own = [c for c in self.columns if c not in (self.camera, "replay_us")]
        with store.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f).read_row_group(partition.number, columns=own)
        times = table.column(self.time).to_numpy()
        table = table.take(np.flatnonzero(self._kept(partition, times) & (times > partition.after) & (times <= partition.until))).select(own)
        table = table.append_column(self.camera, pa.array([partition.camera] * len(table), pa.string()))
        table = table.append_column("replay_us", pa.array(table.column(self.time).to_numpy() - partition.saved, pa.int64()))
        yield from table.select(self.columns).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass
