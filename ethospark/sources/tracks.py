"""Scans of what cameras and models leave: track and behaviour CSV, tracking JSON lines, tracklet JSON, embeddings.

Files are read by Spark with explicit schemas that hold every column of old and new files; paths give camera, date,
time and track. Conditions on these prune files through partitions or the file's metadata.
"""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.functions.text import coalesce_labels

TRACK = (
    "frame_id long, timestamp string, bbox_top2 double, bbox_left2 double, bbox_bottom2 double, bbox_right2 double, bbox_top double, bbox_left double, bbox_bottom double, bbox_right double, score double,"
    " world_x double, world_y double, identity_label string, behavior_label string, behavior_conf double, quality_label string, quality_conf double"
)
BEHAVIOUR = "timestamp string, behavior_label_raw string, behavior_label_stage1 string, behavior_label_old string, behavior_label string, behavior_conf double, quality_label string, quality_conf double"
#: Which label column counts: as predicted for smoothing, as corrected for analysis.
AS_PREDICTED = ["behavior_label_raw", "behavior_label_stage1", "behavior_label_old", "behavior_label"]
AS_CORRECTED = ["behavior_label", "behavior_label_raw", "behavior_label_stage1", "behavior_label_old"]
NAME = r"T(\d{6})_ID(-?\d+)"
STRICT = r"^T\d{6}_ID\d{6}$"
#: A cell of a CSV line and the comma after it.
CELL = r'\s*("[^"]*(?:""[^"]*)*"\s*|[^,]*),'
PLACE = r"([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$"


def _with_path(df: DataFrame) -> DataFrame:
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    return df.select(
        "*",
        F.regexp_extract(path, PLACE, 1).alias("camera"),
        F.to_date(F.regexp_extract(path, PLACE, 2)).alias("date"),
        F.try_to_timestamp(F.concat(F.regexp_extract(path, PLACE, 2), F.lit(" "), F.regexp_extract(name, NAME, 1)), F.lit("yyyy-MM-dd HHmmss")).cast("timestamp_ntz").alias("file_time"),
        F.regexp_extract(name, NAME, 2).try_cast("bigint").alias("track"),
        F.regexp_replace(name, r"\.\w+$", "").alias("stem"),
    )


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, without the white space and quotes around them; an empty cell is null. A quote that isn't closed is text."""
    bare = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1)), lambda x: F.nullif(F.trim(bare(F.trim(x))), F.lit("")))


def _lines(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """Rows (place of the file, _h, _v, line): the cells of each line and of its file's header, the first line that isn't blank.

    A file is a row until its lines are taken apart, so its header is at hand without a join; a track's file is bounded by the length of a track.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text(paths, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = _with_path(files.select("value", "_metadata")).withColumn("_lines", lines).withColumn("_h", csv_cells(F.get("_lines", F.lit(0))))
    rows = rows.select("camera", "date", "file_time", "track", "stem", "_h", F.explode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines"), F.lit(1)))).alias("line"))
    return rows.withColumn("_v", csv_cells(F.col("line")))


def _csv(spark: SparkSession, paths: str | list[str], schema: str, glob: str) -> DataFrame:
    """Columns are found by their names in each file's header, wherever they stand, so files of old and new layouts read alike.

    Cells and names may be quoted. A line with more or fewer cells than the header, or of a file without ``timestamp``, is kept in ``corrupt``.
    """
    rows = _lines(spark, paths, glob)
    kinds = dict(f.split() for f in schema.split(","))
    cell = lambda c: F.when(F.array_position("_h", F.lit(c)) > 0, F.get("_v", (F.array_position("_h", F.lit(c)) - 1).cast("int")))
    return rows.select("camera", "date", "file_time", "track", "stem", *[cell(c).try_cast(k).alias(c) for c, k in kinds.items()], F.when(_misfit(), F.col("line")).alias("corrupt"))


def _misfit() -> Column:
    return (F.size("_v") != F.size("_h")) | (F.array_position("_h", F.lit("timestamp")) == 0)


def corrupt_lines(spark: SparkSession, paths: str | list[str], glob: str = "T*_ID*.csv") -> DataFrame:
    """Rows (camera, date, stem, line) of lines that don't fit their file's header, and of files without a column ``timestamp``, none of whose rows ``tracks`` has."""
    return _lines(spark, paths, glob).where(_misfit()).select("camera", "date", "stem", "line")


def night_paths(root: str, date: str) -> list[str]:
    """The folders of a night, its date's and the next one's, of all cameras: other nights' files aren't listed."""
    day = dt.date.fromisoformat(date)
    return [f"{root.rstrip('/')}/*/{d.isoformat()}" for d in (day, day + dt.timedelta(days=1))]


def paths_between(spark: SparkSession, root: str, first: str, last: str) -> list[str]:
    """The track files that begin in [first, last], by their folders' dates and their names: only the folders of these days are listed, and no file is read.

    The names of a time range's files come to the driver, as a listing does. ``tracks`` reads them; without any the list is empty.
    """
    begin, end = dt.datetime.fromisoformat(first), dt.datetime.fromisoformat(last)
    days = [(begin.date() + dt.timedelta(days=k)).isoformat() for k in range((end.date() - begin.date()).days + 1)]
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "T*_ID*.csv").load(f"{root.rstrip('/')}/*/{{{','.join(days)}}}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    at = F.try_to_timestamp(F.concat(F.regexp_extract("path", PLACE, 2), F.lit(" "), F.regexp_extract("path", NAME, 1)), F.lit("yyyy-MM-dd HHmmss")).cast("timestamp_ntz")
    return sorted(r["path"] for r in listed.select("path").where(at.between(F.lit(begin), F.lit(end))).collect())


def tracks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of all track files below ``path`` (not the behaviour files), with naive times; rows without a time are left out."""
    out = _csv(spark, path, TRACK, "T*_ID*.csv").where(~F.col("stem").endswith("behavior") & ~F.col("stem").startswith("part_"))
    return out.withColumn("ts", F.col("timestamp").try_cast("timestamp_ntz")).where("ts is not null").drop("timestamp")


def behaviours(spark: SparkSession, path: str | list[str], precedence: list[str] | None = None) -> DataFrame:
    """Rows of all behaviour files, with ``label`` by the given precedence of columns."""
    out = _csv(spark, path, BEHAVIOUR, "*behavior.csv").withColumn("ts", F.col("timestamp").try_cast("timestamp_ntz")).where("ts is not null").drop("timestamp")
    return out.withColumn("label", coalesce_labels(precedence or AS_CORRECTED, out.columns))


def for_night(df: DataFrame, date: str) -> DataFrame:
    """The files of a night: those of its date and of the next."""
    return df.where(F.col("date").between(F.to_date(F.lit(date)), F.date_add(F.to_date(F.lit(date)), 1)))


def between(df: DataFrame, first: str, last: str) -> DataFrame:
    """The rows of the files that begin in [first, last], by their names."""
    return df.where(F.col("file_time").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def strict_names(df: DataFrame) -> DataFrame:
    """The rows of files whose names have the exact form T<HHmmss>_ID<6 digits>."""
    return df.where(F.col("stem").rlike(STRICT))


def positions(df: DataFrame) -> DataFrame:
    """World positions in order of time within each track; rows without one are left out."""
    return df.select("camera", "track", "ts", "world_x", "world_y").dropna().sortWithinPartitions("camera", "track", "ts")


def gallery(df: DataFrame, label: str, known: list[str] | None = None) -> DataFrame:
    """Labelled reference vectors, of the known labels if there are any."""
    return df.where(F.col(label).isin(known)) if known else df.where(F.col(label).isNotNull())


def bout_summaries(spark: SparkSession, path: str, keyword: str = "") -> DataFrame:
    """Bout summaries below ``path`` whose names hold a keyword, with date, group and companions.

    A name is ``<date>_<group>_...``; the companions are the group of another file of the same date.
    """
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{keyword}*.csv").csv(path).select("*", F.col("_metadata.file_name").alias("file"))
    stem = F.split(F.regexp_replace("file", r"\.csv$", ""), "_")
    rows = rows.withColumn("date", F.get(stem, F.lit(0))).withColumn("group", F.get(stem, F.lit(1)))
    names = rows.select("date", "group").distinct()
    other = names.alias("a").join(names.alias("b"), (F.col("a.date") == F.col("b.date")) & (F.col("a.group") != F.col("b.group"))).groupBy(F.col("a.date").alias("date"), F.col("a.group").alias("group"))
    return rows.join(other.agg(F.array_join(F.array_sort(F.collect_set("b.group")), ",").alias("companions")), ["date", "group"], "left")


def video_files(spark: SparkSession, path: str, extensions: list[str], containing: str = "") -> DataFrame:
    """Rows (path, length, modified) of the videos below a folder, in order of their paths without regard to case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    ends = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.where(ends & F.lower("path").contains(containing.lower())).orderBy(F.lower("path"), "path")


def scan_targets(templates: list[str], at: dt.datetime) -> list[str]:
    """Path templates (strftime) for a time; they may hold globs, which Spark resolves."""
    return list(dict.fromkeys(at.strftime(t) for t in templates))


def synthetic_nights(spark: SparkSession, subjects: int, nights_: int, seed: int, begins: int = 18, hours: int = 14) -> DataFrame:
    """Rows (subject, night, room, start_us, end_us, label): for each animal and night a room and one stretch of sleep, at random from a seed."""
    grid = spark.range(subjects * nights_).select((F.col("id") % subjects).alias("subject"), F.floor(F.col("id") / subjects).alias("night"))
    roll = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "subject", "night"), F.lit(n))
    start = (F.col("night") * 24 + begins + roll("start", hours // 2)) * 3_600_000_000
    return grid.select("subject", "night", F.when(roll("room", 2) == 0, "mit").otherwise("ohne").alias("room"), start.alias("start_us"), (start + (1 + roll("length", hours // 2)) * 3_600_000_000).alias("end_us"), F.lit("sleep").alias("label"))


def nights(df: DataFrame) -> DataFrame:
    return df.select("date").distinct()


def tracking_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tracking JSON lines: one row for each box of each frame, with the video's rate and size from the first line."""
    schema = "meta struct<video:string,fps:double,width:int,height:int>, results struct<frame_idx:long,timestamp:string,tracks:array<struct<raw_track_id:string,bbox:array<double>,score:double>>>"
    lines = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    meta = lines.where("meta is not null").select("file", "meta.*")
    rows = lines.where("results is not null").select("file", "results.frame_idx", "results.timestamp", F.explode("results.tracks").alias("t"))
    return rows.select("file", "frame_idx", "timestamp", "t.raw_track_id", "t.bbox", "t.score").join(meta, "file", "left")


TRACKLET = (
    "track_id string, raw_track_id string, track_filename string, track_csv_path string, track_video_path string, camera_id string, stitched_id int, stitched_label string, identity_label string, smoothed_label string, voted_track_label string,"
    " semi_gt_labels array<string>, invalid_flag boolean, start_timestamp string, end_timestamp string, feature_path string, cross_cam_id string, cross_cam_stitched_id string, cross_cam_individual int, cross_cam_stitched_id_vote string,"
    " cross_cam_stitched_id_vote_counts map<string,struct<count:long,pct:double>>"
)


def tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Tracklet JSON of all stages: fields that a stage doesn't write are null; identity falls back from the latest to the first."""
    out = spark.read.schema(TRACKLET).option("multiLine", True).json(path)
    usable = lambda c: F.when(~F.lower(F.col(c)).isin("unknown", "invalid", "spurious", "confused", ""), F.col(c))
    return out.withColumn("identity", F.coalesce(usable("identity_label"), usable("cross_cam_stitched_id_vote"), usable("stitched_label"), usable("smoothed_label"), usable("voted_track_label"), F.lit("unknown")))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """NPZ files as rows (file, frame_id, feature). Files come through Spark's reader, so any store will do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    features = z["features"] if "features" in z else z["feature"]
                    ids = z["frame_ids"] if "frame_ids" in z else np.arange(len(features))
                yield pd.DataFrame({"file": file, "frame_id": ids.astype("int64"), "feature": list(features.astype("float32"))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "file string, frame_id long, feature array<float>")


VIDEO = [r"^(?<c>[A-Za-z0-9]+)_(?<d>\d{8})[_-]?(?<t>\d{6})", r"(?<c>cam\d+).*?(?<d>\d{4}-\d{2}-\d{2})[T_ ](?<t>\d{2}[-:]?\d{2}[-:]?\d{2})"]


def video_times(df: DataFrame, name: str, seconds: str) -> DataFrame:
    """Camera, start and end of a video from its file name (two layouts) and its length."""
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(F.col(name), p, k), F.lit("")) for p in VIDEO])
    digits = F.regexp_replace(F.concat(part(2), part(3)), "[^0-9]", "")
    start = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    out = df.withColumn("camera", part(1)).withColumn("start", start)
    return out.withColumn("end", F.col("start") + F.make_dt_interval(secs=F.col(seconds)))


def video_index(spark: SparkSession, path: str) -> DataFrame:
    """A video index of parallel arrays for each camera, as intervals."""
    schema = "cameras map<string,struct<videos:array<string>,filenames:array<string>,start_times:array<string>,end_times:array<string>>>"
    cameras = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cameras").alias("camera", "v"))
    zipped = F.arrays_zip(F.coalesce("v.videos", "v.filenames").alias("video"), F.col("v.start_times").alias("start"), F.col("v.end_times").alias("end"))
    return cameras.select("camera", F.inline(zipped)).select("camera", "video", F.col("start").try_cast("timestamp_ntz").alias("start"), F.col("end").try_cast("timestamp_ntz").alias("end"))


def refresh_index(known: DataFrame, listed: DataFrame) -> DataFrame:
    """The index without each camera's last video, which may have grown, and without files that are gone, plus unseen files."""
    w = Window.partitionBy("camera").orderBy(F.col("start").desc())
    settled = known.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n").join(listed.select("camera", "video"), ["camera", "video"], "left_semi")
    return settled.unionByName(listed.join(settled.select("camera", "video"), ["camera", "video"], "left_anti"))


def keeper_log(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """A log in which a date holds for all rows up to the next one. ``row`` gives the order; a log is a sheet, so one window is fine."""
    last = F.last(F.col(date), ignorenulls=True).over(Window.partitionBy("file").orderBy("row"))
    return df.select("file", "row", F.coalesce(F.try_to_date(last, "dd.MM.yyyy"), F.try_to_date(last, "yyyy-MM-dd")).alias("date"), *columns)
