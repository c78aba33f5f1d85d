"""Annotation and training sets: histograms, masks, merges, allow lists, splits, companions and folders."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.marts import surrogate_ids


def annotation_points(df: DataFrame, keys: list[str], start: str, fps: float, annotations: str) -> DataFrame:
    """Rows (keys, frame, us, label, x, y) from annotations by frame: the mean of each record's points, at the frame's time.

    ``annotations`` is a map of frame number (text) to records (label, points (x, y)); frames count from ``start`` in microseconds.
    """
    rows = df.select(*keys, start, F.explode(annotations).alias("frame", "records")).select(*keys, start, F.col("frame").cast("long").alias("frame"), F.explode("records").alias("r"))
    mean = lambda c: F.aggregate("r.points", F.lit(0.0), lambda s, p: s + p[c], lambda s: F.when(F.size("r.points") > 0, s / F.size("r.points")))
    return rows.select(*keys, "frame", (F.col(start) + F.round(F.col("frame") * 1e6 / fps).cast("long")).alias("us"), F.col("r.label").alias("label"), mean("x").alias("x"), mean("y").alias("y"))


def annotated_share(df: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """Rows (keys, n, share): how many items there are and what share has an annotation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.size(labels) > 0, 1.0).otherwise(0.0)).alias("share"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def only_listed(df: DataFrame, listed: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """The rows whose key is on a list, or (``keep`` false) is not: allow lists, skip lists, files to remove."""
    return df.join(listed.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def without_dates(df: DataFrame, date: str, skipped: list[str]) -> DataFrame:
    """The rows of all but a few dates; rows without a date stay."""
    return df.where(~F.coalesce(F.col(date).cast("string").isin(skipped), F.lit(False)))


def labelled_union(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Several sets as one, each row with the name of its set."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(label, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def mask_runs(pixels: DataFrame, keys: list[str], x: str, y: str, height: int) -> DataFrame:
    """Rows (keys, area, x1, y1, x2, y2, runs): column-major run-length code of a mask, with its area and bounding box.

    ``pixels`` has a row for each set pixel. ``runs`` alternates unset and set pixels from the first column on, as usual for such codes;
    the unset pixels at the end are left out.
    """
    place = pixels.select(*keys, x, y).distinct().withColumn("_p", F.col(x).cast("long") * height + F.col(y))
    w = Window.partitionBy(*keys).orderBy("_p")
    marked = place.withColumn("_new", F.coalesce(F.col("_p") - F.lag("_p").over(w) > 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "_run").agg(F.min("_p").alias("_a"), (F.max("_p") + 1).alias("_b"), F.count("*").alias("_n"), *[f(c).alias(f"_{n}") for n, f, c in (("x1", F.min, x), ("y1", F.min, y), ("x2", F.max, x), ("y2", F.max, y))])
    before = F.coalesce(F.lag("_b").over(Window.partitionBy(*keys).orderBy("_run")), F.lit(0))
    code = runs.withColumn("_gap", F.col("_a") - before)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_gap", "_n"))), lambda r: F.array(r["_gap"], r["_n"])))
    return code.groupBy(*keys).agg(F.sum("_n").alias("area"), F.min("_x1").alias("x1"), F.min("_y1").alias("y1"), F.max("_x2").alias("x2"), F.max("_y2").alias("y2"), listed.alias("runs"))


def merge_annotations(images: DataFrame, annotations: DataFrame, source: str, image_id: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of several sets with ids that are unique over all: numbered by set and old id, annotations following their image."""
    numbered = surrogate_ids(images, [source, image_id], "new_id")
    remapped = annotations.join(numbered.select(source, image_id, "new_id"), [source, image_id])
    return numbered, remapped


def last_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The last ``k`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def companions(df: DataFrame, keys: list[str], individual: str, fallback: Column | None = None) -> DataFrame:
    """Rows (keys, individual, companions): who else is there, in order of name; without anyone, or without a key or a name, a fallback.

    Each individual comes out of its group's list, so only single rows are shuffled; lists never are.
    """
    there = df.groupBy(*keys).agg(F.array_sort(F.collect_set(individual)).alias("_all"), F.bool_or(F.col(individual).isNull()).alias("_unnamed"))
    each = F.when(F.col("_unnamed"), F.array_append("_all", F.lit(None).cast(df.schema[individual].dataType))).otherwise(F.col("_all"))
    rows = there.select(*keys, "_all", F.explode(each).alias(individual))
    others = F.when(F.col(individual).isNotNull() & reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True)), F.array_remove("_all", F.col(individual)))
    return rows.select(*keys, individual, F.when(F.size(others) > 0, F.array_join(others, ",")).otherwise(fallback if fallback is not None else F.lit("")).alias("companions"))


def night_offset(us: Column, night_start: Column) -> Column:
    """Microseconds since the night began, so that several nights can be laid over each other."""
    return us - night_start


def single_animal(label: Column, known: Column) -> Column:
    """Where one animal alone is known to be there, every track is that animal."""
    return F.when(F.size(known) == 1, F.get(known, F.lit(0))).otherwise(label)


def output_folder(label: Column, named: Column) -> Column:
    """The folder of an identity: its own, or ``invalid`` where the file's name doesn't name it."""
    return F.when(F.array_contains(named, label), label).otherwise("invalid")


def identity_files(paths: DataFrame, path: str) -> DataFrame:
    """Rows (path, identity, camera, year) from ``<identity>/<...>camera<N>_<YYYY>...`` paths; those of another form are left out."""
    p = F.col(path)
    rows = paths.select(p, F.regexp_extract(p, r"([^/]+)/[^/]*$", 1).alias("identity"), F.regexp_extract(p, r"[Cc]am(?:era)?_?(\d+)", 1).alias("camera"), F.regexp_extract(p, r"(?:^|[^0-9])((?:19|20)\d{2})", 1).alias("year"))
    return rows.where((F.col("identity") != "") & (F.col("camera") != "") & (F.col("year") != "")).withColumn("camera", F.col("camera").cast("int")).withColumn("year", F.col("year").cast("int"))


def seeded_share(df: DataFrame, key: str, seed: int, share: float, name: str = "held_out") -> DataFrame:
    """Marks a share of the rows by a seeded hash of their key: the same ones in every run, whatever the partitions."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def split_by_year(df: DataFrame, date: str, test_years: list[int]) -> DataFrame:
    """``part``: test for a few years, train for the rest."""
    return df.withColumn("part", F.when(F.year(date).isin(test_years), "test").otherwise("train"))


def bounds(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """First start and last end of each key."""
    return df.groupBy(*keys).agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.count("*").alias("n"))


def common_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that all tables have."""
    out = frames[0].select(*keys).distinct()
    for df in frames[1:]:
        out = out.join(df.select(*keys).distinct(), keys, "left_semi")
    return out


def missing_keys(frame: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that the first table has and the second doesn't."""
    return frame.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti")


def page_of(df: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """One page of a listing, from 0."""
    return df.orderBy(*order).offset(size * number).limit(size)
