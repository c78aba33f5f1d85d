"""Which positions lie in a camera's zones, where zones are a table of polygons.

A grid over the frame is the index: each cell that a polygon meets is either wholly inside it or has to be tested. Positions are joined by (camera, frame
size, cell), an equi-join that adds no rows, as the index has one row a cell; only positions in cells on an edge need the polygon's edges.
Frames get their zones by position, so lists are as many as there are pixels at most, and zones of a frame aren't tested again for the next.
All coordinates are whole pixels, so the tests are exact; points on an edge are inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a cell's side.
CELL = 64


def rescaled(zones: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (camera, width, height, zone, px, py): each zone in each size that its camera's frames have, coordinates cut to whole pixels.

    ``zones`` has (camera, zone, px, py, of_width, of_height): arrays of corners in a frame of a given size. ``sizes`` has (camera, width, height). A
    polygon of fewer than three corners, or with a null in it, is left out.
    """
    whole = lambda c, to, of: F.transform(c, lambda v: (v * F.col(to) / F.col(of)).cast("int"))
    fit = zones.where((F.size("px") > 2) & (F.size("px") == F.size("py")) & ~F.exists("px", lambda v: v.isNull()) & ~F.exists("py", lambda v: v.isNull()))
    both = fit.join(sizes.dropna().distinct(), "camera")
    return both.select("camera", "width", "height", "zone", whole("px", "width", "of_width").alias("px"), whole("py", "height", "of_height").alias("py"))


def edges(px: Column, py: Column) -> Column:
    """The edges of a polygon as structs (ax, ay, bx, by), the last corner joined to the first."""
    n = F.size(px)
    long = lambda c, i: F.get(c, i).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(long(px, i).alias("ax"), long(py, i).alias("ay"), long(px, (i + 1) % n).alias("bx"), long(py, (i + 1) % n).alias("by")))


def _side(e: Column, x: Column, y: Column) -> Column:
    """The sign says on which side of an edge's line a point lies; 0 is on it."""
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])


def inside(poly: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a polygon given by its ``edges``, those included."""
    on = F.exists(poly, lambda e: (_side(e, x, y) == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    # An edge that passes the point's height is crossed if it lies to the right: the side's sign says so, without a division.
    crossed = lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((_side(e, x, y) > 0) == (e["by"] > e["ay"]))
    return on | (F.size(F.filter(poly, crossed)) % 2 == 1)


def grid_index(zones: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows (camera, width, height, cx, cy, whole, test) of ``rescaled`` zones: for each cell whether a zone covers it wholly, and the edges of those that may cover a part."""
    span = lambda c: F.sequence(F.floor(F.array_min(c) / cell).cast("int"), F.floor(F.array_max(c) / cell).cast("int"))
    # The table of zones is small and the work on its cells isn't, so it is dealt to many tasks.
    many = zones.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")), "camera", "width", "height", "zone")
    rows = many.withColumn("cx", F.explode(span("px"))).withColumn("cy", F.explode(span("py"))).withColumn("poly", edges(F.col("px"), F.col("py")))
    x0, y0 = F.col("cx").cast("long") * cell, F.col("cy").cast("long") * cell
    x1, y1 = x0 + (cell - 1), y0 + (cell - 1)

    def meets(e: Column) -> Column:
        """Whether an edge can touch the cell: their boxes overlap and the cell's corners aren't all on one side of its line."""
        apart = (F.greatest(e["ax"], e["bx"]) < x0) | (F.least(e["ax"], e["bx"]) > x1) | (F.greatest(e["ay"], e["by"]) < y0) | (F.least(e["ay"], e["by"]) > y1)
        corners = [_side(e, a, b) for a in (x0, x1) for b in (y0, y1)]
        return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    partly = F.exists("poly", meets)
    kept = rows.withColumn("part", partly).where(F.col("part") | inside(F.col("poly"), x0, y0))
    return kept.groupBy("camera", "width", "height", "cx", "cy").agg(F.max(~F.col("part")).alias("whole"), F.collect_list(F.when(F.col("part"), F.struct("zone", "poly"))).alias("test"), F.collect_list(F.when(~F.col("part"), F.col("zone"))).alias("covers"))


def in_zones(frames: DataFrame, zones: DataFrame, x: str, y: str, cell: int = CELL) -> DataFrame:
    """``frames`` (camera, width, height, x, y, ..) with ``zones``: the sorted zones of its camera that its position is in; empty where it is in none or isn't known.

    ``zones`` as in ``rescaled``. Frames are on whole pixels, so many share a position: each position of a camera and size is tested once, and its list is joined
    to its frames. Frames with a null camera, size or position are kept.
    """
    index = grid_index(rescaled(zones, frames.select("camera", "width", "height")), cell).select("camera", "width", "height", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "covers", "test")
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    px, py = F.col(x).cast("long"), F.col(y).cast("long")
    place = ["camera", "width", "height", x, y]
    rows = frames.select(*place).distinct().withColumn("_cx", at(x)).withColumn("_cy", at(y)).join(index, ["camera", "width", "height", "_cx", "_cy"])
    tested = F.transform(F.filter("test", lambda t: inside(t["poly"], px, py)), lambda t: t["zone"])
    found = rows.select(*place, F.array_sort(F.concat("covers", tested)).alias("zones")).where(F.size("zones") > 0)
    return frames.join(found, place, "left").withColumn("zones", F.coalesce("zones", F.array().cast(f"array<{zones.schema['zone'].dataType.simpleString()}>")))


def outside(frames: DataFrame, zones: DataFrame, x: str, y: str, cell: int = CELL) -> DataFrame:
    """The frames whose position is in no zone of their camera."""
    return in_zones(frames, zones, x, y, cell).where(F.size("zones") == 0).drop("zones")
