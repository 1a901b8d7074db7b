"""Interpolation onto points: from rasters, and from meshes by barycentric weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spatial import bucket, nearest
from .mesh import corners, triangulation


def from_raster_linear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (pid, x, y) with z between the four cells around (x to columns, y to rows); no row outside or at missing cells.

    The cells are gathered by fours, so that a point stays one row and meets them once.
    """
    corners_ = [(i, j) for i in (0, 1) for j in (0, 1)]
    part = F.inline(F.array(*[F.struct((F.col("row") - i).cast("long").alias("r0"), (F.col("col") - j).cast("long").alias("c0"), F.lit(k).alias("k")) for k, (i, j) in enumerate(corners_)]))
    fours = cells.where("z is not null").select("z", part).groupBy("r0", "c0").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"_z{k}") for k in range(4)])
    at = points.withColumn("c0", F.floor("x").cast("long")).withColumn("r0", F.floor("y").cast("long"))
    fx, fy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    z, gap = F.lit(0.0), F.lit(False)
    for k, (i, j) in enumerate(corners_):
        w = (fy if i else 1 - fy) * (fx if j else 1 - fx)
        gap = gap | ((w > 0) & F.col(f"_z{k}").isNull())  # a point on a line of cells needs only those
        z = z + F.when(w > 0, w * F.col(f"_z{k}")).otherwise(0.0)
    return at.join(fours, ["r0", "c0"]).where(~gap).select("pid", z.alias("z"))


def from_raster_cubic(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with z by cubic convolution of the 4 x 4 cells around (parameter -0.5): smooth like a bicubic spline, exact at cells, local.

    No row where one of the sixteen cells is missing or outside of the grid.
    """
    at = points.withColumn("c0", F.floor("x").cast("long")).withColumn("r0", F.floor("y").cast("long"))
    at = at.withColumn("fx", F.col("x") - F.col("c0")).withColumn("fy", F.col("y") - F.col("r0"))

    def weight(t, k):  # of the cell k - 1 steps from the one below
        return [((-0.5 * t + 1.0) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1.0, ((-1.5 * t + 2.0) * t + 0.5) * t, (0.5 * t - 0.5) * t * t][k]

    part = F.array(*[F.struct((F.col("r0") + i - 1).alias("row"), (F.col("c0") + j - 1).alias("col"), (weight(F.col("fy"), i) * weight(F.col("fx"), j)).alias("w")) for i in range(4) for j in range(4)])
    met = at.select("pid", F.inline(part)).join(cells.where("z is not null").select("row", "col", "z"), ["row", "col"])
    return met.groupBy("pid").agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count("*").alias("n")).where("n = 16").select("pid", "z")


def from_raster_nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with z of the cell whose centre is nearest (halves go up)."""
    at = points.withColumn("col", F.floor(F.col("x") + 0.5).cast("long")).withColumn("row", F.floor(F.col("y") + 0.5).cast("long"))
    return at.join(cells.where("z is not null").select("row", "col", "z"), ["row", "col"]).select("pid", "z")


def from_mesh(points: DataFrame, elements: DataFrame, nodes: DataFrame, size: float = 4.0) -> DataFrame:
    """(pid, value) by barycentric weights in the triangle that holds a point; on shared borders that of the smallest (elem_id, part).

    Points outside of all elements have no row. Triangles are filed under all
    grid buckets that their extent meets.
    """
    t = triangulation(elements).select("elem_id", F.when(F.col("part") == 0, "a").otherwise("b").alias("etype"), "nodes", "part")
    c = corners(t.select((F.col("elem_id") * 2 + F.col("part")).alias("elem_id"), "etype", "nodes"), nodes)
    span = lambda a: F.sequence(F.floor(F.array_min(a) / size), F.floor(F.array_max(a) / size))
    filed = c.withColumn("_x", F.explode(span("xs"))).withColumn("_y", F.explode(span("ys"))).withColumn("_b", F.struct(F.col("_x").alias("bx"), F.col("_y").alias("by")))
    met = points.withColumn("_b", bucket("x", "y", size)).join(filed, "_b")
    x, y = (lambda i: F.get("xs", F.lit(i))), (lambda i: F.get("ys", F.lit(i)))
    det = (y(1) - y(2)) * (x(0) - x(2)) + (x(2) - x(1)) * (y(0) - y(2))
    w0 = ((y(1) - y(2)) * (F.col("x") - x(2)) + (x(2) - x(1)) * (F.col("y") - y(2))) / det
    w1 = ((y(2) - y(0)) * (F.col("x") - x(2)) + (x(0) - x(2)) * (F.col("y") - y(2))) / det
    met = met.where(det != 0).withColumn("w0", w0).withColumn("w1", w1).where((F.col("w0") >= 0) & (F.col("w1") >= 0) & (F.col("w0") + F.col("w1") <= 1))
    v = lambda i: F.get("values", F.lit(i))
    value = F.col("w0") * v(0) + F.col("w1") * v(1) + (1 - F.col("w0") - F.col("w1")) * v(2)
    return met.groupBy("pid").agg(F.min_by(value, "elem_id").alias("value"))


def nearest_value(points: DataFrame, places: DataFrame, start: float = 2.0) -> DataFrame:
    """(pid, value) of the nearest place (fid, x, y, value); ties go to the smaller fid."""
    return nearest(points, "pid", places, start).join(places.select("fid", "value"), "fid").select("pid", "value")


def fill_from(first: DataFrame, second: DataFrame) -> DataFrame:
    """Values of ``first`` (pid, value), else of ``second``."""
    return first.join(second.withColumnRenamed("value", "_v"), "pid", "full").select("pid", F.coalesce("value", "_v").alias("value"))


def mesh_contour_segments(elements: DataFrame, nodes: DataFrame, level: float) -> DataFrame:
    """(elem_id, u, v, x, y): where a level crosses the sides of triangles; raises at missing values."""
    c = corners(triangulation(elements).where("part = 0 or part = 1").select((F.col("elem_id") * 2 + F.col("part")).alias("elem_id"), F.lit("tria").alias("etype"), "nodes"), nodes)
    side = lambda i: F.struct(*[F.get(a, F.lit(k)).alias(n) for a, k, n in (("nodes", i, "na"), ("nodes", (i + 1) % 3, "nb"), ("xs", i, "xa"), ("xs", (i + 1) % 3, "xb"), ("ys", i, "ya"), ("ys", (i + 1) % 3, "yb"), ("values", i, "za"), ("values", (i + 1) % 3, "zb"))])
    s = c.select("elem_id", F.inline(F.array(*[side(i) for i in range(3)])))
    swap = F.col("na") > F.col("nb")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    s = s.select("elem_id", pick("na", "nb").alias("u"), pick("nb", "na").alias("v"), pick("xa", "xb").alias("x1"), pick("xb", "xa").alias("x2"), pick("ya", "yb").alias("y1"), pick("yb", "ya").alias("y2"), pick("za", "zb").alias("z1"), pick("zb", "za").alias("z2"))
    bad = F.col("z1").isNull() | F.col("z2").isNull() | F.isnan("z1") | F.isnan("z2")
    s = s.where(F.when(bad, F.raise_error(F.lit("a node has no value")).cast("boolean")).otherwise((F.col("z1") >= level) != (F.col("z2") >= level)))
    t = (F.lit(float(level)) - F.col("z1")) / (F.col("z2") - F.col("z1"))
    return s.select("elem_id", "u", "v", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
