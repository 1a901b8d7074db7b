"""Spatial joins by grid buckets: equi-joins, never a product of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import checkpointed

#: Times that a cell is halved at most, and before the first comparison (of 64 cells with 64 at most).
_HALVES, _FIRST = 30, 3
#: Places that are broadcast to the points at most.
_SENT = 1 << 13


def bucket(x: str, y: str, size: float) -> Column:
    return F.struct(F.floor(F.col(x) / size).alias("bx"), F.floor(F.col(y) / size).alias("by"))


def around(x: str, y: str, size: float) -> Column:
    """The bucket of a point and its eight neighbours."""
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    return F.explode(F.array(*[F.struct((bx + i).alias("bx"), (by + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def nearest_within(points: DataFrame, key: str, targets: DataFrame, radius: float, target_key: str = "fid") -> DataFrame:
    """(key, target_key, d2) of the nearest target at a distance of ``radius`` or less (ties: smaller target_key).

    ``points`` has x, y; ``targets`` x, y. Points without one are left out. A
    point meets its own bucket and eight others only.
    """
    p = points.select(key, "x", "y").withColumn("_b", bucket("x", "y", radius))
    t = targets.select(target_key, F.col("x").alias("_tx"), F.col("y").alias("_ty")).withColumn("_b", around("_tx", "_ty", radius))
    d2 = (F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx")) + (F.col("y") - F.col("_ty")) * (F.col("y") - F.col("_ty"))
    met = p.join(t, "_b").select(key, target_key, d2.alias("d2")).where(F.col("d2") <= radius * radius)
    return met.groupBy(key).agg(F.min(F.struct("d2", target_key)).alias("m")).select(key, f"m.{target_key}", "m.d2")


#: Targets that a cell's points are compared with one by one; above it cells are halved.
MET = 64


def nearest(points: DataFrame, key: str, targets: DataFrame, start: float, target_key: str = "fid") -> DataFrame:
    """(key, target_key, d2) of the nearest target of every point, at any distance (ties: smaller target_key).

    Distinct places of points and of targets are cut into square cells, halved
    together round by round, down from one that covers all (of ``start`` if that
    has no extent). A cell of points keeps only the cells of targets that can hold
    the nearest one of any of its points, by the bounds of what lies in both.
    Where those hold ``MET`` targets or fewer, each point looks through them;
    so neither far points nor crowded targets meet everything. Points, targets and
    cells are joined by merging: a broadcast would gather them on the driver.
    """
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    t = checkpointed(targets.where(known).groupBy("x", "y").agg(F.min(target_key).alias(target_key)))
    p = checkpointed(points.where(known).select("x", "y").distinct())
    extent = t.select("x", "y").unionByName(p).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    if t.isEmpty() or p.isEmpty():
        return points.sparkSession.createDataFrame([], nearest_within(points, key, targets, start, target_key).schema)
    size = max(extent.w, extent.h) or start
    part = lambda c, low, k: F.least(F.floor((F.col(c) - low) / size * 2.0**k), F.lit(2**k - 1))
    cell = lambda k: part("x", extent.x0, k) * 2**_HALVES + part("y", extent.y0, k)
    bounds = [F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb")]

    def cells(df: DataFrame, up: int, k: int, side: str) -> DataFrame:
        """Cells of level k: (the one they are part of), themselves, bounds and rows."""
        found = df.groupBy(cell(up).alias(f"{side}up"), cell(k).alias(side)).agg(*bounds, F.count("*").alias("n"))
        return found.select(f"{side}up", side, *[F.col(c).alias(side + c) for c in ("xa", "xb", "ya", "yb", "n")])

    gap = lambda c: F.greatest(F.col(f"p{c}a") - F.col(f"t{c}b"), F.col(f"t{c}a") - F.col(f"p{c}b"), F.lit(0.0))
    reach = lambda c: F.greatest(F.col(f"p{c}b") - F.col(f"t{c}a"), F.col(f"t{c}b") - F.col(f"p{c}a"))
    least, most = gap("x") * gap("x") + gap("y") * gap("y"), reach("x") * reach("x") + reach("y") * reach("y")
    d2 = lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])
    own = Window.partitionBy("p")
    pairs, found, up, k = None, None, _FIRST - 1, _FIRST
    while True:
        ours, theirs = cells(p, up, k, "p"), cells(t, up, k, "t")
        met = ours.crossJoin(theirs) if pairs is None else pairs.select(F.col("p").alias("pup"), F.col("t").alias("tup")).join(ours.hint("merge"), "pup").join(theirs.hint("merge"), "tup")
        met = met.select("p", "t", "tn", least.alias("least"), F.min(most).over(own).alias("_most")).where(F.col("least") <= F.col("_most") * (1 + 1e-9))
        met = checkpointed(met.select("p", "t", F.sum("tn").over(own).alias("n")))
        done = met if k == _HALVES else met.where(F.col("n") <= MET)
        pairs = met.where(F.col("n") > MET)
        left = pairs.count()
        last = k == _HALVES or not left
        if last or not done.isEmpty():
            held = done.join(t.withColumn("t", cell(k)).hint("merge"), "t").groupBy("p").agg(F.collect_list(F.struct("x", "y", target_key)).alias("c"))
            one = F.array_min(F.transform("c", lambda c: F.struct(d2(c).alias("d2"), c[target_key].alias(target_key))))
            now = checkpointed(p.withColumn("p", cell(k)).hint("merge").join(held, "p").select("x", "y", one.alias("m")))
            found = now if found is None else found.unionByName(now)
        if last:
            found = F.broadcast(found) if found.count() <= _SENT else found.hint("merge")  # points are never sent to the driver
            return points.where(known).select(key, "x", "y").join(found, ["x", "y"]).select(key, f"m.{target_key}", "m.d2")
        up, k = k, min(_HALVES, k + (3 if left <= 1 << 10 else 2 if left <= 1 << 14 else 1))  # few pairs are halved several times at once


def boxes_of(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (x0, y0, x1, y1) with a row for each bucket that they meet."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return boxes.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1"))).withColumn("_b", F.struct(F.col("_bx").alias("bx"), F.col("_by").alias("by"))).drop("_bx", "_by")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 8.0, closed: bool = False) -> DataFrame:
    """Points (x, y) joined with the boxes that hold them; borders are out unless ``closed``."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1")) if closed else (x > F.col("x0")) & (x < F.col("x1")) & (y > F.col("y0")) & (y < F.col("y1"))
    return points.withColumn("_b", bucket("x", "y", size)).join(boxes_of(boxes, size), "_b").where(inside).drop("_b")


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]], closed: bool = True) -> Column:
    """Even-odd test against a literal ring (not repeated at its end); its border counts as inside if ``closed``."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = F.lit(float(x1)) + (y - float(y1)) * (float(x2 - x1) / float(y2 - y1))
            crossings = crossings + (((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at)).cast("int")
        cross = (x - float(x1)) * float(y2 - y1) - (y - float(y1)) * float(x2 - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    odd = crossings % 2 == 1
    return (odd | on_edge) if closed else (odd & ~on_edge)
