"""Polygons with holes: tables (poly, ring, seq, x, y), ring_type exterior or interior, rings not repeated at their end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chains import traced
from ..plans.numbering import checkpointed

#: Steps (row, col) across the sides of a cell: up, right, down, left.
_ACROSS = ((-1, 0), (0, 1), (1, 0), (0, -1))


def from_cells(cells: DataFrame, width: int) -> DataFrame:
    """(poly, ring, ring_type, seq, x, y): corners of the rings around cells (row, col) connected through sides.

    ``width`` is above every column; poly is row * width + col of the first cell.
    Rings run along the sides towards cells outside, cells on their right, and
    turn right where cells touch at a corner, so that they never cross. ring
    counts the rings of a polygon; holes are interior. Traced by pointer
    doubling, whatever the size of a polygon.
    """
    from .domains import cell_components

    own = cells.select("row", "col").distinct()
    around = [(k, dr, dc) for k, (dr, dc) in enumerate(_ACROSS)] + [(4 + k, _ACROSS[k][0] + _ACROSS[(k + 1) % 4][0], _ACROSS[k][1] + _ACROSS[(k + 1) % 4][1]) for k in range(4)]
    near = own.select("row", "col", F.inline(F.array(*[F.struct(F.lit(1 << k).alias("bit"), (F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c")) for k, dr, dc in around])))
    met = near.join(own.select(F.col("row").alias("r"), F.col("col").alias("c")), ["r", "c"], "left_semi").groupBy("row", "col").agg(F.sum("bit").alias("mask"))
    marked = own.join(met, ["row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    has = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    edge = lambda r, c, k: F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(k).alias("side"))

    def side(k: int) -> Column:
        turn = (k + 1) % 4
        over, corner = _ACROSS[turn], tuple(a + b for a, b in zip(_ACROSS[k], _ACROSS[turn]))
        after = F.when(~has(turn), edge(0, 0, turn)).when(~has(4 + k), edge(*over, k)).otherwise(edge(*corner, (k + 3) % 4))
        return F.when(~has(k), F.struct(edge(0, 0, k).alias("id"), after.alias("after")))

    edges = checkpointed(marked.select(F.inline(F.filter(F.array(*[side(k) for k in range(4)]), lambda e: e.isNotNull()))))
    found = traced(edges.select(F.col("after").alias("id"), F.col("id").alias("prev")))
    named = found.join(edges.select(F.col("after").alias("id"), F.col("id.side").alias("_from")), "id").where("id.side <> _from")  # corners only
    poly = cell_components(own, width).select("row", "col", F.col("component").alias("poly"))
    placed = named.join(poly, (F.col("id.row") == F.col("row")) & (F.col("id.col") == F.col("col")))
    right, below = F.col("id.side").isin(1, 2), F.col("id.side").isin(2, 3)
    placed = placed.select("poly", "root", "seq", (F.col("id.col") + F.when(right, 0.5).otherwise(-0.5)).alias("x"), (F.col("id.row") + F.when(below, 0.5).otherwise(-0.5)).alias("y"))
    rings = placed.groupBy("poly", "root").agg(F.first("poly").alias("_p"))
    # the first side in the order of rows belongs to the outer ring
    number = rings.select("root", (F.row_number().over(Window.partitionBy("poly").orderBy("root")) - 1).alias("ring"))
    out = placed.join(number, "root")
    return out.select("poly", "ring", F.when(F.col("ring") == 0, "exterior").otherwise("interior").alias("ring_type"), F.col("seq").cast("int").alias("seq"), "x", "y")


def from_contours(cells: DataFrame, level: float) -> DataFrame:
    """(poly, ring, ring_type, seq, x, y): the ground at or above ``level``, its borders interpolated between cells (row, col, z).

    Beyond the raster, and in cells without a value, there is no ground: borders
    close along the centres of the last cells. Each hole belongs to the smallest
    exterior ring that holds it; poly is a hash of its line.
    """
    from .raster import contour_lines

    known = cells.where("z is not null").select("row", "col", "z")
    around = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    rim = known.select(F.inline(around)).distinct().join(known.select("row", "col"), ["row", "col"], "left_anti")
    lines = contour_lines(known.unionByName(rim.withColumn("z", F.lit(float(level) - 1e12))), level)
    last = Window.partitionBy("line")
    points = lines.withColumn("_last", F.max("seq").over(last)).where("seq < _last")  # the end repeats the start
    rings = checkpointed(points.select(F.xxhash64("line").alias("poly"), F.lit(0).alias("ring"), "seq", "x", "y"))
    sized = measures(rings).select("poly", "area")
    outer, inner = sized.where("area > 0"), sized.where("area < 0")
    exterior = rings.join(outer.select("poly"), "poly", "left_semi")
    first = rings.where("seq = 0").join(inner.select("poly"), "poly", "left_semi").select(F.col("poly").alias("pid"), "x", "y")
    held = containing(first, exterior).join(outer, "poly").groupBy("pid").agg(F.min_by("poly", "area").alias("owner"))
    number = held.select("owner", "pid", F.row_number().over(Window.partitionBy("owner").orderBy("pid")).alias("ring"))
    holes = rings.drop("ring").join(number.withColumnRenamed("pid", "poly"), "poly").select(F.col("owner").alias("poly"), "ring", F.lit("interior").alias("ring_type"), "seq", "x", "y")
    return exterior.select("poly", "ring", F.lit("exterior").alias("ring_type"), "seq", "x", "y").unionByName(holes)


def measures(polygons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_corners, area, length) of rings: signed area (positive: left turns in x, y) and circumference."""
    keys = keys or ["poly", "ring"]
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = polygons.withColumn("_x", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("_y", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    return p.groupBy(*keys).agg(F.count("*").alias("n_corners"), (F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2).alias("area"), F.sum(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y"))).alias("length"))


def implode(polygons: DataFrame) -> DataFrame:
    """(poly, rings): one row a polygon, its rings as arrays of points, the exterior first."""
    rings = polygons.groupBy("poly", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return rings.groupBy("poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))


def explode(imploded: DataFrame) -> DataFrame:
    """The table of rings of ``implode``'s rows."""
    rings = imploded.select("poly", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("poly", "ring", F.posexplode("points").alias("seq", "p"))
    return points.select("poly", "ring", F.when(F.col("ring") == 0, "exterior").otherwise("interior").alias("ring_type"), "seq", "p.x", "p.y")


def problems(polygons: DataFrame) -> DataFrame:
    """(poly, ring, problem) of rings that aren't valid: fewer than three corners, no area, or a corner visited twice."""
    m = measures(polygons)
    few = m.where("n_corners < 3").select("poly", "ring", F.lit("few corners").alias("problem"))
    flat = m.where("n_corners >= 3 and area = 0").select("poly", "ring", F.lit("no area").alias("problem"))
    twice = polygons.groupBy("poly", "ring", "x", "y").count().where("count > 1").select("poly", "ring", F.lit("repeated corner").alias("problem")).distinct()
    return few.unionByName(flat).unionByName(twice)


def containing(points: DataFrame, polygons: DataFrame, size: float = 8.0) -> DataFrame:
    """Points (pid, x, y) with the poly that holds them, by the even-odd rule over all rings; a left or lower border is inside.

    Sides of rings are filed under the grid rows that they cross, with the
    polygon's columns in between, so that a point meets only polygons near it.
    """
    w = Window.partitionBy("poly", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = polygons.withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    s = s.select("poly", "x", "y", "x2", "y2").where("y <> y2")
    band = lambda c: F.floor(c / size)
    filed = s.withColumn("_band", F.explode(F.sequence(band(F.least("y", "y2")), band(F.greatest("y", "y2")))))
    p = points.select("pid", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("_band", band(F.col("py")))
    at = F.col("x") + (F.col("py") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    crossed = ((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < at)
    met = p.join(filed, "_band").where(crossed).groupBy("pid", "poly").agg((F.count("*") % 2).alias("odd"))
    return met.where("odd = 1").select("pid", "poly")


def triangulate(polygons: DataFrame) -> DataFrame:
    """(poly, tri, xs, ys): triangles of polygons between their own corners, n - 2 of n corners and two more for each hole.

    Ears are cut off one by one; holes are first joined to the ring around them
    by a pair of sides. A polygon is cut in one task; a task takes them row by row.
    """

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"poly": [], "tri": [], "xs": [], "ys": []}
            for poly, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, t in enumerate(ears(bridged([[(p["x"], p["y"]) for p in r] for r in rings]))):
                    for name, value in zip(out, (poly, k, [p[0] for p in t], [p[1] for p in t])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("poly", pa.int64()), ("tri", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))]))

    return implode(polygons.select("poly", "ring", "seq", "x", "y")).mapInArrow(cut, "poly long, tri int, xs array<double>, ys array<double>")


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _signed(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def bridged(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """One ring, left turns outside, that runs into each hole (from right to left) and back again."""
    outer = rings[0] if _signed(rings[0]) > 0 else rings[0][::-1]
    holes = [h if _signed(h) < 0 else h[::-1] for h in rings[1:]]
    for hole in sorted(holes, key=lambda h: -max(h)[0]):
        i = max(range(len(hole)), key=lambda k: hole[k])
        m = hole[i]
        near = sorted((j for j, p in enumerate(outer) if p == m or p[0] > m[0]), key=lambda j: math.hypot(outer[j][0] - m[0], outer[j][1] - m[1]))
        end = next((j for j in near if _joins(outer, j, hole, i)), None)
        if end is None:
            raise ValueError("a hole isn't inside of its polygon")
        outer = outer[: end + 1] + hole[i:] + hole[: i + 1] + outer[end:]
    return outer


def _joins(outer, j: int, hole, i: int) -> bool:
    """Whether the side from hole[i] to outer[j] runs inside of ``outer``, on that side of a corner visited several times, and meets nothing else."""
    m, p = hole[i], outer[j]
    if p == m:
        return _opens(outer, j, hole[i - 1]) and _opens(outer, j, hole[(i + 1) % len(hole)])
    if not _opens(outer, j, m):
        return False
    between = lambda q: _turn(m, p, q) == 0 and min(m, p) < q < max(m, p)
    for a, b in zip(outer, outer[1:] + outer[:1]):
        if between(a):
            return False
        if a not in (m, p) and b not in (m, p):
            s, t = _turn(m, p, a), _turn(m, p, b)
            u, v = _turn(a, b, m), _turn(a, b, p)
            if (s > 0 > t or s < 0 < t) and (u >= 0 >= v or u <= 0 <= v):
                return False
    return True


def _opens(ring, j: int, q) -> bool:
    """Whether a side from ring[j] to q starts inside of the ring, left turns outside."""
    a, b, c = ring[j - 1], ring[j], ring[(j + 1) % len(ring)]
    if _turn(a, b, c) > 0:
        return _turn(a, b, q) > 0 and _turn(b, c, q) > 0
    return _turn(a, b, q) > 0 or _turn(b, c, q) > 0


def _within(p, a, b, c) -> bool:
    s = [_turn(a, b, p), _turn(b, c, p), _turn(c, a, p)]
    return min(s) >= 0 or max(s) <= 0


def ears(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles of a ring with left turns outside."""
    at, out = list(range(len(ring))), []
    while len(at) > 3:
        for strict in (True, False):
            k = next((k for k in range(len(at)) if _is_ear(ring, at, k, strict)), None)
            if k is not None:
                break
        if k is None:
            raise ValueError("a polygon crosses itself")
        out.append((ring[at[k - 1]], ring[at[k]], ring[at[(k + 1) % len(at)]]))
        del at[k]
    return [*out, tuple(ring[i] for i in at)] if len(at) == 3 else out


def _is_ear(ring, at, k, strict: bool) -> bool:
    a, b, c = ring[at[k - 1]], ring[at[k]], ring[at[(k + 1) % len(at)]]
    turn = _turn(a, b, c)
    if turn < 0 or (strict and turn == 0):
        return False
    if turn == 0:
        return True
    n = len(at)
    for o in range(n):
        p = ring[at[o]]
        if p in (a, b, c):
            if (o - k + 1) % n > 2 and any(_between(p, q, a, b, c) for q in (ring[at[o - 1]], ring[at[(o + 1) % n]])):
                return False
        elif _within(p, a, b, c):
            return False
    return True


def _between(p, q, a, b, c) -> bool:
    """Whether a side from p, a corner of the triangle, to q starts within it."""
    first, last = {a: (b, c), b: (c, a), c: (a, b)}[p]
    return _turn(p, first, q) > 0 > _turn(p, last, q)
