"""Raster operators over cells (row, col, z); row 0 is on top, null is no data."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spatial import nearest


def ticks(cells: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Add x and y: equal steps from edge to edge of ``bounds`` (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bounds
    x = F.lit(float(x0)) + F.col("col") * ((x1 - x0) / (width - 1) if width > 1 else 0.0)
    y = F.lit(float(y1)) - F.col("row") * ((y1 - y0) / (height - 1) if height > 1 else 0.0)
    return cells.withColumn("x", x).withColumn("y", y)


def window(cells: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    return cells.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def windows(width: int, height: int, chunk: int = 0, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """(row, col, height, width) of square windows; overlap extends to higher rows and columns only."""
    if chunk < 0:
        raise ValueError("chunk must not be negative")
    if not chunk:
        return [(0, 0, height, width)]
    return [(r, c, min(chunk + overlap, height - r), min(chunk + overlap, width - c)) for r in range(0, height, chunk) for c in range(0, width, chunk)]


def with_tiles(cells: DataFrame, chunk: int, overlap: int = 0) -> DataFrame:
    """Cells with the window (tile_row, tile_col) of each; a cell in an overlap has a row for each of its windows."""
    first = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - (chunk + overlap) + chunk) / chunk))
    span = lambda c: F.sequence(first(c).cast("long"), F.floor(F.col(c) / chunk).cast("long"))
    return cells.withColumn("tile_row", F.explode(span("row"))).withColumn("tile_col", F.explode(span("col")))


def bbox(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def sample(cells: DataFrame, points: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Points (with x, y) and the z of the pixel that holds each; null outside and where there is no data."""
    x0, y0, x1, y1 = bounds
    col = F.floor((F.col("x") - x0) / ((x1 - x0) / width)).cast("long")
    row = F.floor((F.lit(float(y1)) - F.col("y")) / ((y1 - y0) / height)).cast("long")
    return points.withColumn("row", row).withColumn("col", col).join(cells.select("row", "col", "z"), ["row", "col"], "left").drop("row", "col")


def clip(cells: DataFrame, inside: Column) -> DataFrame:
    """Cells where ``inside`` holds (a predicate over x, y or row, col)."""
    return cells.where(inside)


def mask(cells: DataFrame, inside: Column) -> DataFrame:
    """All cells, without data where ``inside`` does not hold."""
    return cells.withColumn("z", F.when(inside, F.col("z")))


def adjust(cells: DataFrame, inside: Column | None = None, cond: Callable[[Column], Column] | None = None, inside_min: float = -math.inf, outside_max: float = math.inf) -> DataFrame:
    """Raise z to ``inside_min`` within the mask and lower it to ``outside_max`` elsewhere; missing cells stay so."""
    if inside is None and cond is None:
        raise ValueError("a shape or a condition is needed")
    where = F.lit(True)
    if inside is not None:
        where = where & inside
    if cond is not None:
        where = where & F.coalesce(cond(F.col("z")), F.lit(False))
    z = F.col("z")
    return cells.withColumn("z", F.when(z.isNull(), z).when(where, F.greatest(z, F.lit(float(inside_min)))).otherwise(F.least(z, F.lit(float(outside_max)))))


# -- focal -------------------------------------------------------------------------------


def _reflect(i: Column, n: Column) -> Column:
    """Mirror an index at the borders, border cells repeated (any distance)."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def _along(cells: DataFrame, fixed: str, moving: str, names: list[str], weights: list[float], low: int) -> DataFrame:
    """Weighted sums along rows or columns, borders mirrored; one array a line, JVM only."""
    line = cells.groupBy(fixed).agg(F.array_sort(F.collect_list(F.struct(moving, *names))).alias("a"))
    n = F.size("a")
    out = []
    for name in names:
        values = F.col(f"a.{name}")

        def at(i: Column, values: Column = values) -> Column:
            total = F.lit(0.0)
            for k, w in enumerate(weights):
                total = total + F.get(values, _reflect(i + (low + k), n)) * float(w)
            return total

        out.append(_transform(n, at))
    zipped = F.arrays_zip(F.col(f"a.{moving}").alias(moving), *[c.alias(x) for c, x in zip(out, names)])
    return line.select(fixed, F.inline(zipped))


def _transform(n: Column, at: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i))


def average_filter(cells: DataFrame, size: int, drop_above: float | None = None, drop_below: float | None = None) -> DataFrame:
    """Mean of the ``size`` x ``size`` footprint without missing cells, borders mirrored.

    Even sizes extend one more towards lower indices. Values beyond the drop
    limits count as missing; missing cells stay so, as does a cell whose
    footprint has no value.
    """
    z = F.col("z")
    if drop_above is not None:
        z = F.when(z <= drop_above, z)
    if drop_below is not None:
        z = F.when(z >= drop_below, z)
    valid = cells.select("row", "col", z.alias("z0")).select("row", "col", "z0", F.coalesce("z0", F.lit(0.0)).alias("s"), F.col("z0").isNotNull().cast("double").alias("n"))
    low = -(size // 2)
    across = _along(valid, "row", "col", ["s", "n"], [1.0] * size, low)
    both = _along(across, "col", "row", ["s", "n"], [1.0] * size, low)
    return valid.select("row", "col", "z0").join(both, ["row", "col"]).select("row", "col", F.when(F.col("z0").isNotNull() & (F.col("n") > 0), F.col("s") / F.col("n")).alias("z"))


def gaussian_filter(cells: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian, borders mirrored; cells must have data."""
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    w = [x / sum(w) for x in w]
    across = _along(cells.select("row", "col", F.col("z").cast("double").alias("z")), "row", "col", ["z"], w, -radius)
    return _along(across, "col", "row", ["z"], w, -radius)


def generic_filter(cells: DataFrame, size: int, function: Callable, tile: int = 256) -> DataFrame:
    """``function(footprint array) -> float`` for every cell, on tiles with a halo; borders repeat the edge's mirror image."""
    half = size // 2
    haloed = _halo(cells, tile, half)

    def run(pdf):
        import numpy as np
        import pandas as pd

        r0, c0 = int(pdf.row.min()), int(pdf.col.min())
        a = np.full((int(pdf.row.max()) - r0 + 1, int(pdf.col.max()) - c0 + 1), np.nan)
        a[pdf.row - r0, pdf.col - c0] = pdf.z
        padded = np.pad(a, half, mode="symmetric")
        own = pdf[(pdf.row // tile == pdf.tile_row) & (pdf.col // tile == pdf.tile_col)]
        z = [float(function(padded[r - r0 : r - r0 + size, c - c0 : c - c0 + size].ravel())) for r, c in zip(own.row, own.col)]
        return pd.DataFrame({"row": own.row.to_numpy(), "col": own.col.to_numpy(), "z": z})

    return haloed.groupBy("tile_row", "tile_col").applyInPandas(run, "row long, col long, z double")


def _halo(cells: DataFrame, tile: int, half: int) -> DataFrame:
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile))
    return cells.withColumn("tile_row", F.explode(span("row"))).withColumn("tile_col", F.explode(span("col")))


def gradient(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Add gx and gy: central differences, one-sided at the borders; gy along rows."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def slope(w: Window, step: float) -> Column:
        before, after, z = F.lag("z").over(w), F.lead("z").over(w), F.col("z")
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return F.when(first & last, F.lit(0.0)).when(first, (after - z) / step).when(last, (z - before) / step).otherwise((after - before) / (2 * step))

    return cells.withColumn("gx", slope(across, dx)).withColumn("gy", slope(down, dy))


def slope(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """(row, col, slope) in degrees."""
    return gradient(cells, dx, dy).select("row", "col", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"))


def fill_nearest(cells: DataFrame) -> DataFrame:
    """Missing cells take the value of the nearest cell with data (ties: smaller row, then column).

    Cells are joined by merging: Spark's guess of a file's size would have the driver hold them all.
    """
    at = cells.select(F.struct("row", "col").alias("cell"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z")
    near = nearest(at.where("z is null"), "cell", at.where("z is not null").select(F.col("cell").alias("source"), "x", "y"), 2.0, "source")
    near = near.join(at.select(F.col("cell").alias("source"), F.col("z").alias("_z")).hint("merge"), "source").select("cell.row", "cell.col", "_z")
    return cells.join(near.hint("merge"), ["row", "col"], "left").select("row", "col", F.coalesce("z", "_z").alias("z"))


# -- resampling ----------------------------------------------------------------------------


def resample_average(cells: DataFrame, factor: int) -> DataFrame:
    """Coarser by ``factor``: mean of the cells with data."""
    return cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("z").alias("z"))


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Finer by ``factor``: every cell repeated."""
    k = F.sequence(F.lit(0), F.lit(factor - 1))
    return cells.withColumn("_r", F.explode(k)).withColumn("_c", F.explode(k)).select((F.col("row") * factor + F.col("_r")).alias("row"), (F.col("col") * factor + F.col("_c")).alias("col"), "z")


def warp_nearest(cells: DataFrame, target: DataFrame, back: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Target cells (row, col) with the z of the source cell at ``back(row, col)``, rounded half up; null outside."""
    r, c = back(F.col("row"), F.col("col"))
    t = target.select("row", "col", F.floor(r + 0.5).cast("long").alias("_r"), F.floor(c + 0.5).cast("long").alias("_c"))
    return t.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "z"), ["_r", "_c"], "left").select("row", "col", "z")


def mosaic(cells: DataFrame) -> DataFrame:
    """(row, col, z) of overlapping rasters (raster_id, row, col, z, tie): the largest raster_id wins, then the largest tie."""
    return cells.groupBy("row", "col").agg(F.max_by("z", F.struct("raster_id", "tie")).alias("z"))


# -- statistics -----------------------------------------------------------------------------


def hypsometry(cells: DataFrame) -> DataFrame:
    """(z, n_cum): cells at or below each level.

    Levels, which may be nearly as many as cells, are cut into ranges; sums run
    within ranges, and one row a range brings what lies below it.
    """
    from ..plans.numbering import ranged

    levels = cells.where("z is not null").groupBy("z").agg(F.count("*").alias("n"))
    rows = ranged(levels, "z", "_part")
    below = rows.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))  # RANGES rows at most
    within = F.sum("n").over(Window.partitionBy("_part").orderBy("z"))
    return rows.withColumn("_sum", within).join(F.broadcast(below), "_part").select("z", (F.col("_below") + F.col("_sum")).cast("long").alias("n_cum"))


def slope_bins(cells: DataFrame, low: float, width: float) -> DataFrame:
    """(bin, n, mean_slope) by elevation."""
    s = slope(cells).join(cells.select("row", "col", "z"), ["row", "col"])
    return s.groupBy(F.floor((F.col("z") - low) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("slope").alias("mean_slope"))


def classes(cells: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """(row, col, class): the first inclusive range that holds z, else null."""
    case = F.lit(None).cast("string")
    for name, low, high in reversed(ranges):
        case = F.when(F.col("z").between(low, high), name).otherwise(case)
    return cells.select("row", "col", case.alias("class"))


# -- contours and domains ---------------------------------------------------------------------


def contour_segments(cells: DataFrame, level: float) -> DataFrame:
    """(row, col, side, x, y): where the level crosses the sides of each 2 x 2 block, by linear interpolation.

    Sides: 0 top, 1 right, 2 bottom, 3 left; x grows with columns, y with rows.
    Blocks with missing corners are skipped. Two sides make a segment; four are
    paired in side order.
    """
    across = Window.partitionBy("row").orderBy("col")
    right = cells.withColumn("z1", F.lead("z").over(across)).withColumn("c1", F.lead("col").over(across)).where("c1 = col + 1")
    down = Window.partitionBy("col").orderBy("row")
    block = right.withColumn("z3", F.lead("z").over(down)).withColumn("z2", F.lead("z1").over(down)).withColumn("r1", F.lead("row").over(down)).where("r1 = row + 1")
    block = block.where("z is not null and z1 is not null and z2 is not null and z3 is not null")
    high = lambda c: F.col(c) >= level
    part = lambda a, b: (F.lit(float(level)) - F.col(a)) / (F.col(b) - F.col(a))
    col, row = F.col("col").cast("double"), F.col("row").cast("double")
    side = lambda k, a, b, x, y: F.when(high(a) != high(b), F.struct(F.lit(k).alias("side"), x.alias("x"), y.alias("y")))
    sides = F.array(
        side(0, "z", "z1", col + part("z", "z1"), row), side(1, "z1", "z2", col + 1, row + part("z1", "z2")),
        side(2, "z3", "z2", col + part("z3", "z2"), row + 1), side(3, "z", "z3", col, row + part("z", "z3")),
    )
    return block.select("row", "col", F.inline(F.filter(sides, lambda s: s.isNotNull())))


def contour_lines(cells: DataFrame, level: float) -> DataFrame:
    """(line, seq, x, y, closed): crossings of ``contour_segments`` joined into lines, ground at or above the level on one side throughout.

    Going around a block, each crossing where the ground falls below the level
    is joined with the next one where it rises again, so that a block crossed
    four times keeps its high ground connected. A crossing between two blocks
    ends a segment in one and starts one in the other; segments are traced by
    pointer doubling. A line is named by its first crossing; a closed one ends
    where it starts.
    """
    from ..plans.chains import traced

    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    right = cells.withColumn("z1", F.lead("z").over(across)).withColumn("c1", F.lead("col").over(across)).where("c1 = col + 1")
    block = right.withColumn("z3", F.lead("z").over(down)).withColumn("z2", F.lead("z1").over(down)).withColumn("r1", F.lead("row").over(down)).where("r1 = row + 1")
    block = block.where("z is not null and z1 is not null and z2 is not null and z3 is not null")
    lv, row, col = F.lit(float(level)), F.col("row"), F.col("col")
    # a crossing is named by the side it lies on: from cell (row, col) to the right (0) or down (1)
    place = lambda r, c, k, a, b: F.struct(r.alias("row"), c.alias("col"), F.lit(k).alias("side"), (c + ((lv - F.col(a)) / (F.col(b) - F.col(a)) if k == 0 else 0)).cast("double").alias("x"), (r + ((lv - F.col(a)) / (F.col(b) - F.col(a)) if k == 1 else 0)).cast("double").alias("y"))
    corners = ["z", "z1", "z2", "z3"]
    places = [place(row, col, 0, "z", "z1"), place(row, col + 1, 1, "z1", "z2"), place(row + 1, col, 0, "z3", "z2"), place(row, col, 1, "z", "z3")]
    high = [F.col(c) >= lv for c in corners]
    falls = [high[k] & ~high[(k + 1) % 4] for k in range(4)]
    rises = [~high[k] & high[(k + 1) % 4] for k in range(4)]

    def segment(k: int) -> Column:
        to = F.lit(None)
        for step in (3, 2, 1):
            to = F.when(rises[(k + step) % 4], places[(k + step) % 4]).otherwise(to)
        return F.when(falls[k], F.struct(places[k].alias("p"), to.alias("q")))

    from ..plans.numbering import checkpointed

    key = lambda c: F.struct(f"{c}.row", f"{c}.col", f"{c}.side")
    found = block.select(F.inline(F.filter(F.array(*[segment(k) for k in range(4)]), lambda s: s.isNotNull())))
    found = checkpointed(found.select(key("p").alias("id"), key("q").alias("to"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")))
    chained = traced(found.select("id").join(found.select(F.col("to").alias("id"), F.col("id").alias("prev")), "id", "left"))
    joined = found.join(chained, "id").withColumn("line", F.concat_ws("-", "root.row", "root.col", "root.side"))
    last = joined.groupBy("line").agg(F.max(F.struct("seq", "to", "x2", "y2", "root")).alias("m"))
    last = last.select("line", (F.col("m.seq") + 1).alias("seq"), F.col("m.x2").alias("x"), F.col("m.y2").alias("y"), (F.col("m.to") == F.col("m.root")).alias("closed"))
    points = joined.select("line", "seq", "x", "y").join(last.select("line", "closed"), "line")
    return points.unionByName(last.select("line", "seq", "x", "y", "closed"))


def domain_cells(cells: DataFrame, zmin: float | None = None, zmax: float | None = None) -> DataFrame:
    """Cells with zmin <= z <= zmax."""
    found = cells.where("z is not null")
    if zmin is not None:
        found = found.where(F.col("z") >= zmin)
    return found if zmax is None else found.where(F.col("z") <= zmax)


def channel_cells(cells: DataFrame, level: float, width: float) -> DataFrame:
    """(row, col) of the narrow parts of the domain at or below ``level``: what an opening by width / 2 removes.

    Distances run between cell centres; a cell outside of the grid does not count as outside of the domain.
    """
    from ..plans.spatial import nearest_within

    r = width / 2
    at = lambda d: d.select(F.struct("row", "col").alias("cell"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    inside, outside = at(domain_cells(cells, zmax=level)), at(cells.where(~F.coalesce(F.col("z") <= level, F.lit(False))))
    eroded = inside.join(nearest_within(inside, "cell", outside.withColumnRenamed("cell", "o"), r, "o").select("cell"), "cell", "left_anti")
    opened = nearest_within(inside, "cell", eroded.withColumnRenamed("cell", "o"), r, "o").select("cell")
    return inside.join(opened, "cell", "left_anti").select("cell.row", "cell.col")
