"""Size functions: a column ``h`` folded by refinements and bounded by constraints.

Points are rows with x, y, a depth or elevation ``z`` and a size ``h``, keyed by
``key``. Refinements only lower h, so that a chain of them is one fold of
``least`` in one projection; relaxation and features join nearest points by grid
buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import courant_number, courant_size
from ..plans.spatial import boxes_of, bucket, nearest_within

#: The size of an unrefined point: the largest 32-bit float.
UNSET = 3.4028234663852886e38


def initial(points: DataFrame, value: float = UNSET) -> DataFrame:
    return points.withColumn("h", F.lit(float(value)))


def clamp(points: DataFrame, hmin: float | None = None, hmax: float | None = None) -> DataFrame:
    h = F.col("h")
    if hmin is not None:
        h = F.greatest(h, F.lit(float(hmin)))
    if hmax is not None:
        h = F.least(h, F.lit(float(hmax)))
    return points.withColumn("h", h)


def between(lower: float | None, upper: float | None) -> Column:
    """Strictly between; a missing elevation is outside."""
    z, ok = F.col("z"), F.col("z").isNotNull()
    if lower is not None and lower > -math.inf:
        ok = ok & (z > lower)
    if upper is not None and upper < math.inf:
        ok = ok & (z < upper)
    return ok


def constant(points: DataFrame, value: float, lower: float | None = None, upper: float | None = None) -> DataFrame:
    return points.withColumn("h", F.when(between(lower, upper), F.least("h", F.lit(float(value)))).otherwise(F.col("h")))


def patch(points: DataFrame, inside: Column, target: float) -> DataFrame:
    return points.withColumn("h", F.when(inside, F.least("h", F.lit(float(target)))).otherwise(F.col("h")))


def ring_places(spark, ring: list[tuple[float, float]], step: float) -> DataFrame:
    """(fid, x, y): places along a literal ring, ``step`` apart or less on each side."""
    places = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        n = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / step))
        places += [(x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n) for k in range(n)]
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "fid long, x double, y double")


def patch_expanded(points: DataFrame, key: str, inside: Column, border: DataFrame, target: float, rate: float, hmin: float | None = None, hmax: float | None = None) -> DataFrame:
    """A patch whose size grows outside with the distance to its border: h falls to target inside, to target + rate * target * distance beyond.

    ``border`` has places (fid, x, y) along the border; see ``ring_places``.
    """
    size = float(target) if hmin is None else max(float(target), float(hmin))
    cols = points.columns
    within = points.withColumn("_in", F.coalesce(inside, F.lit(False)))
    out = feature(within.where("not _in").select(*cols), key, border, rate, target, hmin, hmax)
    return patch(within.where("_in").select(*cols), F.lit(True), size).unionByName(out)


def feature(points: DataFrame, key: str, places: DataFrame, rate: float, target: float, hmin: float | None = None, hmax: float | None = None) -> DataFrame:
    """h falls to target + rate * target * distance to the nearest place (fid, x, y).

    With ``hmax`` only places within its radius are met; farther points get
    exactly hmax. Without, the distance has no bound and the search widens.
    """
    if not target or target <= 0:
        raise ValueError("a target size above 0 is needed")
    if hmax is not None:
        radius = (hmax - target) / (rate * target)
        near = nearest_within(points, key, places, radius)
        d = F.coalesce(F.sqrt("d2"), F.lit(radius))
    else:
        from ..plans.spatial import nearest

        near = nearest(points, key, places, max(1.0, 4 / rate))
        d = F.sqrt("d2")
    size = rate * target * d + target
    if hmin is not None:
        size = F.greatest(size, F.lit(float(hmin)))
    if hmax is not None:
        size = F.least(size, F.lit(float(hmax)))
    joined = points.join(near.select(key, "d2"), key, "left").withColumn("h", F.least("h", size))
    return joined.select(*points.columns)


def flow_limiter(points: DataFrame, hmin: float | None = None, hmax: float | None = None, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """h falls to |z / (3 |gradient|)| (columns gx, gy) between the bounds; flat cells stay as they are."""
    g = F.hypot("gx", "gy")
    size = F.abs(F.col("z") / (3 * F.when(g > 0, g)))
    if hmin is not None:
        size = F.greatest(size, F.lit(float(hmin)))
    if hmax is not None:
        size = F.least(size, F.lit(float(hmax)))
    off = F.lit(False)
    if upper is not None:
        off = off | (F.col("z") > upper)
    if lower is not None:
        off = off | (F.col("z") < lower)
    # greatest and least skip nulls: a flat cell must not become hmin
    return points.withColumn("h", F.when(off | g.isNull() | (g == 0) | F.col("z").isNull(), F.col("h")).otherwise(F.least("h", size)))


# -- constraints ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Constraint:
    """A bound on h where ``mask`` holds: ``kind`` min keeps h above the value, max below (both strictly)."""

    value: Column | float
    kind: str = "min"
    mask: Column | None = None
    rate: float | None = None

    def __post_init__(self):
        if self.kind not in ("min", "max"):
            raise ValueError("kind is min or max")

    def satisfied(self, h: Column, value: Column) -> Column:
        return (h > value) if self.kind == "min" else (h < value)


def constrain(points: DataFrame, c: Constraint, key: str | None = None, reach: float = 1000.0) -> DataFrame:
    """Set h to the value where the constraint holds and isn't met; relax it around with ``rate``.

    Relaxed: a point at distance d from the nearest such point of value m gets
    m * (1 - d * rate) (min) or m * (1 + d * rate) (max) where that isn't met
    either. A min bound ends at d = 1 / rate; a max bound is followed to ``reach``.
    """
    value = c.value if isinstance(c.value, Column) else F.lit(float(c.value))
    mask = F.coalesce((c.mask if c.mask is not None else F.lit(True)) & ~c.satisfied(F.col("h"), value), F.lit(False))
    out = points.withColumn("_m", mask).withColumn("h", F.when(F.col("_m"), value).otherwise(F.col("h")))
    if c.rate is None:
        return out.drop("_m")
    radius = 1 / c.rate if c.kind == "min" else reach
    fixed = out.where("_m").select(F.col(key).alias("fid"), "x", "y", F.col("h").alias("_v"))
    near = nearest_within(out.where("not _m"), key, fixed, radius).join(fixed.select("fid", "_v"), "fid")
    limit = F.col("_v") * (1 + F.sqrt("d2") * (c.rate if c.kind == "max" else -c.rate))
    joined = out.join(near.select(key, "_v", "d2"), key, "left")
    return joined.withColumn("h", F.when(~F.col("_m") & limit.isNotNull() & ~c.satisfied(F.col("h"), limit), limit).otherwise(F.col("h"))).select(*points.columns)


def topo_bound(value: float, kind: str = "min", lower: float | None = None, upper: float | None = None, rate: float | None = None) -> Constraint:
    return Constraint(value, kind, between(lower, upper), rate)


def topo_function(function: Callable[[Column], Column] = lambda z: z / 2.0, kind: str = "min", lower: float | None = None, upper: float | None = None, rate: float | None = None) -> Constraint:
    return Constraint(function(F.col("z")), kind, between(lower, upper), rate)


def courant(points: DataFrame, timestep: float = 150.0, upper: float | None = 0.9, lower: float | None = None, amplitude: float = 2.0) -> DataFrame:
    """Change h where the Courant number isn't below ``upper`` or above ``lower``, so that it is at that bound."""
    if upper is None and lower is None:
        raise ValueError("a bound is needed")
    for bound, kind in ((upper, "max"), (lower, "min")):
        if bound is not None:
            number = courant_number(F.col("z"), F.col("h"), timestep, amplitude)
            bad = (number >= bound) if kind == "max" else (number <= bound)
            points = points.withColumn("h", F.when(F.coalesce(bad, F.lit(False)), courant_size(F.col("z"), timestep, bound, amplitude)).otherwise(F.col("h")))
    return points


# -- many sources -----------------------------------------------------------------------------


@dataclass
class Collector:
    """Refinements and constraints for many sources, kept as specs and applied in a fixed order when asked for.

    Sources are rows with source_index; a later one counts more where they
    overlap. ``source_index`` of a spec picks sources (None: all).
    """

    hmin: float | None = None
    hmax: float | None = None
    refinements: list[tuple[int, object, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    constraints: list[tuple[object, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    ORDER = ("contour", "flow_limiter", "constant", "feature", "patch", "channel")

    def add(self, kind: str, apply: Callable[[DataFrame], DataFrame], source_index: int | list[int] | None = None) -> "Collector":
        self.refinements.append((self.ORDER.index(kind), source_index, apply))
        return self

    def add_constraint(self, apply: Callable[[DataFrame], DataFrame], source_index: int | list[int] | None = None) -> "Collector":
        self.constraints.append((source_index, apply))
        return self

    # specs by name; ``source_index`` as in ``add``

    def add_constant(self, value: float, lower: float | None = None, upper: float | None = None, source_index=None) -> "Collector":
        return self.add("constant", lambda p: constant(p, value, lower, upper), source_index)

    def add_feature(self, places: DataFrame, rate: float = 0.01, target: float | None = None, hmax: float | None = None, key: str = "node_id", source_index=None, kind: str = "feature") -> "Collector":
        size, top = target if target is not None else self.hmin, hmax if hmax is not None else self.hmax
        return self.add(kind, lambda p: feature(p, key, places, rate, size, self.hmin, top), source_index)

    def add_contour(self, cells: DataFrame, level: float, rate: float = 0.01, target: float | None = None, key: str = "node_id", source_index=None) -> "Collector":
        """A feature along the contour of a raster (row, col, z)."""
        from .raster import contour_segments

        places = contour_segments(cells, level).select(F.xxhash64("row", "col", "side").alias("fid"), "x", "y")
        return self.add_feature(places, rate, target, key=key, source_index=source_index, kind="contour")

    def add_patch(self, inside: Column, target: float | None = None, source_index=None, expansion_rate: float | None = None, border: DataFrame | None = None, key: str = "node_id") -> "Collector":
        """``expansion_rate``, with places along the border: the size grows outside of the patch."""
        size = target if target is not None else self.hmin
        if expansion_rate is None:
            return self.add("patch", lambda p: patch(p, inside, size), source_index)
        if border is None:
            raise ValueError("an expanding patch needs the places along its border")
        return self.add("patch", lambda p: patch_expanded(p, key, inside, border, size, expansion_rate, self.hmin, self.hmax), source_index)

    def add_channel(self, cells: DataFrame, level: float = 0.0, width: float = 1000.0, target: float = 200.0, source_index=None) -> "Collector":
        """A patch on the narrow parts of a raster's domain; points are met by row and col."""
        from .raster import channel_cells

        narrow = channel_cells(cells, level, width).withColumn("_narrow", F.lit(True))

        def apply(p: DataFrame) -> DataFrame:
            return patch(p.join(narrow, ["row", "col"], "left"), F.col("_narrow").isNotNull(), target).select(*p.columns)

        return self.add("channel", apply, source_index)

    def add_flow_limiter(self, hmin: float | None = None, hmax: float | None = None, lower: float | None = None, upper: float | None = None, source_index=None) -> "Collector":
        return self.add("flow_limiter", lambda p: flow_limiter(p, hmin, hmax, lower, upper), source_index)

    def add_topo_bound(self, value: float, kind: str = "min", lower: float | None = None, upper: float | None = None, rate: float | None = None, key: str = "node_id", source_index=None) -> "Collector":
        return self.add_constraint(lambda p: constrain(p, topo_bound(value, kind, lower, upper, rate), key), source_index)

    def add_topo_function(self, function: Callable[[Column], Column] = lambda z: z / 2.0, kind: str = "min", lower: float | None = None, upper: float | None = None, rate: float | None = None, key: str = "node_id", source_index=None) -> "Collector":
        return self.add_constraint(lambda p: constrain(p, topo_function(function, kind, lower, upper, rate), key), source_index)

    def add_courant(self, upper: float | None = 0.9, lower: float | None = None, timestep: float = 150.0, amplitude: float = 2.0, source_index=None) -> "Collector":
        return self.add_constraint(lambda p: courant(p, timestep, upper, lower, amplitude), source_index)

    def add_region(self, value: float, kind: str, inside: Column, rate: float | None = None, key: str = "node_id", source_index=None) -> "Collector":
        return self.add_constraint(lambda p: constrain(p, Constraint(value, kind, inside, rate), key), source_index)

    def evaluate(self, points: DataFrame, initial_value: float = UNSET) -> DataFrame:
        """All sources with h (exact mode): one plan, refinements before constraints, then the clamp."""
        out = initial(points, initial_value)
        for _, index, apply in [*sorted(self.refinements, key=lambda r: r[0]), *[(0, *c) for c in self.constraints]]:
            old = out.columns
            if index is None:
                out = apply(out)
            else:
                chosen = F.col("source_index").isin([index] if isinstance(index, int) else list(index))
                out = apply(out.where(chosen)).select(*old).unionByName(out.where(~chosen))
        return clamp(out, self.hmin, self.hmax)

    def fast(self, points: DataFrame, initial_value: float = UNSET) -> DataFrame:
        """Fast mode: one grid, the last source's elevation at each (row, col), source indices ignored."""
        grid = points.groupBy("row", "col").agg(F.max_by(F.struct(*[c for c in points.columns if c not in ("row", "col")]), "source_index").alias("s")).select("row", "col", "s.*")
        every = Collector(self.hmin, self.hmax, [(k, None, a) for k, _, a in self.refinements], [(None, a) for _, a in self.constraints])
        return every.evaluate(grid, initial_value)


def priority_merge(points: DataFrame, extents: DataFrame, size: float = 16.0) -> DataFrame:
    """Points of a source outside of the boxes (source_index, x0, y0, x1, y1) of later sources; boxes are filed under buckets of ``size``."""
    later = boxes_of(extents.select(F.col("source_index").alias("_s"), "x0", "y0", "x1", "y1"), size)
    hit = (F.col("_s") > F.col("source_index")) & (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    filed = points.withColumn("_b", bucket("x", "y", size)).alias("p")
    return filed.join(later.alias("l"), (F.col("p._b") == F.col("l._b")) & hit, "left_anti").select(*points.columns)
