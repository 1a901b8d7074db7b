"""What users ask for, checked when it is said: features, options, and domains and size functions of any kind.

A spec holds parameters only; ``apply`` and the factories turn it into the
DataFrame operators of ``sizing``, ``domains`` and ``polygons``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import domains, polygons, sizing
from .raster import channel_cells, contour_segments, domain_cells


def _positive(**values) -> None:
    for name, v in values.items():
        if v is not None and not v > 0:
            raise ValueError(f"{name} is above zero")


@dataclass
class Contour:
    """A level of one or more rasters, refined along; sources are added by index, None for all."""

    level: float
    rate: float = 0.01
    target: float | None = None
    sources: list[int | None] = field(default_factory=list)

    def __post_init__(self):
        _positive(rate=self.rate, target=self.target)

    def add_source(self, index: int | None = None) -> "Contour":
        if index in self.sources:
            raise ValueError("a source is added once")
        self.sources.append(index)
        return self

    def places(self, cells: DataFrame) -> DataFrame:
        return contour_segments(cells, self.level).select(F.xxhash64("row", "col", "side").alias("fid"), "x", "y")

    def apply(self, collector: sizing.Collector, cells: DataFrame, key: str = "node_id") -> sizing.Collector:
        for index in self.sources or [None]:
            collector.add_contour(cells, self.level, self.rate, self.target, key, index)
        return collector


@dataclass(frozen=True)
class FilledContour:
    """The ground between two levels, one of which may be open."""

    lower: Contour | float | None = None
    upper: Contour | float | None = None

    def __post_init__(self):
        low, high = self.bounds
        if low is None and high is None:
            raise ValueError("a filled contour has a level")
        if low is not None and high is not None and low >= high:
            raise ValueError("the lower level is below the upper one")

    @property
    def bounds(self) -> tuple[float | None, float | None]:
        return tuple(c.level if isinstance(c, Contour) else c for c in (self.lower, self.upper))

    def cells(self, cells: DataFrame) -> DataFrame:
        return domain_cells(cells, *self.bounds)


@dataclass(frozen=True)
class Channel:
    """Narrow parts of the ground at or below a level."""

    level: float = 0.0
    width: float = 1000.0
    target: float = 200.0

    def __post_init__(self):
        _positive(width=self.width, target=self.target)

    def cells(self, cells: DataFrame) -> DataFrame:
        return channel_cells(cells, self.level, self.width)

    def apply(self, collector: sizing.Collector, cells: DataFrame, source_index=None) -> sizing.Collector:
        return collector.add_channel(cells, self.level, self.width, self.target, source_index)


@dataclass(frozen=True)
class LineFeature:
    """Lines (line_id, seq, x, y) or places (fid, x, y), given one way only."""

    lines: DataFrame | None = None
    places: DataFrame | None = None
    step: float = 1.0

    def __post_init__(self):
        if (self.lines is None) == (self.places is None):
            raise ValueError("a line feature has lines or places")
        _positive(step=self.step)

    def points(self) -> DataFrame:
        """Places along the lines, ``step`` apart at most."""
        from .lines import segments

        if self.places is not None:
            return self.places
        s = segments(self.lines)
        n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / self.step).cast("int"))
        k = s.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_k"))
        at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_k") / F.col("_n"))
        return k.select(at("x1", "x2").alias("x"), at("y1", "y2").alias("y")).distinct().select(F.xxhash64("x", "y").alias("fid"), "x", "y")


@dataclass(frozen=True)
class Patch:
    """A region by a predicate over x, y, or by polygons (poly, ring, seq, x, y); with an expansion rate it needs the places of its border."""

    inside: Column | None = None
    region: DataFrame | None = None
    expansion_rate: float | None = None
    target: float | None = None

    def __post_init__(self):
        if (self.inside is None) == (self.region is None):
            raise ValueError("a patch has a predicate or polygons")
        _positive(expansion_rate=self.expansion_rate, target=self.target)

    def holds(self, points: DataFrame, key: str) -> DataFrame:
        """(key) of the points inside."""
        if self.inside is not None:
            return points.where(self.inside).select(key)
        return polygons.containing(points.select(F.col(key).alias("pid"), "x", "y"), self.region).select(F.col("pid").alias(key)).distinct()


@dataclass(frozen=True)
class EngineOptions:
    """Options of the meshing engine: bounds of sizes, and whether borders keep their corners only."""

    name: str = "delaunay"
    hmin: float | None = None
    hmax: float | None = None

    def __post_init__(self):
        from .engine import ENGINES

        if self.name not in ENGINES:
            raise ValueError(f"there are the engines {', '.join(ENGINES)}")
        _positive(hmin=self.hmin, hmax=self.hmax)
        if self.hmin is not None and self.hmax is not None and self.hmin > self.hmax:
            raise ValueError("hmin is above hmax")

    def sizes(self, points: DataFrame) -> DataFrame:
        return sizing.clamp(points, self.hmin, self.hmax)


def domain(source, kind: str, zmin: float | None = None, zmax: float | None = None, width: int = 1 << 20) -> DataFrame:
    """Polygons of a domain: of raster cells, of a mesh (elements, nodes), or polygons as they stand."""
    if kind == "raster":
        return polygons.from_cells(domain_cells(source, zmin, zmax), width)
    if kind == "mesh":
        from .boundaries import hull

        elements, nodes = source
        rings = hull(domains.mesh_domain(elements, nodes, zmin, zmax), nodes)
        return rings.select(F.col("component").alias("poly"), "ring", "ring_type", "seq", "x", "y")
    if kind == "polygons":
        missing = {"poly", "ring", "seq", "x", "y"} - set(source.columns)
        if missing:
            raise ValueError(f"polygons lack {', '.join(sorted(missing))}")
        return source
    raise ValueError("a domain is of kind raster, mesh or polygons")


def size_function(source, kind: str, value: float = sizing.UNSET) -> DataFrame:
    """Points (node_id, x, y, z, h) of a size function: on raster cells, on a mesh (elements, nodes) from its edges, or scattered points."""
    if kind == "raster":
        at = source.select(F.struct("row", "col").alias("node_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z")
        return sizing.initial(at, value)
    if kind == "mesh":
        from .mesh import size_from_mesh

        elements, nodes = source
        return nodes.withColumnRenamed("value", "z").join(size_from_mesh(elements, nodes), "node_id").select("node_id", "x", "y", "z", "h")
    if kind == "points":
        return source if "h" in source.columns else sizing.initial(source, value)
    raise ValueError("a size function is of kind raster, mesh or points")
