"""Domains: which cells or elements belong to the region to be meshed, from many sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mesh
from .raster import domain_cells


def mesh_domain(elements: DataFrame, nodes: DataFrame, zmin: float | None = None, zmax: float | None = None) -> DataFrame:
    """Elements that touch a node with zmin < value < zmax (strict; all without limits)."""
    inside = nodes
    if zmin is not None:
        inside = inside.where(F.col("value") > zmin)
    if zmax is not None:
        inside = inside.where(F.col("value") < zmax)
    return elements if zmin is None and zmax is None else mesh.clip_by_nodes(elements, inside, every=False)


def collect_domain(cells: DataFrame, zmin: float | None = None, zmax: float | None = None, patches: DataFrame | None = None) -> DataFrame:
    """(row, col): cells in the domain of any source (raster_id, row, col, z), or in a patch (row, col)."""
    found = domain_cells(cells, zmin, zmax).select("row", "col")
    return (found if patches is None else found.unionByName(patches.select("row", "col"))).distinct()


def combine_with_base(cells: DataFrame, base: DataFrame, zmin: float | None = None, zmax: float | None = None) -> DataFrame:
    """(row, col, origin): domain of the rasters, and base cells (row, col) outside of every raster's extent."""
    extent = cells.groupBy("raster_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # one extent a raster, cut into the cells' buckets of 64 to join by equality
    spans = extent.withColumn("br", F.explode(F.sequence(F.floor(F.col("r0") / 64), F.floor(F.col("r1") / 64)))).withColumn("bc", F.explode(F.sequence(F.floor(F.col("c0") / 64), F.floor(F.col("c1") / 64))))
    b = base.withColumn("br", F.floor(F.col("row") / 64)).withColumn("bc", F.floor(F.col("col") / 64))
    covered = b.join(spans, ["br", "bc"]).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).select("row", "col").distinct()
    rest = base.select("row", "col").join(covered, ["row", "col"], "left_anti").withColumn("origin", F.lit("base"))
    return collect_domain(cells, zmin, zmax).withColumn("origin", F.lit("raster")).unionByName(rest)


def cell_borders(cells: DataFrame) -> DataFrame:
    """(row, col, side): sides of domain cells towards cells outside; 0 up, 1 right, 2 down, 3 left. Rings of a domain run along them."""
    around = F.array(*[F.struct(F.lit(k).alias("side"), (F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c")) for k, dr, dc in ((0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1))])
    sides = cells.select("row", "col", F.inline(around))
    other = cells.select(F.col("row").alias("r"), F.col("col").alias("c")).distinct()
    return sides.join(other, ["r", "c"], "left_anti").select("row", "col", "side")


def cell_components(cells: DataFrame, width: int) -> DataFrame:
    """(row, col, component): cells connected through sides; ``width`` is above every column."""
    from ..plans.graph import components

    key = F.col("row") * width + F.col("col")
    own = cells.select("row", "col", key.alias("k"))
    step = lambda dr, dc: own.select(F.col("k").alias("a"), ((F.col("row") + dr) * width + F.col("col") + dc).alias("b"))
    near = step(0, 1).where((F.col("b") % width) != 0).unionByName(step(1, 0)).join(own.select(F.col("k").alias("b")), "b", "left_semi")
    roots = components(near.select("a", "b"))
    return own.join(roots, F.col("k") == F.col("node"), "left").select("row", "col", F.coalesce("root", "k").alias("component"))


def sieve_cells(cells: DataFrame, width: int, least: int) -> DataFrame:
    """Cells of components with more than ``least`` cells."""
    c = cell_components(cells, width)
    keep = c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > least).select("component")
    return c.join(keep, "component", "left_semi")


def remove_slivers(elements: DataFrame, nodes: DataFrame, least: float = 1e-15) -> DataFrame:
    """Without triangles smaller than ``least`` and elements that share a node with one."""
    small = mesh.element_areas(elements, nodes).where((F.col("etype") == "tria") & (F.abs("area") < least)).select("elem_id")
    touched = elements.join(small, "elem_id", "left_semi").select(F.explode("nodes").alias("node_id"))
    return mesh.clip_by_nodes(elements, touched, every=False, inverse=True)


def clip_mesh_by_mesh(elements: DataFrame, nodes: DataFrame, clipper: DataFrame, clipper_nodes: DataFrame, buffer: float = 0.0, inverse: bool = True) -> DataFrame:
    """Elements of which no node (inverse) or any node lies in an element of the clipper or within ``buffer`` of its nodes."""
    from ..plans.spatial import nearest_within
    from .interpolate import from_mesh

    at = nodes.select(F.col("node_id").alias("pid"), "x", "y")
    hit = from_mesh(at, clipper, clipper_nodes).select(F.col("pid").alias("node_id"))
    if buffer > 0:
        used = clipper_nodes.join(clipper.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")
        near = nearest_within(nodes, "node_id", used.select(F.col("node_id").alias("fid"), "x", "y"), buffer)
        hit = hit.unionByName(near.select("node_id"))
    return mesh.clip_by_nodes(elements, hit, every=False, inverse=inverse)


def snap(points: DataFrame, key: str, targets: DataFrame, radius: float = 1e-8) -> DataFrame:
    """(key, fid): the first target within ``radius`` of a point."""
    from ..plans.spatial import nearest_within

    return nearest_within(points, key, targets, radius).select(key, "fid")
