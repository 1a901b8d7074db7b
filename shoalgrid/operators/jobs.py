"""Jobs: compositions of operators that read and write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import reproject
from ..plans.spatial import points_in_boxes
from ..sources import text
from . import boundaries, domains, engine, interpolate, mesh, polygons, raster, sizing


def run_driver(polygons: DataFrame, size: float | None = None, sizes: DataFrame | None = None, sieve: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Mesh a domain and finalise it: parts are stacked by offsets, then duplicates, pinches and small parts go."""
    nodes, elements = engine.generate(polygons, size, sizes)
    span = nodes.agg(F.max("node_id")).first()[0]
    if span is None:
        return nodes.drop("poly_id"), elements.drop("poly_id")
    wide = span + 1
    n = nodes.select((F.col("poly_id") * wide + F.col("node_id")).alias("node_id"), "x", "y", "value")
    many = (elements.agg(F.max("elem_id")).first()[0] or 0) + 1
    shifted = elements.withColumn("_s", F.col("poly_id") * wide)
    e = shifted.select((F.col("poly_id") * many + F.col("elem_id")).alias("elem_id"), "etype", F.expr("transform(nodes, k -> k + _s)").alias("nodes"))
    return mesh.finalize(n, e, 0.0 if sieve is None else sieve)


def build_geometry(cells: DataFrame, zmin: float | None, zmax: float | None, base: DataFrame | None = None) -> DataFrame:
    return domains.collect_domain(cells, zmin, zmax).withColumn("origin", F.lit("raster")) if base is None else domains.combine_with_base(cells, base, zmin, zmax)


def build_sizes(points: DataFrame, hmin: float | None, hmax: float | None, constants: list[tuple[float | None, float | None, float]], contours: list[tuple[float, float, float]]) -> DataFrame:
    """Sizes from constants (lower, upper, value) and contours (level, expansion rate, target) of a raster (row, col, z)."""
    c = sizing.Collector(hmin, hmax)
    cells = points.select("row", "col", "z")
    for lower, upper, value in constants:
        c.add("constant", lambda p, a=(value, lower, upper): sizing.constant(p, *a))
    for level, rate, target in contours:
        s = raster.contour_segments(cells, level)
        places = s.select(F.xxhash64("row", "col", "side").alias("fid"), "x", "y")
        c.add("contour", lambda p, a=(places, rate, target): sizing.feature(p.withColumn("_k", F.xxhash64("row", "col")), "_k", a[0], a[1], a[2], hmin, hmax).drop("_k"))
    located = points if "x" in points.columns else points.withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double"))
    return c.evaluate(located)


def subset_and_combine(fine: tuple[DataFrame, DataFrame], coarse: tuple[DataFrame, DataFrame], box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """The fine mesh within a box and the coarse one outside of it, stacked; values come with their nodes."""
    f = mesh.clip_by_nodes(fine[1], mesh.nodes_in_box(fine[0], box), every=False)
    c = domains.clip_mesh_by_mesh(coarse[1], coarse[0], f, fine[0])
    fine_nodes, f = mesh.cleanup_isolates(fine[0], f)
    coarse_nodes, c = mesh.cleanup_isolates(coarse[0], c)
    return mesh.merge_neighbors([(fine_nodes, f), (coarse_nodes, c)])


def upgrade_values(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Node values from a raster by linear interpolation, old ones where it has no data."""
    found = interpolate.from_raster_linear(nodes.select(F.col("node_id").alias("pid"), "x", "y"), cells)
    return nodes.join(found.select(F.col("pid").alias("node_id"), F.col("z").alias("_z")), "node_id", "left").select("node_id", "x", "y", F.coalesce("_z", "value").alias("value"))


def write_hull(spark: SparkSession, elements: DataFrame, nodes: DataFrame, path: str) -> None:
    boundaries.hull(elements, nodes).write.mode("overwrite").parquet(path)


def transform_mesh(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes with their places in another reference system."""
    x, y = reproject(F.col("x"), F.col("y"), source, target)
    return nodes.withColumns({"x": x, "y": y})


def write_outputs(nodes: DataFrame, elements: DataFrame, path: str, formats: tuple[str, ...] = ("tables",), boundary: DataFrame | None = None) -> dict[str, str]:
    """Where each format was written: tables, 2dm, grd (with ``boundary`` as of ``text.grd_boundary_lines``), hull (polygons)."""
    unknown = set(formats) - {"tables", "2dm", "grd", "hull"}
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}")
    out = {f: f"{path}/{f}" for f in formats}
    if "tables" in out:
        nodes.write.mode("overwrite").parquet(f"{out['tables']}/nodes")
        elements.write.mode("overwrite").parquet(f"{out['tables']}/elements")
    if "2dm" in out:
        text.write_lines(text.sms2dm_lines(nodes, elements), out["2dm"])
    if "grd" in out:
        text.write_lines(text.grd_lines(nodes, elements, "mesh", boundary), out["grd"])
    if "hull" in out:
        write_hull(nodes.sparkSession, elements, nodes, out["hull"])
    return out


def clipping_cells(cells: DataFrame, width: int, cutoff: float = -200.0, upstream: int = 100, extra: DataFrame | None = None) -> DataFrame:
    """(row, col): where a fine mesh is wanted: cells at or above ``cutoff``, small parts below it (``upstream`` cells at most), and ``extra`` cells (row, col)."""
    low = raster.domain_cells(cells).where(F.col("z") < cutoff).select("row", "col")
    parts = domains.cell_components(low, width)
    small = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= upstream).select("component")
    found = raster.domain_cells(cells, zmin=cutoff).select("row", "col").unionByName(parts.join(small, "component", "left_semi").select("row", "col"))
    return (found if extra is None else found.unionByName(extra.select("row", "col"))).distinct()


def blended_sizes(places: DataFrame, fine: tuple[DataFrame, DataFrame], coarse: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(pid, x, y, h) at places (pid, x, y): the mean edge length around, between the nodes of the fine mesh or else of the coarse one, else of the nearest node."""
    found = None
    stacked = mesh.merge_stack([coarse, fine])
    for nodes, elements in (fine, coarse):
        sized = nodes.drop("value").join(mesh.size_from_mesh(elements, nodes).withColumnRenamed("h", "value"), "node_id")
        at = interpolate.from_mesh(places, elements, sized)
        found = at if found is None else interpolate.fill_from(found, at)
    all_sizes = mesh.size_from_mesh(stacked[1], stacked[0]).join(stacked[0].select("node_id", "x", "y"), "node_id").where("h > 0").select(F.col("node_id").alias("fid"), "x", "y", F.col("h").alias("value"))
    missing = places.join(found, "pid", "left_anti")
    found = found.unionByName(interpolate.nearest_value(missing, all_sizes))
    return places.join(found, "pid").select("pid", "x", "y", F.col("value").alias("h"))


def remesh_by_dem(elements: DataFrame, nodes: DataFrame, cells: DataFrame, hmin: float, hmax: float, constants: list[tuple[float | None, float | None, float]] = (), contours: list[tuple[float, float, float]] = ()) -> tuple[DataFrame, DataFrame]:
    """A mesh generated anew inside of the old one's rings, sizes from a raster (row, col, z), values from it."""
    sizes = build_sizes(raster.domain_cells(cells), hmin, hmax, list(constants), list(contours)).select("x", "y", "h")
    rings = _rings_of(elements, nodes)
    # a part gets the sizes within its extent
    box = rings.groupBy("poly_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    at = points_in_boxes(sizes, box, max(8.0, 4 * hmax), closed=True).select("poly_id", "x", "y", "h")
    n, e = run_driver(rings, sizes=at)
    return upgrade_values(n, cells), e


def remesh_by_shape(elements: DataFrame, nodes: DataFrame, region: DataFrame, factor: float) -> tuple[DataFrame, DataFrame]:
    """A mesh generated anew inside of the old one's rings, as fine as it was, and ``factor`` times as coarse within ``region`` (polygons poly, ring, seq, x, y)."""
    if not factor > 0:
        raise ValueError("factor is above zero")
    own = mesh.element_components(elements).join(elements.select("elem_id", F.explode("nodes").alias("node_id")), "elem_id").select(F.col("component").alias("poly_id"), "node_id").distinct()
    inside = polygons.containing(nodes.select(F.col("node_id").alias("pid"), "x", "y"), region).select(F.col("pid").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    sized = own.join(mesh.size_from_mesh(elements, nodes), "node_id").join(nodes.select("node_id", "x", "y"), "node_id").join(inside, "node_id", "left")
    return run_driver(_rings_of(elements, nodes), sizes=sized.select("poly_id", "x", "y", F.when(F.col("_in"), F.col("h") * factor).otherwise(F.col("h")).alias("h")))


def _rings_of(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    return mesh.checkpointed(boundaries.rings(elements, nodes)).select(F.col("component").alias("poly_id"), "ring", "seq", "x", "y")
