"""The registered queries of the mesh and raster operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import boundaries, domains, interpolate, lines, mesh, polygons, raster, sizing
from .sources import raster_store as store
from .sources import tables as t
from .sources import text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

BOX = (9.5, 4.5, 20.5, 15.5)
#: An L shape and a triangle with slanted sides.
L_SHAPE = [(5.0, 1.0), (25.0, 1.0), (25.0, 3.0), (12.0, 3.0), (12.0, 4.0), (5.0, 4.0)]
WEDGE = [(3.0, 0.0), (30.5, 1.5), (10.5, 4.5)]


def query(f: Query) -> Query:
    _QUERIES[f.__name__.lstrip("_")] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded to six digits, never -0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def _mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return t.mesh_elements(spark, sf), t.mesh_nodes(spark, sf)


def _joined(elements: DataFrame) -> DataFrame:
    """Node arrays as text, which compares alike in every engine."""
    return elements.select("elem_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("nodes"))


def _box_nodes(nodes: DataFrame) -> DataFrame:
    return mesh.nodes_in_box(nodes, BOX)


# -- edges and measures ----------------------------------------------------------------


@query
def mesh_edges(spark, sf):
    return mesh.mesh_edges(_mesh(spark, sf)[0])


@query
def boundary_edges(spark, sf):
    return mesh.boundary_edges(_mesh(spark, sf)[0])


@query
def edge_lengths(spark, sf):
    return mesh.edge_lengths(*_mesh(spark, sf)).select("u", "v", r6("length").alias("length"))


@query
def boundary_types(spark, sf):
    return mesh.boundary_types(*_mesh(spark, sf)).select("u", "v", r6("length").alias("length"), "btype")


@query
def tria_areas(spark, sf):
    return mesh.tria_areas(*_mesh(spark, sf)).select("elem_id", r6("area").alias("area"))


@query
def element_area_signed(spark, sf):
    return mesh.element_areas(*_mesh(spark, sf))


@query
def element_angles(spark, sf):
    return mesh.element_angles(*_mesh(spark, sf)).select("elem_id", "corner", r6("angle").alias("angle"))


@query
def vertex_adjacency(spark, sf):
    return mesh.vertex_adjacency(_mesh(spark, sf)[0])


@query
def pinched_nodes(spark, sf):
    return mesh.pinched_nodes(_mesh(spark, sf)[0])


@query
def interior_nodes(spark, sf):
    return mesh.interior_nodes(_mesh(spark, sf)[0])


@query
def incident_edges(spark, sf):
    e, n = _mesh(spark, sf)
    return mesh.incident_edges(e, _box_nodes(n))


@query
def size_from_mesh(spark, sf):
    return mesh.size_from_mesh(*_mesh(spark, sf)).select("node_id", r6("h").alias("h"))


@query
def rect_mesh(spark, sf):
    return _joined(_mesh(spark, sf)[0])


@query
def element_ids(spark, sf):
    return mesh.element_ids(_mesh(spark, sf)[0]).select("elem_id", "etype", "id")


@query
def triangulation(spark, sf):
    parts = mesh.triangulation(_mesh(spark, sf)[0])
    return parts.select("elem_id", "part", F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("nodes"))


# -- selections ------------------------------------------------------------------------


@query
def verts_in_box(spark, sf):
    return _box_nodes(_mesh(spark, sf)[1])


@query
def verts_in_polygon(spark, sf):
    n = _mesh(spark, sf)[1]
    closed, inner = mesh.nodes_in_polygon(n, L_SHAPE), mesh.nodes_in_polygon(n, L_SHAPE, closed=False)
    return closed.join(inner.withColumn("strict", F.lit(True)), "node_id", "left").select("node_id", F.coalesce("strict", F.lit(False)).alias("strict"))


@query
def surrounding_verts(spark, sf):
    e, n = _mesh(spark, sf)
    return mesh.surrounding_nodes(e, _box_nodes(n))


@query
def select_adjacent(spark, sf):
    e, n = _mesh(spark, sf)
    return mesh.select_adjacent(e, _box_nodes(n), 3)


@query
def lone_elements(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.lone_elements(mesh.clip_by_nodes(e, n.where("value >= 20"))))


@query
def clip_all(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.clip_by_nodes(e, _box_nodes(n)))


@query
def clip_any(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.clip_by_nodes(e, _box_nodes(n), every=False))


@query
def clip_inverse(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.clip_by_nodes(e, _box_nodes(n), inverse=True))


@query
def clip_cross_edges(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.clip_with_cross_edges(e, n, [(9.5, 1.5), (20.5, 1.5), (20.5, 3.5), (9.5, 3.5)]))


@query
def clip_cross_edges_inverse(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.clip_with_cross_edges(e, n, [(9.5, 1.5), (20.5, 1.5), (20.5, 3.5), (9.5, 3.5)], inverse=True))


@query
def remove_by_edge(spark, sf):
    e, _ = _mesh(spark, sf)
    return _joined(mesh.remove_by_edges(e, mesh.boundary_edges(e)))


@query
def clip_by_index(spark, sf):
    e, _ = _mesh(spark, sf)
    return _joined(mesh.clip_by_index(e, e.where("elem_id % 7 = 3")))


# -- clean-up -----------------------------------------------------------------------------


@query
def cleanup_isolates(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.cleanup_isolates(n, mesh.clip_by_nodes(e, _box_nodes(n)))[1])


def _halved(spark, sf):
    e, n = _mesh(spark, sf)
    return n.withColumn("x", F.floor(F.col("x") / 2).cast("double")).withColumn("y", F.floor(F.col("y") / 2).cast("double")), e


@query
def cleanup_duplicates(spark, sf):
    n, e = _halved(spark, sf)
    return mesh.cleanup_duplicates(n, e)[0]


@query
def cleanup_duplicate_elements(spark, sf):
    n, e = _halved(spark, sf)
    return _joined(mesh.cleanup_duplicates(n, e)[1])


def _sheared(nodes: DataFrame) -> DataFrame:
    """Nodes moved sideways by their value, so that elements take on many shapes."""
    return nodes.withColumn("x", F.col("x") + F.col("value") * 3 / 512)


@query
def cleanup_skewed(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.cleanup_skewed(e, _sheared(n), (20.3, 120.7), (30.3, 150.7)))


@query
def cleanup_concave(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.cleanup_concave(e, _sheared(n)))


@query
def cleanup_folded(spark, sf):
    return _joined(mesh.cleanup_folded(_mesh(spark, sf)[0]))


@query
def order_ccw(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.order_ccw(e.withColumn("nodes", F.reverse("nodes")), n))


@query
def quads_from_tri(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.quads_from_tri(e, n))


@query
def components(spark, sf):
    e, n = _mesh(spark, sf)
    return mesh.element_components(mesh.clip_by_nodes(e, n.where("value >= -20")))


@query
def component_areas(spark, sf):
    e, n = _mesh(spark, sf)
    return mesh.component_areas(mesh.clip_by_nodes(e, n.where("value >= -20")), n)


@query
def sieve_components(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.sieve(mesh.clip_by_nodes(e, n.where("value >= -20")), n, 2.0))


@query
def finalize(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.finalize(n, mesh.clip_by_nodes(e, n.where("value >= -60")), 2.0)[1])


@query
def boundary_chains(spark, sf):
    return mesh.boundary_chains(*_mesh(spark, sf))


@query
def merge_priority(spark, sf):
    e, n = _mesh(spark, sf)
    box = mesh.nodes_in_box(n, (9.5, 0.5, 20.5, 3.5))
    front = mesh.clip_by_nodes(e, box)
    return _joined(mesh.merge_priority([(n, e), (n.join(box, "node_id", "left_semi"), front)])[1])


@query
def merge_neighbors(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(mesh.merge_neighbors([(n, e), (n.withColumn("x", F.col("x") + (t.WIDTH - 1)), e)])[1])


@query
def river_quads(spark, sf):
    f = t.lines(spark, sf).select((F.col("line_id") % 2).alias("river_idx"), F.floor(F.col("line_id") / 2).cast("long").alias("arc"), "seq", "x", "y")
    q = mesh.river_quads(f)
    return q.select("river_idx", "arc", F.col("seg").cast("long").alias("seg"), (g.signed_area(F.col("xs"), F.col("ys"))).alias("area"))


# -- size functions ---------------------------------------------------------------------


def _points(spark, sf, h: float = sizing.UNSET) -> DataFrame:
    return sizing.initial(t.mesh_nodes(spark, sf).select("node_id", "x", "y", F.col("value").alias("z")), h)


def _sized(df: DataFrame) -> DataFrame:
    return df.select("node_id", r6("h").alias("h"))


@query
def hfun_constant(spark, sf):
    return _sized(sizing.constant(_points(spark, sf, 100), 25, -40, 60))


@query
def hfun_feature(spark, sf):
    return _sized(sizing.feature(_points(spark, sf, 100), "node_id", t.features(spark, sf), 0.5, 10, 5, 40))


@query
def hfun_patch(spark, sf):
    from .plans.spatial import in_polygon

    return _sized(sizing.patch(_points(spark, sf, 100), in_polygon(F.col("x"), F.col("y"), WEDGE), 15))


@query
def hfun_flow_limiter(spark, sf):
    cells = raster.gradient(t.raster_cells(spark, sf))
    p = cells.select((F.col("row") * t.WIDTH + F.col("col")).alias("node_id"), "z", "gx", "gy", F.lit(100.0).alias("h"))
    return _sized(sizing.flow_limiter(p, 0.5, 50, -80, 80))


@query
def hfun_topo_const_min(spark, sf):
    return _sized(sizing.constrain(_points(spark, sf, 10), sizing.topo_bound(30, "min", -20, 40)))


@query
def hfun_topo_const_max(spark, sf):
    return _sized(sizing.constrain(_points(spark, sf, 100), sizing.topo_bound(30, "max", lower=0)))


@query
def hfun_topo_func(spark, sf):
    return _sized(sizing.constrain(_points(spark, sf, 10), sizing.topo_function(lambda z: F.abs(z) / 2, "min", lower=-50)))


@query
def hfun_courant(spark, sf):
    return _sized(sizing.courant(_points(spark, sf, 1000).where("z < 0"), 100, 0.8, 0.2))


@query
def hfun_region(spark, sf):
    from .plans.spatial import in_polygon

    return _sized(sizing.constrain(_points(spark, sf, 10), sizing.Constraint(40, "min", in_polygon(F.col("x"), F.col("y"), WEDGE, closed=False))))


@query
def hfun_region_relaxed(spark, sf):
    from .plans.spatial import in_polygon

    return _sized(sizing.constrain(_points(spark, sf, 10), sizing.Constraint(40, "min", in_polygon(F.col("x"), F.col("y"), WEDGE, closed=False), 0.25), "node_id"))


@query
def hfun_fold(spark, sf):
    p = sizing.constant(sizing.constant(_points(spark, sf), 60), 30, upper=0)
    p = sizing.patch(p, (F.col("x") > 9.5) & (F.col("x") < 20.5), 20)
    p = sizing.constrain(p, sizing.topo_bound(35, "min", lower=50))
    return _sized(sizing.clamp(p, 22, 50))


def _collector() -> sizing.Collector:
    c = sizing.Collector(hmin=5, hmax=80)
    c.add("constant", lambda p: sizing.constant(p, 40, lower=150000), 1)
    c.add("constant", lambda p: sizing.constant(p, 25, upper=100000))
    c.add_constraint(lambda p: sizing.constrain(p, sizing.topo_bound(60, "min", lower=300000)), [0, 2])
    return c


def _sources(spark, sf) -> DataFrame:
    s = t.source_cells(spark, sf).groupBy("raster_id", "row", "col").agg(F.max_by("z", "tie").alias("z"))
    return s.select(F.col("raster_id").alias("source_index"), "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("z").cast("double").alias("z"))


@query
def hfun_collector_exact(spark, sf):
    return _collector().evaluate(_sources(spark, sf)).select("source_index", "row", "col", r6("h").alias("h"))


@query
def hfun_collector_fast(spark, sf):
    return _collector().fast(_sources(spark, sf)).select("row", "col", r6("h").alias("h"))


@query
def hfun_collector_specs(spark, sf):
    """Every kind of spec on one grid, in the collector's order."""
    cells = raster.gradient(t.raster_cells(spark, sf))
    p = cells.select(F.lit(0).alias("source_index"), (F.col("row") * t.WIDTH + F.col("col")).alias("node_id"), "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z", "gx", "gy")
    c = sizing.Collector(hmin=2, hmax=60)
    c.add_topo_bound(20, "min", lower=60).add_region(8, "max", (F.col("x") > 30.5) & (F.col("y") < 3.5))
    c.add_constant(45, lower=-90, upper=70).add_flow_limiter(3, 50, upper=40)
    c.add_feature(t.features(spark, sf), 0.5, 10, hmax=40).add_patch((F.col("x") > 3.5) & (F.col("x") < 6.5), 7)
    return _sized(c.evaluate(p))


@query
def hfun_priority(spark, sf):
    boxes = spark.createDataFrame([(1, 4.5, 4.5, 20.5, 30.5), (2, 15.5, 10.5, 30.5, 40.5)], "source_index int, x0 double, y0 double, x1 double, y1 double")
    return sizing.priority_merge(_sources(spark, sf), boxes).select("source_index", "row", "col", "z")


# -- rasters ----------------------------------------------------------------------------------


@query
def raster_xyz(spark, sf):
    return raster.ticks(t.raster_cells(spark, sf), (0.0, 0.0, 19.5, 10.0), 40, 41).select("x", "y", "z")


@query
def raster_bbox(spark, sf):
    return raster.bbox(raster.ticks(t.raster_cells(spark, sf), (0.0, 0.0, 19.5, 10.0), 40, 41))


@query
def raster_window(spark, sf):
    return raster.window(t.raster_cells(spark, sf), 2, 10, 3, 12)


@query
def raster_tiles(spark, sf):
    tiles = raster.with_tiles(t.raster_cells(spark, sf), 8, 2)
    return tiles.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("z").alias("total"))


@query
def raster_sample(spark, sf):
    return raster.sample(t.raster_cells(spark, sf, True), t.scattered(spark, sf), (0.0, 0.0, 40.0, 50.0), 40, 50).select("pid", "z")


@query
def raster_mask_count(spark, sf):
    c = t.raster_cells(spark, sf, True)
    return c.groupBy("row").agg(F.count("z").alias("valid"), F.count_if(F.col("z").isNull()).alias("missing"))


@query
def raster_clip(spark, sf):
    from .plans.spatial import in_polygon

    return raster.clip(t.raster_cells(spark, sf, True), in_polygon(F.col("col").cast("double"), F.col("row").cast("double"), WEDGE))


@query
def raster_mask(spark, sf):
    return raster.mask(t.raster_cells(spark, sf, True), F.col("col").between(5, 30))


@query
def raster_adjust(spark, sf):
    return raster.adjust(t.raster_cells(spark, sf, True), F.col("col").between(10, 20), lambda z: z < 50, -20, 40)


@query
def raster_avg_filter(spark, sf):
    return raster.average_filter(t.raster_cells(spark, sf, True), 3, drop_above=80).select("row", "col", r6("z").alias("z"))


@query
def raster_gaussian(spark, sf):
    return raster.gaussian_filter(t.raster_cells(spark, sf), 0.5, 2.0).select("row", "col", r6("z").alias("z"))


@query
def raster_gradient(spark, sf):
    return raster.gradient(t.raster_cells(spark, sf)).select("row", "col", "gx", "gy")


@query
def raster_slope(spark, sf):
    return raster.slope(t.raster_cells(spark, sf), 30.0, 30.0).select("row", "col", r6("slope").alias("slope"))


@query
def raster_resample_avg(spark, sf):
    return raster.resample_average(t.raster_cells(spark, sf, True), 4).select("row", "col", r6("z").alias("z"))


@query
def raster_resample_nearest(spark, sf):
    return raster.resample_nearest(raster.window(t.raster_cells(spark, sf), 0, 0, 3, 40), 2)


@query
def raster_warp_nearest(spark, sf):
    c = t.raster_cells(spark, sf)
    return raster.warp_nearest(c, c.select("row", "col"), lambda r, k: (r * 0.75 + k * 0.125, k * 0.75 - r * 0.125))


@query
def raster_fill_nearest(spark, sf):
    return raster.fill_nearest(t.raster_cells(spark, sf, True))


@query
def raster_hypsometry(spark, sf):
    return raster.hypsometry(t.raster_cells(spark, sf))


@query
def raster_slope_bins(spark, sf):
    return raster.slope_bins(t.raster_cells(spark, sf), -100, 20).select("bin", "n", r6("mean_slope").alias("mean_slope"))


@query
def raster_classes(spark, sf):
    return raster.classes(t.raster_cells(spark, sf, True), [("deep", -100, -40), ("shelf", -40, 0), ("shore", 0, 12), ("land", 12, 96)])


@query
def raster_contour_segments(spark, sf):
    s = raster.contour_segments(t.raster_cells(spark, sf), 10)
    return s.select("row", "col", "side", r6("x").alias("x"), r6("y").alias("y"))


@query
def raster_domain_area(spark, sf):
    return raster.domain_cells(t.raster_cells(spark, sf, True), -50, 20).groupBy("row").agg(F.count("*").alias("cells"))


@query
def channel_cells(spark, sf):
    return raster.channel_cells(t.raster_cells(spark, sf), 60, 3)


@query
def mosaic_priority(spark, sf):
    return raster.mosaic(t.source_cells(spark, sf))


@query
def total_bounds(spark, sf):
    return raster.bbox(t.scattered(spark, sf))


# -- lines, boxes and polygons --------------------------------------------------------------


@query
def line_split(spark, sf):
    return lines.split(t.lines(spark, sf), 4)


@query
def line_resample(spark, sf):
    return lines.resample(t.lines(spark, sf), 2.5).select("line_id", "k", r6("x").alias("x"), r6("y").alias("y"))


@query
def line_simplify_collinear(spark, sf):
    flat = t.lines(spark, sf).withColumn("y", F.floor(F.col("y") / 25).cast("double"))
    return lines.simplify_collinear(flat)


@query
def ring_area(spark, sf):
    return lines.ring_areas(t.lines(spark, sf), ["line_id"])


@query
def remove_small_holes(spark, sf):
    b = t.boxes(spark, sf)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    outer = b.select("poly_id", F.lit(0).alias("ring"), F.lit("exterior").alias("ring_type"), area.alias("area"))
    hole = b.select("poly_id", F.lit(1).alias("ring"), F.lit("interior").alias("ring_type"), (area * (F.col("poly_id") % 5) / 16).alias("area"))
    return lines.remove_small_holes(outer.unionByName(hole), 0.1)


@query
def overlapping_boxes(spark, sf):
    return lines.overlapping_boxes(t.boxes(spark, sf))


@query
def points_in_boxes(spark, sf):
    from .plans.spatial import points_in_boxes

    return points_in_boxes(t.scattered(spark, sf), t.boxes(spark, sf)).select("pid", "poly_id")


@query
def points_in_closed_boxes(spark, sf):
    from .plans.spatial import points_in_boxes

    nodes = t.mesh_nodes(spark, sf).select("node_id", "x", "y")
    return points_in_boxes(nodes, t.boxes(spark, sf, 0.0), closed=True).select("node_id", "poly_id")


@query
def nearest_feature(spark, sf):
    from .plans.spatial import nearest

    return nearest(t.mesh_nodes(spark, sf), "node_id", t.features(spark, sf), 2.0).select("node_id", "fid", "d2")


# -- interpolation -----------------------------------------------------------------------------


@query
def interp_linear(spark, sf):
    return interpolate.from_raster_linear(t.scattered(spark, sf), t.raster_cells(spark, sf, True))


@query
def interp_cubic(spark, sf):
    return interpolate.from_raster_cubic(t.scattered(spark, sf), t.raster_cells(spark, sf)).select("pid", r6("z").alias("z"))


@query
def interp_nearest(spark, sf):
    return interpolate.from_raster_nearest(t.scattered(spark, sf), t.raster_cells(spark, sf, True))


@query
def interp_mesh_to_mesh(spark, sf):
    e, n = _mesh(spark, sf)
    return interpolate.from_mesh(t.scattered(spark, sf), e, n).select("pid", r6("value").alias("value"))


@query
def interp_fill_nearest(spark, sf):
    p, f = t.scattered(spark, sf), t.features(spark, sf)
    linear = interpolate.from_raster_linear(p, t.raster_cells(spark, sf, True)).withColumnRenamed("z", "value")
    return interpolate.fill_from(linear, interpolate.nearest_value(p, f.withColumn("value", F.col("fid").cast("double"))))


@query
def mesh_contour_segments(spark, sf):
    s = interpolate.mesh_contour_segments(*_mesh(spark, sf), 10)
    return s.select("elem_id", "u", "v", r6("x").alias("x"), r6("y").alias("y"))


# -- scalars and text ----------------------------------------------------------------------------


@query
def utm_project(spark, sf):
    p = t.scattered(spark, sf).select("pid", (F.col("x") * 8 - 160).alias("lon"), (F.col("y") * 3 - 75).alias("lat"))
    zone = g.utm_zone(F.col("lon"), F.col("lat"))
    x, y = g.utm(F.col("lon"), F.col("lat"), zone)
    return p.select("pid", zone.alias("zone"), F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query
def web_mercator(spark, sf):
    p = t.scattered(spark, sf).select("pid", (F.col("x") * 8 - 160).alias("lon"), (F.col("y") * 3 - 75).alias("lat"))
    x, y = g.web_mercator(F.col("lon"), F.col("lat"))
    return p.select("pid", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query
def courant_number(spark, sf):
    n = t.mesh_nodes(spark, sf)
    return n.select("node_id", r6(g.courant_number(F.col("value"), F.col("x") + 100, 150.0)).alias("courant"))


@query
def particle_velocity(spark, sf):
    return t.mesh_nodes(spark, sf).select("node_id", r6(g.particle_velocity(F.col("value"))).alias("velocity"))


@query
def grd_lines(spark, sf):
    e, n = _mesh(spark, sf)
    return text.grd_lines(n, e, "lattice")


@query
def sms2dm_lines(spark, sf):
    e, n = _mesh(spark, sf)
    return text.sms2dm_lines(n, e)


@query
def triangulate(spark, sf):
    from .operators.delaunay import triangulate as tri

    return tri(t.lines(spark, sf).select("line_id", "x", "y"), "line_id")


@query
def stream_cell_minimum(spark, sf):
    from .streaming.cells import minimum_by_cell

    return minimum_by_cell(spark, f"{sf}/events.parquet", t.WIDTH)


@query
def stream_windows(spark, sf):
    from .streaming.cells import windowed_counts

    return windowed_counts(spark, f"{sf}/events.parquet")


# -- boundaries and domains ---------------------------------------------------------------------


@query
def hull_rings(spark, sf):
    return boundaries.ring_types(boundaries.rings(*_mesh(spark, sf)))


@query
def hull_net_area(spark, sf):
    """Areas of rings, summed: that of the elements."""
    return boundaries.ring_types(boundaries.rings(*_mesh(spark, sf))).groupBy("component").agg(F.sum("area").alias("area"))


@query
def boundaries_auto(spark, sf):
    return boundaries.auto_generate(*_mesh(spark, sf))


@query
def boundaries_region(spark, sf):
    e, n = _mesh(spark, sf)
    typed = boundaries.auto_generate(e, n)
    return boundaries.set_region(typed, n, (F.col("x") > 30.5) & (F.col("y") < 2.5), "open").where("btype <> 'interior'").groupBy("btype", "ibtype").agg(F.count("*").alias("n"))


@query
def boundary_runs(spark, sf):
    return boundaries.chains(boundaries.auto_generate(*_mesh(spark, sf)))


@query
def mesh_domain(spark, sf):
    return _joined(domains.mesh_domain(*_mesh(spark, sf), -30, 30))


@query
def domain_collect(spark, sf):
    return domains.collect_domain(t.source_cells(spark, sf), 100000, 250000)


@query
def domain_combine(spark, sf):
    s = t.source_cells(spark, sf).where("row between 5 and 30 and col between 4 and 25")
    base = t.raster_cells(spark, sf).select("row", "col")
    return domains.combine_with_base(s, base, 100000, 250000)


@query
def domain_borders(spark, sf):
    return domains.cell_borders(raster.domain_cells(t.raster_cells(spark, sf), 0, 60))


@query
def domain_components(spark, sf):
    return domains.cell_components(raster.domain_cells(t.raster_cells(spark, sf), 0, 60), t.WIDTH)


@query
def domain_sieve(spark, sf):
    return domains.sieve_cells(raster.domain_cells(t.raster_cells(spark, sf), 0, 60), t.WIDTH, 6)


@query
def remove_slivers(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(domains.remove_slivers(e, n.withColumn("x", F.col("x") + F.col("value") / 128), 0.2))


@query
def cleanup_pinched(spark, sf):
    e, _ = _mesh(spark, sf)
    return _joined(mesh.clip_by_nodes(e, mesh.pinched_nodes(e), every=False, inverse=True))


@query
def clip_mesh_by_mesh(spark, sf):
    e, n = _mesh(spark, sf)
    return _joined(domains.clip_mesh_by_mesh(e, n, mesh.clip_by_nodes(e, _box_nodes(n)), n, 1.5))


@query
def snap_nodes(spark, sf):
    n = t.mesh_nodes(spark, sf).select("node_id", "x", "y")
    return domains.snap(n, "node_id", t.features(spark, sf).withColumn("x", F.col("x") + 0.25), 0.5)


@query
def interp_provenance(spark, sf):
    """Value and source of each node: of overlapping rasters the last one with data."""
    n = t.mesh_nodes(spark, sf).select(F.col("y").cast("long").alias("row"), F.col("x").cast("long").alias("col"), "node_id")
    hit = n.join(t.source_cells(spark, sf), ["row", "col"])
    return hit.groupBy("node_id").agg(F.max_by(F.struct("raster_id", "z"), F.struct("raster_id", "tie")).alias("m")).select("node_id", "m.raster_id", "m.z")


@query
def boxes_smaller_than(spark, sf):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0") + F.col("poly_id") % 4)
    return t.boxes(spark, sf).withColumn("area", area).where("area < 20").select("poly_id", "area")


@query
def box_largest(spark, sf):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0") + F.col("poly_id") % 4)
    b = t.boxes(spark, sf).withColumn("area", area)
    return b.agg(F.max(F.struct("area", -F.col("poly_id"))).alias("m")).select((-F.col("m.col2")).alias("poly_id"), "m.area")


@query
def line_redistribute(spark, sf):
    return lines.redistribute(t.lines(spark, sf), 3.0).select("line_id", "k", r6("x").alias("x"), r6("y").alias("y"))


@query
def line_lengths(spark, sf):
    return lines.lengths(t.lines(spark, sf)).groupBy("line_id").agg(r6(F.max("d")).alias("length"), F.count("*").alias("n"))


@query
def negative_share(spark, sf):
    """Share of cells below sea level, by row: where the colours of topography and bathymetry part."""
    return t.raster_cells(spark, sf, True).groupBy("row").agg(r6(F.avg((F.col("z") < 0).cast("double"))).alias("share"))


@query
def zone_of_bounds(spark, sf):
    p = t.scattered(spark, sf).select((F.col("x") * 2 - 100).alias("x"), (F.col("y") + 10).alias("y"))
    b = raster.bbox(p)
    return b.select(g.utm_zone((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).alias("zone"), ((F.col("y0") + F.col("y1")) / 2 < 0).alias("south"))


@query
def hfun_mesh_feature(spark, sf):
    """Sizes of a mesh, from its edges, lowered around places; the largest size is the bound."""
    e, n = _mesh(spark, sf)
    p = n.join(mesh.size_from_mesh(e, n), "node_id").withColumn("h", F.col("h") * 20).withColumnRenamed("value", "z")
    return _sized(sizing.feature(p, "node_id", t.features(spark, sf), 0.5, 5, hmax=30))


@query
def raster_generic_range(spark, sf):
    return raster.generic_filter(t.raster_cells(spark, sf), 3, lambda a: a.max() - a.min(), tile=16)


@query
def mesh_polygons(spark, sf):
    from .operators.engine import generate

    b = t.boxes(spark, sf).where("poly_id < 5")
    corner = F.array(*[F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))])
    return generate(b.select("poly_id", F.lit(0).alias("ring"), F.inline(corner)), 1.0)[1].groupBy("poly_id").agg(F.count("*").alias("n"))


@query
def stream_sessions(spark, sf):
    from .streaming.cells import session_counts

    return session_counts(spark, f"{sf}/events.parquet")


@query
def remesh_holes(spark, sf):
    """Triangles that close the holes of the mesh: their areas by size."""
    from .operators.engine import fill_holes

    e, n = _mesh(spark, sf)
    new = fill_holes(e, n, 0.0, 1.5)
    return mesh.element_areas(new, n).agg(F.count("*").alias("n"), F.sum(F.abs("area")).alias("area"))


# -- polygons, contours, stored rasters ----------------------------------------------------


def _land(spark, sf) -> DataFrame:
    return raster.domain_cells(t.raster_cells(spark, sf), 0, 60)


@query
def raster_polygons(spark, sf):
    """Rings with holes around the cells of a domain: corners, signed areas and lengths."""
    p = polygons.from_cells(_land(spark, sf), t.WIDTH)
    return polygons.measures(p, ["poly", "ring", "ring_type"]).select("poly", F.col("ring").cast("long").alias("ring"), "ring_type", "n_corners", "area", "length")


@query
def polygon_areas(spark, sf):
    """Net area and rings of each polygon: that of its cells."""
    m = polygons.measures(polygons.from_cells(_land(spark, sf), t.WIDTH))
    return m.groupBy("poly").agg(F.count("*").alias("n_rings"), F.sum("area").alias("area"))


@query
def polygon_triangles(spark, sf):
    """Triangles between the corners of polygons with holes: their number and area."""
    tri = polygons.triangulate(polygons.from_cells(_land(spark, sf), t.WIDTH))
    x, y = (lambda i: F.get("xs", F.lit(i))), (lambda i: F.get("ys", F.lit(i)))
    area = F.abs((x(1) - x(0)) * (y(2) - y(0)) - (y(1) - y(0)) * (x(2) - x(0))) / 2
    return tri.groupBy("poly").agg(F.count("*").alias("n"), F.sum(area).alias("area"))


@query
def polygon_points(spark, sf):
    """Which polygon holds a point."""
    points = t.scattered(spark, sf).select("pid", (F.col("x") + 0.125).alias("x"), (F.col("y") + 0.125).alias("y"))
    return polygons.containing(points, polygons.from_cells(_land(spark, sf), t.WIDTH))


@query
def polygon_round_trip(spark, sf):
    """Polygons as nested rows and back: corners of each ring."""
    back = polygons.explode(polygons.implode(polygons.from_cells(_land(spark, sf), t.WIDTH)))
    return back.groupBy("poly", F.col("ring").cast("long").alias("ring"), "ring_type").agg(F.count("*").alias("n_corners"))


@query
def contour_lines(spark, sf):
    """Contours joined into lines: points and extent of each."""
    c = raster.contour_lines(t.raster_cells(spark, sf), 10.0)
    return c.groupBy("line", "closed").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("sx"), r6(F.sum("y")).alias("sy"))


@query
def contour_polygons(spark, sf):
    """Rings and area of the ground at or above a level, borders interpolated."""
    p = polygons.from_contours(t.raster_cells(spark, sf), 10.0)
    m = polygons.measures(p, ["poly", "ring", "ring_type"])
    return m.groupBy("ring_type").agg(F.count("*").alias("n"), r6(F.sum("area")).alias("area"))


@query
def hfun_patch_expansion(spark, sf):
    n = _mesh(spark, sf)[1]
    p = sizing.initial(n.withColumnRenamed("value", "z"), 100)
    border = sizing.ring_places(spark, WEDGE, 0.5)
    out = sizing.patch_expanded(p, "node_id", _in_wedge(), border, 15.0, 0.25, hmax=60)
    return out.select("node_id", r6("h").alias("h"))


def _in_wedge() -> Column:
    from .plans.spatial import in_polygon

    return in_polygon(F.col("x"), F.col("y"), WEDGE)


@query
def grd_boundaries(spark, sf):
    """Boundary sections of a grd file: the lower side is open, the left one land, two cells an island."""
    n = _mesh(spark, sf)[1]
    kind = lambda k, btype, ibtype, seq: F.struct(F.lit(k).alias("bnd_id"), F.lit(btype).alias("btype"), F.lit(ibtype).cast("int").alias("ibtype"), seq.cast("long").alias("seq"))
    b = F.when(F.col("y") == 0, kind(1, "open", None, F.col("x"))).when(F.col("x") == 0, kind(1, "land", 20, F.col("y") - 1))
    b = b.when((F.col("y") == 1) & F.col("x").between(5, 8), kind(2, "interior", None, F.col("x") - 5))
    rows = n.select(b.alias("b"), "node_id").where("b is not null").select("b.*", "node_id")
    return text.grd_boundary_lines(rows)


@query
def mesh_difference(spark, sf):
    """The mesh less the polygons of a raster domain."""
    from .operators.engine import difference

    return _joined(difference(*_mesh(spark, sf), polygons.from_cells(_land(spark, sf).where("col between 4 and 30"), t.WIDTH)))


@query
def raster_windows(spark, sf):
    """Windows that tile a raster, with their bounds."""
    cells = t.raster_cells(spark, sf)
    m = store.Meta(100.0, 50.0, 0.5, -0.25, (cells.agg(F.max("row")).first()[0] or 0) + 1, t.WIDTH)
    return store.window_bounds(store.sample_windows(m, 16)(spark), m)


@query
def raster_digest(spark, sf):
    return store.digest(t.raster_cells(spark, sf, True), 16)


@query
def ascii_grid(spark, sf):
    """Lines of an ASCII grid: length and first characters of each."""
    cells = t.raster_cells(spark, sf, True)
    m = store.Meta(0.0, 10.0, 2.0, -2.0, (cells.agg(F.max("row")).first()[0] or 0) + 1, t.WIDTH)
    return store.ascii_lines(cells, m).select("section", "id", F.substring("line", 1, 30).alias("head"), F.length("line").alias("n"))


@query
def crs_round_trip(spark, sf):
    """Longitudes and latitudes to a UTM zone, to web Mercator, to another zone and back."""
    p = t.scattered(spark, sf).select("pid", (F.col("x") / 4 + 8).alias("lon"), (F.col("y") * 3 - 75).alias("lat"))
    for a, b in (("EPSG:4326", "EPSG:32633"), ("EPSG:32633", "EPSG:3857"), ("EPSG:3857", "EPSG:32732"), ("EPSG:32732", "EPSG:4326")):
        x, y = g.reproject(F.col("lon"), F.col("lat"), a, b)
        p = p.select("pid", x.alias("lon"), y.alias("lat"))
    return p.select("pid", r6("lon").alias("lon"), r6("lat").alias("lat"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .catalog_sql import ORACLE

    return dict(ORACLE)
