"""Mesh operators: edges, boundaries, angles, clean-up, clipping and editing.

A mesh is two tables: nodes (node_id, x, y, value) and elements (elem_id, etype,
nodes), where nodes is an array of node ids in ring order. Operators take and
return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, heron, signed_area
from ..plans.chains import traced
from ..plans.graph import components
from ..plans.numbering import checkpointed, numbered

# -- construction -------------------------------------------------------------


def rectangle_nodes(nx: int, ny: int, spark) -> DataFrame:
    """Nodes of an nx x ny lattice, value 10."""
    return spark.range(nx * ny).select(F.col("id").alias("node_id"), (F.col("id") % nx).cast("double").alias("x"), F.floor(F.col("id") / nx).cast("double").alias("y"), F.lit(10.0).alias("value"))


def rectangle_elements(spark, nx: int, ny: int, hole: Column | None = None, quad: Column | None = None) -> DataFrame:
    """Elements of a lattice: two triangles a cell, a quadrangle where ``quad``, none where ``hole``.

    Both are predicates over ``cell`` (row * (nx - 1) + column, from 0); a hole comes first.
    """
    cells = spark.range(max(0, (nx - 1) * (ny - 1))).withColumnRenamed("id", "cell")
    if hole is not None:
        cells = cells.where(~hole)
    a = F.floor(F.col("cell") / (nx - 1)) * nx + F.col("cell") % (nx - 1)
    b, c, d = a + 1, a + nx + 1, a + nx
    one = lambda k, kind, *n: F.struct((F.col("cell") * 2 + k).alias("elem_id"), F.lit(kind).alias("etype"), F.array(*n).alias("nodes"))
    two = F.array(one(0, "tria", a, b, d), one(1, "tria", b, c, d))
    parts = two if quad is None else F.when(quad, F.array(one(0, "quad", a, b, c, d))).otherwise(two)
    return cells.select(F.inline(parts))


def corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements with the arrays xs, ys and values of their corners."""
    parts = elements.select("elem_id", "etype", "nodes", F.posexplode("nodes").alias("pos", "node_id"))
    joined = parts.join(nodes.select("node_id", "x", "y", "value").hint("merge"), "node_id")
    ring = F.array_sort(F.collect_list(F.struct("pos", "x", "y", "value")))
    found = joined.groupBy("elem_id").agg(F.first("etype").alias("etype"), F.first("nodes").alias("nodes"), ring.alias("c"))
    return found.select("elem_id", "etype", "nodes", F.col("c.x").alias("xs"), F.col("c.y").alias("ys"), F.col("c.value").alias("values"))


def triangulation(elements: DataFrame) -> DataFrame:
    """Quadrangles split into (0, 1, 3) and (1, 2, 3); part 0 or 1."""
    n = lambda *i: F.array(*[F.get("nodes", F.lit(k)) for k in i])
    parts = F.when(F.size("nodes") == 4, F.array(n(0, 1, 3), n(1, 2, 3))).otherwise(F.array(F.col("nodes")))
    return elements.select("elem_id", F.posexplode(parts).alias("part", "nodes"))


def element_ids(elements: DataFrame) -> DataFrame:
    """Export ids from 1: triangles first, then quadrangles, each cut into ranges of elem_id."""
    trias, quads = elements.where("etype = 'tria'"), elements.where("etype <> 'tria'")
    first = trias.count()
    return numbered(trias, ["elem_id"], "_n").withColumn("id", F.col("_n") + 1).unionByName(numbered(quads, ["elem_id"], "_n").withColumn("id", F.col("_n") + 1 + first)).drop("_n")


# -- edges ------------------------------------------------------------------------


def sides(elements: DataFrame) -> DataFrame:
    """(elem_id, u, v) of every side, u < v."""
    n = F.col("nodes")
    pairs = F.transform(n, lambda a, i: F.struct(F.least(a, F.get(n, (i + 1) % F.size(n))).alias("u"), F.greatest(a, F.get(n, (i + 1) % F.size(n))).alias("v")))
    return elements.select("elem_id", F.inline(pairs))


def mesh_edges(elements: DataFrame) -> DataFrame:
    """(u, v, n_elem): distinct undirected edges and how many elements have them."""
    return sides(elements).groupBy("u", "v").agg(F.count("*").alias("n_elem"))


def boundary_edges(elements: DataFrame) -> DataFrame:
    return mesh_edges(elements).where("n_elem = 1").select("u", "v")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ux, uy, uz, vx, vy, vz."""
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("value").alias(f"{c}z"))
    return edges.join(end("u"), "u").join(end("v"), "v")


def edge_lengths(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    e = with_ends(mesh_edges(elements), nodes)
    return e.select("u", "v", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")).alias("length"))


def boundary_types(elements: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(u, v, length, btype): a boundary edge is land if either end reaches ``threshold``, else open.

    Raises where a value is missing.
    """
    e = with_ends(boundary_edges(elements), nodes)
    bad = F.col("uz").isNull() | F.col("vz").isNull() | F.isnan("uz") | F.isnan("vz")
    kind = F.when(bad, F.raise_error(F.lit("a boundary node has no value"))).when((F.col("uz") >= threshold) | (F.col("vz") >= threshold), "land").otherwise("open")
    return e.select("u", "v", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")).alias("length"), kind.alias("btype"))


def vertex_adjacency(elements: DataFrame) -> DataFrame:
    """(node_id, other): all pairs of nodes of an element, diagonals included."""
    pairs = elements.select(F.explode("nodes").alias("node_id"), "nodes").select("node_id", F.explode("nodes").alias("other"))
    return pairs.where("node_id <> other").distinct()


def pinched_nodes(elements: DataFrame) -> DataFrame:
    """(node_id, n_boundary): nodes with more than two boundary edges."""
    ends = boundary_edges(elements).select(F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("n_boundary")).where("n_boundary > 2")


def interior_nodes(elements: DataFrame) -> DataFrame:
    used = elements.select(F.explode("nodes").alias("node_id")).distinct()
    return used.join(boundary_edges(elements).select(F.explode(F.array("u", "v")).alias("node_id")), "node_id", "left_anti")


def incident_edges(elements: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges that touch a node of ``chosen`` (node_id)."""
    c = chosen.select("node_id").distinct()
    e = mesh_edges(elements).select("u", "v")
    return e.join(c, e.u == c.node_id, "left_semi").unionByName(e.join(c, e.v == c.node_id, "left_semi")).distinct()


def size_from_mesh(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, h): mean length of a node's edges, 0 without any."""
    ends = edge_lengths(elements, nodes).select(F.explode(F.array("u", "v")).alias("node_id"), "length")
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.avg("length").alias("h")), "node_id", "left").select("node_id", F.coalesce("h", F.lit(0.0)).alias("h"))


# -- element measures -------------------------------------------------------------


def tria_areas(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    return corners(elements.where("etype = 'tria'"), nodes).select("elem_id", heron(F.col("xs"), F.col("ys")).alias("area"))


def element_areas(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    return corners(elements, nodes).select("elem_id", "etype", signed_area(F.col("xs"), F.col("ys")).alias("area"))


def element_angles(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(elem_id, corner, angle) in degrees, corners from 0."""
    c = corners(elements, nodes)
    return c.select("elem_id", "xs", "ys", F.posexplode("nodes").alias("corner", "_n")).select("elem_id", "corner", angle(F.col("xs"), F.col("ys"), F.col("corner")).alias("angle"))


# -- selections --------------------------------------------------------------------


def clip_by_nodes(elements: DataFrame, chosen: DataFrame, every: bool = True, inverse: bool = False) -> DataFrame:
    """Elements of which all (or any) nodes are ``chosen``; the others if ``inverse``."""
    parts = elements.select("elem_id", F.explode("nodes").alias("node_id")).join(chosen.select("node_id").distinct(), "node_id", "left_semi")
    hits = parts.groupBy("elem_id").agg(F.count("*").alias("hits"))
    e = elements.join(hits, "elem_id", "left")
    hit = F.coalesce(F.col("hits"), F.lit(0))
    keep = (hit == F.size("nodes")) if every else (hit > 0)
    return e.where(~keep if inverse else keep).select("elem_id", "etype", "nodes")


def nodes_in_box(nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = box
    return nodes.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1)).select("node_id")


def nodes_in_polygon(nodes: DataFrame, ring: list[tuple[float, float]], closed: bool = True) -> DataFrame:
    """A box test first (pushed to the scan), then even-odd; the border counts unless ``closed`` is False."""
    from ..plans.spatial import in_polygon

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    near = nodes.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return near.where(in_polygon(F.col("x"), F.col("y"), ring, closed)).select("node_id")


def surrounding_nodes(elements: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes of all elements that touch ``chosen``."""
    return clip_by_nodes(elements, chosen, every=False).select(F.explode("nodes").alias("node_id")).distinct()


def select_adjacent(elements: DataFrame, chosen: DataFrame, layers: int) -> DataFrame:
    """``chosen`` grown by ``layers`` - 1 rings of elements (0 and 1: none)."""
    found = chosen.select("node_id").distinct()
    for _ in range(layers - 1):
        # both sides stem from one checkpoint: a full join, as a union of them trips the optimizer's constraint rewriting
        found = checkpointed(surrounding_nodes(elements, found).join(found, "node_id", "full").select("node_id"))
    return found


def lone_elements(elements: DataFrame) -> DataFrame:
    """Elements of which every node is used once in the mesh."""
    once = elements.select(F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n")).where("n = 1")
    return clip_by_nodes(elements, once)


def remove_by_edges(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements with fewer than two nodes among those of ``edges`` (u, v)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    parts = elements.select("elem_id", F.explode("nodes").alias("node_id")).join(ends, "node_id", "left_semi")
    return elements.join(parts.groupBy("elem_id").agg(F.count("*").alias("n")).where("n >= 2"), "elem_id", "left_anti")


def clip_by_index(elements: DataFrame, index: DataFrame, inverse: bool = False) -> DataFrame:
    """Drop the elements of ``index`` (elem_id); keep only those if ``inverse``."""
    return elements.join(index.select("elem_id").distinct(), "elem_id", "left_semi" if inverse else "left_anti")


def cross_edges(elements: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """(u, v) of edges that meet the border of a polygon given as a literal ring."""
    e = with_ends(mesh_edges(elements), nodes)
    ux, uy, vx, vy = (F.col(c) for c in ("ux", "uy", "vx", "vy"))
    met = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        a, b, c, d = (F.lit(float(k)) for k in (x1, y1, x2, y2))
        o1, o2 = turn(ux, uy, vx, vy, a, b), turn(ux, uy, vx, vy, c, d)
        o3, o4 = turn(a, b, c, d, ux, uy), turn(a, b, c, d, vx, vy)
        within = lambda px, py, qx, qy, rx, ry: rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))
        touch = ((o1 == 0) & within(ux, uy, vx, vy, a, b)) | ((o2 == 0) & within(ux, uy, vx, vy, c, d)) | ((o3 == 0) & within(a, b, c, d, ux, uy)) | ((o4 == 0) & within(a, b, c, d, vx, vy))
        met = met | ((o1 != o2) & (o3 != o4) & (o1 * o2 <= 0) & (o3 * o4 <= 0)) | touch
    return e.where(met).select("u", "v")


def clip_with_cross_edges(elements: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]], inverse: bool = False) -> DataFrame:
    """Any-match clip by a polygon whose border-crossing edges count: their nodes join the set; inverse drops elements with two of them."""
    inside = nodes_in_polygon(nodes, ring)
    crossing = cross_edges(elements, nodes, ring)
    if inverse:
        return remove_by_edges(clip_by_nodes(elements, inside, every=False, inverse=True), crossing)
    ends = crossing.select(F.explode(F.array("u", "v")).alias("node_id"))
    return clip_by_nodes(elements, inside.unionByName(ends), every=False)


# -- clean-up ------------------------------------------------------------------------


def renumber(elements: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace node ids by ``mapping`` (node_id, new_id), ring order kept."""
    parts = elements.select("elem_id", "etype", F.posexplode("nodes").alias("pos", "node_id")).join(mapping, "node_id")
    found = parts.groupBy("elem_id").agg(F.first("etype").alias("etype"), F.array_sort(F.collect_list(F.struct("pos", "new_id"))).alias("c"))
    return found.select("elem_id", "etype", F.col("c.new_id").alias("nodes"))


def cleanup_isolates(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop unused nodes; new ids are ranks of the old ones."""
    used = nodes.join(elements.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")
    ranked = numbered(used, ["node_id"], "new_id")
    return ranked.select(F.col("new_id").alias("node_id"), "x", "y", "value"), renumber(elements, ranked.select("node_id", "new_id"))


def cleanup_duplicates(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge nodes of equal place (ids by (x, y), value of the first) and drop elements of equal node sets (first kept)."""
    place = nodes.groupBy("x", "y").agg(F.min(F.struct("node_id", "value")).alias("first"))
    ranked = numbered(place, ["x", "y"], "new_id")
    mapping = nodes.join(ranked.select("x", "y", "new_id"), ["x", "y"]).select("node_id", "new_id")
    moved = renumber(elements, mapping).withColumn("_key", F.array_sort("nodes"))
    first = moved.groupBy("etype", "_key").agg(F.min(F.struct("elem_id", "nodes")).alias("e"))
    return ranked.select(F.col("new_id").alias("node_id"), "x", "y", F.col("first.value").alias("value")), first.select("e.elem_id", "etype", "e.nodes")


def cleanup_skewed(elements: DataFrame, nodes: DataFrame, tria: tuple[float, float] = (1.0, 175.0), quad: tuple[float, float] = (10.0, 179.0)) -> DataFrame:
    """Drop elements with an angle below the lower or at or above the upper bound of their kind."""
    bound = lambda i: F.when(F.col("etype") == "tria", tria[i]).otherwise(quad[i])
    a = element_angles(elements, nodes).join(elements.select("elem_id", "etype"), "elem_id")
    bad = a.where((F.col("angle") < bound(0)) | (F.col("angle") >= bound(1))).select("elem_id").distinct()
    return elements.join(bad, "elem_id", "left_anti")


def cleanup_concave(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop quadrangles whose turns don't all agree."""
    c = corners(elements.where("etype = 'quad'"), nodes)
    at = lambda a, i: F.get(a, F.lit(i % 4))
    turn = lambda i: (at(F.col("xs"), i + 1) - at(F.col("xs"), i)) * (at(F.col("ys"), i + 2) - at(F.col("ys"), i + 1)) - (at(F.col("ys"), i + 1) - at(F.col("ys"), i)) * (at(F.col("xs"), i + 2) - at(F.col("xs"), i + 1))
    turns = F.array(*[turn(i) for i in range(4)])
    bad = c.where(~(F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0))).select("elem_id")
    return elements.join(bad, "elem_id", "left_anti")


def cleanup_folded(elements: DataFrame) -> DataFrame:
    """Drop triangles of which all nodes are boundary nodes."""
    ends = boundary_edges(elements).select(F.explode(F.array("u", "v")).alias("node_id"))
    bad = clip_by_nodes(elements.where("etype = 'tria'"), ends)
    return elements.join(bad.select("elem_id"), "elem_id", "left_anti")


def order_ccw(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of each element by angle around its centroid, from -180 degrees on."""
    c = corners(elements, nodes)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    turned = F.array_sort(F.transform("nodes", lambda n, i: F.struct(F.atan2(F.get("ys", i) - mean(F.col("ys")), F.get("xs", i) - mean(F.col("xs"))).alias("t"), n.alias("n"))))
    return c.select("elem_id", "etype", turned.alias("t")).select("elem_id", "etype", F.col("t.n").alias("nodes"))


def quads_from_tri(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(elem_id, nodes): pairs of triangles joined across the side opposite to their corner nearest to 90 degrees.

    elem_id is the smaller of the pair's; triangles that don't pair are left out.
    """
    tri = elements.where("etype = 'tria'")
    a = element_angles(tri, nodes).withColumn("off", F.round(F.abs(F.col("angle") - 90), 6))
    best = a.groupBy("elem_id").agg(F.min(F.struct("off", "corner")).alias("b")).select("elem_id", F.col("b.corner").alias("corner"))
    n = lambda k: F.get("nodes", (F.col("corner") + k) % 3)
    d = tri.join(best, "elem_id").select("elem_id", n(0).alias("tip"), F.least(n(1), n(2)).alias("u"), F.greatest(n(1), n(2)).alias("v"))
    pairs = d.groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("elem_id", "tip"))).alias("t")).where(F.size("t") == 2)
    q = pairs.select(F.get("t", F.lit(0))["elem_id"].alias("elem_id"), F.array(F.get("t", F.lit(0))["tip"], F.col("u"), F.get("t", F.lit(1))["tip"], F.col("v")).alias("nodes"), F.lit("quad").alias("etype"))
    q = q.where(F.size(F.array_distinct("nodes")) == 4)
    return order_ccw(q, nodes).select("elem_id", "nodes")


# -- components ------------------------------------------------------------------------


def element_components(elements: DataFrame) -> DataFrame:
    """(elem_id, component): elements connected through shared edges; component is the smallest elem_id."""
    s = sides(elements)
    hub = s.groupBy("u", "v").agg(F.min("elem_id").alias("a"))
    links = s.join(hub.hint("merge"), ["u", "v"]).where("elem_id <> a").select("a", F.col("elem_id").alias("b"))
    roots = components(links)
    return elements.select("elem_id").join(roots.hint("merge"), F.col("elem_id") == F.col("node"), "left").select("elem_id", F.coalesce("root", "elem_id").alias("component"))


def component_areas(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, n_elem, area)."""
    e = element_components(elements).join(element_areas(elements, nodes).select("elem_id", F.abs("area").alias("area")), "elem_id")
    return e.groupBy("component").agg(F.count("*").alias("n_elem"), F.sum("area").alias("area"))


def sieve(elements: DataFrame, nodes: DataFrame, area: float | None = None) -> DataFrame:
    """Elements of components larger than ``area``; of the largest one (ties: all) without it."""
    comp = checkpointed(element_components(elements))
    areas = comp.join(element_areas(elements, nodes).select("elem_id", F.abs("area").alias("area")), "elem_id").groupBy("component").agg(F.sum("area").alias("area"))
    least = F.lit(area) if area is not None else None
    if least is None:
        top = areas.agg(F.max("area").alias("top")).first().top
        keep = areas.where(F.col("area") >= F.lit(top)) if top is not None else areas
    else:
        keep = areas.where(F.col("area") > least)
    return elements.join(comp.join(keep.select("component"), "component", "left_semi").select("elem_id"), "elem_id", "left_semi")


def finalize(nodes: DataFrame, elements: DataFrame, area: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Pinched nodes and small components go until neither is left; then isolates and duplicates."""
    while True:
        before = elements.count()
        pinched = pinched_nodes(elements)
        elements = checkpointed(clip_by_nodes(elements, pinched, every=False, inverse=True))
        elements = checkpointed(sieve(elements, nodes, area))
        if elements.count() == before:
            break
    nodes, elements = cleanup_isolates(nodes, elements)
    return cleanup_duplicates(nodes, elements)


def directed_boundary(elements: DataFrame) -> DataFrame:
    """(elem_id, a, b): boundary edges in the direction of their element's ring."""
    steps = F.expr("transform(nodes, (a, i) -> struct(a as a, nodes[(i + 1) % size(nodes)] as b))")
    directed = elements.select("elem_id", F.inline(steps))
    return directed.join(boundary_edges(elements).hint("merge"), (F.least("a", "b") == F.col("u")) & (F.greatest("a", "b") == F.col("v"))).select("elem_id", "a", "b")


def preceding(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Directed ``edges`` (keys, a, b) with prev: the edge (a, b) before each among those of equal ``keys``, null for none.

    Where several arrive at a node, the k-th by its first node goes on with the
    k-th that leaves it, by its last node.
    """
    leaving = edges.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("b")))
    arriving = edges.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "b").orderBy("a"))).select(*keys, F.col("b").alias("_at"), "_k", F.struct("a", "b").alias("prev"))
    met = leaving.withColumn("_at", F.col("a")).join(arriving.hint("merge"), [*keys, "_at", "_k"], "left")
    return met.select(*keys, "a", "b", "prev")


def boundary_chains(elements: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(chain, btype, seq, node_id): boundary edges of a type chained into node lists, elements on their left.

    A chain is named by its first edge; a closed one starts, and ends, at the
    first node of its smallest edge. Traced by pointer doubling.
    """
    typed = boundary_types(elements, nodes, threshold).select(F.col("u").alias("_u"), F.col("v").alias("_v"), "btype")
    e = checkpointed(directed_boundary(elements).join(typed, (F.least("a", "b") == F.col("_u")) & (F.greatest("a", "b") == F.col("_v"))).select("btype", "a", "b"))
    found = traced(preceding(e, ["btype"]).select(F.struct("a", "b").alias("id"), "prev"))
    found = found.select(F.concat_ws("-", "root.a", "root.b").alias("chain"), "seq", F.col("id.a").alias("a"), F.col("id.b").alias("b")).join(e, ["a", "b"])
    last = found.groupBy("chain").agg(F.max(F.struct("seq", "b", "btype")).alias("m")).select("chain", "m.btype", (F.col("m.seq") + 1).alias("seq"), F.col("m.b").alias("node_id"))
    return found.select("chain", "btype", "seq", F.col("a").alias("node_id")).unionByName(last).withColumn("seq", F.col("seq").cast("int"))


# -- merging ------------------------------------------------------------------------------


def merge_priority(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Stack meshes, the last first: elements of earlier ones go if all their nodes lie strictly in the box of a later one."""
    nodes_out, elements_out, offset, elem_offset, taken = None, None, 0, 0, []
    for nodes, elements in reversed(meshes):
        for box in taken:
            elements = clip_by_nodes(elements, nodes_in_box(nodes, box), every=True, inverse=True)
        b = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max("node_id")).first()
        top = elements.agg(F.max("elem_id")).first()[0]
        n = nodes.select((F.col("node_id") + offset).alias("node_id"), "x", "y", "value")
        e = elements.select((F.col("elem_id") + elem_offset).alias("elem_id"), "etype", F.expr(f"transform(nodes, k -> k + {offset})").alias("nodes"))
        nodes_out = n if nodes_out is None else nodes_out.unionByName(n)
        elements_out = e if elements_out is None else elements_out.unionByName(e)
        taken.append((b[0], b[1], b[2], b[3]))
        offset, elem_offset = offset + (b[4] or 0) + 1, elem_offset + (top or 0) + 1
    return nodes_out, elements_out


def merge_neighbors(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Stack meshes and fuse nodes of equal place; elements of equal node sets go."""
    nodes, elements = merge_stack(meshes)
    return cleanup_duplicates(nodes, elements)


def merge_stack(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union with shifted ids."""
    nodes_out, elements_out, offset, elem_offset = None, None, 0, 0
    for nodes, elements in meshes:
        n = nodes.select((F.col("node_id") + offset).alias("node_id"), "x", "y", "value")
        e = elements.select((F.col("elem_id") + elem_offset).alias("elem_id"), "etype", F.expr(f"transform(nodes, k -> k + {offset})").alias("nodes"))
        nodes_out = n if nodes_out is None else nodes_out.unionByName(n)
        elements_out = e if elements_out is None else elements_out.unionByName(e)
        offset += (nodes.agg(F.max("node_id")).first()[0] or 0) + 1
        elem_offset += (elements.agg(F.max("elem_id")).first()[0] or 0) + 1
    return nodes_out, elements_out


def river_quads(arcs: DataFrame) -> DataFrame:
    """(river_idx, arc, seg, xs, ys) from (river_idx, arc, seq, x, y): quadrangles between consecutive arcs of a stream."""
    w = Window.partitionBy("river_idx", "arc").orderBy("seq")
    seg = arcs.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")
    rank = arcs.select("river_idx", "arc").distinct().withColumn("k", F.row_number().over(Window.partitionBy("river_idx").orderBy("arc")))
    seg = seg.join(rank, ["river_idx", "arc"])
    up = seg.select("river_idx", (F.col("k") - 1).alias("k"), "seq", F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("x2").alias("ux2"), F.col("y2").alias("uy2"))
    q = seg.join(up, ["river_idx", "k", "seq"])
    return q.select("river_idx", "arc", F.col("seq").alias("seg"), F.array("x", "ux", "ux2", "x2").alias("xs"), F.array("y", "uy", "uy2", "y2").alias("ys"))
