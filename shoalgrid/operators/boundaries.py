"""Boundary rings, hulls and boundary conditions.

A boundary edge is used by one element. Rings are closed chains of such edges
within a component of elements; the ring of largest area is its exterior. Types:
open, land (ibtype 0), island (ibtype 1; any ibtype that ends in 1 is interior).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chains import traced
from ..plans.graph import components
from . import mesh


def rings(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, ring, seq, node_id, x, y): boundary edges traced into closed rings, elements on their left.

    A ring starts at its smallest edge; rings of a component are numbered in the
    order of these. At nodes where a component touches itself the edges that
    arrive, by their first node, go on with those that leave, by their last one.
    Edges are traced by pointer doubling: no task holds a coastline.
    """
    marked = mesh.directed_boundary(elements).join(mesh.element_components(elements).hint("merge"), "elem_id").select("component", "a", "b")
    edges = mesh.checkpointed(marked)
    found = traced(mesh.preceding(edges, ["component"]).select(F.struct("a", "b").alias("id"), "prev"))
    first = edges.join(found.where("seq = 0").select("id.a", "id.b", F.col("id").alias("root")).hint("merge"), ["a", "b"])
    number = first.select("root", "component", (F.row_number().over(Window.partitionBy("component").orderBy("root")) - 1).alias("ring"))  # a row a ring
    out = found.join(number.hint("merge"), "root").select("component", "ring", F.col("seq").cast("int").alias("seq"), F.col("id.a").alias("node_id"))
    return out.join(nodes.select("node_id", "x", "y").hint("merge"), "node_id").select("component", "ring", "seq", "node_id", "x", "y")


def ring_types(traced: DataFrame) -> DataFrame:
    """(component, ring, area, ring_type): exterior is the ring of largest area of a component (ties: the first)."""
    from .lines import ring_areas

    area = ring_areas(traced, ["component", "ring"])
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.abs("area").desc(), "ring")) == 1
    return area.withColumn("ring_type", F.when(first, "exterior").otherwise("interior"))


def hull(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rings with their types: the polygons of a mesh, all parts. Rings are checkpointed, as they are read twice."""
    traced = mesh.checkpointed(rings(elements, nodes))
    return traced.join(ring_types(traced).select("component", "ring", "ring_type").hint("merge"), ["component", "ring"])


def edges_of(rings_: DataFrame) -> DataFrame:
    """(component, ring, ring_type, seq, a, b): consecutive nodes of rings."""
    w = Window.partitionBy("component", "ring").orderBy("seq")
    return rings_.withColumn("b", F.coalesce(F.lead("node_id").over(w), F.first("node_id").over(w))).select("component", "ring", "ring_type", "seq", F.col("node_id").alias("a"), "b")


def auto_generate(elements: DataFrame, nodes: DataFrame, threshold: float = 0.0, land_ibtype: int = 0, interior_ibtype: int = 1) -> DataFrame:
    """(a, b, btype, ibtype): exterior edges open or land by elevation, edges of interior rings islands."""
    e = edges_of(hull(elements, nodes))
    z = lambda c: nodes.select(F.col("node_id").alias(c), F.col("value").alias(f"z{c}")).hint("merge")
    e = e.join(z("a"), "a").join(z("b"), "b")
    bad = F.col("za").isNull() | F.col("zb").isNull() | F.isnan("za") | F.isnan("zb")
    land = (F.col("za") >= threshold) | (F.col("zb") >= threshold)
    kind = F.when(bad, F.raise_error(F.lit("a boundary node has no value"))).when(F.col("ring_type") == "interior", "interior").when(land, "land").otherwise("open")
    typed = e.withColumn("btype", kind)
    ibtype = F.when(F.col("btype") == "interior", interior_ibtype).when(F.col("btype") == "land", land_ibtype)
    return typed.select("a", "b", "btype", ibtype.cast("int").alias("ibtype"))


def islands(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    return hull(elements, nodes).where("ring_type = 'interior'")


def set_region(boundaries: DataFrame, nodes: DataFrame, region: Column, btype: str, ibtype: int | None = None) -> DataFrame:
    """Assign exterior edges (a, b, btype, ibtype) with an end in ``region`` (a predicate over x, y) to a type.

    Chains of the changed table (``chains``) split and join by themselves.
    """
    if btype not in ("open", "land"):
        raise ValueError("exterior edges are open or land")
    inside = nodes.where(region).select("node_id").distinct()
    end = lambda c: inside.select(F.col("node_id").alias(c), F.lit(True).alias(f"_{c}")).hint("merge")
    out = boundaries.join(end("a"), "a", "left").join(end("b"), "b", "left")  # boundaries are read once
    change = (F.col("_a").isNotNull() | F.col("_b").isNotNull()) & (F.col("btype") != "interior")
    return out.select("a", "b", F.when(change, btype).otherwise(F.col("btype")).alias("btype"), F.when(change, F.lit(ibtype)).otherwise(F.col("ibtype")).cast("int").alias("ibtype"))


def of_type(boundaries: DataFrame, btype: str) -> DataFrame:
    return boundaries.where(F.col("btype") == btype)


def type_of(ibtype: Column) -> Column:
    """open for null, interior where the number ends in 1, else land."""
    return F.when(ibtype.isNull(), "open").when(F.endswith(ibtype.cast("string"), F.lit("1")), "interior").otherwise("land")


def chains(boundaries: DataFrame) -> DataFrame:
    """(bnd, btype, n_edges): connected runs of edges of a type; bnd is the smallest node. Edges are checkpointed, as they are read twice."""
    kind = F.when(F.col("btype") == "open", 0).when(F.col("btype") == "land", 1).otherwise(2)
    e = mesh.checkpointed(boundaries.select("btype", (F.col("a") * 3 + kind).alias("_ka"), (F.col("b") * 3 + kind).alias("_kb")))
    roots = components(e.select(F.col("_ka").alias("a"), F.col("_kb").alias("b")))
    return e.join(roots.hint("merge"), F.col("_ka") == F.col("node")).groupBy(F.floor(F.col("root") / 3).alias("bnd"), "btype").agg(F.count("*").alias("n_edges"))
