"""Meshing engine: polygons and size functions to triangles.

A polygon part is meshed in one task: its rings are resampled by size, interior
points are laid out in rows whose spacing follows the size, and the Delaunay
triangles whose centres lie in the polygon are kept. Promised are Delaunay
triangles, coverage up to the resampled border, and sizes near those asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delaunay import delaunay

ENGINES = ("delaunay",)


def get_engine(name: str = "delaunay"):
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; there are {', '.join(ENGINES)}")
    return generate


def inside(rings: list[list[tuple[float, float]]], x: float, y: float) -> bool:
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def resample_ring(ring: list[tuple[float, float]], size) -> list[tuple[float, float]]:
    """Walk a ring with steps of the local size; its corners stay."""
    out = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        length = math.hypot(x2 - x1, y2 - y1)
        n = max(1, round(length / size((x1 + x2) / 2, (y1 + y2) / 2)))
        out += [(x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n) for k in range(n)]
    return out


def mesh_polygon(rings: list[list[tuple[float, float]]], size) -> tuple[list[tuple[float, float]], list[tuple[int, int, int]]]:
    import numpy as np

    border = [resample_ring(r, size) for r in rings]
    points = list(dict.fromkeys(p for r in border for p in r))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    rim = np.array(points)
    rim = rim[np.argsort(rim[:, 1], kind="stable")]  # only border points in a row's band can be near
    levels = np.ascontiguousarray(rim[:, 1])
    y, row = min(ys), 0
    while y < max(ys):
        x, step_y = min(xs), None
        while x < max(xs):
            h = size(x, y)
            step_y = h if step_y is None else min(step_y, h)
            px = x + (h / 2 if row % 2 else 0)
            near = rim[np.searchsorted(levels, y - 0.6 * h) : np.searchsorted(levels, y + 0.6 * h, "right")]
            if inside(rings, px, y) and (((near - (px, y)) ** 2).sum(axis=1) > (0.6 * h) ** 2).all():
                points.append((px, y))
            x += h
        y += step_y * math.sqrt(3) / 2
        row += 1
    tri = [t for t in delaunay(points) if inside(rings, sum(points[i][0] for i in t) / 3, sum(points[i][1] for i in t) / 3)]
    return points, tri


def generate(polygons: DataFrame, size: float | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of polygons (poly_id, ring, seq, x, y), each part in a task of its own.

    ``size`` is one for all; ``sizes`` (poly_id, x, y, h) are scattered values, of
    which the nearest holds. Ids are unique within a part: use ``merge_stack`` or
    the part's key to combine parts.
    """
    if size is None and sizes is None:
        raise ValueError("a size is needed")
    schema = "poly_id long, kind string, id long, x double, y double, nodes array<long>"

    def build(key, rings_pdf, sizes_pdf):
        import numpy as np
        import pandas as pd

        rings = [list(zip(g.x, g.y)) for _, g in rings_pdf.sort_values(["ring", "seq"]).groupby("ring")]
        if sizes_pdf is not None and len(sizes_pdf):
            sx, sy, sh = (sizes_pdf[c].to_numpy() for c in "xyh")
            local = lambda x, y: float(sh[np.argmin((sx - x) ** 2 + (sy - y) ** 2)])
        else:
            local = lambda x, y: float(size)
        points, tri = mesh_polygon(rings, local)
        rows = [(key, "node", i, x, y, None) for i, (x, y) in enumerate(points)] + [(key, "tria", i, None, None, list(t)) for i, t in enumerate(tri)]
        return pd.DataFrame(rows, columns=["poly_id", "kind", "id", "x", "y", "nodes"])

    if sizes is None:
        out = polygons.groupBy("poly_id").applyInPandas(lambda pdf: build(int(pdf.poly_id.iloc[0]), pdf, None), schema)
    else:
        own = sizes.select(*[F.col(c).alias(c) for c in ("poly_id", "x", "y", "h")])  # columns of its own, where both come from one table
        out = polygons.groupBy("poly_id").cogroup(own.groupBy("poly_id")).applyInPandas(lambda a, b: build(int(a.poly_id.iloc[0]), a, b), schema)
    nodes = out.where("kind = 'node'").select("poly_id", F.col("id").alias("node_id"), "x", "y", F.lit(float("nan")).alias("value"))
    return nodes, out.where("kind = 'tria'").select("poly_id", F.col("id").alias("elem_id"), F.lit("tria").alias("etype"), "nodes")


def remesh(elements: DataFrame, nodes: DataFrame, size: float | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of a mesh generated anew inside of the rings of an old one, each of its components a part (poly_id).

    Sizes as in ``generate``; with neither, the mean edge length at each old
    node is asked for, so that the new mesh is as fine as the old one.
    """
    from . import mesh
    from .boundaries import rings

    traced = mesh.checkpointed(rings(elements, nodes))
    if size is None and sizes is None:
        own = mesh.element_components(elements).join(elements.select("elem_id", F.explode("nodes").alias("node_id")), "elem_id").select("component", "node_id").distinct()
        sizes = own.join(mesh.size_from_mesh(elements, nodes), "node_id").join(nodes.select("node_id", "x", "y"), "node_id").select(F.col("component").alias("poly_id"), "x", "y", "h")
    return generate(traced.select(F.col("component").alias("poly_id"), "ring", "seq", "x", "y"), size, sizes)


def difference(elements: DataFrame, nodes: DataFrame, polygons: DataFrame, size: float = 8.0) -> DataFrame:
    """Elements whose centre lies in none of ``polygons`` (poly, ring, seq, x, y): a mesh less a region."""
    from . import mesh
    from .polygons import containing

    c = mesh.corners(elements, nodes)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    centres = c.select(F.col("elem_id").alias("pid"), mean(F.col("xs")).alias("x"), mean(F.col("ys")).alias("y"))
    return elements.join(containing(centres, polygons, size).select(F.col("pid").alias("elem_id")), "elem_id", "left_anti")


def fill_holes(elements: DataFrame, nodes: DataFrame, least: float = 0.0, most: float = math.inf) -> DataFrame:
    """(elem_id, etype, nodes) of triangles that close interior rings with an area from ``least`` to ``most``.

    Only the ring's own nodes are used; a ring is closed in one task, ring by ring,
    and once: the triangles are checkpointed before they are numbered. New ids
    follow those of the mesh, ring after ring.
    """
    from ..plans.numbering import checkpointed, numbered
    from .boundaries import ring_types, rings

    traced = checkpointed(rings(elements, nodes))
    kinds = ring_types(traced).where((F.col("ring_type") == "interior") & F.abs("area").between(least, most))
    holes = traced.join(kinds.select("component", "ring").hint("merge"), ["component", "ring"], "left_semi")
    corner = F.array_sort(F.collect_list(F.struct("seq", "node_id", "x", "y")))
    holes = holes.groupBy("component", "ring").agg(corner.alias("c")).select("component", "ring", F.col("c.node_id").alias("ids"), F.col("c.x").alias("xs"), F.col("c.y").alias("ys"))
    new = checkpointed(holes.mapInArrow(_closed, "component long, ring int, k int, nodes array<long>"))
    top = (elements.agg(F.max("elem_id")).first()[0] or 0) + 1
    return numbered(new, ["component", "ring", "k"], "_n").select((F.col("_n") + top).alias("elem_id"), F.lit("tria").alias("etype"), "nodes")


def _closed(batches: Iterator) -> Iterator:
    """(component, ring, k, nodes): the triangles of each ring (component, ring, ids, xs, ys)."""
    import pyarrow as pa

    schema = pa.schema([("component", pa.int64()), ("ring", pa.int32()), ("k", pa.int32()), ("nodes", pa.list_(pa.int64()))])
    for batch in batches:
        out: dict[str, list] = {c: [] for c in schema.names}
        for component, ring, ids, xs, ys in zip(*(batch.column(c).to_pylist() for c in ("component", "ring", "ids", "xs", "ys"))):
            points = list(zip(xs, ys))
            tri = [t for t in delaunay(points) if inside([points], sum(points[i][0] for i in t) / 3, sum(points[i][1] for i in t) / 3)]
            for k, t in enumerate(tri):
                for c, value in zip(schema.names, (component, ring, k, [ids[i] for i in t])):
                    out[c].append(value)
        yield pa.RecordBatch.from_pydict(out, schema)


def merge_overlapping(background: tuple[DataFrame, DataFrame], foreground: tuple[DataFrame, DataFrame], buffer: float) -> tuple[DataFrame, DataFrame]:
    """Carve the foreground and a buffer out of the background and close the gap with triangles between both rims.

    The gap is one region: it runs between the foreground's exterior rings and
    the rings of the carved background that enclose them.
    """
    from . import mesh
    from .boundaries import ring_types, rings
    from .domains import clip_mesh_by_mesh

    carved = clip_mesh_by_mesh(background[1], background[0], foreground[1], foreground[0], buffer)
    back_nodes, back = mesh.cleanup_isolates(background[0], carved)
    front_nodes, front = mesh.cleanup_isolates(*foreground)
    nodes, elements = mesh.merge_stack([(back_nodes, back), (front_nodes, front)])
    nodes, elements = mesh.checkpointed(nodes), mesh.checkpointed(elements)
    traced = rings(elements, nodes)
    kinds = ring_types(traced)
    box = front_nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    extent = traced.groupBy("component", "ring").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    around = extent.where((F.col("x0") <= box[0]) & (F.col("y0") <= box[1]) & (F.col("x1") >= box[2]) & (F.col("y1") >= box[3])).select("component", "ring")
    # rims of the gap: the background's interior ring around the foreground, and the foreground's exterior ring
    outer = around.join(kinds.where("ring_type = 'interior'").select("component", "ring"), ["component", "ring"])
    inner = kinds.where("ring_type = 'exterior'").join(around, ["component", "ring"], "left_semi").orderBy(F.abs("area")).limit(1).select("component", "ring")
    rim = traced.join(outer.unionByName(inner).distinct(), ["component", "ring"], "left_semi").withColumn("gap", F.lit(0))

    def close(pdf):
        import pandas as pd

        loops = [g.sort_values("seq") for _, g in pdf.groupby(["component", "ring"])]
        ids = [i for g in loops for i in g.node_id.tolist()]
        points = [p for g in loops for p in zip(g.x, g.y)]
        shapes = [list(zip(g.x, g.y)) for g in loops]
        tri = [t for t in delaunay(points) if inside(shapes, sum(points[i][0] for i in t) / 3, sum(points[i][1] for i in t) / 3)]
        return pd.DataFrame([(k, [int(ids[i]) for i in t]) for k, t in enumerate(tri)], columns=["k", "nodes"])

    top = (elements.agg(F.max("elem_id")).first()[0] or 0) + 1
    gap = rim.groupBy("gap").applyInPandas(close, "k int, nodes array<long>")
    return nodes, elements.unionByName(gap.select((F.col("k") + top).cast("long").alias("elem_id"), F.lit("tria").alias("etype"), "nodes"))
