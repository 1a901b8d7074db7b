"""Worked examples of mesh operators, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from shoalgrid.functions import geometry as g
from shoalgrid.operators import mesh, sizing
from shoalgrid.operators.delaunay import delaunay
from shoalgrid.sources import text


def lattice(spark, nx, ny, hole=None, quad=None):
    nodes = mesh.rectangle_nodes(nx, ny, spark)
    return nodes, mesh.rectangle_elements(spark, nx, ny, hole=hole, quad=quad)


def test_rectangle_with_a_hole(spark):
    nodes, e = lattice(spark, 5, 6, hole=F.col("cell") + 1 == 10)
    assert (nodes.count(), e.count()) == (30, 38)
    edges, faces = mesh.mesh_edges(e).count(), e.count()
    assert 30 - edges + faces == 0  # one hole
    degrees = [r.n for r in mesh.boundary_edges(e).select(F.explode(F.array("u", "v")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()]
    assert all(n % 2 == 0 for n in degrees)


def test_boundary_chains(spark):
    nodes, e = lattice(spark, 5, 6, hole=F.col("cell") + 1 == 10)
    nodes = nodes.withColumn("value", F.when(F.col("x") > 3, -10.0).otherwise(10.0))
    chains = {}
    for r in mesh.boundary_chains(e, nodes).orderBy("chain", "seq").collect():
        chains.setdefault((r.btype, r.chain), []).append(r.node_id + 1)
    found = sorted((b, c) for (b, _), c in chains.items())
    either = lambda c: min(c, c[::-1])
    assert either(next(c for b, c in found if b == "open")) == [5, 10, 15, 20, 25, 30]
    land = [c for b, c in found if b == "land"]
    assert either(next(c for c in land if c[0] != c[-1])) == either([5, 4, 3, 2, 1, 6, 11, 16, 21, 26, 27, 28, 29, 30])
    ring = next(c for c in land if c[0] == c[-1])
    assert sorted(ring[1:]) == [12, 13, 17, 18]


def test_duplicates_of_overlapping_meshes(spark):
    a, b = lattice(spark, 6, 6), lattice(spark, 6, 6)
    moved = b[0].withColumn("x", F.col("x") + 3).withColumn("y", F.col("y") + 2)
    nodes, e = mesh.merge_neighbors([a, (moved, b[1])])
    assert (nodes.count(), e.count()) == (72 - 12, 100 - 12)


def test_neighbours_fuse(spark):
    a, b = lattice(spark, 2, 2), lattice(spark, 2, 2)
    nodes, e = mesh.merge_neighbors([a, (b[0].withColumn("x", F.col("x") + 1), b[1])])
    assert nodes.count() == 6
    assert mesh.element_areas(e, nodes).agg(F.sum("area")).first()[0] == 2.0


def test_finalize_is_idempotent(spark):
    nodes, e = lattice(spark, 9, 9, hole=(F.col("cell") % 7 == 2) | (F.col("cell") % 8 == 5))
    once = mesh.finalize(nodes, e)
    twice = mesh.finalize(*once)
    assert sorted(map(str, once[1].select("nodes").collect())) == sorted(map(str, twice[1].select("nodes").collect()))
    assert mesh.pinched_nodes(once[1]).count() == 0


def test_courant_numbers(spark):
    df = spark.createDataFrame([(-100.0, 50.0), (-1.0, 50.0), (10.0, 50.0)], "d double, s double")
    got = [tuple(r) for r in df.select(g.particle_velocity(F.col("d")), g.courant_number(F.col("d"), F.col("s"), 100.0)).collect()]
    u = 2 * math.sqrt(9.80665 / 100)
    assert got[0] == pytest.approx((u, (u + math.sqrt(9.80665 * 100)) * 2))
    assert got[1] == got[2] == pytest.approx((math.sqrt(2 * 9.80665), 4 * math.sqrt(2 * 9.80665)))
    with pytest.raises(Exception, match="element size is zero"):
        df.select(g.courant_number(F.col("d"), F.col("s") * 0, 100.0)).collect()


def test_relaxed_constraint(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, 0.0, 0.0) for i in range(4)], "k long, x double, y double, z double, h double")
    got = sizing.constrain(p, sizing.Constraint(5.0, "min", F.col("x") == 3, 0.199), "k").orderBy("k").collect()
    assert [r.h for r in got] == pytest.approx([2.015, 3.01, 4.005, 5.0])
    with pytest.raises(ValueError):
        sizing.Constraint(1.0, "between")


def test_flat_cells_keep_their_size(spark):
    p = spark.createDataFrame([(1.0, 0.0, 0.0, 9.0), (30.0, 3.0, 4.0, 9.0), (None, 1.0, 0.0, 9.0)], "z double, gx double, gy double, h double")
    assert [r.h for r in sizing.flow_limiter(p, 0.5).collect()] == [9.0, 2.0, 9.0]


def test_utm_known_points(spark):
    df = spark.createDataFrame([(3.0, 0.0), (-75.0, 40.0), (5.0, 60.0), (15.0, 78.0), (-75.0, -40.0)], "lon double, lat double")
    z = g.utm_zone(F.col("lon"), F.col("lat"))
    x, y = g.utm(F.col("lon"), F.col("lat"), z)
    got = [tuple(r) for r in df.select(z, x, y).collect()]
    assert [r[0] for r in got] == [31, 18, 32, 33, 18]
    assert got[0][1:] == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert got[1][1:] == pytest.approx((500000.0, 4427757.219), abs=1e-2)
    assert got[4][2] == pytest.approx(10000000 - 4427757.219, abs=1e-2)


def test_text_formats_round_trip(spark, tmp_path):
    nodes, e = lattice(spark, 4, 3, quad=F.col("cell") % 2 == 0)
    nodes = nodes.withColumn("value", F.col("node_id") * 1.25 - 3)
    order = lambda d: sorted(map(tuple, d.collect()))
    text.write_lines(text.sms2dm_lines(nodes, e), str(tmp_path / "m.2dm"))
    n2, e2 = text.read_sms2dm(spark, str(tmp_path / "m.2dm"))
    assert order(n2) == order(nodes.select("node_id", "x", "y", "value")) and sorted(map(str, e2.select("nodes").collect())) == sorted(map(str, e.select("nodes").collect()))
    lines = [r.line for r in text.grd_lines(nodes, e, "a lattice").orderBy("section", "id").collect()]
    path = tmp_path / "m.grd"
    path.write_text("\n".join([*lines, "1 = open", "2 = nodes", "2", "1", "2", "1 = land", "3", "3 0", "4", "8", "12"]) + "\n")
    n3, e3, b3 = text.read_grd(spark, str(path))
    assert order(n3) == order(nodes.select("node_id", "x", "y", "value")) and e3.count() == e.count()
    assert order(b3.select("btype", "ibtype", "seq", "node_id")) == [("land", 0, 0, 3), ("land", 0, 1, 7), ("land", 0, 2, 11), ("open", None, 0, 0), ("open", None, 1, 1)]


def test_delaunay_circles_are_empty():
    import random

    rng = random.Random(4)
    pts = [(rng.random(), rng.random()) for _ in range(60)]
    tri = delaunay(pts)
    used = {i for t in tri for i in t}
    assert used == set(range(60))
    for a, b, c in tri:
        (ax, ay), (bx, by), (cx, cy) = pts[a], pts[b], pts[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = math.hypot(ax - ux, ay - uy)
        assert all(math.hypot(x - ux, y - uy) >= r - 1e-9 for x, y in pts)
