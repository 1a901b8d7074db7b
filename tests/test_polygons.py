"""Chains, polygons, contours, stored rasters and specs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import engine, mesh, polygons, raster, sizing, specs
from shoalgrid.plans import chains, graph
from shoalgrid.sources import raster_store as store
from shoalgrid.sources import text


@pytest.mark.parametrize("local", [0, 1 << 17])
def test_cycles_and_paths(spark, monkeypatch, local):
    monkeypatch.setattr(chains, "LOCAL", local)
    rng = random.Random(3)
    ids = list(range(400))
    rng.shuffle(ids)
    links, want, at = [], {}, 0
    for size, closed in ((1, True), (1, False), (2, True), (7, False), (64, True), (65, True), (100, False), (33, True)):
        chain = ids[at : at + size]
        at += size
        root = min(chain) if closed else chain[0]
        k = chain.index(root)
        for i, x in enumerate(chain):
            links.append((x, chain[i - 1] if i or closed else None))
            want[x] = (root, (i - k) % size)
    df = spark.createDataFrame(links, "id long, prev long").repartition(5)
    assert {r.id: (r.root, r.seq) for r in chains.traced(df).collect()} == want
    pairs = df.select(F.struct(F.col("id").alias("a"), F.lit(1).alias("b")).alias("id"), F.when(F.col("prev").isNotNull(), F.struct(F.col("prev").alias("a"), F.lit(1).alias("b"))).alias("prev"))
    assert {r.id.a: (r.root.a, r.seq) for r in chains.traced(pairs).collect()} == want
    assert chains.traced(df.where("false")).count() == 0


@pytest.mark.parametrize("local", [0, 1 << 17])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in got} == low and len(got) == len(low)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def grid(spark, text_):
    rows = [(r, c) for r, line in enumerate(text_.split()) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "row long, col long")


def test_rings_with_holes_that_touch_at_corners(spark):
    cells = grid(spark, """
        ####...#
        #..#..#.
        #.##....
        ####.##.
        .....##.""")  # fmt: skip
    p = polygons.from_cells(cells, 100)
    m = {(r.poly, r.ring_type): (r.n_corners, r.area, r.length) for r in polygons.measures(p, ["poly", "ring_type"]).collect()}
    # the hole of three cells is one ring; cells that touch at a corner are polygons of their own
    assert m == {(0, "exterior"): (4, 16.0, 16.0), (0, "interior"): (6, -3.0, 8.0), (7, "exterior"): (4, 1.0, 4.0), (106, "exterior"): (4, 1.0, 4.0), (305, "exterior"): (4, 4.0, 8.0)}
    tri = polygons.triangulate(p).collect()
    area = lambda t: abs((t.xs[1] - t.xs[0]) * (t.ys[2] - t.ys[0]) - (t.ys[1] - t.ys[0]) * (t.xs[2] - t.xs[0])) / 2
    assert sum(area(t) for t in tri) == 16 - 3 + 1 + 1 + 4
    assert polygons.problems(p).count() == 0
    inside = polygons.containing(spark.createDataFrame([(1, 0.0, 0.2), (2, 1.0, 1.0), (3, 2.1, 2.0), (4, 50.0, 1.0)], "pid long, x double, y double"), p, 2.0)
    assert {(r.pid, r.poly) for r in inside.collect()} == {(1, 0), (3, 0)}
    assert polygons.from_cells(cells.where("false"), 100).count() == 0


def test_ears_of_odd_shapes():
    star = [(math.cos(k * math.pi / 7) * (3 if k % 2 else 1), math.sin(k * math.pi / 7) * (3 if k % 2 else 1)) for k in range(14)]
    holes = [[(0.2, 0.1), (0.2, -0.1), (0.4, -0.1)], [(-0.4, 0.1), (-0.4, -0.1), (-0.2, 0.0)]]
    tri = polygons.ears(polygons.bridged([star, *holes]))
    area = sum(abs(polygons._turn(*t)) / 2 for t in tri)
    assert len(tri) == 14 + 6 + 4 - 2
    assert area == pytest.approx(abs(polygons._signed(star)) - sum(abs(polygons._signed(h)) for h in holes))


def test_triangles_where_rings_touch(spark):
    """Holes that meet their ring, each other or themselves at corners: all of the area, once."""
    rng = random.Random(2)
    cells = spark.createDataFrame([(k // 40, k % 40) for k in range(4000) if rng.random() < 0.55], "row long, col long")
    p = polygons.from_cells(cells, 40).cache()
    m = polygons.measures(p).groupBy("poly").agg((F.sum("n_corners") + 2 * F.count("*") - 4).alias("n"), F.sum("area").alias("area"))
    area = lambda t: abs((t.xs[1] - t.xs[0]) * (t.ys[2] - t.ys[0]) - (t.ys[1] - t.ys[0]) * (t.xs[2] - t.xs[0])) / 2
    got = {}
    for t in polygons.triangulate(p).collect():
        n, a = got.get(t.poly, (0, 0.0))
        got[t.poly] = n + 1, a + area(t)
    assert got == {r.poly: (r.n, r.area) for r in m.collect()}


def test_contours_join_into_lines(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("long").alias("row"), (F.col("id") % 20).alias("col")).withColumn("z", 50.0 - (F.col("row") - 9.5) * (F.col("row") - 9.5) - (F.col("col") - 9.5) * (F.col("col") - 9.5))
    lines = raster.contour_lines(cells, 20.0).orderBy("line", "seq").collect()
    assert len({r.line for r in lines}) == 1 and all(r.closed for r in lines)
    assert (lines[0].x, lines[0].y) == (lines[-1].x, lines[-1].y)
    assert all(math.hypot(r.x - 9.5, r.y - 9.5) == pytest.approx(30**0.5, abs=0.05) for r in lines)
    assert max(math.hypot(a.x - b.x, a.y - b.y) for a, b in zip(lines, lines[1:])) < 1.5
    # a level that leaves the grid gives open lines
    open_ = raster.contour_lines(cells, -60.0).select("line", "closed").distinct().collect()
    assert len(open_) == 4 and not any(r.closed for r in open_)


def test_patch_grows_outside(spark):
    points = sizing.initial(spark.range(20).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(-5.0).alias("z")), 100)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)]
    got = {r.node_id: r.h for r in sizing.patch_expanded(points, "node_id", (F.col("x") <= 4) & (F.col("x") >= 0), sizing.ring_places(spark, ring, 0.5), 10.0, 0.2, hmax=25).collect()}
    assert got[2] == 10 and got[6] == pytest.approx(10 + 0.2 * 10 * 2) and got[19] == 25
    with pytest.raises(ValueError):
        sizing.Collector(1, 9).add_patch(F.lit(True), 2.0, expansion_rate=0.1)


def lattice(spark, nx, ny):
    return mesh.rectangle_nodes(nx, ny, spark), mesh.rectangle_elements(spark, nx, ny)


def test_grd_round_trip_with_boundaries(spark, tmp_path):
    nodes, e = lattice(spark, 4, 3)
    rows = [(1, "open", None, i, i) for i in range(4)] + [(1, "land", 20, i, 3 + 4 * i) for i in range(3)] + [(2, "interior", 21, i, x) for i, x in enumerate((5, 6))]
    bounds = spark.createDataFrame(rows, "bnd_id int, btype string, ibtype int, seq long, node_id long")
    lines = [r.line for r in text.grd_lines(nodes, e, "test", bounds).orderBy("section", "id").collect()]
    (tmp_path / "m.grd").write_text("\n".join(lines) + "\n")
    n, back, b = text.read_grd(spark, str(tmp_path / "m.grd"))
    assert n.count() == 12 and back.count() == e.count()
    got = sorted((r.btype, r.bnd_id, r.seq, r.node_id, r.ibtype) for r in b.collect())
    assert got == sorted(("open" if k == "open" else "land", i, s, x, t) for i, k, t, s, x in rows)
    assert [r.line for r in text.grd_boundary_lines(bounds.where("false")).orderBy("section", "id").collect()] == ["0 = Number of open boundaries", "0 = Total number of nodes of open boundaries", "0 = Number of land boundaries", "0 = Total number of nodes of land boundaries"]


def test_remesh_and_difference(spark):
    nodes, e = lattice(spark, 7, 5)
    n, fine = engine.remesh(e, nodes, size=0.6)
    assert mesh.element_areas(fine, n).agg(F.sum(F.abs("area"))).first()[0] == pytest.approx(24.0) and fine.count() > 100
    n, same = engine.remesh(e, nodes)
    assert 20 < same.count() < 120
    square = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (3, 1), (3, 3), (1, 3)])], "poly long, ring int, seq int, x double, y double")
    assert engine.difference(e, nodes, square).count() == e.count() - 8


def test_stored_rasters(spark, tmp_path):
    a = np.arange(30, dtype=np.float32).reshape(5, 6)
    a[2, 3] = -1
    r = store.from_numpy(spark, a, store.Meta(10.0, 20.0, 0.5, -0.5, crs="EPSG:4326", dtype="float32", nodata=-1.0, tags={"kind": "bathymetry"}))
    r = store.add_band(r, r.band(1).withColumn("z", F.col("z") * 2), {"unit": "m"})
    back = store.load(spark, store.save(r, str(tmp_path / "r")))
    assert back.meta == r.meta and back.bands() == [1, 2] and back.meta.tags["band2.unit"] == "m"
    assert sorted(map(tuple, back.cells.collect()), key=str) == sorted(map(tuple, r.cells.collect()), key=str)
    assert back.band(1).where("z is null").count() == 1 and back.band(2).where("row = 4 and col = 5").first().z == 58
    assert store.digest(back.band(1), 2).first().md5 == store.digest(r.band(1).repartition(3), 2).first().md5 != store.digest(r.band(2), 2).first().md5
    new = store.rewrite(spark, str(tmp_path / "r"), lambda x: store.modify(x, lambda c: c.withColumn("z", F.col("z") + 1), 2))
    assert new.band(2).agg(F.max("z")).first()[0] == 59 and back.band(2).agg(F.max("z")).first()[0] == 58
    assert store.window_of((10.6, 18.4, 11.9, 19.6), r.meta) == (0, 1, 4, 3) and r.meta.window_transform(1, 2) == (0.5, 0.0, 11.0, 0.0, -0.5, 19.5)
    xy = r.xy().where("band = 1 and row = 0 and col = 0").first()
    assert (xy.x, xy.y) == (10.25, 19.75) and store.window(r.band(1), 1, 2, 2, 2).count() == 4
    for bad in ({"dtype": "text"}, {"dx": 0.0}, {"crs": "lambert"}):
        with pytest.raises(ValueError):
            store.Meta(**bad)
    with pytest.raises(ValueError):
        store.modify(r, lambda c: c.drop("z"))
    lines = [x.line for x in store.ascii_lines(r.band(1), r.meta).orderBy("section", "id").collect()]
    (tmp_path / "g.asc").write_text("\n".join(lines) + "\n")
    grid_ = store.read_ascii(spark, str(tmp_path / "g.asc"))
    assert sorted(map(tuple, grid_.band(1).collect()), key=str) == sorted(map(tuple, r.band(1).collect()), key=str)
    assert (grid_.meta.x0, grid_.meta.y0, grid_.meta.dx, grid_.meta.dy) == (10.0, 20.0, 0.5, -0.5)


def test_specs(spark):
    cells = spark.range(100).select((F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"), (F.col("id") % 10 - 5).cast("double").alias("z"))
    assert specs.FilledContour(-2, specs.Contour(2)).cells(cells).count() == 50
    c = specs.Contour(0.5, target=2.0).add_source(1)
    assert c.sources == [1] and c.places(cells).count() > 5
    for make in (lambda: specs.FilledContour(), lambda: specs.FilledContour(3, 1), lambda: specs.Contour(0, rate=0), lambda: specs.Channel(width=-1), lambda: specs.LineFeature(), lambda: specs.Patch(), lambda: c.add_source(1), lambda: specs.EngineOptions("other"), lambda: specs.EngineOptions(hmin=3, hmax=1), lambda: specs.domain(cells, "other"), lambda: specs.domain(cells, "polygons"), lambda: specs.size_function(cells, "other")):
        with pytest.raises(ValueError):
            make()
    line = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 3.0, 0.0)], "line_id long, seq long, x double, y double")
    assert specs.LineFeature(lines=line).points().count() == 4
    region = specs.domain(cells, "raster", zmin=2.0)
    assert polygons.measures(region).first().area == 30.0
    points = specs.size_function(cells, "raster", 7.0)
    assert specs.Patch(region=region).holds(points, "node_id").count() == 30
    nodes, e = lattice(spark, 4, 4)
    assert polygons.measures(specs.domain((e, nodes), "mesh")).first().area == 9.0
    assert specs.EngineOptions(hmin=1.2).sizes(specs.size_function((e, nodes), "mesh")).agg(F.min("h")).first()[0] == pytest.approx(1.2)


def test_polygons_of_contours(spark):
    """A ring-shaped island with a lake and an island in it, and ground that runs out of the raster."""
    at = spark.range(41 * 41).select((F.col("id") / 41).cast("long").alias("row"), (F.col("id") % 41).alias("col"))
    r = F.hypot(F.col("row") - 20.0, F.col("col") - 20.0)
    cells = at.withColumn("z", F.when(r < 8, 4 - r).otherwise(F.lit(5) - F.abs(r - 13)))
    p = polygons.from_contours(cells, 0.0)
    m = sorted((x.ring_type, round(x.area)) for x in polygons.measures(p, ["poly", "ring", "ring_type"]).collect())
    assert [k for k, _ in m] == ["exterior", "exterior", "interior"]
    areas = sorted(abs(a) for _, a in m)
    assert areas[0] == pytest.approx(math.pi * 16, rel=0.05) and areas[1] == pytest.approx(math.pi * 64, rel=0.06) and areas[2] == pytest.approx(math.pi * 324, rel=0.03)
    rings_ = {r.ring_type: r.poly for r in p.where("ring_type = 'interior'").collect()}
    assert p.where(F.col("poly") == rings_["interior"]).select("ring").distinct().count() == 2
    slope = at.withColumn("z", F.when(F.col("row") < 3, None).otherwise(F.col("col") - 20.5))
    x = polygons.measures(polygons.from_contours(slope, 0.0)).first()
    assert x.area == pytest.approx((40 - 20.5) * (40 - 3), rel=1e-6)
