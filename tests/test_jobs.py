"""Boundaries, engine, jobs and the command line."""

import pytest
from pyspark.sql import functions as F

from shoalgrid.__main__ import main
from shoalgrid.operators import boundaries, engine, jobs, mesh
from shoalgrid.plans import schemas


def lattice(spark, nx, ny, hole=None, step=1.0, x=0.0, y=0.0):
    nodes = mesh.rectangle_nodes(nx, ny, spark).withColumn("x", F.col("x") * step + x).withColumn("y", F.col("y") * step + y)
    return nodes, mesh.rectangle_elements(spark, nx, ny, hole=hole)


def area(nodes, elements):
    return mesh.element_areas(elements, nodes).agg(F.sum(F.abs("area"))).first()[0]


def test_rings_islands_and_regions(spark):
    nodes, e = lattice(spark, 5, 6, hole=F.col("cell") + 1 == 10)
    kinds = {r.ring_type: r for r in boundaries.ring_types(boundaries.rings(e, nodes)).collect()}
    assert (kinds["exterior"].area, kinds["interior"].area) == (20.0, -1.0)
    assert sorted(r.node_id + 1 for r in boundaries.islands(e, nodes).collect()) == [12, 13, 17, 18]
    typed = boundaries.auto_generate(e, nodes.withColumn("value", F.when(F.col("x") > 3, -10.0).otherwise(10.0)))
    count = {(r.btype, r.ibtype): r["count"] for r in typed.groupBy("btype", "ibtype").count().collect()}
    assert count == {("open", None): 5, ("land", 0): 13, ("interior", 1): 4}
    moved = boundaries.set_region(typed, nodes, F.col("y") < 0.5, "open")
    assert {r.btype: r["count"] for r in moved.groupBy("btype").count().collect()} == {"open": 5 + 4 + 1, "land": 13 - 5, "interior": 4}
    assert sorted(r.btype for r in boundaries.chains(typed).collect()) == ["interior", "land", "open"]
    with pytest.raises(ValueError):
        boundaries.set_region(typed, nodes, F.lit(True), "interior")
    with pytest.raises(Exception, match="no value"):
        boundaries.auto_generate(e, nodes.withColumn("value", F.lit(float("nan")))).collect()


def test_region_reads_boundaries_and_rings_once(spark):
    nodes, e = lattice(spark, 5, 6, hole=F.col("cell") + 1 == 10)
    typed = boundaries.auto_generate(e, nodes)
    moved = boundaries.set_region(typed, nodes.unionByName(nodes), F.col("y") < 0.5, "open")  # an edge with both ends in it, and nodes that repeat, count once
    assert {r.btype: r["count"] for r in moved.groupBy("btype").count().collect()} == {"open": 4 + 2, "land": 18 - 6, "interior": 4}
    assert {r.btype: r["count"] for r in boundaries.set_region(typed, nodes, F.lit(False), "open").groupBy("btype").count().collect()} == {"land": 18, "interior": 4}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(moved).count("Window") == plan(typed).count("Window")
    assert "Range (" not in plan(boundaries.hull(e, nodes))  # a checkpoint, not the joins that the rings come from


def test_runs_read_edges_once(spark):
    edges = [(0, 1, "open"), (1, 2, "open"), (2, 3, "land"), (3, 4, "land"), (7, 8, "open"), (9, 8, "open"), (4, 0, "interior")]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    table = spark.createDataFrame(edges, "a long, b long, btype string")
    runs = boundaries.chains(table.mapInArrow(counted, table.schema))
    assert sorted(tuple(r) for r in runs.collect()) == [(0, "interior", 1), (0, "open", 2), (2, "land", 2), (7, "open", 2)]
    assert read.value == len(edges)


def test_boundaries_are_not_sent_to_the_driver(spark, monkeypatch):
    nodes, e = lattice(spark, 5, 6, hole=F.col("cell") + 1 == 10)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    plans, frame = [], type(nodes)
    own = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **b: plans.append(plan(df)) or own(df, *a, **b))
    typed = boundaries.auto_generate(e, nodes)
    plans += [plan(boundaries.set_region(typed, nodes, F.col("y") < 0.5, "open")), plan(boundaries.chains(typed))]
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_holes_and_gaps_close(spark):
    nodes, e = lattice(spark, 9, 9, hole=F.col("cell").isin(18, 19, 26, 27, 45))
    new = engine.fill_holes(e, nodes)
    assert area(nodes, e) == 59.0 and area(nodes, e.unionByName(new)) == 64.0
    assert engine.fill_holes(e, nodes, most=1.5).count() == 2
    back, front = lattice(spark, 11, 11), lattice(spark, 21, 21, step=0.1, x=4.0, y=4.0)
    n, all_ = engine.merge_overlapping(back, front, 0.4)
    assert area(n, all_) == pytest.approx(100.0)
    assert mesh.element_components(all_).select("component").distinct().count() == 1


def test_holes_are_closed_once(spark):
    nodes, e = lattice(spark, 9, 9, hole=F.col("cell").isin(18, 19, 26, 27, 45))
    new = engine.fill_holes(e, nodes)
    assert sorted(r.elem_id for r in new.collect()) == list(range(128, 136))
    plan = new._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan  # else every use closes all holes again


def test_engine_covers_a_polygon_with_a_hole(spark):
    ring = lambda k, pts: [(0, k, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    rows = ring(0, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, [(1, 1), (1, 2), (2, 2), (2, 1)])
    polygons = spark.createDataFrame(rows, "poly_id long, ring int, seq int, x double, y double")
    nodes, e = jobs.run_driver(polygons, 0.5)
    assert area(nodes, e) == pytest.approx(15.0)
    lengths = [r.length for r in mesh.edge_lengths(e, nodes).collect()]
    assert 0.2 < min(lengths) and max(lengths) < 1.1
    fine = spark.createDataFrame([(0, 0.0, 0.0, 0.25), (0, 4.0, 4.0, 1.0)], "poly_id long, x double, y double, h double")
    assert engine.generate(polygons, sizes=fine)[1].count() > 60
    with pytest.raises(ValueError):
        engine.generate(polygons)
    with pytest.raises(ValueError):
        engine.get_engine("other")


def test_subset_and_combine(spark):
    fine, coarse = lattice(spark, 11, 11, step=0.5, x=2.0, y=2.0), lattice(spark, 11, 11)
    nodes, e = jobs.subset_and_combine(fine, coarse, (3.1, 3.1, 5.4, 5.4))
    assert e.count() > 150 and mesh.element_areas(e, nodes).where("abs(area) < 1e-9").count() == 0


def test_schemas(spark):
    nodes, e = lattice(spark, 3, 3)
    n, ok = schemas.mesh(nodes.drop("value"), e)
    assert ok.count() == 8 and n.where(F.isnan("value")).count() == 9
    with pytest.raises(ValueError):
        schemas.conform(nodes.drop("x"), schemas.NODES)
    with pytest.raises(Exception, match="wrong number of nodes"):
        schemas.mesh(nodes, e.withColumn("etype", F.lit("quad")))[1].collect()


def test_command_line(spark, tmp_path):
    cells = spark.range(100).select(F.lit(0).alias("raster_id"), (F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"), (F.col("id") % 10 - 5).cast("double").alias("z"))
    cells.write.parquet(str(tmp_path / "cells"))
    main(["geom", str(tmp_path / "cells"), str(tmp_path / "geom"), "--zmax", "0"], spark)
    assert spark.read.parquet(str(tmp_path / "geom")).count() == 60
    main(["hfun", str(tmp_path / "cells"), str(tmp_path / "hfun"), "--hmin", "1", "--hmax", "9", "--contour", "0", "1", "2", "--constant", "2", "99", "3"], spark)
    sizes = {(r.row, r.col): r.h for r in spark.read.parquet(str(tmp_path / "hfun")).collect()}
    assert sizes[5, 5] == pytest.approx(2.0) and sizes[5, 9] == pytest.approx(3.0) and sizes[5, 0] == pytest.approx(9.0)


def test_remeshing_jobs(spark, tmp_path):
    nodes, e = lattice(spark, 7, 7)
    region = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(-1, -1), (3, -1), (3, 7), (-1, 7)])], "poly long, ring int, seq int, x double, y double")
    n, new = jobs.remesh_by_shape(e, nodes, region, 0.5)
    assert area(n, new) == pytest.approx(36.0)
    left = mesh.nodes_in_box(n, (-1.0, -1.0, 2.5, 7.0)).count()
    assert left > 1.5 * mesh.nodes_in_box(n, (3.5, -1.0, 7.0, 7.0)).count()
    with pytest.raises(ValueError):
        jobs.remesh_by_shape(e, nodes, region, 0)
    cells = spark.range(64).select((F.col("id") / 8).cast("long").alias("row"), (F.col("id") % 8).alias("col"), (F.col("id") % 8 - 4).cast("double").alias("z"))
    nodes.write.parquet(str(tmp_path / "m/nodes"))
    e.write.parquet(str(tmp_path / "m/elements"))
    cells.write.parquet(str(tmp_path / "cells"))
    main(["remesh-by-dem", str(tmp_path / "m"), str(tmp_path / "cells"), str(tmp_path / "out"), "--hmin", "0.6", "--hmax", "1.5", "--constant", "0", "9", "0.6"], spark)
    n2, e2 = (spark.read.parquet(str(tmp_path / f"out/tables/{k}")) for k in ("nodes", "elements"))
    assert area(n2, e2) == pytest.approx(36.0) and n2.where("value > 0").count() > n2.where("value < -1").count()


def test_outputs_clipping_and_blended_sizes(spark, tmp_path):
    nodes, e = lattice(spark, 4, 3)
    out = jobs.write_outputs(nodes, e, str(tmp_path), ("2dm", "grd", "hull"))
    assert spark.read.text(out["2dm"]).count() == 1 + 12 + 12 and spark.read.text(out["grd"]).count() == 2 + 12 + 12
    assert spark.read.parquet(out["hull"]).count() == 10
    with pytest.raises(ValueError):
        jobs.write_outputs(nodes, e, str(tmp_path), ("xyz",))
    moved = jobs.transform_mesh(jobs.transform_mesh(nodes, "EPSG:4326", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    assert moved.join(nodes.select("node_id", F.col("x").alias("a")), "node_id").where("abs(x - a) > 1e-9").count() == 0
    z = [[5, 5, -300], [5, -300, -300], [-300, 5, 5]]
    cells = spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row long, col long, z double")
    assert jobs.clipping_cells(cells, 10, upstream=1).count() == 6 and jobs.clipping_cells(cells, 10, upstream=3).count() == 9
    fine, coarse = lattice(spark, 5, 5, step=0.5), lattice(spark, 5, 5)
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.5, 3.5), (3, 9.0, 9.0)], "pid long, x double, y double")
    got = {r.pid: r.h for r in jobs.blended_sizes(places, fine, coarse).collect()}
    assert got[1] < 0.7 and 0.9 < got[2] < 1.5 and got[3] > 0.9
