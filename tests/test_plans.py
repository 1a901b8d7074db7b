"""Components and chains of more edges and ids than one task takes."""

import random

import pytest

from pyspark.sql import functions as F

from shoalgrid.operators import interpolate, raster
from shoalgrid.plans import chains, graph, spatial


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(chains, "LOCAL", 64)
    monkeypatch.setattr(graph, "LOCAL", 64)


def fail(*_):
    raise AssertionError("went by rounds")


def test_components_of_ranges(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "_by_rounds", fail, raising=False)
    monkeypatch.setattr(graph, "_hooked", fail)
    edges = [(k, k + 1) for k in range(1000) if k % 250 != 249] + [(k, k + 2) for k in range(0, 900, 7) if k % 250 < 248]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: k // 250 * 250 for k in range(1000)}


def test_components_without_order(spark, few):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)]
    up = {k: k for e in edges for k in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: up[k] for e in edges if e[0] != e[1] for k in e}


def chained():
    """Links of paths and cycles whose ids run along them, backwards, or not at all; and what to find."""
    rng, links, want, n = random.Random(7), [], {}, 0
    for size, order, closed in ((300, 1, True), (150, -1, True), (200, 1, False), (90, -1, False), (70, 0, True), (1, 1, False), (1, 1, True), (3, 1, True)):
        ids = list(range(n, n + size))[:: order or 1]
        if not order:
            rng.shuffle(ids)
        n += size
        first = ids.index(min(ids)) if closed else 0
        for k, i in enumerate(ids):
            links.append((i, ids[k - 1] if k or closed else None))
            want[i] = (ids[first], (k - first) % size)
    return links, want


@pytest.mark.parametrize("doubling", [False, True])
def test_chains_of_ranges(spark, few, monkeypatch, doubling):
    links, want = chained()
    if doubling:
        got = chains._by_doubling(spark.createDataFrame(links, "id long, prev long"))
    else:
        monkeypatch.setattr(chains, "LOCAL", 128)
        monkeypatch.setattr(chains, "_doubled", fail)
        got = chains.traced(spark.createDataFrame(links, "id long, prev long"))
    assert {r.id: (r.root, r.seq) for r in got.collect()} == want


def test_chains_of_structs(spark, few, monkeypatch):
    monkeypatch.setattr(chains, "LOCAL", 128)
    monkeypatch.setattr(chains, "_doubled", fail)
    links, want = chained()
    df = spark.createDataFrame(links, "id long, prev long")
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.floor(F.col(c) / 10).alias("a"), (F.col(c) % 10).alias("b")))
    df = df.select(F.coalesce(pair("id"), pair("id")).alias("id"), pair("prev").alias("prev"))
    got = {r.id.a * 10 + r.id.b: (r.root.a * 10 + r.root.b, r.seq) for r in chains.traced(df).collect()}
    assert got == want


@pytest.mark.parametrize("crowd", [False, True])
def test_nearest_of_far_points_and_crowds(spark, monkeypatch, crowd):
    rng = random.Random(3)
    targets = [(k, float(rng.randrange(12)), float(rng.randrange(12))) for k in range(900)]  # many at one place
    if crowd:
        targets = [(k, x / 64, y / 64) for k, x, y in targets] + [(900, 5000.0, 5000.0)]
    points = [(k, float(rng.randrange(40)), float(rng.randrange(4)) * 10.0**rng.randrange(4)) for k in range(300)] + [(300, -7.5, 3.0), (301, 1e6, 1e6)]
    joined = []
    monkeypatch.setattr(spatial, "nearest_within", lambda *a: joined.append(a) or fail())
    p, t = spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(targets, "fid long, x double, y double")
    want = {k: min(((x - u) ** 2 + (y - v) ** 2, f) for f, u, v in targets) for k, x, y in points}
    assert {r.pid: (r.d2, r.fid) for r in spatial.nearest(p, "pid", t, 2.0).collect()} == want
    same = spark.createDataFrame([(1, 4.0, 4.0), (2, 4.0, 4.0)], "pid long, x double, y double")
    assert [tuple(r) for r in spatial.nearest(same, "pid", same.select(F.col("pid").alias("fid"), "x", "y"), 2.0).orderBy("pid").collect()] == [(1, 1, 0.0), (2, 1, 0.0)]


def test_gaps_far_from_all_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "nearest_within", fail)
    cells = [(r, c, float(10 * r + c) if r < 3 or (r, c) == (4000, 1) else None) for r in [*range(6), 2001, 2002, 3999, 4000] for c in range(3)]
    got = {(r.row, r.col): r.z for r in raster.fill_nearest(spark.createDataFrame(cells, "row long, col long, z double")).collect()}
    known = [(r, c, z) for r, c, z in cells if z is not None]
    assert got == {(r, c): z if z is not None else min(((r - u) ** 2 + (c - v) ** 2, u, v, w) for u, v, w in known)[3] for r, c, z in cells}


def test_values_of_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(spatial, "nearest_within", fail)
    places = spark.range(500).select(F.col("id").alias("fid"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("id").cast("double").alias("value"))
    points = spark.createDataFrame([(1, 0.4, 5.0), (2, 0.6, 5.0), (3, 0.5, 700.0), (4, 0.4, 5.0)], "pid long, x double, y double")
    assert {r.pid: r.value for r in interpolate.nearest_value(points, places).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_points_between_cells_stay_single_rows(spark):
    cells = [(r, c, None if (r, c) in ((1, 1), (3, 3)) else float(7 * r + c * c)) for r in range(5) for c in range(5)]
    at = [(k, x / 4, y / 4) for k, (x, y) in enumerate((x, y) for x in range(-2, 19) for y in range(-2, 19))]
    known, want = {(r, c): z for r, c, z in cells if z is not None}, {}
    for k, x, y in at:
        parts = [((y % 1 if i else 1 - y % 1) * (x % 1 if j else 1 - x % 1), known.get((y // 1 + i, x // 1 + j))) for i in (0, 1) for j in (0, 1)]
        parts = [p for p in parts if p[0] > 0]
        if all(z is not None for _, z in parts):
            want[k] = sum(w * z for w, z in parts)
    points = spark.createDataFrame([*at, (-1, None, 1.0)], "pid long, x double, y double")
    got = interpolate.from_raster_linear(points, spark.createDataFrame(cells, "row long, col long, z double"))
    assert {r.pid: r.z for r in got.collect()} == want
    assert "Aggregate [pid" not in got._jdf.queryExecution().optimizedPlan().toString()  # four rows of a point, dealt twice


def test_cells_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, own = [], spatial.checkpointed
    monkeypatch.setattr(spatial, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or own(df))
    monkeypatch.setattr(spatial, "_SENT", 0, raising=False)
    cells = spark.range(600).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("z"))
    filled = raster.fill_nearest(cells)
    assert "Broadcast" not in filled._jdf.queryExecution().sparkPlan().toString() and not [p for p in plans if "BroadcastHashJoin" in p]
    assert filled.where("z is null").isEmpty() and filled.count() == 600
