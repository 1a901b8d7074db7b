import numpy as np

from shoalgrid.llm import multiindex as mi
from shoalgrid.llm.components import Forest


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mi, "BLOCK", 40)
    monkeypatch.setattr(mi, "MEETING", 60)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    for c in range(6):  # groups around a centre, of which not all pairs link
        x[c * 60 : c * 60 + 40] = x[c * 60] + 0.32 * x[c * 60 : c * 60 + 40]
    x[400:430] = x[400]
    x[430:440] = 3 * x[400]
    label = [None if i % 97 == 5 else int(i // 60 % 3 if i < 400 else 1) for i in range(700)]
    rows = [(i, v.tolist(), lab, 5) for i, (v, lab) in enumerate(zip(x, label))]
    odd = [(2000, None, 1, 1), (2001, [0.0] * 16, 1, 1), (2002, [float("inf")] * 16, 1, 1), (2003, [None] * 16, 1, 1), (2004, [1.0] * 3, 1, 1), rows[1], (2005, [], 1, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, node int").repartition(5)
    got = sorted(tuple(r) for r in mi.near_duplicates(df).collect())
    everything = rows + [rows[1]]
    y = np.array([r[1] for r in everything])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.93
    for i, a in enumerate(everything):
        for j, b in enumerate(everything):
            near[i, j] &= i != j and a[2] is not None and a[2] == b[2]
    f = Forest()
    for i, j in zip(*np.nonzero(near)):
        f.union(int(i), int(j))
    low = {}
    for i, r in enumerate(everything):
        low[f.find(i)] = min(low.get(f.find(i), r[0]), r[0])
    want = [(r[0], int(near[i].sum()), low[f.find(i)], r[0] == low[f.find(i)]) for i, r in enumerate(everything)]
    want += [(i, 0, i, True) for i in range(2000, 2006)]
    assert got == sorted(want)
    assert any(w[1] > 20 for w in want) and sum(w[1] > 0 for w in want) > 150


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: tuple(r)[1:] for r in mi.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False), 3: (0, 3, True)}
    assert mi.near_duplicates(df.where("false")).count() == 0
    assert mi.near_duplicates(df.where("vec_id = 3")).collect()[0].kept


def test_traversal_hands_out_cells_in_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = mi.Grid(x, 24, 0.93)
    a, b = g.borders(x[:50])
    everything = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    who, cell = g.traverse(x[:50])
    assert 1 < len(who) < 50 * 24 * 24
    for r in range(50):
        own = cell[who == r]
        assert set(own) == set(np.flatnonzero(everything[r] <= g.radius)) and len(set(own)) == len(own)
        assert (np.diff(everything[r][own]) >= 0).all()


def test_recall_and_cost_on_real_vectors(spark):
    """Pairs of a vector of the table and one between it and another of the table, at cosines from the threshold up."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows if r.embedding is not None and np.isfinite(r.embedding).all() and np.any(r.embedding)], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    other = x[rng.permutation(len(x))]
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-9)
    c = rng.uniform(0.93, 0.97, (len(x), 1))
    near = c * x + np.sqrt(1 - c**2) * other
    shares = []
    for n in (20_000, 2_000_000):
        g = mi.best_grid(x[:8192], n, 1.0, 0.93)
        shares.append(g.met)
        seen = (g.reach(g.borders(x), g.cells(near)) <= g.radius) | (g.reach(g.borders(near), g.cells(x)) <= g.radius)
        print(f"{n} vectors: recall {seen.mean():.6f} of {len(x)} pairs; K {g.k}, cells visited {g.visited:.1f}, share met {g.met:.5f}")
        assert seen.mean() >= 0.9995
    assert shares[1] < shares[0]


def test_counts_are_the_same_from_both_ends(spark, monkeypatch):
    """Even where most visits are missed, a pair that is found counts for both of its vectors."""
    monkeypatch.setattr(mi, "MARGIN", 0.02)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 8))
    x[600:] = x[:600] + 0.2 * x[600:]
    df = spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, cell int")
    got = mi.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) % 2 == 0
    linked = {r.vec_id for r in got if r.n_links}
    sizes = {}
    for r in got:
        sizes[r.component_id] = sizes.get(r.component_id, 0) + 1
    assert linked == {r.vec_id for r in got if sizes[r.component_id] > 1}
