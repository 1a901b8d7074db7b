import numpy as np
import pyspark.sql.functions as F
import pytest

from shoalgrid.llm import crosspolytope as cp


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            order = sorted((-v, j) for v, j in zip(s, ids) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def test_rotation_is_orthonormal():
    x = np.random.default_rng(1).normal(size=(5, 64))
    g = cp.Geometry(64, 1, 1)
    assert np.allclose(np.linalg.norm(g.rotate(x, 2, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cp.hadamard(cp.hadamard(x)), x)


@pytest.mark.parametrize("unit", [True, False])
def test_recall_against_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(cp, "BLOCK", 64)
    monkeypatch.setattr(cp, "MEETING", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[300:600] = x[0] + 0.05 * x[300:600]
    x[600:900] = x[1]  # equal vectors
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 24, 1), (2040, [float("nan")] * 24, 1), (2060, [None] * 24, 1), (2080, [1.0] * 3, 1), (None, [1.0] * 24, 1), (2100, [], 1), rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {}
    for r in cp.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(list(range(1500)), x.astype(np.float64))
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.vec_id != q for r in found)
        s = [r.score for r in found]
        assert s == sorted(s, reverse=True) and np.allclose(s, [x[r.vec_id].astype(float) @ x[q].astype(float) for r in found])
        hit += len({r.vec_id for r in found} & set(want[q]))
    assert hit / (20 * len(want)) > 0.93
    assert [r.vec_id for r in got[620]][:20] == want[620]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in cp.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert cp.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [2, 3, 9, 20, 21, 22, 25])
def test_all_candidates_where_there_are_few(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(20 * i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, key int, ids int")
    got = {}
    for r in cp.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute([20 * i for i in range(n)], x)
    if n <= 21:
        assert got == want
    else:
        assert all(len(v) == 20 for v in got.values()) and len(got) == n


def test_probes_are_those_within_reach():
    x = np.random.default_rng(4).normal(size=(40, 16))
    g = cp.Geometry(16, 1, 9)
    shape = (16, 4, 2)
    who, bucket = g.probes(x, 1, shape, 0.05)
    parts = [g.misses(x, 1, level, size) for level, size in enumerate(shape)]
    total = (parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]).reshape(40, -1)
    assert set(zip(who.tolist(), bucket.tolist())) == set(zip(*[a.tolist() for a in np.nonzero(total <= 0.05)]))


def test_candidates_grow_slower_than_rows():
    """Per query, on clustered vectors; the hashes of a table are more for more rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3000, 32))
    shares = []
    for n in (4_000, 64_000):
        x = centres[rng.integers(0, n // 40, n) % 3000] + 0.25 * rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = cp.Geometry(32, 1, 1)
        q = x[:100]
        score = q @ x.T
        score[np.arange(100), np.arange(100)] = -1
        shape, tables, reach, recall = cp.calibrate(g, x[: cp.SAMPLE], q, x[np.argpartition(-score, 20, axis=1)[:, :20]], n)
        met = 0
        for t in range(tables):
            who, bucket = g.probes(q, t, shape, reach)
            met += np.bincount(g.buckets(x, t, shape), minlength=int(np.prod([2 * k for k in shape])))[bucket].sum()
        shares.append(met / 100 / n)
        assert recall >= 0.96
    print(f"share of rows met by a query: {shares}")
    assert shares[1] < shares[0]
