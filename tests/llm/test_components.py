import random

from shoalgrid.llm.components import Forest, components


def brute(edges):
    f = Forest()
    for a, b in edges:
        f.union(a, b)
    return {x: f.find(x) for e in edges for x in e}


def test_random_graphs(spark):
    rng = random.Random(5)
    graphs = [[(i, i + 1) for i in range(40)], [(i * 7 % 41, (i + 1) * 7 % 41) for i in range(40)], [(99, i) for i in range(98)] + [(i, i + 1) for i in range(0, 90, 9)]]
    graphs += [[(rng.randrange(60), rng.randrange(60)) for _ in range(k)] for k in (20, 45)]
    for g in graphs:
        got = {r.node: r.root for r in components(spark.createDataFrame(g, "a long, b long")).collect()}
        want = {k: v for k, v in brute([e for e in g if e[0] != e[1]]).items()}
        assert got == want
    assert components(spark.createDataFrame([(1, None), (2, 2)], "a long, b long")).count() == 0
