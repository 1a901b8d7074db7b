import random

import numpy as np
import xxhash

from shoalgrid.llm import simhash
from shoalgrid.llm.components import Forest


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for text in ["", " \n", "One", "one  TWO", "É a b c\x0bd", *(" ".join(rng.choice("aB cd é x".split()) for _ in range(n)) for n in (3, 4, 50, 300))]:
        assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == slow_fingerprint(text)


def clustered(rng, groups, size):
    out = []
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            out.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    return out + [rng.getrandbits(64) for _ in range(200)]


def brute_classes(values):
    f = Forest()
    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3):
            f.union(values[i], values[int(j)])
    return [f.find(x) for x in values]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_allocation_is_exact(spark):
    rng = random.Random(2)
    values = clustered(rng, 6, 12)
    both = np.eye(64) * len(values) / 2 + len(values) / 4
    fps = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fp long, doc_id long").cache()
    want = brute_classes(values)
    low = {}
    for i, r in enumerate(want):
        low.setdefault(r, i)
    g3, g2 = simhash.group_bits(len(values), both, 3), simhash.group_bits(len(values), both, 2)
    for parts in ([(g, 0) for g in simhash.group_bits(len(values), both, 4)], [(g3[0], 0), (g3[1], 1), (g3[2], 0)], [(g2[0], 1), (g2[1], 1)]):
        edges = simhash.links(simhash.blocks(simhash.probes(fps.select("fp").distinct(), parts), block=8)).collect()
        f = Forest()
        for e in edges:
            f.union(e.a, e.b)
        mine = {}
        for i, v in enumerate(values):
            mine.setdefault(f.find(signed(v)), i)
        assert [mine[f.find(signed(v))] for v in values] == [low[r] for r in want]
    got = {r.fp: r.component_id for r in simhash.classes(fps).collect()}
    assert [got[signed(v)] for v in values] == [low[r] for r in want]


def test_plan_follows_the_number_of_fingerprints():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    few = simhash.plan(10_000, both * 10_000)
    many = simhash.plan(10**10, both * 10**10)
    assert sum(t + 1 for _, t in few) == sum(t + 1 for _, t in many) == 4
    assert len(few) == 4 and len(many) < 4


def test_query_nulls_copies_and_keep_one(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(900))
    near = long + " tail"
    other = " ".join(rng.choice(words) for _ in range(900))
    rows = [(5, long, "x"), (3, near, "y"), (9, other, "z"), (9, other, "z"), (None, other, "z"), (7, None, "n"), (8, "", "e"), (6, "short text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[3].component_id == 3 and by[8].component_id == 7 and by[None].component_id == 9 and by[6].component_id == 6
    for i, text, _ in rows:
        assert by[i].fingerprint == f"{slow_fingerprint(text):016x}"
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 9]
    lost = spark.createDataFrame([(None, long), (None, long), (None, near)], "doc_id long, text string")
    assert simhash.keep_one(lost).count() == 1
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0


def test_keep_one_links_by_fingerprints(spark, monkeypatch):
    """Copies within the radius of the fingerprints go although no bucket of shingles pairs them; their links are verified on the sets."""
    from pyspark.sql import functions as F

    from shoalgrid.llm import similar

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, sets = [], []
    for i in range(40):
        text = [rng.choice(words) for _ in range(500)]
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join([*text, "tail"])), (10 * i + 2, " ".join(text[:250] + ["x"] + text[250:]))]
    sets = [similar.shingle_set(t.encode()) for _, t in rows]
    marks = [simhash.set_fingerprint(s) for s in sets]
    nodes = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "fp long, mark long")
    f = Forest()
    for r in simhash.near_sets(nodes).collect():
        f.union(r.a, r.b)
    want = Forest()
    for i in range(len(marks)):
        for j in range(i):
            if bin((marks[i] ^ marks[j]) & (1 << 64) - 1).count("1") <= simhash.SET_RADIUS:
                want.union(i, j)
    assert sorted(f.stars()) == sorted(want.stars()) and len(want.stars()) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [10 * i for i in range(40)]
    none = lambda spread: spread.where("false").select("s", F.col("fp").alias("a"), F.col("fp").alias("b"))
    monkeypatch.setattr(similar, "met_in_buckets", none)
    alone = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {10 * i for i in range(40)} <= alone and len(alone) < 60
    # fingerprints of every pair within the radius, sets not alike: nothing goes
    monkeypatch.setattr(simhash, "set_fingerprint", lambda s: 0)
    apart = spark.createDataFrame([(i, t) for i, t in rows if i % 10 == 0], "doc_id long, text string")
    assert simhash.keep_one(apart).count() == 40
