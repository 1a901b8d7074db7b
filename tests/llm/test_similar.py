import random

import numpy as np

import corpus_pipeline as pipeline
from shoalgrid.llm import similar


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def corpus():
    """Originals, each with copies of 1 to 6 changed words; all start with a common passage."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    head, rows = " ".join(words[:12]), []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice((60, 110, 220)))]
        rows.append((10 * i, head + " " + " ".join(text)))
        for k in range(1, 7):
            other = list(text)
            for at in rng.sample(range(len(text)), k):
                other[at] = "changed"
            rows.append((10 * i + k, head + " " + " ".join(other)))
    return rows


def test_stage_links_every_pair_of_the_threshold(spark):
    rows = corpus()
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if jaccard(x, y) >= 0.8]
    assert len(pairs) > 200
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == {find(i) for i, _ in rows}


def test_prefixes_and_parities_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 200)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 10))]))
        hot = np.sort(rng.choice(a, len(a) // 3, replace=False))
        far = int(np.bitwise_count((similar.parity(a) ^ similar.parity(b)).view(np.uint64)).sum())
        assert far <= len(np.setxor1d(a, b))
        if len(b) and similar.linked(a, b):
            assert 9 * far <= len(a) + len(b)
            for order in (hot, np.empty(0, np.int64)):
                assert len(np.intersect1d(similar.first(a, order), similar.first(b, order)))


def test_buckets_stream_over_batches(spark):
    """Pairs with the first node, and the members of buckets of three or more, wherever batches end."""
    rng = random.Random(2)
    rows = [(s, rng.randrange(1000)) for s in range(60) for _ in range(rng.choice((1, 1, 2, 3, 9)))]
    rows += rows[::7]
    want_pairs, want_members = set(), set()
    for s in range(60):
        own = sorted({f for t, f in rows if t == s})
        want_pairs |= {(own[0], f) for f in own[1:]}
        want_members |= {(s, f) for f in own} if len(own) > 2 else set()
    for size in ("1", "2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = similar.met_in_buckets(spark.createDataFrame(rows, "s long, fp long")).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.a, r.b) for r in got if r.b is not None} == want_pairs
        assert sorted((r.s, r.a) for r in got if r.b is None) == sorted(want_members)


def test_wide_parity_loses_no_pair():
    rng = np.random.default_rng(8)
    for n in (1, 50, 3000, 20_000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(-(1 << 62), 1 << 62, n // 20)]))
        x, y = (np.frombuffer(similar.wide_parity(v), np.uint64) for v in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_unconnected_nodes_meet_in_blocks(spark):
    """A group of near copies, most of them not linked: rows are written for pairs near the threshold only, and for every linked one, however the group is cut."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 400)
    sets = []
    for _ in range(120):
        kept = base[rng.random(400) > rng.uniform(0.02, 0.4)]
        sets.append(np.unique(np.concatenate([kept, rng.integers(-(1 << 62), 1 << 62, 400 - len(kept))])))
    root = [i % 7 if i < 40 else i for i in range(120)]
    share = lambda a, b: (n := len(np.intersect1d(a, b))) / (len(a) + len(b) - n)
    every = {(a, b): share(sets[a], sets[b]) for a in range(120) for b in range(a + 1, 120) if root[a] != root[b]}
    linked = {k for k, x in every.items() if x >= 0.8}
    assert 100 < len(linked) < len(every) / 5
    apart = spark.createDataFrame([(c, i, r) for c in (0, 3) for i, r in enumerate(root)], "c long, fp long, root long")
    wide = spark.createDataFrame([(i, len(s), similar.wide_parity(s)) for i, s in enumerate(sets)], "fp long, n long, wide binary")
    for block, size in ((4096, "10000"), (16, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [(r.a, r.b) for r in similar.close_pairs(apart, wide, block).collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        # once for each of the two smallest nodes
        assert len(got) == 2 * len(set(got)) and linked <= set(got) <= {k for k, x in every.items() if x >= 0.75}


def test_buckets_with_several_components(spark):
    members = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (2, 5), (2, 6), (2, 7), (3, 9), (3, 5), (3, 6)], "s long, fp long")
    found = spark.createDataFrame([(5, 5), (6, 5), (7, 5)], "node long, root long")
    got = similar.left_apart(members, found).collect()
    assert sorted(map(tuple, got)) == [(5, 5, 5), (5, 6, 5), (5, 9, 9)]
