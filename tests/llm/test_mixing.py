import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from shoalgrid.llm import mixing


def due(n, w, v):
    """Blocks that each source is due when the common clock of their weights stands at v; and the slots passed."""
    f = {s: min(n[s], w[s] * v) for s in n}
    return f, sum(f.values())


def fluid(n, w, t):
    """What each source is due by slot t: the clock by bisection."""
    lo, hi = 0.0, max(n[s] / w[s] for s in n)
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if due(n, w, mid)[1] < t else (lo, mid)
    return due(n, w, hi)[0]


def check(slots, n, w, step=1):
    """Every block has one slot, in order; no source is a block away from its due at any time."""
    total = sum(n.values())
    assert sorted(t for _, _, t in slots) == list(range(total))
    sent = dict.fromkeys(n, 0)
    for s, k, t in sorted(slots, key=lambda x: x[2]):
        assert k == sent[s]
        sent[s] += 1
        if t % step == 0:
            f = fluid(n, w, t + 1)
            for x in n:
                assert abs(sent[x] - f[x]) < 1 + 1e-4, (x, t)


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_less_than_one_block_off_for_any_weights(spark, chunk):
    rng = random.Random(chunk)
    for _ in range(2):
        n = {f"s{i}": rng.choice([1, 5, 30, 90]) for i in range(rng.choice([1, 2, 7]))}
        w = {s: rng.choice([0.01, 0.3, 1.0, 1.7, rng.random()]) for s in n}
        got = mixing.schedule(spark.createDataFrame([(s, n[s], w[s]) for s in n], "src string, blocks long, w double"), chunk)
        check([tuple(r) for r in got.select("src", "k", "slot").collect()], n, w)


def test_small_weight_over_many_blocks(spark):
    n, w = {"a": 99_700, "b": 300}, {"a": 0.997, "b": 0.003}
    got = mixing.schedule(spark.createDataFrame([(s, n[s], w[s]) for s in n], "src string, blocks long, w double"))
    slots = [tuple(r) for r in got.collect()]
    check(slots, n, w, 61)
    assert sum(1 for s, _, t in slots if s == "b" and t < 6_000) in (18, 19)


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 2.5, "c": 1, None: 0.5}])
def test_rows_take_the_places_of_their_blocks(spark, weights):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(900)] + [(None, "b"), (None, "b"), (7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("src", F.lit(1)).withColumn("k", F.lit(2)).withColumn("_row", F.lit(3)).withColumn("_hash", F.lit(4))
    got = mixing.mix(df, weights=weights, block_rows=4, chunk=24).collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    counts, blocks = {}, set()
    for _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    for s in counts:
        own = sorted((r for r in got if r.source == s), key=lambda r: r.mix_rank)
        assert [r.mix_rank for r in own] == list(range(counts[s]))
        order = [hashlib.md5(str(r.doc_id).encode()).hexdigest() if r.doc_id is not None else "" for r in own]
        assert order == sorted(order)
    for r in got:
        assert (r.src, r.k, r._row, r._hash) == (1, 2, 3, 4)
        assert r.mix_position == r.mix_block * 4 + r.mix_rank % 4
        blocks.add((str(r.source), r.mix_rank // 4, r.mix_block))
    n = {str(s): math.ceil(c / 4) for s, c in counts.items()}
    w = {str(s): (c**0.5 if weights is None else weights.get(s, min(weights.values()))) for s, c in counts.items()}
    check(blocks, n, w)


def test_mixed_order_and_empty(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(200)], "doc_id long, source string")
    place = {r.doc_id: r.mix_position for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert [place[r.doc_id] for r in out.collect()] == sorted(place.values())
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"a": 0})
