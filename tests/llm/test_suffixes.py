import hashlib
import random

import numpy as np
import pytest

from shoalgrid.llm import suffixes


def brute(rows):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                low[s] = min(low.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 49):
                if low[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [make(rng.randrange(0, 30))]
        for _ in range(rng.randrange(4)):
            cut = rng.choice(passages)
            a = rng.randrange(len(cut) // 2)
            parts += [cut[a : rng.randrange(a, len(cut)) + 1], make(rng.randrange(0, 12))]
        rows.append((i * 3 - 40, "".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(0, 30, 4)] + [rows[3], rows[7]]
    rows += [(900, "-" * 700), (901, "ab" * 300), (902, "-" * 49), (903, "ab" * 30 + "-" * 60), (904, None), (905, ""), (None, rows[0][1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard,census,bucket,message,hot", [(1, 2 << 20, 16 << 20, 8 << 20, 64, 1 << 14), (2, 3000, 4000, 5000, 0, 12), (3, 1, 1500, 900, 0, 2), (4, 1, 1, 1, 2, 5)])
def test_against_brute_force(spark, monkeypatch, seed, shard, census, bucket, message, hot):
    for name, value in (("SHARD_BYTES", shard), ("CENSUS_BYTES", census), ("SUFFIX_BYTES", bucket), ("MESSAGE", message), ("HOT", hot), ("SMALL", 4)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gid int").repartition(5)
    got = sorted([tuple(r) for r in suffixes.repeat_digests(df).collect()], key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeat_digests(df).count() == 0


def test_text_above_segment_and_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 4096)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 5000)
    rng = random.Random(7)
    long = "".join(rng.choice("abcd é") for _ in range(30_000))
    rows = [(1, long), (2, "x" * 60 + long[9_000:9_400] + "y"), (3, long[100:] + long[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in suffixes.repeat_digests(df).collect()], key=str) == brute(rows)


@pytest.mark.parametrize("small", [1, 64, 2048])
def test_sorting_and_segments(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 50)).astype(np.uint8)
    rows[:, :20] = rows[0, :20]
    order = suffixes.multikey_sort(suffixes._words(rows))
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    parts = suffixes.anchors(data)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
