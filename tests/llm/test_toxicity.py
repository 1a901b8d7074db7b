import random
import zlib

import numpy as np

from shoalgrid.llm import toxicity


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    fire = lambda a, b: rng.random(4000) < np.where(y, a, b)
    one = fire(0.6, 0.01)
    votes = np.column_stack([one, one, one, fire(0.5, 0.02), fire(0.4, 0.02), fire(0.1, 0.1)])
    q, info = toxicity.label_model(votes, np.full(4000, -1))
    assert ((q > 0.5) == y).mean() > 0.9
    assert info["weight"][0] < 0.5 < info["weight"][3] and info["accuracy"][3] > info["accuracy"][5]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghik") for _ in range(6)) for _ in range(300)]
    bad = ["zorgling", "zorgst", "quixit"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[5], text[50] = rng.choice(bad), "zorg" + rng.choice(words)
        docs.append((i, " ".join(text), "src"))
        labels.append((i, int(toxic), 1))
    docs += [(None, "x", "s"), (5000, None, "s"), (5001, "", "s"), (3, docs[3][1], "s")]
    labels += [(None, 1, 1), (5001, None, 0), (3, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    rows = toxicity.predictions(d, t).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(d, t)
    assert kept.columns == d.columns and 700 < kept.count() < 800
    assert toxicity.predictions(d.where("false"), t).count() == 0
    assert toxicity.predictions(d, t.where("false")).count() == len(docs)


def test_scores_against_the_definition_over_a_table(spark):
    """Every text's score is the weighted sum of its features; the split and the threshold follow the contract."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(model.weights) > 5 and len(got) == docs.count()
    for r in docs.collect():
        total = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(r.text or ""))
        want = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        assert abs(got[r.doc_id].score - want) < 1e-9
        assert got[r.doc_id].predicted == (want >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_repeated_beginnings_count():
    text = "bomentea uno bomenteb dos Bomentec tres die"
    found = toxicity.features(text)
    assert {"4 bome", "4 bome x2", "4 bome x3", "5 bomen x3", "lexicon 1", "w die"} <= found and "5 bomen x4" not in found
    model = toxicity.Model(-1.0, {"4 bome": 0.5, "4 bome x3": 1.0, "w uno": 0.25, "lexicon 2": 9.0})
    assert abs(model.score(text) - 1 / (1 + np.exp(-0.75))) < 1e-12 and abs(model.score("") - 1 / (1 + np.e)) < 1e-12
