import pytest

from shoalgrid.llm import licenses

HELD_OUT = ["Made available to everyone under the {}, of which a copy is attached.", "It is offered under the {} to anybody.", "Code is under {}, texts too.", "Subject to the {}."]
TALK = ["The {} was discussed at length in parliament.", "Nobody reads the {} before signing.", "Three students wrote a thesis about the {}."]


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def test_accuracy_on_sentences_held_out(model):
    """Neither the sentences nor their wording are among the examples."""
    right = total = 0
    for family, names in licenses.NAMES.items():
        for name in names:
            for s in HELD_OUT:
                total += 1
                right += model.predict(licenses.words(s.format(name)))[0] == family
    assert right / total > 0.85, right / total
    talk = [model.predict(licenses.words(s.format(n)))[0] == "unknown" for names in licenses.NAMES.values() for n in names for s in TALK]
    assert sum(talk) / len(talk) > 0.75, sum(talk) / len(talk)
    prose = ["The river was calm and the boat went by.", "Version 2 of the bridge opened in spring.", "All seats were reserved for the guests.", "I was granted leave.", "MIT"]
    assert all(model.predict(licenses.words(t))[0] == "unknown" for t in prose)


def test_probabilities_are_calibrated(model):
    """Of the held-out sentences scored near p, about p are right: mean probability and accuracy agree."""
    got = [(p, f == family) for family, names in licenses.NAMES.items() for n in names for s in HELD_OUT for f, p, _ in [model.predict(licenses.words(s.format(n)))]]
    assert abs(sum(p for p, _ in got) / len(got) - sum(ok for _, ok in got) / len(got)) < 0.15


WRAPPED = """Some text of the page goes here
and goes on.

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""


def test_wrapped_notices_and_confirmation(spark):
    talk = "A court in Germany ruled on the MIT License last year."
    rows = [(1, WRAPPED), (2, GPL), (3, "Distributed under the MIT terms"), (4, "prose first.\nAll rights reserved."), (5, talk), (6, None), (7, ""), (8, "\n \n.\n"), (8, "Released under the MIT License.\n\nLicensed under CC BY-NC 4.0."), (None, "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, w int, licenses string")
    got = sorted(((r.doc_id, r.n_passages, r.n_notices, r.n_confirmed, r.families) for r in licenses.license_report(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, 1, "MIT"), (2, 1, 1, 1, "GPL-3.0"), (3, 1, 1, 0, ""), (4, 2, 1, 1, "Proprietary"), (5, 1, 0, 0, ""), (6, 0, 0, 0, ""), (7, 0, 0, 0, ""), (8, 0, 0, 0, ""), (8, 2, 2, 2, "CC-BY-NC,MIT"), (None, 1, 0, 0, "")], key=str)
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "w", "licenses"] and licenses.license_report(df.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_native_scores_against_the_definition(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    long = "word " * 60_000 + "Released under the MIT License"
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, long), (-2, " ".join(licenses.OTHERS * 3)), (-3, "x" * 1_000_000)]
    rows += [(-10 - i, g.format(n)) for i, (g, n) in enumerate((g, n) for g in licenses.GRANTS[:3] for n in licenses.NAMES["CC-BY-SA"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    notices = 0
    for i, text in rows:
        want = [model.predict(w) for w in licenses.passages(text or "")]
        assert len(want) == len(got[i])
        for (family, p, sure), g in zip(want, got[i]):
            assert (family, sure) == (g.family, g.confirmed) and abs(p - g.probability) < 1e-6
        notices += sum(f != "unknown" for f, *_ in want)
    assert notices > 15 and got[-1][-1].family == "MIT" and len(got[-1]) > 700
