import corpus_pipeline as pipeline
from shoalgrid.llm import common, mixing


def test_place_in_the_mix_survives_the_reread(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 50), "en", f"src{i % 7 % 3}", 0) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in mixing.mixed(docs).collect()]
    got = pipeline.tokenize(spark, common.stored(pipeline.mix_sources(spark, docs, ""), "order"), "")
    rows = common.stored(got, "order").collect()
    assert len({r.mix_position for r in rows}) == len(rows) == 900
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_position)] == want
