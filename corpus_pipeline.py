"""Corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as
Parquet to the shared folder and reads it again for the next one, so that a lost
executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm import bpe, common, mixing, secrets, simhash, toxicity

#: Vocabulary of the last stage: a parameter, never copied into the repository.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model fitted on this corpus' labels.

    Null and empty texts are scored like any other and stay, null ids and repeated
    rows, too; a corpus without labels is judged by the fixed lexicon alone.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id. Five-word shingles, similarity 0.8 or more.

    Null ids come last, ties go to the smallest digest of the text; null and empty
    texts are one class, of rows equal in all columns one stays.
    """
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets at any depth of encoding replaced; n_chars follows the text. A null text stays null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files in order, rows in order within.

    A null source is one of its own; null ids come first in their source, ties
    are ordered by the other columns.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids (packed little-endian), n_tokens, whether decoding gives the text back, and mix_position.

    Readers pack files by size, so the order of the rows is lost between stages; the
    mix depends on the rows only and is found again here, as a column that orders them.
    A null text has no tokens and is lossless.
    """
    placed = mixing.mix(docs, prefix="mix_").select("doc_id", "source", "text", "mix_position")
    back = bpe.round_trip(placed, VOCABULARY, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select("doc_id", "source", "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), same.alias("lossless"), "mix_position")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: The classifier, the hashes and the tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py checks the rows, and their places in the mix, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
