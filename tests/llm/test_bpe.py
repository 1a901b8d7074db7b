import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shoalgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf,window", [(2, 1), (3, 2), (7, 4), (64, 8)])
def test_tree_equals_plain_encoding(plain, leaf, window):
    monoid = bpe.Monoid(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN, leaf, window)
    rng = random.Random(leaf)
    parts = ["'re", "'", "'l", "l", " ", "  ", "\n", "\t", " ", "é", "日本", "don't", "12", "345", "...", "!", "we'll", "\U0001f600", "x" * 9, "\r\n", " "]
    for n in list(range(12)) + [40, 200] * 60:
        text = "".join(rng.choice(parts) for _ in range(n))
        ids = monoid.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text), repr(text)
        assert monoid.decode(ids) == text.encode()


def test_query_columns_nulls_and_clashing_names(spark, plain):
    text = "Hello  world, it's me\n\n" * 900
    df = spark.createDataFrame([(1, text, b"x"), (2, None, None), (3, "", None), (None, "a", None), (1, text, b"x")], "doc_id long, text string, token_ids binary")
    rows = bpe.token_digests(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 5
    want = np.array(plain.encode_ordinary(text), "<u4").tobytes()
    for r in rows:
        if r.doc_id == 1:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        if r.doc_id in (2, 3):
            assert (r.n_tokens, r.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.token_digests(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
