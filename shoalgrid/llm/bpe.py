"""Byte-level BPE as a monoid: halves are encoded alone and joined at their seam.

A node of the tree is the token sequence of a text range. ``Monoid.join`` takes
two neighbouring nodes and re-encodes a window around the seam that grows until
it starts and ends at a *synchronisation point*: a place where a non-space
character is followed by white space. In the pre-tokenisation pattern used here
white space stands only at the start of a match or fills all of it, so every
segmentation of every text that contains such a place has a match boundary
there. A match never depends on what stands left of its start, and matches that
end at a synchronisation point have seen no further than its white space, so
tokens outside the window are those of the joined text: they are provably
stable, and the window's own tokens are those of its text. Where a range has no
such place the window grows to the end of the range.

Decoding concatenates token bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces

LEAF_CHARS = 4096
WINDOW_CHARS = 64
_SYNC = re.compile(r"(?<=\S)(?=\s)")


def read_vocabulary(path: str) -> bytes:
    """The raw rank file (about a megabyte; its size does not depend on the corpus)."""
    with open(path, "rb") as f:
        return f.read()


class Monoid:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, vocabulary: bytes, pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        import tiktoken

        ranks = {}
        for line in vocabulary.splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._leaf, self._window = max(2, leaf), max(1, window)

    def leaf(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text) if text else np.empty(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of ``text``, by reduction over halves."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self._leaf:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        start, size = lo, self._window
        while mid - size > lo:
            # the white space after the point has to lie in the left half, too
            found = [m.start() for m in _SYNC.finditer(text, mid - size, mid)]
            if found:
                start = found[-1]
                break
            size *= 2
        found_right = _SYNC.search(text, min(mid + 1, hi), hi)
        stop = found_right.start() if found_right else hi
        tail = len(self.leaf(text[start:mid]))
        head = len(self.leaf(text[mid:stop]))
        return np.concatenate([left[: len(left) - tail], self.leaf(text[start:stop]), right[head:]])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of token ids, concatenated pairwise up the tree."""
        table = self._bytes
        level = [b"".join([table[i] for i in ids[k : k + self._leaf].tolist()]) for k in range(0, len(ids), self._leaf)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


_cache: dict[tuple, Monoid] = {}


def _monoid(vocabulary: bytes, pattern: str, leaf: int) -> Monoid:
    key = (hash(vocabulary), len(vocabulary), pattern, leaf)
    if key not in _cache:
        _cache.clear()
        _cache[key] = Monoid(vocabulary, pattern, leaf)
    return _cache[key]


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", out: str = "token_ids", leaf: int = LEAF_CHARS) -> DataFrame:
    """Add ``out``: the ids of the whole text as packed little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. All other columns pass through;
    a column already named ``out`` is replaced. Work and memory are bounded by
    one text; there is no shuffle.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    keep = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = source.withColumn(out, F.lit(b"")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = _monoid(vocabulary.value, pattern, leaf)
        for batch in pieces(batches):
            ids = [monoid.encode(t or "").astype("<u4").tobytes() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names)

    return map_batches(source, run, schema)


def decode(df: DataFrame, vocabulary_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded", leaf: int = LEAF_CHARS) -> DataFrame:
    """Replace the packed ``ids`` column by ``out``, the decoded bytes (null ids: empty)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    rest = [c for c in source.columns if c != ids]
    schema = source.select(*[F.col(f"`{c}`") for c in rest]).withColumn(out, F.lit(b"")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = _monoid(vocabulary.value, pattern, leaf)
        for batch in pieces(batches):
            done = [monoid.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(done, pa.binary())], names)

    return map_batches(source, run, schema)


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded", leaf: int = LEAF_CHARS) -> DataFrame:
    """``encode`` and ``decode`` of the ids just made, in one pass through Python: adds both columns."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ids, out)])
    schema = source.withColumn(ids, F.lit(b"")).withColumn(out, F.lit(b"")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = _monoid(vocabulary.value, pattern, leaf)
        for batch in pieces(batches, 2 << 20):
            coded = [monoid.encode(t or "").astype("<u4").tobytes() for t in batch.column(text).to_pylist()]
            back = [monoid.decode(np.frombuffer(x, "<u4")) for x in coded]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary()), pa.array(back, pa.binary())], names)

    return map_batches(source, run, schema)


def token_digests(df: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts: encoded, then decoded from the ids."""
    return round_trip(df.select("doc_id", "text"), vocabulary_path, pattern).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
