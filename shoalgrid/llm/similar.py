"""Near-duplicates by the similarity of five-word shingle sets, exact at the threshold.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles (XXH64, words as in ``simhash``) is ``SIMILAR`` or more. At 0.8 a 64-bit
SimHash of the same shingles differs in about ten bits, and in up to twenty; no
radius below that finds all pairs, and at that radius most buckets hold most
fingerprints. The pigeonhole is therefore applied to the sets themselves:

* of the n shingles of a set at most n - ceil(0.8 n) can be missing in a set it
  is linked to, so of any n - ceil(0.8 n) + 1 one is shared; with one order of
  all shingles, linked sets share one among the first so many of both;
* the fingerprints still find what is within a smaller radius, first (``simhash.near_sets``);
* any order is exact. Shingles that a sample shows to be frequent come last, so
  that a common passage fills no bucket; the others go by their hash;
* equal sets are one node. In a bucket the smallest node is compared with all
  others; then all pairs not yet connected. Bit i of a set's parity is whether an
  odd number of its shingles hash to i, so two sets differ in at least as many
  shingles as their parities in bits: pairs that differ too much are left out
  without loss. Every other pair is verified on its sets;
* the buckets of one group of copies nearly all have the same few smallest nodes.
  What isn't connected is therefore compared by smallest node, not by bucket: a
  pair is met once for each smallest node instead of once for each shared shingle,
  and only pairs that wide parities leave are written as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, stored, utf8_bytes
from .components import components

SHINGLE_WORDS, SEED = 5, 42
#: Similarity of linked texts, as a fraction.
SIMILAR = (4, 5)
#: Texts sampled for the order of shingles; those in so many of them come last; so many at most. Results don't depend on them.
SAMPLE, FREQUENT, MOST = 5_000, 5, 50_000
#: Longs of a set's parity bits, and bits of its wide ones.
LONGS, WIDE = 4, 4096
#: Nodes in a chunk of those that are compared with each other.
BLOCK = 4096


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a text of fewer words is one shingle."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.int64)
    width = min(SHINGLE_WORDS, len(words))
    grams = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">i8").astype(np.int64))


def set_name(shingles: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True) if len(shingles) else 0


def parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount(shingles & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def first(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of which one is shared with every linked set; ``hot`` (sorted) come last."""
    n = len(shingles)
    size = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1 if n else 0
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:size]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common, total = len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)
    return SIMILAR[1] * common >= SIMILAR[0] * (total - common)


def frequent(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that a sample of ``texts`` (key, text) repeats."""
    step = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for x in utf8_bytes(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"s": pa.array(shingle_set(x), pa.int64())})

    some = map_batches(texts.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("text"), run, "s long")
    found = some.groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(MOST).collect()
    return np.array(sorted(r.s for r in found), np.int64)


def with_set(texts: DataFrame, hot: np.ndarray, mark: Callable[[np.ndarray], int]) -> DataFrame:
    """(id, key, fp, n, mark, bits, prefix) of (id, key, text): name, size, ``mark`` and parity of the set, and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(x) for x in utf8_bytes(batch.column("text"))]
            made = [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([mark(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), pa.array([first(s, hot) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *made], ["id", "key", "fp", "n", "mark", "bits", "prefix"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, run, f"id {kind}, key string, fp long, n long, mark long, bits array<long>, prefix array<long>")


def sets_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(fp, items): the whole sets, of the texts with ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(x) for x in utf8_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"fp": pa.array([set_name(s) for s in sets], pa.int64()), "items": pa.array([s.tobytes() for s in sets], pa.binary())})

    return map_batches(texts.join(keys, "key", "left_semi").select("text"), run, "fp long, items binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            ok = [linked(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def met_in_buckets(spread: DataFrame) -> DataFrame:
    """Of nodes (s, fp): rows (a, b) pairing each node with the first one of its bucket s; and, of buckets of three nodes or more, the members (s, a).

    Buckets stream through a task, which holds two nodes of one and a batch.
    """
    dealt = spread.select("s", "fp").repartition("s").sortWithinPartitions("s", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 2), np.int64)  # the start of a bucket that may go on: one or two nodes not written, or the last of more
        more = False  # whether its members are being written
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            rows = np.concatenate([kept, rows])
            if not len(rows):
                continue
            again = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1)])
            again[: len(kept)] = False
            rows = rows[~again]
            start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            size = np.diff(np.append(start, len(rows)))
            first = np.repeat(rows[start, 1], size)
            new = np.ones(len(rows), bool)
            new[: len(kept)] = False
            paired = new & (rows[:, 1] != first)
            large = np.repeat(size >= 3, size)
            if more:
                large[: size[0]] = True
            member = large.copy()
            if more:
                member[: len(kept)] = False
            pairs = np.unique(np.stack([np.minimum(rows[:, 1], first), np.maximum(rows[:, 1], first)], axis=1)[paired], axis=0)
            last = slice(start[-1], len(rows))
            more = bool(large[-1])
            if not more:
                member[last] = False
            kept = rows[[start[-1], len(rows) - 1]] if size[-1] > 1 else rows[last]
            out = rows[member]
            n = len(pairs) + len(out)
            if n:
                empty = lambda k: [None] * k
                yield pa.RecordBatch.from_pydict({"s": pa.array([*empty(len(pairs)), *out[:, 0].tolist()], pa.int64()), "a": pa.array(np.concatenate([pairs[:, 0], out[:, 1]])), "b": pa.array([*pairs[:, 1].tolist(), *empty(len(out))], pa.int64())})

    return dealt.mapInArrow(run, "s long, a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    own = lambda k: nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return pairs.join(own("a"), "a").join(own("b"), "b").where(_alike("na", "nb", differ)).select("a", "b")


def _alike(n: str, m: str, differ) -> F.Column:
    """Of similarity p/q or more: sizes within q/p of each other, and at most (q - p)/(q + p) of both sizes differ."""
    p, q = SIMILAR
    return (F.col(n) * q >= F.col(m) * p) & (F.col(m) * q >= F.col(n) * p) & (differ * (p + q) <= (q - p) * (F.col(n) + F.col(m)))


def wide_parity(shingles: np.ndarray) -> bytes:
    """As ``parity``, over ``WIDE`` bits: it tells long sets apart."""
    return np.packbits((np.bincount(shingles & (WIDE - 1), minlength=WIDE) & 1).astype(np.uint8)).tobytes()


def named(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """The keys of texts that have the sets ``some`` (fp)."""
    return nodes.join(some.distinct(), "fp", "left_semi").select("key")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))


def wide_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(fp, n, wide): sizes and wide parities of the sets of the texts with ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(x) for x in utf8_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"fp": pa.array([set_name(x) for x in sets], pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "wide": pa.array([wide_parity(x) for x in sets], pa.binary())})

    return stored(map_batches(texts.join(keys, "key", "left_semi").select("text"), run, "fp long, n long, wide binary").dropDuplicates(["fp"]), "similar-wide")


def words_of(wide: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(wide.to_pylist()), np.uint64).reshape(-1, WIDE // 64)


def links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sets are similar enough; whole sets are made and sent only for pairs that wide parities don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = SIMILAR
        for batch in batches:
            x, y = (words_of(batch.column(c)) for c in ("wa", "wb"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (p + q) <= (q - p) * total
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    wide = wide_of(texts, named(ends(pairs), nodes))
    own = lambda k: wide.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
    return checked(stored(map_batches(pairs.join(own("a"), "a").join(own("b"), "b"), near, "a long, b long"), "similar-close"), nodes, texts)


def checked(close: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``close`` whose whole sets are similar enough."""
    sets = stored(sets_of(texts, named(ends(close), nodes)).dropDuplicates(["fp"]), "similar-sets")
    return stored(verified(close, sets), "similar-links")


def left_apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(c, fp, root) of the nodes in buckets (s, fp) that hold several components (node, root); c is the smallest node of the bucket."""
    rooted = members.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("s", "fp", F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("fp").alias("c")).where("lo < hi").select("s", "c")
    return rooted.join(several, "s").select("c", "fp", "root").distinct()


def pairs_of_block(chunk: np.ndarray, root: np.ndarray, n: np.ndarray, wide: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(x, all y > x) of the rows, ordered by size n, of which sizes and parities don't rule out that their sets are linked.

    Rows of one component are left out, and rows of one chunk where there are two: those meet in a block of their own.
    """
    p, q = SIMILAR
    slim = np.bitwise_xor.reduce(wide.reshape(len(n), -1, LONGS), axis=1)
    two = len(n) > 0 and (chunk != chunk[0]).any()
    for x, end in enumerate(np.searchsorted(n, n * q // p, side="right").tolist()):
        meets = root[x + 1 : end] != root[x]
        if two:
            meets &= chunk[x + 1 : end] != chunk[x]
        y = x + 1 + np.flatnonzero(meets)
        for bits in (slim, wide):
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) * (p + q) <= (q - p) * (n[y] + n[x])]
        if len(y):
            yield x, y


def close_pairs(apart: DataFrame, wide: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of nodes of different components with the same c that may be linked; ``apart`` as of ``left_apart``.

    The nodes of a c are cut into chunks of about ``block``, and every two chunks
    are compared in a block of their own, so that a task holds two chunks at most.
    """
    many = apart.groupBy("c").agg(F.count("*").alias("m")).where(F.col("m") > block).select("c", F.ceil(F.col("m") / block).cast("int").alias("chunks"))
    chunk = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.lit(0))
    others = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda d: F.struct(F.least(chunk, d).alias("i"), F.greatest(chunk, d).alias("j")))
    dealt = apart.join(many, "c", "left").select("c", "fp", "root", chunk.alias("chunk"), F.inline(others)).join(wide, "fp")
    dealt = dealt.select("c", "i", "j", "chunk", "fp", "root", "n", "wide").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "n", "fp")

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp, held, size = rows[4], [], 0
        for x, y in pairs_of_block(rows[3], rows[5], rows[6], rows[7]):
            held.append((np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])))
            size += len(y)
            if size >= 1 << 16:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in zip("ab", zip(*held))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*(batch.column(k).to_numpy() for k in range(7)), words_of(batch.column(7))]
            rows = rows if kept is None else [np.concatenate(z) for z in zip(kept, rows)]
            new = np.any([k[1:] != k[:-1] for k in rows[:3]], axis=0)
            cuts = [0, *(1 + np.flatnonzero(new)).tolist()]
            for start, end in zip(cuts, cuts[1:]):
                yield from pairs([k[start:end] for k in rows])
            kept = [k[cuts[-1] :] for k in rows]
        if kept is not None:
            yield from pairs(kept)

    return map_batches(dealt, run, "a long, b long")


def unconnected(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component (node, root)."""
    own = lambda k: found.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def roots(rows: DataFrame, texts: DataFrame, candidates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all sets that are linked to another one; ``rows`` as of ``with_set``, ``texts`` with (key, text).

    ``candidates`` makes pairs (a, b) of the nodes (fp, mark), which are verified
    first; all other links are found, too, whatever it makes.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "mark", "bits")]), "similar-nodes")  # n, mark and bits are equal for all rows of a set
    known = links(stored(possible(candidates(nodes), nodes), "similar-candidates"), nodes, texts)
    found = components(known)
    spread = rows.join(nodes.select("key"), "key", "left_semi").select(F.explode("prefix").alias("s"), "fp")
    met = stored(met_in_buckets(spread), "similar-met")
    pairs = stored(possible(unconnected(met.where("b is not null").select("a", "b").distinct(), found), nodes), "similar-pairs")
    edges = known.unionByName(links(pairs, nodes, texts))
    found = components(edges)
    # then all pairs of a bucket that aren't connected yet; in a bucket of two there are none
    apart = stored(left_apart(met.where("b is null").select("s", F.col("a").alias("fp")), found), "similar-apart")
    if apart.isEmpty():
        return found
    wide = wide_of(texts, named(apart.select("fp"), nodes))
    rest = stored(close_pairs(apart, wide).distinct().join(pairs, ["a", "b"], "left_anti"), "similar-pairs")
    return found if rest.isEmpty() else components(edges.unionByName(checked(rest, nodes, texts)))
