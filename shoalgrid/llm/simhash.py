"""SimHash near-duplicates under the generalised pigeonhole principle.

Fingerprints: 64 bits over 3-word shingles hashed with XXH64 (seed 42). Pairs at
``radius`` differing bits or fewer are found without comparing all pairs:

* the 64 bits are dealt into parts so that correlated bits share a part;
* part i gets its own threshold t_i >= -1 (-1: not probed) with
  sum(t_i) = radius - parts + 1. If two fingerprints differ by more than t_i in
  every part, they differ in sum(t_i + 1) = radius + 1 bits or more, so a pair
  within the radius is met in some part with a difference of t_i or less: the
  search is exact for any grouping and allocation;
* the allocation, and the number of parts, come from dynamic programming over
  estimated costs: rows that probing emits plus candidate pairs that it meets,
  estimated from bit counts and pair counts over all fingerprints.

Every fingerprint is verified on all 64 bits. Equal fingerprints are one node, so
copies cost nothing. A bucket above ``BLOCK`` fingerprints is cut into chunks
whose pairs are compared as separate blocks; blocks emit a spanning forest of
their links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .common import map_batches, pieces, stored, utf8_bytes
from .components import Forest, components

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a block of a bucket.
BLOCK = 2048
#: Differing bits of sets of five-word shingles that ``keep_one`` looks for.
SET_RADIUS = 6
#: Cost of a probe row (shuffled, sorted) in compared pairs.
ROW_COST = 40.0


def fingerprint(data: bytes, width: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, highest bit first, of the words of a UTF-8 text."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    if not words:
        return bytes(8)
    if len(words) < width:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return majority(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))))


def majority(digests: bytes) -> bytes:
    """Eight bytes: the bits that are set in over half the ``digests`` of eight bytes, highest bit first."""
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out`` (long, the 64 bits) from the whole text; null and empty texts have zero."""
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = b"".join(fingerprint(x) for x in utf8_bytes(batch.column(text)))
            values = np.frombuffer(got, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names)

    return map_batches(source, run, schema)


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """(count, 64 x 64 matrix of how often bits i and j are both set), over all rows.

    Each task sends one 64 x 64 table, summed before it reaches the driver, so
    the driver holds 4,096 numbers at any size of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            v = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(v), 1 << 16):
                x = np.unpackbits(v[at : at + (1 << 16)], axis=1).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
            rows += len(v)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([*range(BITS * BITS), -1], pa.int32()), "n": pa.array([*total.ravel().tolist(), rows], pa.int64())})

    found = fps.select(column).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    by = {r.cell: r.n for r in found}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(BITS * BITS)], np.float64).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        inner = strength[np.ix_(free, free)]
        group = [free[int(inner.sum(axis=1).argmax())]]
        free.remove(group[0])
        while len(group) < size:
            best = free[int(strength[np.ix_(free, group)].mean(axis=1).argmax())]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def estimate(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated cost of a part for thresholds 0..most: probe rows and the pairs they meet.

    The chance that two fingerprints differ in d of the bits is the
    Poisson-binomial law of their frequencies; the shared information of
    neighbouring bits (from pair counts) shrinks the number of bits that count.
    """
    p = np.diag(both)[bits] / max(n, 1)
    pair = both[np.ix_(bits, bits)] / max(n, 1)
    dev = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    r2 = ((pair - np.outer(p, p)) ** 2 / dev) * (1 - np.eye(len(bits)))
    independent = 1 / (1 + r2.sum(axis=1))
    law = np.array([1.0])
    for q in 2 * p * (1 - p) * independent:
        law = np.convolve(law, [1 - q, q])
    met = np.cumsum(law)
    return [ROW_COST * n * sum(comb(len(bits), k) for k in range(t + 1)) + n * n / 2 * met[t] * (2 if t else 1) for t in range(most + 1)]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts as (bits, threshold) of least estimated cost; parts that aren't probed are left out."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        costs = [[0.0, *estimate(n, both, g, radius)] for g in groups]  # index t + 1
        budget = radius + 1  # the thresholds plus one, summed over the parts
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, chosen) in table.items():
                for share in range(budget - used + 1):
                    x = so_far + cost[share]
                    if used + share not in after or x < after[used + share][0]:
                        after[used + share] = (x, [*chosen, share - 1])
            table = after
        cost, thresholds = table[budget]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


_PROBE = "part int, key long, fp long, home boolean"


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, home) for every key that a fingerprint is filed under (home) or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(start, 4096).to_numpy()
                bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
                for i, (group, limit) in enumerate(parts):
                    weights = np.left_shift(np.uint64(1), np.arange(len(group), dtype=np.uint64))
                    key = (bits[:, group].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                    for k in range(limit + 1):
                        for flip in combinations(range(len(group)), k):
                            mask = np.uint64(sum(1 << b for b in flip))
                            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(fp), i, np.int32)), "key": pa.array((key ^ mask).view(np.int64)), "fp": pa.array(fp), "home": pa.array(np.full(len(fp), k == 0))})

    return fps.select("fp").mapInArrow(run, _PROBE)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the block (i, j): pairs of chunks of a bucket; (0, 0) where a bucket fits into one."""
    large = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    c = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda d: F.struct(F.least(F.coalesce(c, F.lit(0)), d).alias("i"), F.greatest(F.coalesce(c, F.lit(0)), d).alias("j")))
    )
    return rows.join(large, ["part", "key"], "left").select("part", "key", F.inline(others), "fp", "home")


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int, forest: Forest) -> None:
    """Add to ``forest`` the links among rows (sorted by key) of whole groups."""
    n = len(fp)
    label = np.arange(n)
    at = np.arange(n)
    shift = 1
    while len(at):
        at = at[at + shift < n]
        at = at[key[at] == key[at + shift]]
        other = at + shift
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= radius) & (home[at] | home[other])
        a, b = at[near], other[near]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        if len(a):
            for x, y in zip(fp[a].view(np.int64).tolist(), fp[b].view(np.int64).tolist()):
                forest.union(x, y)
            for _ in range(4):  # spread labels so that rows known as linked aren't met again
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
        shift += 1


def links(blocked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of a block that are linked."""
    # The order brings a block's rows together; a task holds one block and one batch at a time.
    dealt = blocked.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    dealt = dealt.select(F.xxhash64("part", "key", "i", "j").alias("block"), "part", "key", "i", "j", "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        kept: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "key", "i", "j", "fp", "home")]
            if kept is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(kept, cols)]
            same = np.all([c[1:] == c[:-1] for c in cols[:5]], axis=0) if len(cols[0]) > 1 else np.empty(0, bool)
            group = np.concatenate([[0], np.cumsum(~same)])
            cut = int(np.searchsorted(group, group[-1]))
            _links(group[:cut], cols[5][:cut].view(np.uint64), cols[6][:cut], radius, forest)
            kept = [c[cut:] for c in cols]
        if kept is not None and len(kept[0]):
            _links(np.zeros(len(kept[0]), np.int64), kept[5].view(np.uint64), kept[6], radius, forest)
        stars = forest.stars()
        for at in range(0, len(stars), 1 << 16):
            a, b = zip(*stars[at : at + (1 << 16)])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


def classes(fps: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``fps`` (columns fp, id_column).

    root is the smallest fingerprint (as a long) of the class, component_id the
    smallest id that links reach; null where a class has only null ids.
    """
    distinct = stored(fps.groupBy("fp").agg(F.min(id_column).alias("low")), "simhash-distinct")
    n, both = bit_statistics(distinct)
    if n < 2:
        return distinct.select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    roots = components(links(blocks(probes(distinct, plan(n, both, radius))), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_column, fingerprint, component_id), a row for each row of ``df``.

    Null or empty texts have fingerprint zero and are linked like any other.
    Rows with a null id take part, but never name a class. Repeated rows share a
    class. Other columns of ``df`` don't matter.
    """
    fps = stored(with_fingerprint(df.select(F.col(id_column), F.col(text).alias("text")), out="fp").select(id_column, "fp"), "simhash-fingerprints")
    return fps.join(classes(fps, id_column), "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(shingles: np.ndarray) -> int:
    """The fingerprint (as a long) of a set of shingle hashes; zero of the empty one."""
    return int.from_bytes(majority(shingles.astype(">i8").tobytes()), "big", signed=True)


def near_sets(nodes: DataFrame, radius: int = SET_RADIUS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (fp, mark) that connect all whose fingerprints ``mark`` are linked within ``radius``.

    By the allocation and the probes of ``classes``. The links are not verified on the sets.
    """
    marks = stored(nodes.groupBy("mark").agg(F.min("fp").alias("low")), "simhash-marks")
    same = nodes.join(marks, "mark").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    n, both = bit_statistics(marks, "mark")
    if n < 2:
        return same
    near = links(blocks(probes(marks.select(F.col("mark").alias("fp")), plan(n, both, radius))), radius)
    own = lambda k: marks.select(F.col("mark").alias(k), F.col("low").alias(f"low_{k}"))
    pairs = near.distinct().join(own("a"), "a").join(own("b"), "b")
    return same.unionByName(pairs.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))).distinct()


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the smallest id.

    Five-word shingle sets of similarity 0.8 or more are linked, all of them.
    Fingerprints of the sets within ``SET_RADIUS`` bits are found first, by the
    generalised pigeonhole, and verified on the sets; ``similar`` adds the links
    that no such radius is sure to find, and compares only what isn't connected.
    Null ids come last, ties go to the smallest digest of the text, and of rows
    that are equal in both one stays. Columns and their order are unchanged.
    """
    key = F.concat_ws(":", F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("-")), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), key.alias("key"))
    narrow = stored(similar.with_set(texts, similar.frequent(texts), set_fingerprint), "simhash-rows")
    rooted = narrow.select("id", "key", "fp").join(similar.roots(narrow, texts, near_sets).withColumnRenamed("node", "fp"), "fp", "left")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))
    keys = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(best.alias("best")).select(F.col("best.key").alias("_key"))
    # the row travels as one struct, so that its columns can't clash with those made here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key")).join(keys, "_key", "left_semi")
    ties = [F.col(f"_row.`{c}`").asc_nulls_last() for c, kind in df.dtypes if c not in (id_column, text) and "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("_key").orderBy(*(ties or [F.lit(1)]))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
