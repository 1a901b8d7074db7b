"""Nearest neighbours by cross-polytope hashing.

A hash rotates vectors by a pseudo-random rotation (three rounds of random signs
and a fast Hadamard transform) and takes the nearest signed axis. A table
concatenates one hash over all coordinates with further ones over the first
2^j of them, more as there are more vectors, so that buckets stay small. A
query visits, in every table, the buckets whose axes it misses by no more than
``reach`` in squared length (multiprobe: how many these are depends on the
query); what it meets is ranked by inner products in double precision. Vectors
of differing length are first mapped to the unit sphere by one more coordinate,
so that nearness on the sphere orders inner products; the ranking always uses
the original vectors.

Concatenation, tables and reach are the cheapest, for the number of vectors at
hand, that have ``TARGET`` recall for a bounded sample of queries, whose true
neighbours among all rows are found by brute force. A query that meets too few
vectors visits all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import is_vector, matrix, name, shape

NEIGHBOURS = 20
#: Vectors of the sample, queries of it that fix tables and reach, and the recall asked of them.
SAMPLE, SAMPLE_QUERIES, TARGET = 8192, 256, 0.97
TABLES = 4
#: Hashes of a table, its buckets at most, and vectors that a bucket is to hold at least on average.
LEVELS, BUCKETS, LEAST = 3, 1 << 20, 8
#: Cost of a visit to a bucket in compared vectors.
VISIT = 300.0
#: Vectors in a block of a bucket, and queries in a piece.
BLOCK, PIECE = 4096, 512
#: Queries that one block meets in one task.
MEETING = 1 << 16
SEED = 20240

_ROW = "key long, kind int, gid long, blob binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        y[:, :, 0], y[:, :, 1] = a, b
        h *= 2
    return x / np.sqrt(n)


class Geometry:
    """Maps vectors to the sphere and to signed axes."""

    def __init__(self, d: int, low: float, high: float):
        self.d, self.high = d, high
        self.lift = low < high * (1 - 1e-3)
        self.width = 1 << max(1, (d + self.lift - 1).bit_length())
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], (TABLES, LEVELS, 3, self.width))

    def shapes(self, n: int) -> list[tuple[int, ...]]:
        """Coordinates of each hash of a table, from one hash on, as long as ``n`` vectors fill the buckets."""
        out, full = [(self.width,)], (self.width,)
        while len(full) < LEVELS:
            for j in range(self.width.bit_length()):
                if np.prod([2 * k for k in (*full, 1 << j)], dtype=float) > min(BUCKETS, n / LEAST):
                    return out
                out.append((*full, 1 << j))
            full = (*full, self.width)
        return out

    def on_sphere(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if query or not self.lift:
            out[:, : self.d] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, : self.d] = x / self.high
            out[:, self.d] = np.sqrt(np.maximum(0.0, 1 - (out[:, : self.d] ** 2).sum(axis=1)))
        return out

    def rotate(self, unit: np.ndarray, table: int, level: int) -> np.ndarray:
        for s in self.signs[table, level]:
            unit = hadamard(unit * s)
        return unit

    def axes(self, x: np.ndarray, table: int, level: int, size: int) -> np.ndarray:
        """Nearest signed axis of each vector among ``size`` coordinates: i for +axis i, size + i for -axis i."""
        r = self.rotate(self.on_sphere(x, False), table, level)[:, :size]
        best = np.abs(r).argmax(axis=1)
        return best + size * (r[np.arange(len(r)), best] < 0)

    def misses(self, x: np.ndarray, table: int, level: int, size: int) -> np.ndarray:
        """By how much each query misses each signed axis, squared; 0 for the nearest."""
        r = self.rotate(self.on_sphere(x, True), table, level)[:, :size]
        both = np.concatenate([r, -r], axis=1)
        return (both.max(axis=1, keepdims=True) - both) ** 2

    def buckets(self, x: np.ndarray, table: int, shape: tuple[int, ...]) -> np.ndarray:
        """The bucket of each vector."""
        out = np.zeros(len(x), np.int64)
        for level, size in enumerate(shape):
            out = out * 2 * size + self.axes(x, table, level, size)
        return out

    def probes(self, x: np.ndarray, table: int, shape: tuple[int, ...], reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query number, bucket) of all buckets missed by ``reach`` or less."""
        return _expand([self.misses(x, table, level, size) for level, size in enumerate(shape)], reach)


def _expand(misses: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of axes, one of each hash, whose misses add up to ``reach`` or less."""
    who = np.arange(len(misses[0]))
    bucket, so_far = np.zeros(len(who), np.int64), np.zeros(len(who))
    for miss in misses:
        total = so_far[:, None] + miss[who]
        at, axis = np.nonzero(total <= reach)
        who, bucket, so_far = who[at], bucket[at] * miss.shape[1] + axis, total[at, axis]
    return who, bucket


def calibrate(geometry: Geometry, sample: np.ndarray, queries: np.ndarray, nearest: np.ndarray, n: int, target: float = TARGET) -> tuple[tuple[int, ...], int, float, float]:
    """(shape, tables, reach, recall) of least cost for ``n`` vectors.

    ``nearest``: for each of ``queries`` its true neighbours among all vectors.
    ``sample`` shows what share of the vectors a query meets.
    """
    near = nearest.reshape(-1, nearest.shape[2])
    best = (np.inf, None)
    for shape in geometry.shapes(n):
        met, true, parts = [], [], []
        for t in range(TABLES):
            parts.append([geometry.misses(queries, t, level, size) for level, size in enumerate(shape)])
            axes = [(geometry.axes(sample, t, level, size), geometry.axes(near, t, level, size).reshape(nearest.shape[:2])) for level, size in enumerate(shape)]
            met.append(sum(m[:, a] for m, (a, _) in zip(parts[-1], axes)))
            true.append(sum(np.take_along_axis(m, a, axis=1) for m, (_, a) in zip(parts[-1], axes)))
            first = np.sort(np.min(true, axis=0), axis=None)
            reach = float(first[min(len(first) - 1, int(np.ceil(target * len(first))))])
            visits = sum(len(_expand(m, reach)[0]) for m in parts) / len(queries)
            cost = VISIT * visits + n * float(sum((m <= reach).mean() for m in met))
            if cost < best[0]:
                best = (cost, (shape, t + 1, reach, float((first <= reach).mean())))
    return best[1]


def true_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, neighbours: int) -> np.ndarray:
    """The vectors of the ``neighbours`` nearest rows (vec_id, v) of each query, other than those with its id, by brute force.

    A scan of all rows against a bounded number of queries; each task sends its
    own nearest ones.
    """
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, found = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                own = part.column("vec_id").to_numpy()
                s = queries @ matrix(part.column("v"), d).T
                s[ids[:, None] == own[None]] = -np.inf
                s, f = np.concatenate([score, s], axis=1), np.concatenate([found, np.broadcast_to(own, s.shape)], axis=1)
                top = np.argpartition(-s, min(neighbours, s.shape[1]) - 1, axis=1)[:, :neighbours]
                score, found = np.take_along_axis(s, top, axis=1), np.take_along_axis(f, top, axis=1)
        q, i = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q.astype(np.int32)), "vec_id": pa.array(found[q, i]), "score": pa.array(score[q, i])})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = rows.select("vec_id", "v").mapInArrow(run, "q int, vec_id long, score double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= neighbours)
    got = rows.join(F.broadcast(top), "vec_id").select("q", "v").toArrow()  # one row for each query and neighbour
    q = got.column("q").to_numpy()
    return matrix(got.column("v").combine_chunks(), d)[np.argsort(q, kind="stable")].reshape(len(ids), -1, d)


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)


def _arrays(blob: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        out.append(np.frombuffer(blob, t, size // np.dtype(t).itemsize, at + 8))
        at += 8 + size
    return out


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types, names = [pa.int64(), pa.int32(), pa.int64(), pa.binary()], ["key", "kind", "gid", "blob"]
    held, size = [], 0
    for r in found:
        held.append(r)
        size += len(r[3]) + 32
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query number, id, score) rows the k best of each query without its own id, each id once; best first."""
    keep = ids != own[query]
    query, ids, score = query[keep], ids[keep], score[keep]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    if len(query):
        again = np.concatenate([[False], (query[1:] == query[:-1]) & (ids[1:] == ids[:-1])])
        query, ids, score = query[~again], ids[~again], score[~again]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate([start, [len(query)]])))
        query, ids, score = query[place < k], ids[place < k], score[place < k]
    return query, ids, score


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest rows of each query by inner product.

    Queries are the rows where ``is_query`` (a Column over ``vec_id``) holds; candidates
    are all rows but those with the query's id. Rows with a null id or a vector
    that is null, empty, zero or has null or non-finite components take no part,
    nor do vectors of another dimension than most. Of rows that repeat an id the
    smallest vector counts. Equal vectors are one index entry with the
    ``neighbours`` + 1 smallest of their ids, as no more can be among the
    nearest. Ties go to the smaller id; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & is_vector("v"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    found = shape(rows, "v")
    if not found:
        return spark.createDataFrame([], schema)
    d, n, low, high = found
    rows = rows.where(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    geometry = Geometry(d, low, high)
    if n > neighbours + 1:
        x, ids = matrix(sample.column("v").combine_chunks(), d), sample.column("vec_id").to_numpy()
        some = x[:SAMPLE_QUERIES]
        shape_, tables, reach, _ = calibrate(geometry, x, some, true_neighbours(rows, ids[:SAMPLE_QUERIES], some, neighbours), n)
    else:  # every other vector is a neighbour
        shape_, tables, reach = (geometry.width,), 1, np.inf

    same = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= neighbours + 1)
    entries = stored(entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    queries = rows.where(is_query)

    width = int(np.prod([2 * k for k in shape_]))  # buckets of a table
    found = _search(entries, queries, geometry, shape_, tables, reach, width, neighbours, d)
    found = stored(found, "ann-found")
    met = found.groupBy("query_id").agg(F.count("*").alias("met"))
    short = queries.join(met, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("met", F.lit(0)) < min(neighbours, n - 1)).select("vec_id", "v")
    short = stored(short, "ann-short")
    if short.isEmpty():
        return found
    more = _search(entries, short, geometry, (geometry.width,), 1, np.inf, 2 * geometry.width, neighbours, d)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _search(entries: DataFrame, queries: DataFrame, geometry: Geometry, shape_: tuple[int, ...], tables: int, reach: float, width: int, neighbours: int, d: int) -> DataFrame:
    """Nearest entries (v, ids) that each of ``queries`` (vec_id, v) meets."""
    schema = "query_id long, rank int, vec_id long, score double"

    def count(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(tables * width, np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, PIECE):
                    x = matrix(batch.column("v").slice(start, PIECE), d)
                    for t in range(tables):
                        a = geometry.buckets(x, t, shape_) if kind else geometry.probes(x, t, shape_, reach)[1]
                        total += np.bincount(a + t * width, minlength=len(total))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used])})

        return run

    def size(df: DataFrame, kind: int) -> np.ndarray:
        """One number for each bucket: ``TABLES`` times ``BUCKETS`` of them at most, at any size of the input."""
        got = df.select("v").mapInArrow(count(kind), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(tables * width, np.int64)
        out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        return out

    filed_n, asked_n = size(entries, 1), size(queries, 0)
    blocks, groups = np.maximum(1, -(-filed_n // BLOCK)), np.maximum(1, -(-asked_n // MEETING))

    def key(bucket: int, block: int, group: int) -> int:
        return (bucket * 1_000_003 + block) * 1_000_003 + group

    def together(*names: np.ndarray) -> list[np.ndarray]:
        """Places of the rows that agree in all ``names``, group by group."""
        order = np.lexsort(names)
        if not len(order):
            return []
        differ = np.any([a[order[1:]] != a[order[:-1]] for a in names], axis=0)
        return np.split(order, np.flatnonzero(differ) + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in batches:
                x = matrix(batch.column("v"), d)
                lists = batch.column("ids")
                first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                ids = lists.flatten().to_numpy()
                salt = (ids[first[:-1]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for t in range(tables):
                    bucket = geometry.buckets(x, t, shape_) + t * width
                    block = (salt % blocks[bucket].astype(np.uint64)).astype(np.int64)
                    for rows_ in together(block, bucket):
                        b, i = int(bucket[rows_[0]]), int(block[rows_[0]])
                        if not asked_n[b]:
                            continue
                        counts = np.diff(first)[rows_]
                        own = ids[np.concatenate([np.arange(first[r], first[r + 1]) for r in rows_])]
                        for g in range(groups[b]):
                            yield key(b, i, g), 0, 0, _blob(x[rows_], counts, own)

        yield from _rows(out())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, PIECE):
                    part = batch.slice(start, PIECE)
                    x, ids = matrix(part.column("v"), d), part.column("vec_id").to_numpy()
                    gid = name(ids)
                    yield gid, 2, gid, _blob(ids)
                    for t in range(tables):
                        who, bucket = geometry.probes(x, t, shape_, reach)
                        keep = filed_n[bucket + t * width] > 0
                        who, bucket = who[keep], bucket[keep] + t * width
                        for rows_ in together(bucket):
                            b, at = int(bucket[rows_[0]]), np.sort(who[rows_])
                            g = gid % int(groups[b])
                            for i in range(blocks[b]):
                                yield key(b, i, g), 1, gid, _blob(at, ids[at], x[at])

        yield from _rows(out())

    asked = queries.mapInArrow(ask, _ROW)
    met = entries.mapInArrow(index, _ROW).unionByName(asked.where("kind = 1"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (kind 0) come before the pieces (kind 1) that meet them; a key's blocks make one index block."""

        def out() -> Iterator[tuple]:
            now, held, x, counts, ids = None, [], None, None, None
            for batch in batches:
                for k, kind, gid, blob in zip(*[batch.column(c) for c in range(4)]):
                    k, blob = k.as_py(), blob.as_py()
                    if k != now:
                        now, held, x = k, [], None
                    if kind.as_py() == 0:
                        held.append(_arrays(blob, np.float64, np.int64, np.int64))
                        continue
                    if x is None:
                        if not held:
                            continue
                        x, counts, ids = (np.concatenate(c) for c in zip(*held))
                        x = x.reshape(-1, d)
                        first = np.cumsum(counts) - counts
                    at, own, q = _arrays(blob, np.int64, np.int64, np.float64)
                    score = q.reshape(-1, d) @ x.T
                    k_ = min(neighbours + 1, len(x))
                    edge = np.partition(score, len(x) - k_, axis=1)[:, len(x) - k_]
                    row, col = np.nonzero(score >= edge[:, None])
                    size_ = counts[col]
                    pos = np.repeat(first[col] - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
                    got = best_of(np.repeat(row, size_), ids[pos], np.repeat(score[row, col], size_), own, neighbours)
                    yield gid.as_py(), 3, gid.as_py(), _blob(at[got[0]], got[1], got[2])

        yield from _rows(out())

    ranked = met.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(rank, _ROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(own: np.ndarray, parts: list) -> pa.RecordBatch:
            q, ids, score = best_of(*[np.concatenate(c) for c in zip(*parts)], own, neighbours)
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
            return pa.RecordBatch.from_pydict({"query_id": pa.array(own[q]), "rank": pa.array((place + 1).astype(np.int32)), "vec_id": pa.array(ids), "score": pa.array(score)})

        now, own, parts, held = None, None, [], 0
        for batch in batches:
            for k, kind, _, blob in zip(*[batch.column(c) for c in range(4)]):
                k = k.as_py()
                if k != now:
                    if parts:
                        yield finish(own, parts)
                    now, parts, held = k, [], 0
                if kind.as_py() == 2:
                    own = _arrays(blob.as_py(), np.int64)[0]
                else:
                    parts.append(_arrays(blob.as_py(), np.int64, np.int64, np.float64))
                    held += len(parts[-1][0])
                    if held > 1 << 20:  # what can't be among the nearest goes, so that a piece's parts stay small
                        parts = [best_of(*[np.concatenate(c) for c in zip(*parts)], own, neighbours)]
                        held = len(parts[0][0])
        if parts:
            yield finish(own, parts)

    return ranked.unionByName(asked.where("kind = 2")).repartition("key").sortWithinPartitions("key", "kind").mapInArrow(merge, schema)
