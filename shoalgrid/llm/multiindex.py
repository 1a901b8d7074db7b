"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook of K centroids
and the K x K product grid gives the cells. A vector looks for its neighbours by
multi-sequence traversal: the centroids of each half are put in order of the
squared distance to their borders (bisectors to the vector's own centroid), and
a queue hands out the cells of the grid in order of the sum, until the radius at
which pairs at exactly the threshold are met with the recall ``TARGET``; closer
pairs are met more often. Every pair met is verified by cosine in double
precision. K grows with the number of vectors, to the least estimated cost.

Equal vectors of a label are one entry with a multiplicity. Cells above
``BLOCK`` entries are split into blocks and those that more than ``MEETING``
vectors visit into groups, so that a task holds one block and streams its
visitors. A pair counts for both of its vectors if either visits the other's
cell. Links are counted where they are met and reduced to spanning forests;
pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import Forest, components
from .vectors import is_vector, matrix, name, shape

THRESHOLD = 0.93
#: Vectors for the codebooks; and the recall that the traversal's radius is set for, at the threshold itself.
SAMPLE, TARGET = 8192, 0.9995
#: The radius is that much larger than the sample asks for, up to where no pair can be missed.
MARGIN = 1.5
BLOCK, CHUNK, MEETING = 4096, 512, 1 << 16
#: Entries whose counts and links a task holds before it writes them.
PENDING = 1 << 16
SEED = 20241


class Grid:
    """Two codebooks and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target: float = TARGET):
        self.d = sample.shape[1]
        self.cut = max(1, self.d // 2)
        self.k = k
        rng = np.random.default_rng(SEED)
        halves = [sample[:, : self.cut], sample[:, self.cut :]]
        self.books = [_kmeans(h, k, rng) for h in halves]
        self.gaps = [np.maximum(np.sqrt(np.maximum(((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c @ c.T), 0)), 1e-12) for c in self.books]
        # pairs at the threshold: a random direction at right angles to each vector
        other = rng.normal(size=sample.shape)
        other -= (other * sample).sum(axis=1, keepdims=True) * sample
        other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
        other = threshold * sample + np.sqrt(1 - threshold**2) * other
        need = np.sort(self.reach(self.borders(sample), self.cells(other)))
        wanted = MARGIN * float(need[min(len(need) - 1, int(np.ceil(target * len(need))))])
        # vectors at the threshold are 2 - 2 * threshold apart, so no pair lies beyond that
        self.radius = min(wanted, 2 - 2 * threshold) + 1e-12
        some = sample[:256]
        who, cell = self.traverse(some)
        self.visited = len(who) / len(some)
        share = np.bincount(self.cells(sample), minlength=k * k) / len(sample)
        self.met = float(share[cell].sum()) / len(some)

    def _half(self, x: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        """(own centroid, squared distance to the border of each centroid) of one half."""
        part = x[:, : self.cut] if h == 0 else x[:, self.cut :]
        book = self.books[h]
        far = ((part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T) if part.shape[1] else np.zeros((len(x), len(book)))
        near = far.argmin(axis=1)
        border = (far - far[np.arange(len(x)), near][:, None]) / (2 * self.gaps[h][near])
        border[np.arange(len(x)), near] = 0
        return near, np.maximum(border, 0) ** 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self._half(x, 0)[0] * self.k + self._half(x, 1)[0]

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._half(x, 0)[1], self._half(x, 1)[1]

    def reach(self, borders: tuple[np.ndarray, np.ndarray], cell: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """At which radius the vectors (of the rows) visit the cells."""
        row = np.arange(len(cell)) if row is None else row
        return borders[0][row, cell // self.k] + borders[1][row, cell % self.k]

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the radius of each vector, nearest cells first."""
        sides = []
        for border in self.borders(x):
            order = np.argsort(border, axis=1, kind="stable")
            near = np.take_along_axis(border, order, axis=1)
            sides.append((order, near, (near <= self.radius).sum(axis=1)))
        who, cells = [], []
        for r in range(len(x)):
            (oa, a, na), (ob, b, nb) = ((o[r, : n[r]].tolist(), v[r, : n[r]].tolist(), int(n[r])) for o, v, n in sides)
            queue = [(a[0] + b[0], 0, 0)]
            while queue and queue[0][0] <= self.radius:
                _, i, j = heappop(queue)
                cells.append(oa[i] * self.k + ob[j])
                who.append(r)
                # each cell enters the queue once: from the one before it in its row, or above it in the first column
                if j + 1 < nb:
                    heappush(queue, (a[i] + b[j + 1], i, j + 1))
                if not j and i + 1 < na:
                    heappush(queue, (a[i + 1] + b[0], i + 1, 0))
        return np.array(who, np.int64), np.array(cells, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    book = np.concatenate([book, np.zeros((k - len(book), x.shape[1]))])
    for _ in range(rounds):
        near = ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def best_grid(sample: np.ndarray, n: int, labels: float, threshold: float) -> Grid:
    """The grid of least cost: vectors sent to cells (as 200 comparisons each) plus comparisons."""
    best = None
    for k in (x for e in range(16) for x in (1 << e, 3 << e >> 1) if e or x == 1):
        if k > 1 and (k * k > n / labels or 8 * k > len(sample)):
            break
        g = Grid(sample, k, threshold)
        cost = 200 * g.visited + g.met * n / labels
        if best is None or cost < best[0]:
            best = (cost, g)
    return best[1]


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)


def _arrays(blob: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        out.append(np.frombuffer(blob, t, size // np.dtype(t).itemsize, at + 8))
        at += 8 + size
    return out


_SENT = "label int, cell int, gid long, n long, blob binary"


def _send(entries: DataFrame, grid: Grid, visit: bool) -> DataFrame:
    """Entries in chunks by (label, cell): of the cell they lie in, or of those they visit."""
    d = grid.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                x = matrix(part.column("v"), d)
                labels = part.column("label").to_numpy()
                nodes, mult = part.column("node").to_numpy(), part.column("mult").to_numpy()
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                home = grid.cells(unit)
                who, cell = grid.traverse(unit) if visit else (np.arange(len(x)), home)
                key = labels[who].astype(np.int64) * grid.k**2 + cell
                order = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.diff(key[order])) + 1
                rows = [(int(labels[who[g[0]]]), int(cell[g[0]]), name(nodes[who[g]]), len(g), _blob(nodes[who[g]], mult[who[g]], home[who[g]], x[who[g]])) for g in np.split(order, cut) if len(g)]
                if rows:
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["label", "cell", "gid", "n", "blob"])

    return entries.select("label", "node", "mult", "v").mapInArrow(run, _SENT)


def _meet(homes: DataFrame, visits: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """(a, b, n): edges (a, b) of a spanning forest; or, with b null, n links of the entry a."""
    blocks = homes.groupBy("label", "cell").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    groups = visits.groupBy("label", "cell").agg(F.ceil(F.sum("n") / MEETING).alias("groups"))
    large = blocks.join(groups, ["label", "cell"], "full").select("label", "cell", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("groups", F.lit(1)).alias("groups"))
    large = stored(large.where("blocks > 1 or groups > 1"), "multi-index-large")
    size = lambda df: df.join(large, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("groups", F.coalesce("groups", F.lit(1)))
    row = ["label", "cell", "i", "g", "kind", "blob"]
    h = size(homes).withColumn("i", F.pmod("gid", "blocks")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("kind", F.lit(0)).select(row)
    v = size(visits).withColumn("g", F.pmod("gid", "groups")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1)).select(row)

    d = grid.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts = Forest(), {}
        now, held, unit, nodes, mult, same, borders = None, [], None, None, None, None, None

        def written() -> Iterator[pa.RecordBatch]:
            rows = [(a, b, None) for a, b in forest.stars()] + [(a, None, n) for a, n in counts.items()]
            for at in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + (1 << 16)])], ["a", "b", "n"])

        for batch in batches:
            for *key, kind, blob in zip(*[batch.column(c) for c in range(6)]):
                key = tuple(k.as_py() for k in key)
                if key != now:
                    now, held, unit = key, [], None
                    if len(counts) + len(forest.up) > PENDING:
                        yield from written()
                        forest, counts = Forest(), {}
                got = _arrays(blob.as_py(), np.int64, np.int64, np.int64, np.float64)
                if kind.as_py() == 0:
                    held.append(got)
                    continue
                if unit is None:
                    if not held:
                        continue
                    nodes, mult, _, x = (np.concatenate(c) for c in zip(*held))
                    x = x.reshape(-1, d)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    same, borders = np.arange(len(nodes)), grid.borders(unit)
                own, times, home, q = got
                q = q.reshape(-1, d)
                near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T >= threshold
                near &= own[:, None] != nodes[None]
                links = near @ mult
                # the visitor counts its own links, and those of entries that don't visit its cell in turn
                i, j = np.nonzero(near)
                still = grid.reach(borders, home[i], j) > grid.radius
                for k, n in zip(nodes[j[still]].tolist(), times[i[still]].tolist()):
                    counts[k] = counts.get(k, 0) + n
                for i in np.flatnonzero(links).tolist():
                    node = int(own[i])
                    counts[node] = counts.get(node, 0) + int(links[i])
                    hits = np.flatnonzero(near[i])
                    apart = np.unique(same[hits])
                    forest.union(node, int(nodes[hits[0]]))
                    if len(apart) > 1:  # entries that this vector joins for the first time
                        for j in apart[1:].tolist():
                            forest.union(int(nodes[apart[0]]), int(nodes[j]))
                        same[np.isin(same, apart)] = apart[0]
        yield from written()

    return h.unionByName(v).repartition("label", "cell", "i", "g").sortWithinPartitions("label", "cell", "i", "g", "kind").mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows link if their labels are equal and not null and their cosine is
    ``threshold`` or more. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing, nor does one of another dimension
    than most. Every row is a vector: rows that repeat one link with each other.
    A null id takes part, names no component and isn't kept. An empty table
    gives no rows. Other columns of ``vectors`` don't matter, whatever their names.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("int").alias("label"))
    fit = F.coalesce(F.col("label").isNotNull() & is_vector("v"), F.lit(False))
    found = shape(rows.where(fit), "v")
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not found:
        return alone(rows)
    d, n = found[:2]
    fit = fit & (F.size("v") == d)
    entries = rows.where(fit).groupBy("label", "v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"))
    entries = stored(entries.withColumn("node", F.monotonically_increasing_id()), "multi-index-entries")
    sample = entries.orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    x = matrix(sample.column("v").combine_chunks(), d)
    names = sample.column("label").to_numpy()
    labels = len(names) ** 2 / float((np.unique(names, return_counts=True)[1] ** 2).sum())
    grid = best_grid(x / np.linalg.norm(x, axis=1, keepdims=True), n, labels, threshold)
    met = stored(_meet(_send(entries, grid, False), _send(entries, grid, True), grid, threshold), "multi-index-links")
    roots = components(met.where("b is not null"))
    counts = met.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    known = (
        entries.join(roots, "node", "left")
        .select("label", "v", "mult", "low", "node", F.coalesce("root", "node").alias("root"))
        .join(counts, F.col("node") == F.col("a"), "left")
        .select("label", "v", "low", "root", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lows, "root").select("label", "v", "n_links", "component_id")
    linked = rows.where(fit).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone(rows.where(~fit)))
