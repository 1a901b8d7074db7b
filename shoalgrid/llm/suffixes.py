"""Repeated byte strings across documents, by a distributed sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Documents are packed into shards (a few megabytes,
compressed, in a table that all executors share) and three exchanges follow, of
which only the second carries text:

1. *Census.* Every window of ``LENGTH`` bytes names an anchor: the place of its
   smallest ``GRAM``-byte hash. Equal windows name the same place, so a repeated
   window has an anchor whose gram occurs in two documents. Shards send 48-bit
   hashes of their anchors' grams, once each, and get back two bits per hash:
   seen elsewhere, or twice here (false positives only cost work), and whether
   it is hot, with ``HOT`` anchors or more in all. Whole texts take part by
   digest, so that copies of a smaller document drop out here.
2. *Suffixes.* Surviving anchors become suffixes of the sparse suffix array,
   each with the bytes to its left that a window can reach. Equal ones of a
   shard collapse to one with the smallest document id, so that a passage found
   everywhere counts once a shard. Splitters sampled from the survivors'
   leading tokens (8-byte words) range-partition the suffixes. A splitter stands
   between two different pairs of leading tokens, which is the comparison across
   the boundary: suffixes on its two sides share fewer than ``GRAM`` bytes, so
   no match crosses it. A bucket sorts its suffixes by multikey quicksort over
   tokens, likewise the reversed left contexts, and takes common-prefix lengths
   of neighbours in both orders. For each of the offsets of a window around its
   anchor, runs of both orders give exact classes of equal windows.
   The suffixes of a hot gram, which would all meet in one bucket, are split by
   further tokens: by the hash of the whole window, each window on its own.
3. *Marks.* Each suffix gets back a bit per offset: a smaller document has that
   window. Shards apply the bits to their documents and cut the bytes.

Every step reads shards by key and holds one bucket or shard at a time. Each
shard writes a message to each bucket; both hold more text as the corpus grows,
with its square root, so that a message keeps ``MESSAGE`` anchors and their
number grows with the corpus and no faster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, stored

LENGTH = 50
GRAM = 16
#: Text bytes in a shard (a longer text is a shard of its own), in a bucket's share of the census and of the suffixes.
SHARD_BYTES, CENSUS_BYTES, SUFFIX_BYTES = 2 << 20, 16 << 20, 8 << 20
#: Text bytes for a partition of an exchange.
TASK_BYTES = 16 << 20
#: Anchors of a message from a shard to a bucket, from the size on at which shards or buckets would otherwise send fewer.
MESSAGE = 64
#: Bytes of text for an anchor, about.
SPACING = 18
#: Ranges between splitters, and sampled leading tokens for each; buckets beyond that number are made by hash within a range.
RANGES, SAMPLES = 1024, 128
#: Shards, chosen by hash, whose suffixes are sampled for the splitters.
SAMPLE_SHARDS = 64
#: Anchors of a gram from which its suffixes go by whole windows.
HOT = 1 << 14
#: Rows that a sort no longer parts by pivots.
SMALL = 2048
#: Windows are enumerated over so many bytes at a time.
SEGMENT = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_ROW = "key long, gid long, kind int, bucket long, blob binary"
_SHARD, _CENSUS, _MARKS, _COPIES, _HOT = 0, 1, 2, 3, 4


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; integers by byte planes, so that small values pack well."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.ndim == 1 and a.itemsize > 1 else a.tobytes()
        out += [np.array([a.itemsize, a.size * a.itemsize], np.int64).tobytes(), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 0, []
    for t in types:
        item, size = np.frombuffer(data, np.int64, 2, at)
        raw = np.frombuffer(data, np.uint8, size, at + 16)
        at += 16 + int(size)
        t = np.dtype(t)
        out.append(np.ascontiguousarray(raw.reshape(t.itemsize, -1).T).reshape(-1).view(t) if t.itemsize > 1 else raw.view(t))
    return out


def _delta(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=_U(0))


# -- anchors ---------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Mixed polynomial hashes of all k-byte strings (k a power of two), by doubling."""
    h, n, base = data.astype(_U) + _U(1), 1, _BASE
    with np.errstate(over="ignore"):
        while n < k:
            h = h[:-n] * base + h[n:]
            base, n = base * base, 2 * n
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return np.maximum(h, _U(1))


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    n, out = 1, a
    while 2 * n <= width:
        out = f(out[:-n], out[n:])
        n *= 2
    m = len(a) - width + 1
    return f(out[:m], out[width - n : width - n + m])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows of a text, in order."""
    places, hashes = [], []
    width = LENGTH - GRAM + 1
    for start in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        h = gram_hashes(data[start : start + SEGMENT + LENGTH - 1])
        low = _sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, _U)
        chosen = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
        places.append(chosen + start)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, _U)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


class Shard:
    """Documents of a shard with all that the exchanges recompute from their bytes."""

    def __init__(self, gid: int, blob: bytes):
        self.gid = gid
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        self.ids = np.frombuffer(data, np.int64, n, 8)
        sizes = np.frombuffer(data, np.int64, n, 8 + 8 * n)
        self.buffer = np.frombuffer(data, np.uint8, int(sizes.sum()), 8 + 16 * n)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    @staticmethod
    def pack(ids: list[int], texts: list[bytes]) -> bytes:
        head = np.array([len(ids), *ids, *map(len, texts)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))

    def text(self, i: int) -> np.ndarray:
        return self.buffer[self.starts[i] : self.ends[i]]

    def digests(self) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """(digest of each text of LENGTH bytes or more, distinct ones sorted, smallest id of each)."""
        own = [hashlib.blake2b(self.text(i), digest_size=16).digest() if self.ends[i] - self.starts[i] >= LENGTH else b"" for i in range(len(self.ids))]
        low: dict[bytes, int] = {}
        for d, x in zip(own, self.ids.tolist()):
            if d:
                low[d] = min(low.get(d, x), x)
        keys = sorted(low)
        return own, keys, np.array([low[k] for k in keys], np.int64)

    def anchors(self) -> None:
        found = [anchors(self.text(i)) for i in range(len(self.ids))]
        counts = [len(p) for p, _ in found]
        self.doc = np.repeat(np.arange(len(found)), counts)
        self.place = np.concatenate([p + s for (p, _), s in zip(found, self.starts)]) if found else np.empty(0, np.int64)
        self.hash = np.concatenate([h for _, h in found]) >> _U(16) if found else np.empty(0, _U)

    def census(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, whether two documents with different ids have it here, anchors as a power of two)."""
        order = np.lexsort((self.ids[self.doc], self.hash))
        h, d = self.hash[order], self.ids[self.doc][order]
        new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(h)]])[: len(at)] - 1
        return h[at], d[at] != d[last], np.ceil(np.log2(last - at + 1)).astype(np.uint8)

    def suffixes(self, keep: np.ndarray, hot: np.ndarray) -> None:
        """Distinct (left, right) contexts of the anchors in ``keep``, the smallest id of each, and whether its gram is ``hot``."""
        left, width = LENGTH - GRAM, 2 * LENGTH - GRAM
        doc, place = self.doc[keep], self.place[keep]
        before = np.minimum(place - self.starts[doc], left)
        after = np.minimum(self.ends[doc] - place, LENGTH)
        padded = np.concatenate([np.zeros(left, np.uint8), self.buffer, np.zeros(LENGTH, np.uint8)])
        rows = np.zeros((len(place), width + 2), np.uint8)
        step = np.arange(width)
        for at in range(0, len(place), 1 << 16):
            s = slice(at, at + (1 << 16))
            got = padded[place[s, None] + step]
            got[(step < left - before[s, None]) | (step >= left + after[s, None])] = 0
            rows[s, :width] = got
        rows[:, width], rows[:, width + 1] = before, after
        distinct, inverse = np.unique(rows.view(f"V{width + 2}").reshape(-1), return_inverse=True) if len(rows) else (rows.view(f"V{width + 2}").reshape(-1), np.empty(0, np.int64))
        self.context = distinct.view(np.uint8).reshape(-1, width + 2)
        self.low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.low, inverse, self.ids[doc])
        self.hot = np.zeros(len(distinct), bool)
        self.hot[inverse] = hot
        self.kept_doc, self.kept_place, self.kept_context = doc, place, inverse

    def windows(self) -> None:
        """Distinct windows of the hot contexts and the smallest id of each."""
        left = LENGTH - GRAM
        at = np.flatnonzero(self.hot)
        before, after = self.context[at, -2].astype(np.int64), self.context[at, -1].astype(np.int64)
        own, offset, found = [], [], []
        for o in range(left + 1):
            valid = at[(before >= o) & (after >= LENGTH - o)]
            own.append(valid)
            offset.append(np.full(len(valid), o))
            found.append(self.context[valid, left - o : left - o + LENGTH])
        rows = np.ascontiguousarray(np.concatenate(found))
        distinct, inverse = np.unique(rows.view(f"V{LENGTH}").reshape(-1), return_inverse=True) if len(rows) else (rows.reshape(-1), np.empty(0, np.int64))
        self.window = distinct.view(np.uint8).reshape(-1, LENGTH)
        self.window_own, self.window_offset, self.window_of = np.concatenate(own), np.concatenate(offset), inverse
        self.window_low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.window_low, inverse, self.low[self.window_own])

    def apply_windows(self, mask: np.ndarray, marked: np.ndarray) -> None:
        """Set the bits of the hot contexts in ``mask`` from those of the windows."""
        smaller = marked[self.window_of] | (self.window_low[self.window_of] < self.low[self.window_own])
        np.bitwise_or.at(mask, self.window_own[smaller], _U(1) << self.window_offset[smaller].astype(_U))


def _words(rows: np.ndarray) -> np.ndarray:
    """Byte rows as rows of big-endian 8-byte tokens (zero-padded)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(_U)


def multikey_sort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows by multikey quicksort: parted by a pivot into smaller, equal and larger ones; the equal ones go on with the next token."""
    n, m = tokens.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, j = todo.pop()
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(tokens[part, j:].T[::-1])]
            continue
        key = tokens[part, j]
        some = np.sort(key[:: max(1, len(key) // 64)])
        pivot = some[len(some) // 2]
        less, more = key < pivot, key > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(x, y, k) for x, y, k in ((lo, a, j), (a, b, j + 1), (b, hi, j)) if y - x > 1 and k < m]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row (in order) and the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 16):
        a, b = rows[order[at : at + (1 << 16)]], rows[order[at - 1 : at - 1 + len(order[at : at + (1 << 16)])]]
        differ = a != b
        out[at : at + len(a)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def mark_windows(context: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each suffix a bit per offset o: the window that starts o bytes before the anchor occurs in a document smaller than ``low``."""
    left = LENGTH - GRAM
    n = len(context)
    mask = np.zeros(n, _U)
    if n < 2:
        return mask
    before, after = context[:, -2].astype(np.int64), context[:, -1].astype(np.int64)
    right = context[:, left : left + LENGTH]
    back = np.ascontiguousarray(context[:, :left][:, ::-1])
    by_right = multikey_sort(_words(right))
    right_prefix = common_prefixes(right, by_right)
    # only suffixes that share a gram with a neighbour can have equal windows
    close = right_prefix >= GRAM
    live = np.sort(by_right[close | np.concatenate([close[1:], [False]])])
    if len(live) < n:
        mask[live] = mark_windows(context[live], low[live]) if len(live) > 1 else _U(0)
        return mask
    by_back = multikey_sort(_words(back))
    back_prefix = common_prefixes(back, by_back)
    right_class, back_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(left + 1):
        valid = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(valid) < 2:
            continue
        right_class[by_right] = np.cumsum(right_prefix < LENGTH - o)
        back_class[by_back] = np.cumsum(back_prefix < o)
        key = right_class[valid] * (n + 1) + back_class[valid]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat(low[valid][order], at)
        smaller = np.repeat(least, np.diff(np.concatenate([at, [len(key)]]))) < low[valid][order]
        mask[valid[order[smaller]]] |= _U(1) << _U(o)
    return mask


def mark_equal(windows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row whether an equal one has a smaller ``low``."""
    out = np.zeros(len(windows), bool)
    if len(windows) > 1:
        tokens = _words(windows)
        order = multikey_sort(tokens)
        at = np.flatnonzero(np.concatenate([[True], (tokens[order[1:]] != tokens[order[:-1]]).any(axis=1)]))
        out[order] = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.append(at, len(order)))) < low[order]
    return out


# -- exchanges --------------------------------------------------------------------


def _exchange(df: DataFrame, run: Callable[[int, list[tuple[int, int, int, bytes]]], Iterator[tuple]], tasks: int) -> DataFrame:
    """Rows by key over ``tasks`` partitions, then ``run(key, [(gid, kind, bucket, blob)])`` for each key; yields rows of the same shape."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        key, rows = None, []
        for batch in batches:
            for k, *rest in zip(*[batch.column(i) for i in range(5)]):
                k = k.as_py()
                if k != key and rows:
                    yield key, rows
                    rows = []
                key = k
                rows.append(tuple(x.as_py() for x in rest))
        if rows:
            yield key, rows

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches):
            yield from _batches(run(key, rows))

    return df.repartition(tasks, "key").sortWithinPartitions("key", "kind", "gid", "bucket").mapInArrow(apply, _ROW)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["key", "gid", "kind", "bucket", "blob"]
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4]) + 32
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def shards(docs: DataFrame, id_column: str, text: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Documents with an id, packed to ``limit`` bytes: (gid, n_bytes, blob) in a table that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            blob = Shard.pack(ids, texts)
            gid = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "big", signed=True)
            return pa.RecordBatch.from_pydict({"gid": pa.array([gid], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in pieces(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if ids and size + len(t) > limit:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield out()

    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(map_batches(rows, run, "gid long, n_bytes long, blob binary"), "suffix-shards")


def _census_rows(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for gid, blob in zip(batch.column("gid").to_pylist(), batch.column("blob")):
                    shard = Shard(gid, blob.as_py())
                    shard.anchors()
                    hashes, twice, count = shard.census()
                    for b, s in _spread(hashes, buckets):
                        yield b, gid, _CENSUS, b, _pack(_delta(hashes[s]), twice[s].astype(np.uint8), count[s])
                    _, keys, low = shard.digests()
                    where = np.array([int.from_bytes(k[:6], "big") for k in keys], _U)
                    for b, s in _spread(where, buckets):
                        yield b, gid, _SHARD, b, _pack(np.frombuffer(b"".join(keys[s]), np.uint8), low[s])

        yield from _batches(rows())

    return table.mapInArrow(run, _ROW)


def _spread(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted 48-bit hashes by equal ranges."""
    if not len(sorted_hashes):
        return
    edges = np.array([(b << 48) // buckets for b in range(1, buckets)], _U)
    cuts = [0, *np.searchsorted(sorted_hashes, edges).tolist(), len(sorted_hashes)]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, slice(cuts[b], cuts[b + 1])


def _census_answers(key: int, rows: list) -> Iterator[tuple]:
    """Bits for each shard: hash found in another document, and hot; text found with a smaller id."""
    own = [r for r in rows if r[1] == _CENSUS]
    if own:
        parts = [_unpack(r[3], _U, np.uint8, np.uint8) for r in own]
        hashes = [np.cumsum(d, dtype=_U) for d, *_ in parts]
        everything = np.concatenate(hashes)
        order = np.argsort(everything, kind="stable")
        h = everything[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shards_ = np.diff(np.append(start, len(h)))
        anchors_ = np.add.reduceat(np.int64(1) << np.concatenate([c for *_, c in parts])[order].astype(np.int64), start)
        again, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
        again[order] = np.repeat(shards_ > 1, shards_)
        again |= np.concatenate([t for _, t, _ in parts]).astype(bool)
        hot[order] = np.repeat(anchors_ >= HOT, shards_)
        at = 0
        for r, x in zip(own, hashes):
            yield r[0], r[0], _CENSUS, r[2], _pack(np.packbits(again[at : at + len(x)]), np.packbits(hot[at : at + len(x)]))
            at += len(x)
    texts = [r for r in rows if r[1] == _SHARD]
    if texts:
        least: dict[bytes, int] = {}
        parts = [_unpack(r[3], np.uint8, np.int64) for r in texts]
        for keys, low in parts:
            data = keys.tobytes()
            for i, x in enumerate(low.tolist()):
                k = data[16 * i : 16 * i + 16]
                least[k] = min(least.get(k, x), x)
        for r, (keys, low) in zip(texts, parts):
            data = keys.tobytes()
            copy = np.array([least[data[16 * i : 16 * i + 16]] < x for i, x in enumerate(low.tolist())], np.uint8)
            yield r[0], r[0], _COPIES, r[2], _pack(np.packbits(copy))


def _surviving(shard: Shard, answers: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors to keep, which of them are hot), from the census; sets shard.copy (document is a copy of one with a smaller id)."""
    shard.anchors()
    own, keys, low = shard.digests()
    flags = [_unpack(r[3], np.uint8)[0] for r in sorted((r for r in answers if r[1] == _COPIES), key=lambda r: r[2])]
    sizes = _sizes(np.array([int.from_bytes(k[:6], "big") for k in keys], _U), buckets)
    copied = np.concatenate([np.unpackbits(f)[:n] for f, n in zip(flags, sizes)]).astype(bool) if flags else np.zeros(len(keys), bool)
    at = {k: i for i, k in enumerate(keys)}
    shard.copy = np.array([bool(d) and bool(copied[at[d]] or low[at[d]] < x) for d, x in zip(own, shard.ids.tolist())], bool)
    hashes = shard.census()[0]
    flags = [_unpack(r[3], np.uint8, np.uint8) for r in sorted((r for r in answers if r[1] == _CENSUS), key=lambda r: r[2])]
    if not flags:
        return np.empty(0, np.int64), np.empty(0, bool)
    again, hot = (np.concatenate([np.unpackbits(f[i])[:n] for f, n in zip(flags, _sizes(hashes, buckets))]).astype(bool) for i in (0, 1))
    where = np.searchsorted(hashes, shard.hash)
    keep = np.flatnonzero(again[where] & ~shard.copy[shard.doc])
    return keep, hot[where[keep]]


def _sizes(hashes: np.ndarray, buckets: int) -> list[int]:
    return [s.stop - s.start for _, s in _spread(hashes, buckets)]


def _assign(context: np.ndarray, splitters: np.ndarray, parts: int) -> np.ndarray:
    """Bucket of each suffix: range of its leading tokens, then a hash of them within the range."""
    left = LENGTH - GRAM
    tokens = _words(context[:, left : left + GRAM])
    if len(splitters):
        # ranges by two tokens: the first decides, the second where the first is a splitter's own
        first = np.searchsorted(splitters[:, 0], tokens[:, 0], "left")
        last = np.searchsorted(splitters[:, 0], tokens[:, 0], "right")
        where = first.copy()
        for i in np.flatnonzero(last > first):
            where[i] += np.searchsorted(splitters[first[i] : last[i], 1], tokens[i, 1], "right")
    else:
        where = np.zeros(len(context), np.int64)
    with np.errstate(over="ignore"):
        mixed = ((tokens[:, 0] * _BASE) ^ tokens[:, 1]) * _BASE >> _U(33)
    return where * parts + (mixed % _U(parts)).astype(np.int64)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_column, n_bytes, removed, kept): removed byte ranges [start, end) of the UTF-8 text, and the bytes left.

    Null and empty texts have nothing to remove. A row with a null id keeps all
    its bytes, and is no smaller document for any other; rows with equal ids
    never remove from each other. One row for each row of ``docs``; an empty
    table gives none. Other columns of ``docs`` don't matter.
    """
    out_schema = f"{id_column} long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    total = docs.where(F.col(id_column).isNotNull()).agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("binary"))), F.lit(0))).first()[0]
    root = int((SPACING * MESSAGE * total) ** 0.5)
    table = shards(docs, id_column, text, max(SHARD_BYTES, root))
    count = table.count()
    census = max(1, -(-total // max(CENSUS_BYTES, root)))
    wanted = max(1, -(-total // max(SUFFIX_BYTES, root)))
    tasks = max(1, -(-total // max(TASK_BYTES, root)))
    ranges = min(RANGES, wanted)
    parts = -(-wanted // ranges)
    share = min(1.0, SAMPLE_SHARDS / max(1, count))
    rate = min(1.0, ranges * SAMPLES / max(1.0, share * total / SPACING))

    def answer(key: int, got: list) -> Iterator[tuple]:
        return _census_answers(key, got)

    answers = stored(_exchange(_census_rows(table, census), answer, tasks), "suffix-census")
    packed = table.select(F.col("gid").alias("key"), "gid", F.lit(_SHARD).alias("kind"), F.lit(0).cast("long").alias("bucket"), "blob")

    def rebuilt(got: list) -> Shard:
        shard = Shard(got[0][0], next(r[3] for r in got if r[1] == _SHARD))
        shard.suffixes(*_surviving(shard, got, census))
        return shard

    def once(got: list) -> Iterator[Shard]:
        copies: set[bytes] = set()
        for one in _each(got):
            if one[0][3] not in copies:  # equal shards are one: their documents have equal ids
                copies.add(one[0][3])
                yield rebuilt(one)

    def sample(key: int, got: list) -> Iterator[tuple]:
        for shard in once(got):
            cold = shard.context[~shard.hot]
            grams = cold[:, LENGTH - GRAM : LENGTH]
            mixed = (_words(cold) * _BASE).sum(axis=1, dtype=_U) * _BASE >> _U(32)
            yield key, shard.gid, _MARKS, 0, np.ascontiguousarray(grams[mixed < _U(int(rate * (1 << 32)))]).tobytes()

    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))
    splitters = _split(_exchange(packed.where(chosen).unionByName(answers.where(chosen)), sample, tasks).select("blob"), ranges) if ranges > 1 else np.empty((0, 2), _U)

    def grouped(where: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(where, kind="stable")
        at = np.flatnonzero(where[order][1:] != where[order][:-1]) + 1
        return [(int(where[x[0]]), rows[x]) for x in np.split(order, at)] if len(order) else []

    def dealt(shard: Shard) -> tuple[list, list]:
        """(bucket, contexts) of the suffixes, (bucket, windows) of the hot ones."""
        cold = np.flatnonzero(~shard.hot)
        shard.windows()
        where = ((_words(shard.window) * _BASE ** np.arange(1, 8, dtype=_U)).sum(axis=1, dtype=_U) * _BASE >> _U(33)) % _U(wanted)
        return grouped(_assign(shard.context[cold], splitters, parts), cold), grouped(where.astype(np.int64), np.arange(len(where)))

    def send(key: int, got: list) -> Iterator[tuple]:
        for shard in once(got):
            cold, hot = dealt(shard)
            for b, x in cold:
                yield b, shard.gid, _MARKS, b, _pack(shard.context[x].reshape(-1), shard.low[x])
            for b, x in hot:
                yield -1 - b, shard.gid, _HOT, b, _pack(shard.window[x].reshape(-1), shard.window_low[x])

    def mark(key: int, got: list) -> Iterator[tuple]:
        if key < 0:
            parts_ = [_unpack(r[3], np.uint8, np.int64) for r in got]
            found = mark_equal(np.concatenate([w.reshape(-1, LENGTH) for w, _ in parts_]), np.concatenate([low for _, low in parts_]))
            at = 0
            for r, (_, low) in zip(got, parts_):
                yield r[0], r[0], _HOT, r[2], _pack(found[at : at + len(low)].view(np.uint8))
                at += len(low)
            return
        width = 2 * LENGTH - GRAM + 2
        parts_ = [_unpack(r[3], np.uint8, np.int64) for r in got]
        context = np.concatenate([c.reshape(-1, width) for c, _ in parts_])
        mask = mark_windows(context, np.concatenate([low for _, low in parts_]))
        at = 0
        for r, (_, low) in zip(got, parts_):
            yield r[0], r[0], _MARKS, r[2], _pack(mask[at : at + len(low)])
            at += len(low)

    marks = _exchange(_exchange(packed.unionByName(answers), send, tasks), mark, tasks)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(got: list) -> Iterator[pa.RecordBatch]:
            shard = rebuilt(got)
            masks = {r[2]: _unpack(r[3], _U)[0] for r in got if r[1] == _MARKS}
            marked_ = {r[2]: _unpack(r[3], np.uint8)[0] for r in got if r[1] == _HOT}
            mask = np.zeros(len(shard.context), _U)
            cold, hot = dealt(shard)
            for b, x in cold:
                mask[x] = masks[b]
            marked = np.zeros(len(shard.window), bool)
            for b, x in hot:
                marked[x] = marked_[b].astype(bool)
            shard.apply_windows(mask, marked)
            yield from _cut(shard, mask, id_column)

        key, rows = None, []
        for batch in batches:
            for k, *rest in zip(*[batch.column(i) for i in range(5)]):
                k = k.as_py()
                if k != key and rows:
                    for one in _each(rows):
                        yield from cut(one)
                    rows = []
                key = k
                rows.append(tuple(x.as_py() for x in rest))
        if rows:
            for one in _each(rows):
                yield from cut(one)

    everything = packed.unionByName(answers).unionByName(marks)
    found = everything.repartition(tasks, "key").sortWithinPartitions("key", "kind", "bucket").mapInArrow(finish, out_schema)
    loose = docs.where(F.col(id_column).isNull()).select(
        F.lit(None).cast("long").alias(id_column),
        F.octet_length(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("n_bytes"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("removed"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"),
    )
    return found.unionByName(loose)


def _each(rows: list) -> Iterator[list]:
    """Shards of one key (equal ones share their key) with the answers."""
    rest = [r for r in rows if r[1] != _SHARD]
    seen = set()
    rest = [r for r in rest if not ((r[1], r[2]) in seen or seen.add((r[1], r[2])))]
    for r in rows:
        if r[1] == _SHARD:
            yield [r, *rest]


def _split(sampled: DataFrame, ranges: int) -> np.ndarray:
    """``ranges`` - 1 splitters (two tokens each) from about ``ranges * SAMPLES`` sampled leading tokens."""
    grams = b"".join(r.blob for r in sampled.collect())
    tokens = _words(np.frombuffer(grams, np.uint8).reshape(-1, GRAM))
    if not len(tokens):
        return np.empty((0, 2), _U)
    tokens = tokens[np.lexsort((tokens[:, 1], tokens[:, 0]))]
    cut = tokens[[len(tokens) * i // ranges for i in range(1, ranges)]]
    return np.unique(cut, axis=0)


def _cut(shard: Shard, mask: np.ndarray, id_column: str) -> Iterator[pa.RecordBatch]:
    """Apply the marks of a shard to its documents."""
    n = len(shard.buffer)
    change = np.zeros(n + LENGTH + 1, np.int32)
    own = mask[shard.kept_context]
    later = shard.ids[shard.kept_doc] > shard.low[shard.kept_context]
    before = np.minimum(shard.kept_place - shard.starts[shard.kept_doc], LENGTH - GRAM)
    after = shard.ends[shard.kept_doc] - shard.kept_place
    for o in range(LENGTH - GRAM + 1):
        valid = (before >= o) & (after >= LENGTH - o) & (later | ((own >> _U(o)) & _U(1)).astype(bool))
        start = shard.kept_place[valid] - o
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    gone = np.cumsum(change[:n]) > 0
    ids, sizes, spans, kept, held = [], [], [], [], 0
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    names = [id_column, "n_bytes", "removed", "kept"]
    for i in range(len(shard.ids)):
        own = np.ones(shard.ends[i] - shard.starts[i], bool) if shard.copy[i] else gone[shard.starts[i] : shard.ends[i]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        ids.append(int(shard.ids[i]))
        sizes.append(len(own))
        spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        kept.append(shard.text(i)[~own].tobytes() if len(edge) else shard.text(i).tobytes())
        held += len(kept[-1])
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, sizes, spans, kept), types)], names)
            ids, sizes, spans, kept, held = [], [], [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, sizes, spans, kept), types)], names)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of whole texts."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
