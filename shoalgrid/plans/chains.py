"""Places in disjoint cycles and paths, by walking ranges of ids and by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import checkpointed


#: Ids that one task traces by itself; more are traced range by range first.
LOCAL = 1 << 17


def traced(links: DataFrame) -> DataFrame:
    """(id, root, seq) from (id, prev): each id has one predecessor at most and precedes one id at most.

    The root of a path is its first id, that of a cycle its smallest one; seq
    counts from the root. ``LOCAL`` ids or fewer are walked in one task. More are
    cut into ranges of that size, whose tasks walk the stretches within them; the
    stretches, few where ids run along the chains, are then walked in one task,
    each as long as it is. Where there are more than ``LOCAL`` stretches, ids are
    traced by doubling: each round doubles the stretch that an id looks back
    over, so a chain of n ids takes log2(n) rounds of equi-joins, whatever the
    number of chains. No task holds a chain. Ids may be structs.
    """
    links = checkpointed(links.select("id", "prev"))
    kind = links.schema["id"].dataType.simpleString()
    n = links.count()
    if n <= LOCAL:
        return checkpointed(links.coalesce(1).mapInArrow(_walk, f"id {kind}, root {kind}, seq long"))
    known = links.join(links.select(F.col("id").alias("prev"), F.lit(True).alias("_known")).hint("merge"), "prev", "left")
    known = known.select("id", F.when(F.col("_known"), F.col("prev")).alias("prev"))  # a prev that isn't there is none
    walked = checkpointed(known.repartitionByRange(-(-n // LOCAL), "id").mapInArrow(_stretches, f"id {kind}, head {kind}, seq long, prev {kind}, closed boolean"))
    stretches = walked.where("not closed").groupBy("head").agg(F.count("*").alias("n"), F.min(F.struct("id", "seq")).alias("low"), F.first("prev", True).alias("prev"))
    before = walked.select(F.col("id").alias("prev"), F.col("head").alias("before"))
    stretches = checkpointed(stretches.join(before.hint("merge"), "prev", "left").select("head", "before", "n", F.col("low.id").alias("low"), F.col("low.seq").alias("at")))
    if stretches.count() > LOCAL:
        return _by_doubling(links)
    placed = stretches.coalesce(1).mapInArrow(_placed, f"head {kind}, root {kind}, base long, total long")
    joined = walked.join(placed.hint("merge"), "head", "left")
    seq = F.when(F.col("closed"), F.col("seq")).when(F.col("total").isNull(), F.col("base") + F.col("seq")).otherwise(F.pmod(F.col("base") + F.col("seq"), F.col("total")))
    return checkpointed(joined.select("id", F.coalesce("root", "head").alias("root"), seq.alias("seq")))


def _by_doubling(links: DataFrame) -> DataFrame:
    s = links.select("id", F.col("prev").alias("ptr"), F.col("id").alias("best"), F.lit(0).cast("long").alias("dist"))
    step = 1
    while True:
        s = s.withColumn("moved", F.lit(False))
        for _ in range(2):  # two doublings to a checkpoint
            s = _doubled(s, step)
            step *= 2
        s = checkpointed(s)
        if s.where("moved").isEmpty():
            return s.select("id", F.col("best").alias("root"), F.col("dist").alias("seq"))
        s = s.drop("moved")


def _doubled(s: DataFrame, step: int) -> DataFrame:
    """Stretches of ``step`` ids joined with those before them; without a pointer a stretch ends at its path's first id."""
    before = s.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("best").alias("b2"), F.col("dist").alias("d2"))
    first = F.col("p2").isNull()
    better = F.col("b2").isNotNull() & (first | (F.col("b2") < F.col("best")))
    return s.join(before, "ptr", "left").select(
        "id", F.when(F.col("b2").isNotNull(), F.col("p2")).alias("ptr"), F.when(better, F.col("b2")).otherwise(F.col("best")).alias("best"),
        F.when(better, F.col("d2") + step).otherwise(F.col("dist")).alias("dist"), (F.col("moved") | better).alias("moved"),
    )


def _table(batches: Iterator):
    import pyarrow as pa

    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


def _column(table, name: str):
    """A column as one array, and as a list of plain values."""
    import pyarrow as pa

    own = table.column(name)
    own = pa.concat_arrays(own.chunks) if own.num_chunks != 1 else own.chunk(0)
    plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
    return own, [plain(v) for v in own.to_pylist()]


def _walk(batches: Iterator) -> Iterator:
    import pyarrow as pa

    table = _table(batches)
    if table is None:
        return
    (own, ids), (_, before) = _column(table, "id"), _column(table, "prev")
    root, seq, _ = _walked(ids, before)
    yield pa.RecordBatch.from_arrays([own, own.take(pa.array(root)), pa.array(seq, pa.int64())], ["id", "root", "seq"])


def _walked(ids: list, before: list) -> tuple[list[int], list[int], list[bool]]:
    """(place of the root, seq, whether in a cycle) of each id; a path begins where ``before`` is None."""
    after = {p: k for k, p in enumerate(before) if p is not None}
    root, seq, closed = [-1] * len(ids), [0] * len(ids), [False] * len(ids)
    heads = [k for k, p in enumerate(before) if p is None]
    for i, start in enumerate([*heads, *sorted(range(len(ids)), key=ids.__getitem__)]):
        k, n = start, 0
        while k is not None and root[k] < 0:
            root[k], seq[k], closed[k], n = start, n, i >= len(heads), n + 1
            k = after.get(ids[k])
    return root, seq, closed


def _stretches(batches: Iterator) -> Iterator:
    """(id, head, seq, prev, closed): ids of one range walked from the first id of a stretch, whose prev is beyond the range or null; closed are whole cycles."""
    import pyarrow as pa

    table = _table(batches)
    if table is None:
        return
    (own, ids), (prev, before) = _column(table, "id"), _column(table, "prev")
    here = set(ids)
    inner = [p if p in here else None for p in before]
    root, seq, closed = _walked(ids, inner)
    beyond = pa.array([k if p is None and before[k] is not None else None for k, p in enumerate(inner)], pa.int64())
    yield pa.RecordBatch.from_arrays([own, own.take(pa.array(root)), pa.array(seq, pa.int64()), prev.take(beyond), pa.array(closed)], ["id", "head", "seq", "prev", "closed"])


def _placed(batches: Iterator) -> Iterator:
    """(head, root, base, total): where stretches begin in their chain; in a cycle counted from its smallest id, modulo its total."""
    import pyarrow as pa

    table = _table(batches)
    if table is None:
        return
    (own, heads), (_, before), (low, lows) = _column(table, "head"), _column(table, "before"), _column(table, "low")
    sizes, at = table.column("n").to_pylist(), table.column("at").to_pylist()
    first, order, closed = _walked(heads, before)
    chains: dict[int, list[int]] = {}
    for k in sorted(range(len(heads)), key=order.__getitem__):
        chains.setdefault(first[k], []).append(k)
    base, total, root = [0] * len(heads), [None] * len(heads), [0] * len(heads)
    roots = pa.concat_arrays([own, low])
    for start, chain in chains.items():
        n = 0
        for k in chain:
            base[k], n = n, n + sizes[k]
        if not closed[start]:
            for k in chain:
                root[k] = start
            continue
        least = min(chain, key=lows.__getitem__)
        shift = base[least] + at[least]
        for k in chain:
            base[k], total[k], root[k] = base[k] - shift, n, len(heads) + least
    yield pa.RecordBatch.from_arrays([own, roots.take(pa.array(root)), pa.array(base, pa.int64()), pa.array(total, pa.int64())], ["head", "root", "base", "total"])
