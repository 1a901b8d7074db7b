"""Connected components of edge lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import checkpointed


#: Edges that one task joins by itself; more are joined range by range first.
LOCAL = 1 << 17


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that ``node`` reaches.

    ``LOCAL`` edges or fewer are joined in one task. More are cut into ranges of
    that size, each joined in a task of its own; what is left are links between
    the roots of nodes that stand in several ranges, few where ids run along the
    graph. Where the ranges don't halve the edges, they are joined by rounds:
    smallest neighbours make a pointer forest; pointers jump to their target's
    own, other edges are hooked to the smallest neighbour, until nothing moves.
    Two such rounds run to a checkpoint. Ranges are joined by merging: a broadcast
    would gather nodes on the driver.
    """
    e = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("p")).distinct())
    kind = e.schema["u"].dataType.simpleString()
    n = e.count()
    if n <= LOCAL:
        return checkpointed(e.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
    stars = checkpointed(e.repartitionByRange(-(-n // LOCAL), "u").mapInArrow(_joined, f"node {kind}, root {kind}"))
    low = stars.groupBy("node").agg(F.min("root").alias("m"))
    links = checkpointed(stars.join(low.hint("merge"), "node").where("root <> m").select(F.col("root").alias("u"), F.col("m").alias("p")).distinct())
    if links.count() * 2 <= n:
        roots = components(links, "u", "p").select(F.col("node").alias("m"), F.col("root").alias("top"))
        return low.join(roots.hint("merge"), "m", "left").select("node", F.coalesce("top", "m").alias("root"))
    return _by_rounds(e)


def _by_rounds(e: DataFrame) -> DataFrame:
    while True:
        e = checkpointed(_hooked(_hooked(e)))
        if e.where("moved").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())


def _hooked(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("p").alias("m"))
    jump = low.join(low.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m", "left").select("u", F.coalesce("mm", "m").alias("p"), F.col("mm").isNotNull().alias("moved"))
    hook = e.join(low, "u").where("p <> m").select(F.col("p").alias("u"), F.col("m").alias("p"), F.lit(True).alias("moved"))
    return jump.unionByName(hook).groupBy("u", "p").agg(F.max("moved").alias("moved"))


def _joined(batches: Iterator) -> Iterator:
    import pyarrow as pa

    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = y
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([find(x) for x in up], kind)], ["node", "root"])
