"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node it reaches.

    Each round keeps for every node its smallest neighbour ``m``: a pointer
    forest towards smaller nodes. A further, larger neighbour ``p`` of the node
    is hooked to ``m`` (edge p-m replaces node-p, so the number of edges never
    grows), and every pointer jumps to its target's own pointer, which halves
    the depth of the forest. The rounds end when no edge changes. The only
    grouped state is one minimum per node (combined before the shuffle); a hub
    that many nodes point to is the many-side of an equi-join, which adaptive
    execution splits. Each round is written by checkpoint(), so a lost executor
    costs one round at most. Edges with a null end and loops are ignored; an
    empty edge list gives no rows.
    """
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("p"))
        .distinct()
    )
    while True:
        low = e.groupBy("u").agg(F.min("p").alias("m"))
        up = low.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        jump = low.join(up, "m", "left").select("u", F.coalesce("mm", "m").alias("p"), F.col("mm").isNotNull().alias("moved"))
        hook = e.join(low, "u").where("p <> m").select(F.col("p").alias("u"), F.col("m").alias("p"), F.lit(True).alias("moved"))
        e = cut(jump.unionByName(hook).groupBy("u", "p").agg(F.max("moved").alias("moved")))
        if e.where("moved").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())


class Forest:
    """Union-find over integers, for the links found within one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True

    def stars(self) -> list[tuple[int, int]]:
        """(node, smallest node of its tree), roots left out."""
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
