"""Mesh text formats: grd (fort.14) and 2dm, written from and read into tables.

In grd files values point down and are negated on both ways; ids start at 1. In
2dm files values stand as they are, and a missing one is -99999.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import element_ids
from ..plans.numbering import checkpointed


def _e16(c: F.Column) -> F.Column:
    return F.format_string("%.16E", c)


def grd_lines(nodes: DataFrame, elements: DataFrame, description: str = "", boundaries: DataFrame | None = None) -> DataFrame:
    """(section, id, line) of a grd file: 0 header, 1 sizes, 2 nodes, 3 elements; with ``boundaries`` 4 the open ones, 5 the others."""
    spark = nodes.sparkSession
    if boundaries is not None:
        return grd_lines(nodes, elements, description).unionByName(grd_boundary_lines(boundaries))
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("id"), F.lit(description).alias("line"))
    sizes = elements.agg(F.count("*").alias("ne")).join(nodes.agg(F.count("*").alias("np")), F.lit(True)).select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("id"), F.concat_ws(" ", "ne", "np").alias("line"))
    n = nodes.select(F.lit(2).alias("section"), (F.col("node_id") + 1).alias("id"), F.concat_ws(" ", F.col("node_id") + 1, _e16(F.col("x")), _e16(F.col("y")), _e16(0.0 - F.col("value"))).alias("line"))
    e = element_ids(elements)
    e = e.select(F.lit(3).alias("section"), "id", F.concat_ws(" ", "id", F.size("nodes"), F.array_join(F.transform("nodes", lambda k: (k + 1).cast("string")), " ")).alias("line"))
    return head.unionByName(sizes).unionByName(n).unionByName(e)


def grd_boundary_lines(boundaries: DataFrame) -> DataFrame:
    """(section, id, line) of boundaries (bnd_id, btype, ibtype, seq, node_id): counts, then each boundary's head and nodes, seq from 0.

    bnd_id orders the boundaries of a section; a null ibtype counts as 0 (1 for
    interior ones).
    """
    spark = boundaries.sparkSession
    b = boundaries.withColumn("section", F.when(F.col("btype") == "open", 4).otherwise(5))
    kinds = spark.createDataFrame([(4, "open boundaries"), (5, "land boundaries")], "section int, what string")
    sizes = b.groupBy("section").agg(F.countDistinct("bnd_id").alias("n"), F.count("*").alias("k"))
    sizes = kinds.join(sizes, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"), "what")
    line = lambda i, text: F.struct(F.lit(i).cast("long").alias("id"), text.alias("line"))
    counts = sizes.select("section", F.inline(F.array(line(-2, F.concat_ws(" ", "n", F.lit("= Number of"), "what")), line(-1, F.concat_ws(" ", "k", F.lit("= Total number of nodes of"), "what")))))
    at = F.col("bnd_id").cast("long") * (1 << 32)
    ibtype = F.coalesce(F.first("ibtype"), F.when(F.first("btype") == "interior", 1).otherwise(0))
    heads = b.groupBy("section", "bnd_id").agg(F.count("*").alias("k"), ibtype.alias("i"))
    heads = heads.select("section", at.alias("id"), F.when(F.col("section") == 4, F.col("k").cast("string")).otherwise(F.concat_ws(" ", "k", "i")).alias("line"))
    body = b.select("section", (at + F.col("seq") + 1).alias("id"), (F.col("node_id") + 1).cast("string").alias("line"))
    return counts.unionByName(heads).unionByName(body)


def sms2dm_lines(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(section, id, line) of a 2dm file: 0 header, 1 E3T, 2 E4Q, 3 ND."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("id"), F.lit("MESH2D").alias("line"))
    e = element_ids(elements)
    kind = F.when(F.col("etype") == "tria", "E3T").otherwise("E4Q")
    e = e.select(F.when(F.col("etype") == "tria", 1).otherwise(2).alias("section"), "id", F.concat_ws(" ", kind, "id", F.array_join(F.transform("nodes", lambda k: (k + 1).cast("string")), " ")).alias("line"))
    value = F.when(F.col("value").isNull() | F.isnan("value"), -99999.0).otherwise(F.col("value"))
    n = nodes.select(F.lit(3).alias("section"), (F.col("node_id") + 1).alias("id"), F.concat_ws(" ", F.lit("ND"), F.col("node_id") + 1, _e16(F.col("x")), _e16(F.col("y")), _e16(value)).alias("line"))
    return head.unionByName(e).unionByName(n)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order (section, id) as text files; concatenated by name they are the file."""
    lines.repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.mode("overwrite").text(path)


def read_sms2dm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of a 2dm file or folder; ids become 0-based in the order of the file's ids."""
    tok = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))
    n = tok.where(F.element_at("t", 1) == "ND").select((F.element_at("t", 2).cast("long") - 1).alias("node_id"), *[F.element_at("t", i).cast("double").alias(c) for i, c in ((3, "x"), (4, "y"), (5, "value"))])
    kind = F.element_at("t", 1)
    e = tok.where(kind.isin("E3T", "E4Q")).select(
        (F.element_at("t", 2).cast("long") - 1).alias("elem_id"), F.when(kind == "E3T", "tria").otherwise("quad").alias("etype"),
        F.transform(F.slice("t", 3, F.when(kind == "E3T", 3).otherwise(4)), lambda x: x.cast("long") - 1).alias("nodes"),
    )
    return n, e


def parse_grd(content: str) -> Iterator[tuple]:
    """(kind, id, a, b, c, nodes) rows of a grd text: node, element, open and land boundaries."""
    lines = iter(content.splitlines())
    next(lines)
    ne, np_ = (int(x) for x in next(lines).split()[:2])
    for _ in range(np_):
        k, x, y, *v = next(lines).split()
        yield ("node", int(k), float(x), float(y), -float(v[0]) if v else 0.0, None)
    for _ in range(ne):
        k, n, *ids = next(lines).split()
        yield ("element", int(k), None, None, None, [int(i) for i in ids[: int(n)]])
    for kind in ("open", "land"):
        first = next(lines, None)
        if first is None or not first.strip():
            return
        next(lines)
        for b in range(int(first.split()[0])):
            head = next(lines).split()
            ibtype = float(head[1]) if kind == "land" and len(head) > 1 and head[1].lstrip("-").isdigit() else None
            yield (kind, b + 1, ibtype, None, None, [int(next(lines).split()[0]) for _ in range(int(head[0]))])


def read_grd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, elements, boundaries) of a grd file; one task a file, as its sections follow from counts."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf.content:
                rows = list(parse_grd(bytes(content).decode("utf-8")))
                yield pd.DataFrame(rows, columns=["kind", "id", "a", "b", "c", "nodes"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "kind string, id long, a double, b double, c double, nodes array<long>")
    rows = checkpointed(rows)  # read once for the three tables
    nodes = rows.where("kind = 'node'").select((F.col("id") - 1).alias("node_id"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("value"))
    ring = F.transform("nodes", lambda k: k - 1)
    elements = rows.where("kind = 'element'").select((F.col("id") - 1).alias("elem_id"), F.when(F.size("nodes") == 3, "tria").otherwise("quad").alias("etype"), ring.alias("nodes"))
    bounds = rows.where("kind in ('open', 'land')").select(F.col("kind").alias("btype"), F.col("a").cast("int").alias("ibtype"), F.col("id").alias("bnd_id"), F.posexplode(ring).alias("seq", "node_id"))
    return nodes, elements, bounds
