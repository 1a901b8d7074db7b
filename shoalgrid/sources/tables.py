"""Meshes, rasters, points, lines and boxes bound to the driver's tables.

A lattice of width 40: node ``i`` stands at column i % 40, row i // 40. All
coordinates are integers or dyadic fractions, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, x, y, value): value is an elevation from -96 to 100."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"), "p_size")
    return p.select("node_id", (F.col("node_id") % WIDTH).cast("double").alias("x"), F.floor(F.col("node_id") / WIDTH).cast("double").alias("y"), ((F.col("p_size") - 25) * 4).cast("double").alias("value"))


def mesh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(elem_id, etype, nodes) of a mixed mesh: every fifth cell a quadrangle, every seventeenth a hole."""
    from ..operators.mesh import rectangle_elements

    ny = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) // WIDTH + 1
    cell = F.col("cell")
    return rectangle_elements(spark, WIDTH, ny, hole=cell % 17 == 3, quad=cell % 5 == 0)


def raster_cells(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """(row, col, z), row 0 on top; with ``gaps`` every cell whose part size is a multiple of 11 has no data."""
    p = table(spark, sf_dir, "part")
    z = ((F.col("p_size") - 25) * 4).cast("double")
    return p.select(
        F.floor(F.col("p_partkey") / WIDTH).cast("long").alias("row"),
        (F.col("p_partkey") % WIDTH).cast("long").alias("col"),
        (F.when(F.col("p_size") % 11 != 0, z) if gaps else z).alias("z"),
    )


def source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, row, col, z, tie) of three overlapping rasters; a cell may have several values, of which the largest tie counts."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") % 3).cast("int").alias("raster_id"), (F.col("o_orderkey") % 50).cast("long").alias("row"), (F.col("o_custkey") % WIDTH).cast("long").alias("col"),
        F.floor("o_totalprice").cast("long").alias("z"), F.col("o_orderkey").cast("long").alias("tie"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, x, y) of point features."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("fid"), (F.col("s_suppkey") * 7 % WIDTH).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 50).cast("double").alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, seq, x, y): ten lines through the features, seq from 0."""
    f = features(spark, sf_dir)
    return f.select((F.col("fid") % 10).alias("line_id"), F.floor(F.col("fid") / 10).cast("long").alias("seq"), "x", "y")


def boxes(spark: SparkSession, sf_dir: str, shift: float = 0.5) -> DataFrame:
    """(poly_id, x0, y0, x1, y1): 4 x 3 boxes; shifted, so that no node lies on a border."""
    n = table(spark, sf_dir, "nation")
    x, y = F.col("n_nationkey") + F.lit(shift), F.col("n_regionkey") * 3 + F.lit(shift)
    return n.select(F.col("n_nationkey").cast("long").alias("poly_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 4).cast("double").alias("x1"), (y + 3).cast("double").alias("y1"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y) of scattered points."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long").alias("pid"), (F.col("user_id") % WIDTH + 0.25 * (F.col("event_id") % 4)).cast("double").alias("x"), (F.col("event_id") % 50 + F.lit(0.5)).cast("double").alias("y"))
