"""Checks that a table is what an operator expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("value", T.DoubleType())])
ELEMENTS = T.StructType([T.StructField("elem_id", T.LongType()), T.StructField("etype", T.StringType()), T.StructField("nodes", T.ArrayType(T.LongType()))])
CELLS = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("z", T.DoubleType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, cast; ValueError where one is missing. A missing value column is NaN."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "value":
            out.append(F.lit(float("nan")).alias("value"))
        else:
            raise ValueError(f"column {f.name} is missing")
    return df.select(*out)


def mesh(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conforming tables; rows raise where an element has neither 3 nor 4 nodes or its type does not fit."""
    nodes, elements = conform(nodes, NODES), conform(elements, ELEMENTS)
    fits = ((F.size("nodes") == 3) & (F.col("etype") == "tria")) | ((F.size("nodes") == 4) & (F.col("etype") == "quad"))
    checked = F.when(fits, F.col("nodes")).otherwise(F.raise_error(F.concat(F.lit("element "), F.col("elem_id").cast("string"), F.lit(" has a wrong number of nodes"))))
    return nodes, elements.withColumn("nodes", checked)
