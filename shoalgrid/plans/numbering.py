"""Dense numbers and iteration without a single-task window."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges into which rows are split to be numbered.
RANGES = 256


def checkpoint_folder(spark: SparkSession) -> None:
    """Set the shared folder of ``spark.checkpoint.dir``; a fresh local one only where that is unset and Spark itself is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="shoalgrid-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: the number of a row's range, of ``RANGES`` between approximate quantiles of ``key``."""
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(key).cast("double"), [i / RANGES for i in range(1, RANGES)]).alias("q")).first().q or []))
    cuts = [c for c in cuts if math.isfinite(c)]

    def below(lo: int, hi: int) -> str:
        """How many of cuts[lo:hi] are smaller, and lo more: by halves, eight comparisons a row."""
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(double(`{key}`) <= {cuts[mid]!r}D, {below(lo, mid)}, {below(mid + 1, hi)})"

    return df.withColumn(name, F.expr(below(0, len(cuts))))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``keys`` (distinct in all of them).

    Rows are split at approximate quantiles of the first key and numbered within
    ranges; a table with one row a range adds the offsets.
    """
    rows = ranged(df, keys[0], "_part")
    sizes = rows.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # RANGES rows at most
    within = Window.partitionBy("_part").orderBy(*keys)
    rows = rows.withColumn("_nth", F.row_number().over(within)).join(F.broadcast(offsets), "_part")
    return rows.withColumn(name, (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_part", "_nth", "_before")
