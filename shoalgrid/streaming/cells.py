"""Streams of depth readings: smallest value of a cell, and windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import checkpoint_folder


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def cell_minimum(stream: DataFrame, width: int) -> DataFrame:
    """(col, low, n): running minimum and count for each cell; state is one row a cell."""
    return stream.groupBy((F.col("user_id") % width).alias("col")).agg(F.min("value").alias("low"), F.count("*").alias("n"))


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) by tumbling hours; windows close when the watermark passes them."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def _drained(stream: DataFrame, keys: list[str] | None = None, mode: str | None = None) -> DataFrame:
    """All that a bounded stream gives, from files in the shared folder that its batches wrote.

    With ``keys`` the stream runs in update mode (or ``mode``): of the rows of a
    key that of the last batch counts. Without, rows are appended as the
    watermark closes them; what is open at the end of the input isn't given.
    """
    spark = stream.sparkSession
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode or ("update" if keys else "append")).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{folder}/rows")
    if not keys:
        return got.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def minimum_by_cell(spark: SparkSession, path: str, width: int) -> DataFrame:
    return _drained(cell_minimum(_stream(spark, path), width), ["col"])


def windowed_counts(spark: SparkSession, path: str) -> DataFrame:
    return _drained(hourly(_stream(spark, path)), ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n): runs of a user's events less than ``gap`` apart."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def session_counts(spark: SparkSession, path: str) -> DataFrame:
    # sessions know no update mode; the complete one gives those still open at the end of a bounded stream, too, and holds all of them
    return _drained(sessions(_stream(spark, path)), ["user_id", "start"], "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
