"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh local one only where it is unset and Spark itself is local."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(path)
        return path
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shoalgrid-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        start = 0
        while start < n:
            size = min(step, n - start)
            while size > 1 and batch.slice(start, size).nbytes > 2 * limit:
                size //= 2
            yield batch.slice(start, size)
            start += size


def utf8_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


#: Bytes of an Arrow batch on its way to Python: what a worker and the JVM hold at once beside one row.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of about ``BATCH_BYTES`` for the session, if it still has Spark's default of eight times that."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "64MB", "64m", "67108864"):
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)
