"""Rasters as stored tables: bands of cells and one row of metadata.

A raster is a folder with ``cells`` (band, row, col, z; Parquet, by band) and
``meta`` (x0, y0, dx, dy, n_rows, n_cols, crs, dtype, nodata, tags). x0, y0 is
the outer corner of cell (0, 0); rows go down where dy is negative. ESRI ASCII
grids are read and written as text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DTYPES = ("float32", "float64", "int16", "int32", "uint8")


@dataclass(frozen=True)
class Meta:
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    n_rows: int = 0
    n_cols: int = 0
    crs: str | None = None
    dtype: str = "float64"
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype is one of {', '.join(DTYPES)}")
        if self.dx == 0 or self.dy == 0:
            raise ValueError("cells have a width and a height")
        if self.crs is not None and not self.crs.upper().startswith("EPSG:"):
            raise ValueError("crs is null or EPSG:n")

    @property
    def transform(self) -> tuple[float, ...]:
        """(dx, 0, x0, 0, dy, y0): from (col, row) to (x, y)."""
        return (self.dx, 0.0, self.x0, 0.0, self.dy, self.y0)

    def window_transform(self, row: int, col: int) -> tuple[float, ...]:
        return (self.dx, 0.0, self.x0 + col * self.dx, 0.0, self.dy, self.y0 + row * self.dy)


@dataclass(frozen=True)
class Raster:
    cells: DataFrame
    meta: Meta

    def band(self, k: int = 1) -> DataFrame:
        return self.cells.where(F.col("band") == k).drop("band")

    def bands(self) -> list[int]:
        return sorted(r.band for r in self.cells.select("band").distinct().collect())  # bands are few

    def xy(self) -> DataFrame:
        """Cells with the place of their centres."""
        m = self.meta
        return self.cells.select("*", (F.lit(m.x0) + (F.col("col") + 0.5) * m.dx).alias("x"), (F.lit(m.y0) + (F.col("row") + 0.5) * m.dy).alias("y"))


def from_numpy(spark: SparkSession, array, meta: Meta | None = None) -> Raster:
    """A raster of a (rows, cols) or (bands, rows, cols) array; the nodata value becomes null."""
    import numpy as np
    import pyarrow as pa

    a = np.asarray(array)
    a = a[None] if a.ndim == 2 else a
    meta = replace(meta or Meta(dtype=a.dtype.name if a.dtype.name in DTYPES else "float64"), n_rows=a.shape[1], n_cols=a.shape[2])
    band, row, col = (x.reshape(-1) for x in np.indices(a.shape))
    cells = spark.createDataFrame(pa.table({"band": (band + 1).astype(np.int32), "row": row, "col": col, "z": a.reshape(-1).astype(np.float64)}))
    return Raster(masked(cells, meta.nodata), meta)


def masked(cells: DataFrame, nodata: float | None) -> DataFrame:
    """z is null where it is the nodata value or not a number."""
    gone = F.isnan("z") if nodata is None else F.isnan("z") | (F.col("z") == nodata)
    return cells.withColumn("z", F.when(~gone, F.col("z")))


def save(raster: Raster, path: str) -> str:
    """Write a raster; cells sorted by place within files, so that windows skip row groups."""
    m = raster.meta
    raster.cells.repartition("band", F.floor(F.col("row") / 1024)).sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("band").parquet(f"{path}/cells")
    schema = "x0 double, y0 double, dx double, dy double, n_rows long, n_cols long, crs string, dtype string, nodata double, tags map<string, string>"
    spark = raster.cells.sparkSession
    spark.createDataFrame([(float(m.x0), float(m.y0), float(m.dx), float(m.dy), m.n_rows, m.n_cols, m.crs, m.dtype, None if m.nodata is None else float(m.nodata), dict(m.tags))], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> Raster:
    r = spark.read.parquet(f"{path}/meta").first()
    cells = spark.read.parquet(f"{path}/cells").select(F.col("band").cast("int").alias("band"), "row", "col", "z")
    return Raster(cells, Meta(r.x0, r.y0, r.dx, r.dy, r.n_rows, r.n_cols, r.crs, r.dtype, r.nodata, dict(r.tags or {})))


def add_band(raster: Raster, cells: DataFrame, tags: dict[str, str] | None = None) -> Raster:
    """One band more, of cells (row, col, z)."""
    k = max(raster.bands(), default=0) + 1
    more = {f"band{k}.{a}": b for a, b in (tags or {}).items()}
    return Raster(raster.cells.unionByName(cells.select(F.lit(k).alias("band"), "row", "col", "z")), replace(raster.meta, tags={**raster.meta.tags, **more}))


def modify(raster: Raster, change: Callable[[DataFrame], DataFrame], band: int = 1) -> Raster:
    """The raster with one band's cells (row, col, z) put through ``change``; raises if that doesn't return such cells."""
    new = change(raster.band(band))
    if sorted(new.columns) != ["col", "row", "z"]:
        raise ValueError("a band's cells have row, col and z")
    return Raster(raster.cells.where(F.col("band") != band).unionByName(new.select(F.lit(band).alias("band"), "row", "col", "z")), raster.meta)


def rewrite(spark: SparkSession, path: str, change: Callable[[Raster], Raster]) -> Raster:
    """Modify a stored raster: the new one is written beside it, and read back from there; the old one stays until it is removed."""
    return load(spark, save(change(load(spark, path)), f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"))


def window(cells: DataFrame, r0: int, c0: int, n_rows: int, n_cols: int) -> DataFrame:
    return cells.where(F.col("row").between(r0, r0 + n_rows - 1) & F.col("col").between(c0, c0 + n_cols - 1))


def window_bounds(windows: DataFrame, meta: Meta) -> DataFrame:
    """Windows (r0, c0, n_rows, n_cols) with their outer bounds x_min, y_min, x_max, y_max."""
    x, y = (lambda c: F.lit(float(meta.x0)) + c * float(meta.dx)), (lambda r: F.lit(float(meta.y0)) + r * float(meta.dy))
    xa, xb = x(F.col("c0")), x(F.col("c0") + F.col("n_cols"))
    ya, yb = y(F.col("r0")), y(F.col("r0") + F.col("n_rows"))
    return windows.select("*", F.least(xa, xb).alias("x_min"), F.least(ya, yb).alias("y_min"), F.greatest(xa, xb).alias("x_max"), F.greatest(ya, yb).alias("y_max"))


def window_of(bounds: tuple[float, float, float, float], meta: Meta) -> tuple[int, int, int, int]:
    """(r0, c0, n_rows, n_cols) of the cells that meet (x_min, y_min, x_max, y_max), within the raster."""
    x0, y0, x1, y1 = bounds
    cols = sorted(((x0 - meta.x0) / meta.dx, (x1 - meta.x0) / meta.dx))
    rows = sorted(((y0 - meta.y0) / meta.dy, (y1 - meta.y0) / meta.dy))
    c0, c1 = max(0, math.floor(cols[0])), min(meta.n_cols, math.ceil(cols[1]))
    r0, r1 = max(0, math.floor(rows[0])), min(meta.n_rows, math.ceil(rows[1]))
    return r0, c0, max(0, r1 - r0), max(0, c1 - c0)


def digest(cells: DataFrame, tile: int = 64) -> DataFrame:
    """(md5) of a band's cells (row, col, z), whatever their order: of the digests of its tiles, by place.

    Tiles are digested side by side; what the last step joins is one digest a tile.
    """
    text = F.concat_ws(",", F.col("row"), F.col("col"), F.when(F.col("z").isNull(), "null").otherwise(F.format_string("%.6f", F.col("z"))))
    tiles = cells.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    tiles = tiles.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", text.alias("t")))), lambda s: s["t"]), ";")).alias("d"))
    return tiles.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tr", "tc", "d"))), lambda s: s["d"]), "")).alias("md5"))


# -- ESRI ASCII grids ------------------------------------------------------------


def ascii_lines(cells: DataFrame, meta: Meta) -> DataFrame:
    """(section, id, line) of an ASCII grid: 0 header, 1 rows; missing cells as the nodata value (-9999 if there is none)."""
    nodata = -9999.0 if meta.nodata is None else float(meta.nodata)
    low = meta.y0 + meta.n_rows * meta.dy if meta.dy < 0 else meta.y0
    head = [f"ncols {meta.n_cols}", f"nrows {meta.n_rows}", f"xllcorner {meta.x0:g}", f"yllcorner {low:g}", f"cellsize {abs(meta.dx):g}", f"NODATA_value {nodata:g}"]
    lines = cells.sparkSession.createDataFrame([(0, i, t) for i, t in enumerate(head)], "section int, id long, line string")
    value = F.struct("col", F.when(F.col("z").isNull(), f"{nodata:.6f}").otherwise(F.format_string("%.6f", F.col("z"))).alias("v"))
    rows = cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda s: s["v"]), " ").alias("line"))
    number = F.col("row") if meta.dy < 0 else F.lit(meta.n_rows - 1) - F.col("row")
    return lines.unionByName(rows.select(F.lit(1).alias("section"), number.cast("long").alias("id"), "line"))


def read_ascii(spark: SparkSession, path: str) -> Raster:
    """A grid file; its lines are split by Spark, and a line's row follows from its place in the file."""
    head = {r.value.split()[0].lower(): float(r.value.split()[1]) for r in spark.read.text(path).limit(6).collect()}
    nodata, size = head.get("nodata_value"), head["cellsize"]
    meta = Meta(head["xllcorner"], head["yllcorner"] + head["nrows"] * size, size, -size, int(head["nrows"]), int(head["ncols"]), nodata=nodata)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parts = lines.groupBy("block").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = parts.withColumn("before", F.coalesce(F.sum("lines").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a split
    rows = lines.join(F.broadcast(before.select("block", "first", "before")), "block").select("value", (F.col("before") + F.col("n") - F.col("first")).alias("line")).where("line >= 6")
    cells = rows.select((F.col("line") - 6).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    return Raster(masked(cells.select(F.lit(1).alias("band"), "row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("z")), nodata), meta)


def sample_windows(meta: Meta, size: int) -> Callable[[SparkSession], DataFrame]:
    """Windows of ``size`` cells a side that tile a raster."""

    def windows(spark: SparkSession) -> DataFrame:
        across, down = -(-meta.n_cols // size), -(-meta.n_rows // size)
        w = spark.range(across * down)
        r0, c0 = F.floor(F.col("id") / across) * size, F.col("id") % across * size
        part: Callable[[Column, int], Column] = lambda a, n: F.least(F.lit(size).cast("long"), F.lit(n) - a)
        return w.select(r0.alias("r0"), c0.alias("c0"), part(r0, meta.n_rows).alias("n_rows"), part(c0, meta.n_cols).alias("n_cols"))

    return windows
