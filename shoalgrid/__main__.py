"""Command line: jobs over parquet tables, run by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import jobs
from .sources import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shoalgrid")
    sub = p.add_subparsers(dest="job", required=True)
    geom = sub.add_parser("geom", help="domain cells of rasters, with a base outside of them")
    size = sub.add_parser("hfun", help="sizes of raster cells")
    for q in (geom, size):
        q.add_argument("cells", help="parquet of raster_id, row, col, z")
        q.add_argument("out")
    geom.add_argument("--zmin", type=float)
    geom.add_argument("--zmax", type=float)
    geom.add_argument("--base", help="parquet of row, col")
    size.add_argument("--hmin", type=float)
    size.add_argument("--hmax", type=float)
    size.add_argument("--constant", nargs=3, type=float, action="append", default=[], metavar=("LOWER", "UPPER", "VALUE"))
    size.add_argument("--contour", nargs=3, type=float, action="append", default=[], metavar=("LEVEL", "RATE", "TARGET"))
    mesh = sub.add_parser("mesh", help="mesh polygons")
    mesh.add_argument("polygons", help="parquet of poly_id, ring, seq, x, y")
    mesh.add_argument("out")
    mesh.add_argument("--size", type=float, required=True)
    dem = sub.add_parser("remesh-by-dem", help="mesh the rings of a mesh anew, sizes from a raster")
    shape = sub.add_parser("remesh-by-shape", help="mesh the rings of a mesh anew, coarser or finer within polygons")
    for q in (dem, shape):
        q.add_argument("mesh", help="folder with parquet of nodes and elements")
        q.add_argument("source", help="parquet of row, col, z; or of poly, ring, seq, x, y")
        q.add_argument("out")
    dem.add_argument("--hmin", type=float, required=True)
    dem.add_argument("--hmax", type=float, required=True)
    dem.add_argument("--constant", nargs=3, type=float, action="append", default=[], metavar=("LOWER", "UPPER", "VALUE"))
    dem.add_argument("--contour", nargs=3, type=float, action="append", default=[], metavar=("LEVEL", "RATE", "TARGET"))
    shape.add_argument("--factor", type=float, required=True)
    conv = sub.add_parser("convert", help="2dm or grd to tables")
    conv.add_argument("path")
    conv.add_argument("out")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("shoalgrid").getOrCreate()
    if a.job == "geom":
        jobs.build_geometry(spark.read.parquet(a.cells), a.zmin, a.zmax, spark.read.parquet(a.base) if a.base else None).write.parquet(a.out)
    elif a.job == "hfun":
        jobs.build_sizes(spark.read.parquet(a.cells), a.hmin, a.hmax, [tuple(c) for c in a.constant], [tuple(c) for c in a.contour]).write.parquet(a.out)
    elif a.job == "mesh":
        nodes, elements = jobs.run_driver(spark.read.parquet(a.polygons), a.size)
        nodes.write.parquet(f"{a.out}/nodes")
        elements.write.parquet(f"{a.out}/elements")
    elif a.job.startswith("remesh"):
        nodes, elements = (spark.read.parquet(f"{a.mesh}/{k}") for k in ("nodes", "elements"))
        source = spark.read.parquet(a.source)
        if a.job == "remesh-by-dem":
            new = jobs.remesh_by_dem(elements, nodes, source, a.hmin, a.hmax, [tuple(c) for c in a.constant], [tuple(c) for c in a.contour])
        else:
            new = jobs.remesh_by_shape(elements, nodes, source, a.factor)
        jobs.write_outputs(*new, a.out)
    else:
        nodes, elements = text.read_sms2dm(spark, a.path) if a.path.endswith("2dm") else text.read_grd(spark, a.path)[:2]
        nodes.write.parquet(f"{a.out}/nodes")
        elements.write.parquet(f"{a.out}/elements")


if __name__ == "__main__":
    main()
