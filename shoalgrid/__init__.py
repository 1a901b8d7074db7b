"""Mesh and raster analytics on Spark DataFrames."""
