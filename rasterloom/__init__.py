"""Raster analytics and table processing on Spark DataFrames."""
