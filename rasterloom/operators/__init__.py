"""operators of the raster analytics engine."""
