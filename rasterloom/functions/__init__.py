"""functions of the raster analytics engine."""
