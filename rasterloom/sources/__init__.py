"""sources of the raster analytics engine."""
