"""A Spark library for tiling, aggregating, joining and summarising large 2-D point, polygon and raster tables."""
