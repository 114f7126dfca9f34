"""Streams: the tile and level-0 columns are stateless projections, so they also apply to a streaming table of points."""

from pyspark.sql import DataFrame

from lattica.functions.grid import Grid, with_cells, with_hilbert, with_tiles


def tile_stream(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds gx, gy, tile_row, tile_col and hilbert to a batch or streaming table of points(x, y, ...)."""
    return with_hilbert(with_tiles(with_cells(points, grid), grid))
