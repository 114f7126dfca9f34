"""Point tables: quality filters, the dense gene table, level-of-detail aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.grid import BIN_BITS, Grid, cell, with_cells, with_hilbert, with_tiles

REQUIRED = ("feature_name", "x_location", "y_location")


def require(df: DataFrame, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}; found {', '.join(df.columns)}")


def load_points(df: DataFrame, min_qv: float | None = 20, genes_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, x, y, *keep) of the good points: qv >= min_qv and is_gene, where those columns exist; a null in
    them drops the row while its filter is on."""
    require(df, REQUIRED, "points")
    if min_qv is not None and "qv" in df.columns:
        df = df.where(F.col("qv") >= min_qv)
    if genes_only and "is_gene" in df.columns:
        df = df.where(F.col("is_gene"))
    return df.select(F.col("feature_name").alias("name"), F.col("x_location").cast("double").alias("x"), F.col("y_location").cast("double").alias("y"), *keep)


def gene_table(points: DataFrame) -> DataFrame:
    """(gene_id, name, count): dense ids from 0 in code-point order of the names that occur. The window
    runs over one row per name, after the aggregation."""
    counts = points.groupBy("name").agg(F.count("*").alias("count"))
    return counts.select((F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("gene_id"), "name", "count")


def encode(points: DataFrame, genes: DataFrame) -> DataFrame:
    """Replaces name by gene_id; the gene table is small, so Spark broadcasts it by its size."""
    return points.join(genes.select("name", "gene_id"), "name").drop("name")


def decode(tiles: DataFrame, genes: DataFrame) -> DataFrame:
    return tiles.join(genes, "gene_id")


def pick_genes(points: DataFrame, genes: list[int] | None) -> DataFrame:
    """None: all; an empty list: none."""
    if genes is None:
        return points
    return points.where(F.col("gene_id").isin(genes)) if genes else points.where(F.lit(False))


def all_but(genes: DataFrame, name: str) -> DataFrame:
    return genes.join(genes.where(F.col("name") == name).select("gene_id"), "gene_id", "left_anti")


def search(genes: DataFrame, query: str) -> DataFrame:
    return genes.where(F.lower("name").contains(query.strip().lower()))


def by_abundance(genes: DataFrame, cap: int | None = None) -> DataFrame:
    """Most frequent first, ties by id; with `cap`, so many rows and the number of the others as `more`."""
    out = genes.orderBy(F.desc("count"), F.asc("gene_id"))
    if cap is None:
        return out
    total = genes.agg(F.count("*").alias("n"))
    return out.limit(cap).crossJoin(total).withColumn("more", F.greatest(F.lit(0), F.col("n") - cap)).drop("n")


def mix_hash(*keys: str | Column, method: str = "xxhash64") -> Column:
    """A reproducible hash that is not correlated with the position."""
    return F.md5(F.concat_ws(":", *keys)) if method == "md5" else F.xxhash64(*keys)


def first_level(points: DataFrame, grid: Grid, draw: Column | None = None) -> DataFrame:
    """Level 1 of points(gene_id, x, y): per bin and gene the exact count, and the point of least hash.
    Its tiles are one step coarser than the grid's, with 2 ** BIN_BITS bins an axis."""
    n = 2 ** max(grid.depth - 1 + BIN_BITS, 0)
    t = points.select("gene_id", "x", "y", cell("y", grid.miny, grid.span, n).alias("by"), cell("x", grid.minx, grid.span, n).alias("bx"), (mix_hash("x", "y") if draw is None else draw).alias("draw"))
    return t.groupBy("by", "bx", "gene_id").agg(F.count("*").alias("count"), F.min(F.struct("draw", "x", "y")).alias("pick"))


def next_level(level: DataFrame) -> DataFrame:
    """The level above: bins of 2 x 2 bins; counts add up, and the least pick of four is the least of all."""
    return level.groupBy(F.shiftright("by", 1).alias("by"), F.shiftright("bx", 1).alias("bx"), "gene_id").agg(F.sum("count").alias("count"), F.min("pick").alias("pick"))


def point_levels(points: DataFrame, grid: Grid, draw: Column | None = None) -> DataFrame:
    """All coarse levels, 1 to the grid's depth, with one schema: level, tile_row, tile_col, gene_id, x, y, count.
    Each level is made from the one below it, so the points are scanned once."""
    out, level = [], None
    for k in range(1, grid.depth + 1):
        level = first_level(points, grid, draw) if level is None else next_level(level)
        out.append(level.select(F.lit(k).alias("level"), F.shiftright("by", BIN_BITS).alias("tile_row"), F.shiftright("bx", BIN_BITS).alias("tile_col"), "gene_id", F.col("pick.x").alias("x"), F.col("pick.y").alias("y"), "count"))
    return reduce(DataFrame.unionByName, out)


def fine_tiles(points: DataFrame, grid: Grid) -> DataFrame:
    """Level 0: each point with its tile and Hilbert index."""
    return with_hilbert(with_tiles(with_cells(points, grid), grid)).withColumns({"level": F.lit(0), "count": F.lit(1).cast("long")})


def gene_runs(tiles: DataFrame) -> DataFrame:
    """The gene index of each tile: (level, tile_row, tile_col, gene_id, n, start), start counting the tile's
    rows of smaller genes."""
    runs = tiles.groupBy("level", "tile_row", "tile_col", "gene_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("level", "tile_row", "tile_col").orderBy("gene_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def tile_maximum(tiles: DataFrame) -> DataFrame:
    """Adds the largest count of each row's tile, from one aggregate per tile (no window over a tile)."""
    top = tiles.groupBy("level", "tile_row", "tile_col").agg(F.max("count").alias("tile_max"))
    return tiles.join(top, ["level", "tile_row", "tile_col"])


def dot_size(tiles: DataFrame, scale: float = 1.0) -> DataFrame:
    """Diameter of a dot: 1.2 at least, and 4.8 more for the largest count of the tile, by square root."""
    return tile_maximum(tiles).withColumn("diameter", (1.2 + 4.8 * F.sqrt(F.col("count") / F.col("tile_max"))) * scale)
