"""Polygon tables: rings in long form (object_id, vertex_no, x, y) and one row per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.grid import Grid, with_cells, with_hilbert, with_tiles
from lattica.sources import order as files

from .spans import spread

#: Known names of the id, x and y columns of a boundary table, in order of preference (fixed values).
ALIASES = {"object_id": ("cell_id", "object_id", "label_id", "label", "id"), "x": ("vertex_x", "x", "X"), "y": ("vertex_y", "y", "Y")}


def pick_columns(columns: list[str], named: dict[str, str] | None = None) -> dict[str, str]:
    """Which of a boundary table's columns are object_id, x and y: as named, else the first known alias."""
    out = {}
    for what, aliases in ALIASES.items():
        wanted = (named or {}).get(what)
        found = [wanted] if wanted else [a for a in aliases if a in columns]
        if not found or found[0] not in columns:
            raise ValueError(f"no column for {what}: looked for {', '.join(aliases) if not wanted else wanted}; found {', '.join(columns)}")
        out[what] = found[0]
    return out


def numbered(rows: DataFrame, order: list[str | Column], by: str = "object_id") -> DataFrame:
    """Adds vertex_no from 0 in the given order within each object, so interleaved rows do no harm."""
    return rows.withColumn("vertex_no", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def load_boundaries(df: DataFrame, order: list[str | Column] | None = None, named: dict[str, str] | None = None) -> DataFrame:
    """Open rings (object_id, vertex_no, x, y) of a boundary table, one row per vertex, in the given order, or as
    the rows stand in the table's files, one after the other."""
    picked = pick_columns(df.columns, named)
    df, order = (df, order) if order else files.placed(df)
    kept = {"object_id": F.col(picked["object_id"]), "x": F.col(picked["x"]).cast("double"), "y": F.col(picked["y"]).cast("double")}
    # A column of the order that is one of these as it is goes along once.
    same = {picked[c]: c for c in kept if c == "object_id" or df.schema[picked[c]].dataType.simpleString() == "double"}
    names = [same[o] if isinstance(o, str) and o in same else f"_o{i}" for i, o in enumerate(order)]
    more = {n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order) if n not in kept}
    rows = df.select(*[c.alias(n) for n, c in (kept | more).items()])
    return opened(numbered(spread(rows, "object_id"), names), names)


def opened(vertices: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Drops the last vertex of a ring of 4 or more that repeats the first. order: columns that sort a ring as vertex_no
    does, by which it is sorted already."""
    whole = Window.partitionBy("object_id")
    by = whole.orderBy(*(order or ["vertex_no"])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = vertices.withColumns({"_n": F.count("*").over(whole), "_same": (F.first("x").over(by) == F.last("x").over(by)) & (F.first("y").over(by) == F.last("y").over(by)), "_last": F.max("vertex_no").over(whole)})
    return t.where(~((F.col("_n") >= 4) & F.col("_same") & (F.col("vertex_no") == F.col("_last")))).select("object_id", "vertex_no", "x", "y")


def edges(vertices: DataFrame) -> DataFrame:
    """Adds the next vertex of the ring, the first after the last: x2, y2."""
    order = Window.partitionBy("object_id").orderBy("vertex_no")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.withColumns({f"{c}2": F.coalesce(F.lead(c).over(order), F.first(c).over(all_)) for c in ("x", "y")})


def summaries(vertices: DataFrame) -> DataFrame:
    """One row per object: vertex count, centroid (mean of the vertices), area (shoelace, absolute)."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return edges(vertices).groupBy("object_id").agg(F.count("*").alias("n_vertices"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.abs(F.sum(cross)) / 2).alias("area"))


def rings(vertices: DataFrame) -> DataFrame:
    """(object_id, ring): nested open rings in vertex order."""
    return vertices.groupBy("object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vertex_no", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


def closed(ring: str | Column = "ring") -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def flat_rings(nested: DataFrame) -> DataFrame:
    """(object_id, vertex_no, x, y) of nested rings."""
    return nested.select("object_id", F.posexplode("ring").alias("vertex_no", "v")).select("object_id", "vertex_no", "v.x", "v.y")


def placed(objects: DataFrame, grid: Grid) -> DataFrame:
    """Adds the tile and Hilbert index of each object's centroid (cx, cy); a polygon belongs to that tile only."""
    return with_hilbert(with_tiles(with_cells(objects, grid, "cx", "cy"), grid))


def dense_ids(objects: DataFrame, bits: int = 12, order: int = 16) -> DataFrame:
    """Adds cell_id from 0: the rank by (hilbert, object_id). Objects are numbered inside buckets of leading
    Hilbert bits; a running count over the small bucket table says where each bucket begins."""
    t = objects.withColumn("_bucket", F.shiftright("hilbert", 2 * order - bits))
    starts = t.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("hilbert", "object_id")) - 1
    return t.withColumn("_i", inside).join(starts, "_bucket").withColumn("cell_id", F.col("_i") + F.col("_start")).drop("_bucket", "_i", "_start")


def offsets(objects: DataFrame, count: str = "n_vertices", bits: int = 12) -> DataFrame:
    """Adds `offset`, the running sum of a count over earlier cell_ids, by blocks of cell_ids."""
    t = objects.withColumn("_block", F.shiftright("cell_id", bits))
    starts = t.groupBy("_block").agg(F.sum(count).alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).drop("_n")
    inner = F.coalesce(F.sum(count).over(Window.partitionBy("_block").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_i", inner).join(starts, "_block").withColumn("offset", F.col("_i") + F.col("_start")).drop("_block", "_i", "_start")


def key_runs(rows: DataFrame, key: str, order: list[str], within: str) -> DataFrame:
    """Numbers runs of equal consecutive keys inside `within`, in the given order: run from 1."""
    w = Window.partitionBy(within).orderBy(*order)
    changed = (~F.lag(key).over(w).eqNullSafe(F.col(key))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def contiguous(rows: DataFrame, key: str, order: list[str], within: str) -> DataFrame:
    """(within, n_keys, n_runs, contiguous): whether each key is one run."""
    runs = key_runs(rows, key, order, within)
    return runs.groupBy(within).agg(F.countDistinct(key).alias("n_keys"), F.max("run").cast("long").alias("n_runs")).withColumn("contiguous", F.col("n_keys") == F.col("n_runs"))


def tile_indices(objects: DataFrame, triangles: str = "triangles") -> DataFrame:
    """Triangle indices counted from the tile's first vertex instead of the object's."""
    before = Window.partitionBy("tile_row", "tile_col").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    t = objects.withColumn("vertex_offset", F.coalesce(F.sum("n_vertices").over(before), F.lit(0)))
    return t.withColumn(triangles, F.transform(triangles, lambda i: (i + F.col("vertex_offset")).cast("int")))
