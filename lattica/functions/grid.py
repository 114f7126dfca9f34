"""The shared tile grid: quantizing, tiles, Hilbert order, level choice and rectangles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells per axis of the finest grid are 2 ** ORDER; bins per tile and axis are 2 ** BIN_BITS.
ORDER, BIN_BITS = 16, 5


@dataclass(frozen=True)
class Grid:
    """A square grid over the longest axis of the bounds: 2 ** depth tiles per axis."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    depth: int = 4

    @property
    def span(self) -> float:
        return max(self.maxx - self.minx, self.maxy - self.miny)

    def tile_size(self, depth: int | None = None) -> float:
        return self.span / 2 ** (self.depth if depth is None else depth)

    def tile_range(self, rect: tuple[float, float, float, float], depth: int | None = None) -> tuple[int, int, int, int] | None:
        """(first row, last row, first col, last col) of the tiles that a rectangle touches, or None if it
        lies outside the grid or the grid has no span. An end on a tile's edge doesn't touch the next tile."""
        depth = self.depth if depth is None else depth
        size, last = self.tile_size(depth), 2**depth - 1
        x0, y0, x1, y1 = rect
        if size <= 0:
            return None
        low = lambda v, least: max(0, math.floor((v - least) / size))
        high = lambda v, least: min(last, math.ceil((v - least) / size) - 1)
        r0, r1, c0, c1 = low(y0, self.miny), high(y1, self.miny), low(x0, self.minx), high(x1, self.minx)
        return (r0, r1, c0, c1) if r0 <= r1 and c0 <= c1 else None


def choose_depth(bounds: tuple[float, float, float, float], tile_size: float) -> int:
    """The depth, 0 to ORDER, whose tiles are nearest to tile_size in ratio; ties to the even depth."""
    span = max(bounds[2] - bounds[0], bounds[3] - bounds[1])
    return min(max(round(math.log2(max(span / tile_size, 1))), 0), ORDER)


def cell(value: str | Column, least: float, span: float, n: int) -> Column:
    """The grid cell, 0 to n - 1, of a coordinate; values outside go to the edge cells; no span: cell 0."""
    v = F.col(value) if isinstance(value, str) else value
    if not span:
        return F.when(v.isNotNull(), F.lit(0))
    inside = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - F.lit(least)) / F.lit(span) * F.lit(n)))).cast("int")
    return F.when(v.isNotNull(), inside)  # greatest and least pass over nulls


def with_cells(df: DataFrame, grid: Grid, x: str = "x", y: str = "y", order: int = ORDER) -> DataFrame:
    n = 2**order
    return df.withColumns({"gx": cell(x, grid.minx, grid.span, n), "gy": cell(y, grid.miny, grid.span, n)})


def with_tiles(df: DataFrame, grid: Grid, order: int = ORDER) -> DataFrame:
    """Adds tile_row and tile_col from gx, gy."""
    shift = order - grid.depth
    return df.withColumns({"tile_row": F.shiftright("gy", shift), "tile_col": F.shiftright("gx", shift)})


def hilbert_table(bits: int) -> list[int]:
    """One step of the Hilbert walk over `bits` bits of x and y at once: entry [state, x, y] is the index's
    next 2 * bits bits, times 4, plus the next state. A state says whether to swap (1) and to mirror (2)."""
    out = []
    for state in range(4):
        for x in range(1 << bits):
            for y in range(1 << bits):
                swap, mirror, h = state & 1, state >> 1, 0
                for bit in reversed(range(bits)):
                    rx, ry = (x >> bit & 1) ^ mirror, (y >> bit & 1) ^ mirror
                    rx, ry = (ry, rx) if swap else (rx, ry)
                    h = h * 4 + ((3 * rx) ^ ry)
                    if not ry:
                        mirror, swap = mirror ^ rx, swap ^ 1
                out.append(h * 4 + swap + 2 * mirror)
    return out


def with_hilbert(df: DataFrame, order: int = ORDER, x: str = "gx", y: str = "gy", name: str = "hilbert") -> DataFrame:
    """Adds the Hilbert index of a cell, four bits a step by table, so that the expression stays small."""
    kept, t = df.columns, df.withColumn("_p", F.lit(0).cast("long")).withColumn("_h", F.lit(0).cast("long"))
    left = order
    while left:
        bits = left % 4 or 4
        left -= bits
        part = [F.shiftright(F.col(c), left).bitwiseAND((1 << bits) - 1) for c in (x, y)]
        at = F.col("_p").bitwiseAND(3) * (1 << 2 * bits) + part[0] * (1 << bits) + part[1]
        t = t.withColumn("_p", F.get(F.lit(hilbert_table(bits)), at.cast("int")).cast("long")).withColumn("_h", F.col("_h") * (1 << 2 * bits) + F.shiftright("_p", 2))
    return t.select(*kept, F.col("_h").alias(name))


def hilbert_sql(source: str, keep: str, order: int = ORDER, x: str = "gx", y: str = "gy") -> str:
    """The same as DuckDB SQL: common table expressions named h0, h1, ..., the last h<order>."""
    steps = [f"h0 as (select {keep}, {x}::bigint as x_, {y}::bigint as y_, 0::bigint as h from {source})"]
    for i, bit in enumerate(reversed(range(order))):
        side = 1 << bit
        rx, ry = f"(case when x_ & {side} > 0 then 1 else 0 end)", f"(case when y_ & {side} > 0 then 1 else 0 end)"
        inner = f"select {keep}, h + {side * side}::bigint * xor(3 * {rx}, {ry}) as h, {rx} as rx, {ry} as ry, x_ & {side - 1} as lx, y_ & {side - 1} as ly from h{i}"
        flip = f"case when ry = 0 and rx = 1 then {side - 1} - lx else lx end", f"case when ry = 0 and rx = 1 then {side - 1} - ly else ly end"
        steps.append(f"h{i + 1} as (select {keep}, case when ry = 0 then {flip[1]} else {flip[0]} end as x_, case when ry = 0 then {flip[0]} else {flip[1]} end as y_, h from ({inner}))")
    return ", ".join(steps)


def in_rect(tiles: DataFrame, grid: Grid, rect: tuple[float, float, float, float], depth: int | None = None) -> DataFrame:
    """The rows whose tile a rectangle touches: between-filters that reach the scan."""
    found = grid.tile_range(rect, depth)
    if found is None:
        return tiles.where(F.lit(False))
    r0, r1, c0, c1 = found
    return tiles.where(F.col("tile_row").between(r0, r1) & F.col("tile_col").between(c0, c1))


def rect_tiles(tiles: DataFrame, grid: Grid, rects: DataFrame) -> DataFrame:
    """(rect_id, tile_row, tile_col): the written tiles that each of many rectangles(rect_id, x0, y0, x1, y1)
    touches, an intersection of each rectangle's tiles with the tile index."""
    size, last = grid.tile_size(), 2**grid.depth - 1
    if size <= 0:
        return rects.where(F.lit(False)).select("rect_id", F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"))
    low = lambda c, least: F.greatest(F.lit(0), F.floor((F.col(c) - least) / size)).cast("int")
    high = lambda c, least: F.least(F.lit(last), F.ceil((F.col(c) - least) / size) - 1).cast("int")
    t = rects.select("rect_id", low("y0", grid.miny).alias("r0"), high("y1", grid.miny).alias("r1"), low("x0", grid.minx).alias("c0"), high("x1", grid.minx).alias("c1"))
    t = t.where("r0 <= r1 and c0 <= c1").withColumn("tile_row", F.explode(F.sequence("r0", "r1"))).withColumn("tile_col", F.explode(F.sequence("c0", "c1")))
    return t.select("rect_id", "tile_row", "tile_col").join(tiles.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_semi").select("rect_id", "tile_row", "tile_col")


def coarser_tiles(tiles: DataFrame, levels: int) -> DataFrame:
    """The tile index `levels` steps coarser: a coarse tile exists if one of its children does."""
    return tiles.select(F.shiftright("tile_row", levels).alias("tile_row"), F.shiftright("tile_col", levels).alias("tile_col")).distinct()


def choose_level(scales: list[float], world_per_pixel: float) -> int:
    """The coarsest level (scales ascending) that is not coarser than the screen; 0 if all are."""
    return max((i for i, s in enumerate(scales) if s <= world_per_pixel), default=0)
