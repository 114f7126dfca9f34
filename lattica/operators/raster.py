"""Rasters: level metadata, labels and contrast over pixel tables (row_, col_, value, and channel where there are
several). See chunks for images as arrays and spans for masks as runs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import order_statistics
from .spans import as_spans, boxes, is_spans


@dataclass(frozen=True)
class Level:
    """Metadata of one raster level: world units per pixel, world position of pixel (0, 0), shape, chunk shape."""

    scale: tuple[float, float]
    translation: tuple[float, float] = (0.0, 0.0)
    shape: tuple[int, int] = (0, 0)
    chunk: tuple[int, int] = (256, 256)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """World (minx, miny, maxx, maxy)."""
        (sy, sx), (ty, tx), (h, w) = self.scale, self.translation, self.shape
        return (tx, ty, tx + w * sx, ty + h * sy)

    def chunks(self, rect: tuple[float, float, float, float]) -> tuple[int, int, int, int] | None:
        """(first row, last row, first col, last col) of the chunks that a world rectangle touches; an end on a
        chunk's edge doesn't touch the next chunk. None where there are none."""
        out: list[int] = []
        for axis, ends in ((0, (rect[1], rect[3])), (1, (rect[0], rect[2]))):
            low, high = ((v - self.translation[axis]) / (self.scale[axis] * self.chunk[axis]) for v in ends)
            last = math.ceil(self.shape[axis] / self.chunk[axis]) - 1
            out += [max(0, math.floor(low)), min(last, math.ceil(high) - 1)]
        return (out[0], out[1], out[2], out[3]) if out[0] <= out[1] and out[2] <= out[3] else None

    def coarser(self, steps: int = 1) -> Level:
        """The level `steps` coarser: each step halves the shape, odd ends up."""
        level = self
        for _ in range(steps):
            level = Level((level.scale[0] * 2, level.scale[1] * 2), level.translation, ((level.shape[0] + 1) // 2, (level.shape[1] + 1) // 2), level.chunk)
        return level


def to_world(level: Level, row: str = "row_", col: str = "col_") -> dict[str, Column]:
    """World x and y of a pixel."""
    return {"x": F.lit(level.translation[1]) + F.col(col) * F.lit(level.scale[1]), "y": F.lit(level.translation[0]) + F.col(row) * F.lit(level.scale[0])}


def to_pixel(level: Level, x: str = "x", y: str = "y") -> dict[str, Column]:
    return {"col_": (F.col(x) - F.lit(level.translation[1])) / F.lit(level.scale[1]), "row_": (F.col(y) - F.lit(level.translation[0])) / F.lit(level.scale[0])}


def require_mask(mask: DataFrame) -> None:
    if not ({"row_", "col_", "value"} <= set(mask.columns) or is_spans(mask)):
        raise ValueError("a mask has the columns row_, value, and col_ or c0 and c1")
    if not isinstance(mask.schema["value"].dataType, T.IntegralType):
        raise ValueError("a mask's values must be whole numbers")


def label_boxes(mask: DataFrame) -> DataFrame:
    """Bounding box and pixel count of each label but 0, the background, of a mask of pixels or spans."""
    return boxes(as_spans(mask))


def drop_specks(boxes: DataFrame, least: int = 4) -> DataFrame:
    return boxes.where(F.col("pixel_area") >= least)


def drop_report(boxes: DataFrame, least: int = 4) -> DataFrame:
    """(kept, too_small) counts."""
    return boxes.agg(F.count_if(F.col("pixel_area") >= least).alias("kept"), F.count_if(F.col("pixel_area") < least).alias("too_small"))


def home_block(boxes: DataFrame, step: int, width: int) -> DataFrame:
    """Adds the block that holds the whole object, -1 for one that lies in several."""
    per = math.ceil(width / step)
    block = lambda r, c: F.floor(F.col(r) / step) * per + F.floor(F.col(c) / step)
    return boxes.withColumn("home", F.when(block("row0", "col0") == block("row1", "col1"), block("row0", "col0")).otherwise(-1).cast("long"))


def label_areas(boxes: DataFrame, level: Level) -> DataFrame:
    return boxes.withColumn("area", F.col("pixel_area") * F.lit(abs(level.scale[0] * level.scale[1])))


def contrast(pixels: DataFrame, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """(channel, lo, hi) by linear interpolation between ranks."""
    at = lambda n, p: F.lit(p) * (n - 1)
    ranks = {}
    for name, p in (("lo", low), ("hi", high)):
        ranks[name] = lambda n, p=p: F.floor(at(n, p)) + 1
        ranks[f"{name}_next"] = lambda n, p=p: F.ceil(at(n, p)) + 1
    t = order_statistics(pixels, ["channel"], "value", ranks)
    between = lambda name, p: (F.col(name) + (F.col(f"{name}_next") - F.col(name)) * (at(F.col("n"), p) - F.floor(at(F.col("n"), p)))).alias(name)
    return t.select("channel", between("lo", low), between("hi", high))


def sampled_contrast(pixels: DataFrame, position: Column, stride: int, low: float = 0.01, high: float = 0.005) -> DataFrame:
    """(channel, lo, hi) by nearest rank on each stride-th pixel; hi = lo + 1 where they are equal."""
    rank = lambda n, p: F.greatest(F.lit(1), F.ceil(n * F.lit(p)))
    t = order_statistics(pixels.where(F.pmod(position, F.lit(stride)) == 0), ["channel"], "value", {"lo": lambda n: rank(n, low), "hi": lambda n: n + 1 - rank(n, high)})
    kind = pixels.schema["value"].dataType
    return t.select("channel", F.col("lo").cast(kind).alias("lo"), F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).cast(kind).alias("hi"))


def channel_maximum(pixels: DataFrame) -> DataFrame:
    """(channel, top): the greatest value, 1 at least."""
    return pixels.groupBy("channel").agg(F.greatest(F.lit(1), F.max("value")).alias("top"))


def test_card(spark, size: int) -> DataFrame:
    """A structured image of size x size pixels: a checkerboard with a ripple."""
    t = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("row_"), (F.col("id") % size).cast("int").alias("col_"))
    return t.select("row_", "col_", card_value(F.col("row_"), F.col("col_")).alias("value"))


def card_value(row: Column, col: Column) -> Column:
    square = F.pmod(F.floor(row / 64) + F.floor(col / 64), F.lit(2)) * 20000
    ripple = (F.sin(row / 37.0) + F.cos(col / 53.0) + 2) * 5000
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.floor(F.round(square + ripple, 6)))).cast("int")
