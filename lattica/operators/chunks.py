"""Rasters as chunks: one row per chunk (channel, chunk_row, chunk_col, row0, col0, height, width, values).

values holds the chunk's pixels by rows, null where there is none; the shape is that of the pixels there are, so
chunks at the image's end are smaller. A pixel costs its value, and kernels work on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("channel", "chunk_row", "chunk_col")
PLACE = "channel {channel}, chunk_row int, chunk_col int, row0 long, col0 long, height int, width int"


def is_chunked(df: DataFrame) -> bool:
    return {*KEYS, "row0", "col0", "height", "width", "values"} <= set(df.columns)


def _lists(arrays: list[np.ndarray], missing: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one list column, nulls where missing."""
    ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.concatenate(missing) if missing else np.zeros(0, bool)).cast(kind))


def _image(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """A chunk's values as an array of doubles, NaN where there is no pixel."""
    values = batch.column("values")[i].values
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.column("height")[i].as_py(), batch.column("width")[i].as_py())


def to_chunks(pixels: DataFrame, chunk: tuple[int, int] = (256, 256)) -> DataFrame:
    """Chunks of pixels(row_, col_, value, and channel, else 0). Of pixels given twice the greatest value stays. A
    chunk's pixels meet once, as many as a chunk has; the values keep their type."""
    h, w = chunk
    t = pixels if "channel" in pixels.columns else pixels.withColumn("channel", F.lit(0))
    kinds = {c: t.schema[c].dataType.simpleString() for c in ("channel", "value")}
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    place = (F.pmod("row_", F.lit(h)) * w + F.pmod("col_", F.lit(w))).cast("int")
    t = t.where(F.col("value").isNotNull()).groupBy("channel", at("row_", h).alias("chunk_row"), at("col_", w).alias("chunk_col")).agg(F.collect_list(F.struct(place.alias("at"), "value")).alias("p"))
    t = t.select(*KEYS, F.col("p.at").alias("at"), F.col("p.value").alias("value"))

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("value").type.value_type
            out, gone, heights, widths = [], [], [], []
            for k in range(batch.num_rows):
                at, value = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("at", "value"))
                order = np.lexsort((value, at))
                at, value = at[order], value[order]
                height, width = int(at[-1] // w) + 1, int((at % w).max()) + 1
                a, none = np.zeros((height, width), value.dtype), np.ones((height, width), bool)
                a[at // w, at % w], none[at // w, at % w] = value, False
                out.append(a.ravel())
                gone.append(none.ravel())
                heights.append(height)
                widths.append(width)
            rows, cols = (pa.array(batch.column(c).to_numpy().astype(np.int64) * n) for c, n in (("chunk_row", h), ("chunk_col", w)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), rows, cols, pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), _lists(out, gone, kind)], names=[*KEYS, "row0", "col0", "height", "width", "values"])

    return t.mapInArrow(run, f"{PLACE.format(**kinds)}, values array<{kinds['value']}>")


def pixels(chunks: DataFrame) -> DataFrame:
    """(channel, row_, col_, value) of chunks, in JVM code."""
    t = chunks.select("channel", "row0", "col0", "width", F.posexplode("values").alias("at", "value")).where(F.col("value").isNotNull())
    return t.select("channel", (F.col("row0") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("row_"), (F.col("col0") + F.col("at") % F.col("width")).cast("int").alias("col_"), "value")


def in_range(chunks: DataFrame, found: tuple[int, int, int, int] | None) -> DataFrame:
    """The chunks of a range (first row, last row, first col, last col): filters that reach the scan."""
    if found is None:
        return chunks.where(F.lit(False))
    return chunks.where(F.col("chunk_row").between(found[0], found[1]) & F.col("chunk_col").between(found[2], found[3]))


def downsample(chunks: DataFrame, chunk: tuple[int, int] = (256, 256), how: str = "mean") -> DataFrame:
    """The next coarser level in chunks of the same size, which must be even: 2 x 2 pixels become one, the mean of
    those there are, or the first of them in row order. A chunk is halved where it is, so a quarter of the
    pixels is shuffled, and four halves at most meet."""
    h, w = chunk
    if h % 2 or w % 2:
        raise ValueError("chunks of an odd size can't be halved")
    kind = chunks.schema["channel"].dataType.simpleString()
    schema = f"{PLACE.format(channel=kind)}, values array<double>"

    def halves(batches):
        for batch in batches:
            out, gone = [], []
            for k in range(batch.num_rows):
                a = _image(batch, k)
                a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), constant_values=np.nan)
                four = a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).transpose(0, 2, 1, 3).reshape(a.shape[0] // 2, -1, 4)
                there = ~np.isnan(four)
                n = there.sum(2)
                if how == "mean":
                    a = np.where(there, four, 0.0).sum(2) / np.maximum(n, 1)
                else:
                    a = np.take_along_axis(four, there.argmax(2)[:, :, None], 2)[:, :, 0]
                out.append(a.ravel())
                gone.append((n == 0).ravel())
            size = lambda c: pa.array((batch.column(c).to_numpy() + 1) // 2, pa.int32())
            half = lambda c: pa.array(batch.column(c).to_numpy() // 2)
            up = lambda c: pa.array(batch.column(c).to_numpy() >> 1, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("channel"), up("chunk_row"), up("chunk_col"), half("row0"), half("col0"), size("height"), size("width"), _lists(out, gone, pa.float64())], names=[*KEYS, "row0", "col0", "height", "width", "values"])

    def together(part: pa.Table) -> pa.Table:
        batch = part.combine_chunks().to_batches()[0]
        row0, col0 = batch.column("chunk_row")[0].as_py() * h, batch.column("chunk_col")[0].as_py() * w
        rows, cols = batch.column("row0").to_numpy() - row0, batch.column("col0").to_numpy() - col0
        a = np.full((int((rows + batch.column("height").to_numpy()).max()), int((cols + batch.column("width").to_numpy()).max())), np.nan)
        for k in range(batch.num_rows):
            part_ = _image(batch, k)
            a[rows[k] : rows[k] + part_.shape[0], cols[k] : cols[k] + part_.shape[1]] = part_
        return pa.table({**{c: batch.column(c).slice(0, 1) for c in KEYS}, "row0": pa.array([row0]), "col0": pa.array([col0]), "height": pa.array([a.shape[0]], pa.int32()), "width": pa.array([a.shape[1]], pa.int32()), "values": _lists([a.ravel()], [np.isnan(a).ravel()], pa.float64())})

    return chunks.mapInArrow(halves, schema).groupBy(*KEYS).applyInArrow(together, schema)


def composite(chunks: DataFrame, channels: DataFrame) -> DataFrame:
    """(chunk_row, chunk_col, row0, col0, height, width, r, g, b): the channels(channel, lo, hi, r, g, b in 0 to 1)
    add up, clamped to 255; r, g and b are arrays by rows, null where no channel has a pixel. The chunks of
    all channels at one place meet."""
    t = chunks.join(channels.select("channel", "lo", "hi", *[F.col(c).alias(f"to_{c}") for c in "rgb"]), "channel")

    def add(part: pa.Table) -> pa.Table:
        batch = part.combine_chunks().to_batches()[0]
        height, width = (int(batch.column(c).to_numpy().max()) for c in ("height", "width"))
        sums, there = np.zeros((3, height, width)), np.zeros((height, width), bool)
        for k in range(batch.num_rows):
            a = _image(batch, k)
            lo, hi = (float(batch.column(c)[k].as_py() or 0) for c in ("lo", "hi"))
            share = np.clip((a - lo) / (hi - lo), 0, 1) if hi != lo else np.where(np.isnan(a), np.nan, 0.0)
            there[: a.shape[0], : a.shape[1]] |= ~np.isnan(a)
            for c, name in enumerate("rgb"):
                sums[c, : a.shape[0], : a.shape[1]] += np.nan_to_num(share) * batch.column(f"to_{name}")[k].as_py()
        light = np.floor(np.minimum(255.0, np.round(sums * 255, 6))).astype(np.int32)
        place = {c: batch.column(c).slice(0, 1) for c in ("chunk_row", "chunk_col", "row0", "col0")}
        return pa.table({**place, "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), **{name: _lists([light[c].ravel()], [~there.ravel()], pa.int32()) for c, name in enumerate("rgb")}})

    schema = "chunk_row int, chunk_col int, row0 long, col0 long, height int, width int, r array<int>, g array<int>, b array<int>"
    return t.groupBy("chunk_row", "chunk_col").applyInArrow(add, schema)


def colours(composited: DataFrame) -> DataFrame:
    """(row_, col_, r, g, b) of a composite's chunks."""
    t = composited.select("row0", "col0", "width", F.posexplode(F.arrays_zip("r", "g", "b")).alias("at", "c")).where(F.col("c.r").isNotNull())
    return t.select((F.col("row0") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("row_"), (F.col("col0") + F.col("at") % F.col("width")).cast("int").alias("col_"), "c.r", "c.g", "c.b")


def chunk_sums(chunks: DataFrame) -> DataFrame:
    """(channel, chunk_row, chunk_col, n, total, top, filled): pixels, sum, greatest value and share of values other
    than 0 of each chunk."""
    there = F.filter("values", lambda v: v.isNotNull())
    t = chunks.select(*KEYS, there.alias("v"))
    kind = chunks.schema["values"].dataType.elementType
    total = F.aggregate("v", F.lit(0).cast(kind), lambda s, v: s + v)
    return t.select(*KEYS, F.size("v").cast("long").alias("n"), total.alias("total"), F.array_max("v").alias("top"), (F.size(F.filter("v", lambda v: v != 0)) / F.size("v")).alias("filled"))
