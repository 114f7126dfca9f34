"""Label masks as spans: (row_, c0, c1, value), pixels c0 to c1 of a row with one label.

Spans of a mask never overlap; two with one label may touch. An object costs rows in proportion to its height, not
its pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and columns of the blocks in which overlaps are settled.
ROWS, COLS = 64, 1024


def is_spans(df: DataFrame) -> bool:
    return {"row_", "c0", "c1", "value"} <= set(df.columns)


def as_spans(mask: DataFrame) -> DataFrame:
    """A mask as spans: a pixel table's pixels are spans of one, so nothing is shuffled."""
    return mask if is_spans(mask) else mask.select("row_", F.col("col_").alias("c0"), F.col("col_").alias("c1"), "value")


def to_spans(mask: DataFrame) -> DataFrame:
    """The longest spans of a mask of either form, background left out."""
    t = spread(as_spans(mask).where("value <> 0"), "row_", "value")
    w = Window.partitionBy("row_", "value").orderBy("c0")
    new = F.coalesce(F.col("c0") > F.lag("c1").over(w) + 1, F.lit(True)).cast("int")
    t = t.withColumn("_n", new).withColumn("_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("row_", "value", "_n").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).select("row_", "c0", "c1", "value")


def pixels(spans: DataFrame) -> DataFrame:
    """(row_, col_, value) of spans."""
    return spans.select("row_", F.explode(F.sequence("c0", "c1")).alias("col_"), "value")


def boxes(spans: DataFrame) -> DataFrame:
    """Bounding box and pixel count of each label but 0."""
    t = spans.where("value <> 0").groupBy(F.col("value").alias("label"))
    return t.agg(F.min("row_").alias("row0"), F.min("c0").alias("col0"), F.max("row_").alias("row1"), F.max("c1").alias("col1"), F.sum(F.col("c1") - F.col("c0") + 1).cast("long").alias("pixel_area"))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + len), one after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)


def grouped(batches, key: str, done):
    """Batches of rows sorted by key, cut so that a key's rows come whole: done(table) for each part."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if not len(at):
            continue
        cut = int(np.searchsorted(at, at[-1], "left"))  # the last key may go on in the next batch
        if cut:
            yield done(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
            rest = []
        elif rest and rest[-1].column(batch.schema.get_field_index(key))[-1].as_py() != at[0]:
            yield done(pa.Table.from_batches(rest).combine_chunks())
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield done(pa.Table.from_batches(rest).combine_chunks())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df with equal keys in one task, in as many tasks as Spark's setting names: joined by their compressed size, as
    Spark would otherwise do, few tasks hold all rows until each reads tens of megabytes of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def thinned(row, c0, c1, value) -> np.ndarray:
    """Which of some spans stay of equal extents: the one of highest value."""
    order = np.lexsort((value, c1, c0, row))
    return order[np.append(np.any([v[order][1:] != v[order][:-1] for v in (row, c0, c1)], 0), True)[: len(order)]]


def topmost(drawn: DataFrame) -> DataFrame:
    """Spans of a mask from drawn(row_, c0, c1, value) that overlap: the highest value stays at each place.

    Spans are cut at the edges of blocks, and their places in a block are packed into one number. Equal places are
    thinned out to their highest value as a block's rows arrive, so that only different ones meet; then in a block
    their ends cut the rows into pieces, and values are laid on these in ascending order, a sweep of all rows at once. Pieces of one
    label that touch become one span."""
    t = drawn.select(*[F.col(c).cast("long").alias(c) for c in ("row_", "c0", "c1", "value")]).where("c0 <= c1")
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") / COLS), F.floor(F.col("c1") / COLS))))
    left, high = F.col("_b") * COLS, F.floor(F.col("row_") / ROWS)
    place = ((F.col("row_") - high * ROWS) * COLS + F.greatest("c0", left) - left) * COLS + F.least("c1", left + COLS - 1) - left
    t = t.select((high * (1 << 31) + F.col("_b") + (1 << 30)).alias("block"), place.cast("int").alias("place"), "value")
    t = spread(t, "block").groupBy("block", "place").agg(F.max("value").alias("value"))  # in the block's task, which is where its places are

    def settle(part: pa.Table) -> pa.RecordBatch:
        block, place, value = (part[c].to_numpy() for c in ("block", "place", "value"))
        first = np.append(True, block[1:] != block[:-1])
        blocks, width = block[first], COLS + 1  # a column between rows, so that no span goes on in the next one
        line = ((np.cumsum(first) - 1) * ROWS + place // COLS**2) * width
        start, end = line + place // COLS % COLS, line + place % COLS + 1
        ends = np.unique(np.append(start, end))
        begin, stop = np.searchsorted(ends, start), np.searchsorted(ends, end)
        order = np.argsort(value, kind="stable")
        top, there = np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
        at = ragged(begin[order], (stop - begin)[order])
        top[at], there[at] = np.repeat(value[order], (stop - begin)[order]), True  # of equal places the last one stays
        begins = there & np.append(True, ~there[:-1] | (top[1:] != top[:-1]))
        stops = there & np.append(~there[1:] | (top[1:] != top[:-1]), True)
        a, b = ends[begins], np.append(ends[1:], ends[-1])[stops]
        of = blocks[a // width // ROWS]
        row, col = (of >> 31) * ROWS + a // width % ROWS, ((of & ((1 << 31) - 1)) - (1 << 30)) * COLS
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (row, a % width + col, (b - 1) % width + col, top[begins])], names=["row_", "c0", "c1", "value"])

    return t.sortWithinPartitions("block").mapInArrow(lambda batches: grouped(batches, "block", settle), "row_ long, c0 long, c1 long, value long")
