"""Outlines of labelled objects: open pixel sides linked to chains inside blocks, and chains to rings.

Contour at level 0.5 between pixel centres: each side of a pixel whose neighbour has another label gives a half-way
point. The side after a side, with the object on the right, is the next one of the same pixel where the pixel
ahead has another label, else the same one of the pixel ahead, or one of the pixel across the corner where
that has the label too. A side's number is (row * 2**30 + col) * 4 + side, so it says where it is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import as_spans, grouped, ragged, spread

#: Side of the blocks in which sides are linked.
STEP = 256
#: Steps to the neighbours of a pixel in the order of its sides: top, right, bottom, left.
SIDES = ((-1, 0), (0, 1), (1, 0), (0, -1))
CHAIN = "label long, start long, next long, cross double, sides array<long>"


def ordered(after: np.ndarray):
    """Paths and rings of a partial permutation (-1: no successor): (order, where each begins, which are rings).

    By pointer doubling, a few array operations a round. A path begins at what nothing leads to, a ring at its
    least number; paths and rings come by the number they begin with."""
    n = len(after)
    before = np.arange(n)
    led = after >= 0
    before[after[led]] = np.flatnonzero(led)
    free = np.ones(n, bool)
    free[after[led]] = False  # begins a path
    least, back = np.arange(n), before.copy()
    for _ in range(max(1, n.bit_length())):
        least, back = np.minimum(least, least[back]), back[back]
    ring = ~free[back]
    first = free | (ring & (least == np.arange(n)))
    before[first] = np.flatnonzero(first)
    steps, back = (~first).astype(np.int64), before
    for _ in range(max(1, n.bit_length())):
        steps, back = steps + steps[back], back[back]
    order = np.lexsort((steps, back))
    begins = np.flatnonzero(steps[order] == 0)
    return order, begins, ring[order[begins]]


def crosses(x, y, x2, y2):
    return x * y2 - x2 * y


def side_points(key: np.ndarray):
    """(x, y) of sides by their numbers."""
    side, col, row = key & 3, (key >> 2) & ((1 << 30) - 1), key >> 32
    return col + np.array(SIDES)[side, 1] / 2, row + np.array(SIDES)[side, 0] / 2


def numbered_chains(mask: DataFrame, step: int = STEP) -> DataFrame:
    """(label, start, next, cross, sides): the sides of each block of a mask, pixels or spans, in chains. Sides go by
    their numbers, a quarter of what their points take.

    A chain is a way inside one block: start is its first side, next the first side after it, and null where the
    chain is a ring. Chains end with the block, and before their least side. cross sums x1 * y2 - x2 * y1 from each point to the one after, the one in
    the next block included. Pixels and spans go to their block once, and to the next where they lie at an
    edge; rows and columns count from 0."""
    t = as_spans(mask).where("value <> 0").select(*[F.col(c).cast("long").alias(c) for c in ("row_", "c0", "c1", "value")])
    at = lambda c: F.floor(c / step)
    t = t.withColumn("_r", F.explode(F.array_distinct(F.array(*[at(F.col("row_") + k) for k in (-1, 0, 1)]))))
    t = t.withColumn("_c", F.explode(F.sequence(at(F.col("c0") - 1), at(F.col("c1") + 1))))
    t = t.select(((F.col("_r") + 1) * (1 << 31) + F.col("_c") + 1).alias("block"), "row_", F.greatest("c0", F.col("_c") * step - 1).alias("c0"), F.least("c1", F.col("_c") * step + step).alias("c1"), "value")
    t = spread(t.where("c0 <= c1"), "block").sortWithinPartitions("block")

    def chains_of(block: int, rows, c0, c1, values):
        r0, l0 = ((block >> 31) - 1) * step, ((block & ((1 << 31) - 1)) - 1) * step
        wide = c1 - c0 + 1
        a = np.zeros((step + 2, step + 2), np.int64)
        a[np.repeat(rows - r0 + 1, wide), ragged(c0 - l0 + 1, wide)] = np.repeat(values, wide)
        core = a[1:-1, 1:-1]
        open_ = np.stack([(a[1 + r : step + 1 + r, 1 + c : step + 1 + c] != core) & (core != 0) for r, c in SIDES], 2)
        y, x, s = np.nonzero(open_)
        label, out, ahead = core[y, x], np.array(SIDES)[s], np.array(SIDES)[(s + 1) % 4]
        same = lambda by: a[y + 1 + by[:, 0], x + 1 + by[:, 1]] == label
        on = same(ahead)
        corner = on & same(ahead + out)
        ny = y + np.where(on, ahead[:, 0], 0) + np.where(corner, out[:, 0], 0)
        nx = x + np.where(on, ahead[:, 1], 0) + np.where(corner, out[:, 1], 0)
        ns = np.where(corner, (s + 3) % 4, np.where(on, s, (s + 1) % 4))
        number = np.full((step, step, 4), -1)
        number[y, x, s] = np.arange(len(y))
        inside = (ny >= 0) & (ny < step) & (nx >= 0) & (nx < step)
        after = np.where(inside, number[np.clip(ny, 0, step - 1), np.clip(nx, 0, step - 1), ns], -1)
        order, begins, ring = ordered(after)
        key = (((y + r0) << 30) + x + l0) * 4 + s
        if len(begins):  # a chain is cut at its least side too, so that the least side of a ring begins a chain
            least = np.minimum.reduceat(key[order], begins)
            rings, begins = begins[ring], np.union1d(begins, np.flatnonzero(key[order] == np.repeat(least, np.diff(np.append(begins, len(order))))))
            ring = np.isin(begins, rings)
        ends = np.append(begins[1:], len(order))
        onto = (((ny + r0) << 30) + nx + l0) * 4 + ns
        px, py = side_points(key[order])
        cross = np.add.reduceat(crosses(px, py, *side_points(onto[order])), begins) if len(begins) else np.zeros(0)
        first, last = order[begins], order[ends - 1] if len(begins) else order[:0]
        return label[first], key[first], onto[last], ring, cross, key[order], ends - begins

    def run(part: pa.Table) -> pa.RecordBatch:
        block, rows, c0, c1, values = (part[c].to_numpy() for c in ("block", "row_", "c0", "c1", "value"))
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        found = [chains_of(int(block[i]), rows[i:j], c0[i:j], c1[i:j], values[i:j]) for i, j in zip(first, np.append(first[1:], len(block)))]
        label, start, onto, ring, cross, sides, n = (np.concatenate(c) for c in zip(*found))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(sides))
        return pa.RecordBatch.from_arrays([pa.array(label), pa.array(start), pa.array(onto, mask=ring), pa.array(cross), lists], names=["label", "start", "next", "cross", "sides"])

    return t.mapInArrow(lambda batches: grouped(batches, "block", run), CHAIN)


def side_point(side: Column) -> Column:
    """side_points of a column."""
    half = [F.element_at(F.array(*[F.lit(k[i] / 2) for k in SIDES]), side.bitwiseAND(3).cast("int") + 1) for i in (0, 1)]
    return F.struct((F.shiftright(side, 2).bitwiseAND((1 << 30) - 1) + half[1]).alias("x"), (F.shiftright(side, 32) + half[0]).alias("y"))


def side_chains(mask: DataFrame, step: int = STEP) -> DataFrame:
    """(label, start, next, cross, points): numbered_chains with the sides' points."""
    return numbered_chains(mask, step).select("label", "start", "next", "cross", F.transform("sides", side_point).alias("points"))


def linked(part: pa.Table):
    """The rings of a part's chains, which must come with all chains of their labels: (label, x, y, lengths, whether
    they turn as an outer outline does), each from its least side on, by label and least side."""
    label, start, cross = (part[c].to_numpy() for c in ("label", "start", "cross"))
    sides = part["sides"].combine_chunks() if isinstance(part["sides"], pa.ChunkedArray) else part["sides"]
    lens, ptr = np.diff(sides.offsets.to_numpy()), sides.offsets.to_numpy()[:-1] - sides.offsets[0].as_py()
    x, y = side_points(sides.flatten().to_numpy())
    order = np.lexsort((start, label))
    label, start, cross, lens, ptr = label[order], start[order], cross[order], lens[order], ptr[order]
    closed = part["next"].is_null().to_numpy()[order]
    onto = np.where(closed, start, part["next"].fill_null(0).to_numpy()[order])
    # A side has one label, so its number alone finds the chain that it starts.
    by = np.argsort(start)
    way, begins, _ = ordered(by[np.searchsorted(start[by], onto)])
    take = ragged(ptr[way], lens[way])
    sums = lambda v: np.add.reduceat(v[way], begins) if len(begins) else v[:0]
    return label[way[begins]], x[take], y[take], sums(lens), sums(cross) > 0


def rounds(t: DataFrame, path: str, step, changed) -> DataFrame:
    """step over and over, each result written under path and read again, until no row is `changed`."""
    spark, n = t.sparkSession, 0
    while True:
        t.write.parquet(f"{path}/{n}")
        t = spark.read.parquet(f"{path}/{n}")
        if t.where(changed).isEmpty():
            return t
        t, n = step(t), n + 1


def outlines(mask: DataFrame, path: str, step: int = STEP) -> DataFrame:
    """(object_id, vertex_no, x, y): the longest outer outline of each object of a mask, however wide, in long form.

    Sides are linked to chains in blocks, and chains are ranked across blocks by pointer doubling over tables
    written under path: first each learns the least side of its ring, then how many points come before it from
    there on. Rounds are the logarithm of the chains of a ring, and no object meets in one task. Of outlines
    of one length the one with the least side stays; it begins there, as polygons_from_labels has it."""
    spark = mask.sparkSession
    numbered_chains(mask, step).write.parquet(f"{path}/chains")
    chains = spark.read.parquet(f"{path}/chains").withColumn("n", F.size("sides").cast("long"))
    # A chain that is a ring by itself has its place already.
    whole, chains = chains.where("next is null").withColumns({"least": F.col("start"), "offset": F.lit(0).cast("long")}), chains.where("next is not null")
    t = chains.select(F.col("start").alias("node"), F.coalesce("next", "start").alias("to"))
    t = t.select("node", "to", F.least("node", "to").alias("least"), F.lit(True).alias("moved"))

    def further(t):
        other = t.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        return t.join(other, "to").select("node", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved"))

    ring = rounds(t, f"{path}/least", further, "moved").select("node", "least")
    # Who comes before a chain, and how many points that has; nothing before the chain of the least side.
    came = chains.select(F.coalesce("next", "start").alias("node"), F.col("start").alias("back"), "n")
    t = came.join(ring, "node").select("node", F.when(F.col("node") != F.col("least"), F.col("back")).alias("back"), F.when(F.col("node") != F.col("least"), F.col("n")).otherwise(0).alias("offset"))

    def before(t):
        other = t.select(F.col("node").alias("back"), F.col("back").alias("back2"), F.col("offset").alias("offset2"))
        return t.join(other, "back", "left").select("node", F.col("back2").alias("back"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset"))

    place = rounds(t, f"{path}/place", before, "back is not null").select("node", "offset").join(ring, "node")
    chains = chains.withColumnRenamed("start", "node").join(place, "node").unionByName(whole.withColumnRenamed("start", "node"))
    sizes = chains.groupBy("label", "least").agg(F.sum("n").alias("n"), F.sum("cross").alias("cross")).where("cross > 0")
    best = sizes.groupBy("label").agg(F.min_by("least", F.struct((-F.col("n")).alias("n"), "least")).alias("least"))
    kept = chains.join(best, ["label", "least"], "left_semi")
    t = kept.select(F.col("label").alias("object_id"), "offset", F.posexplode("sides").alias("i", "s"))
    return t.select("object_id", (F.col("offset") + F.col("i")).alias("vertex_no"), side_point(F.col("s")).alias("p")).select("object_id", "vertex_no", "p.x", "p.y")
