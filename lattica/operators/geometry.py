"""Geometry jobs: point-in-polygon join, rasterizing, tracing, simplifying and triangulating rings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outlines import linked, numbered_chains
from .raster import Level
from .spans import as_spans, boxes, grouped, ragged, spread, thinned, topmost

RING = "array<struct<x:double,y:double>>"
#: A row of a ring has so many objects, about; those of a ring of more are dealt to several rows.
IDS = 1024


def slanted(ring: Column) -> Column:
    """The sides (x, y, y2, dx, dy) of a ring but for level ones, which no test counts."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    ends = F.filter(F.arrays_zip(ring.alias("p"), nxt.alias("q")), lambda e: e["p"]["y"] != e["q"]["y"])
    of = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["y"].alias("y2"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))
    return F.transform(ends, lambda e: of(e["p"], e["q"]))


def crossed(sides: Column, px: Column, py: Column) -> Column:
    """Whether (px, py) lies inside the ring of some slanted sides. Even-odd rule, half-open: a side counts if
    (y1 > py) differs from (y2 > py) and it lies right of px."""
    hit = lambda e: ((e["y"] > py) != (e["y2"] > py)) & F.coalesce(px < e["x"] + (py - e["y"]) * e["dx"] / e["dy"], F.lit(False))
    return F.aggregate(sides, F.lit(0), lambda n, e: n + hit(e).cast("int")) % 2 == 1


def inside_ring(ring: Column, px: Column, py: Column) -> Column:
    return crossed(slanted(ring), px, py)


def with_box(objects: DataFrame) -> DataFrame:
    """Adds the bounding box _x0, _y0, _x1, _y1 of each ring."""
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    return objects.withColumns({"_x0": F.array_min(xs), "_y0": F.array_min(ys), "_x1": F.array_max(xs), "_y1": F.array_max(ys)})


def is_box(ring: Column) -> Column:
    """Whether a ring's slanted sides are two upright ones at the ends of its box: then it is its box."""
    ends = [F.get(slanted(ring), i) for i in (0, 1)]
    at = (F.least(*[e["x"] for e in ends]) == F.col("_x0")) & (F.greatest(*[e["x"] for e in ends]) == F.col("_x1"))
    return F.coalesce((F.size(slanted(ring)) == 2) & (ends[0]["dx"] == 0) & (ends[1]["dx"] == 0) & at, F.lit(False))


def with_ring_key(objects: DataFrame) -> DataFrame:
    """(object_id, ring) of the rings with vertices, and _of, a hash of the ring."""
    unknown = F.transform("ring", lambda v: v.isNull().cast("int") * 4 + v["x"].isNull().cast("int") * 2 + v["y"].isNull().cast("int"))  # hashes pass over nulls
    return objects.select("object_id", "ring").where(F.size("ring") > 0).withColumn("_of", F.xxhash64("ring", unknown))


def with_objects(t: DataFrame) -> DataFrame:
    """(ring, _ids) of with_ring_key's table: each different ring with its objects, in rows of about `IDS` at most."""
    crowded = t.groupBy("_of").count().where(F.col("count") > IDS).select("_of", F.ceil(F.col("count") / IDS).alias("_rows"))
    dealt = F.coalesce(F.pmod(F.xxhash64("object_id"), F.col("_rows")), F.lit(0))
    t = t.join(F.broadcast(crowded), "_of", "left").withColumn("_row", dealt)
    return t.groupBy("_of", "ring", "_row").agg(F.collect_list(F.struct("object_id")).alias("_ids")).select("ring", "_ids")


def points_in_rings(points: DataFrame, t: DataFrame, size: float | None = None) -> DataFrame:
    """(point columns, _ids) for each point inside each different ring of with_ring_key's table, with the ring's objects."""
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    size = size or 2 * (with_box(t).agg(F.percentile_approx(side, 0.5)).first()[0] or 0.5)
    sized = lambda t: with_box(t).withColumns({"_k": F.when(side > size, F.ceil(F.log2(side / size))).otherwise(0).cast("int"), "_box": is_box(F.col("ring"))})
    kinds = sized(t).select("_k", "_box").distinct().collect()  # twice as many as powers of two between box sizes
    steps, shapes = sorted({r["_k"] for r in kinds}), sorted({r["_box"] for r in kinds}) or [True]
    cell = lambda c, k: F.floor(c / (F.pow(F.lit(2.0), k) * size)).cast("long")
    rings = sized(with_objects(t)).withColumn("_s", slanted(F.col("ring"))).drop("ring")
    rings = rings.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x0"), F.col("_k")), cell(F.col("_x1"), F.col("_k")))))
    rings = rings.withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0"), F.col("_k")), cell(F.col("_y1"), F.col("_k")))))
    p = points.withColumn("_k", F.explode(F.array(*map(F.lit, steps or [0]))))
    p = p.withColumns({"_cx": cell(F.col("x"), F.col("_k")), "_cy": cell(F.col("y"), F.col("_k"))})
    x, y = F.col("x"), F.col("y")
    box = x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1"))
    within = {True: box & (x < F.col("_x1")) & (y < F.col("_y1")), False: box & crossed(F.col("_s"), x, y)}
    # Boxes and other rings are joined apart, as a test of sides in the condition keeps the join from being compiled.
    of = lambda shape: rings if len(shapes) == 1 else rings.where(F.col("_box") == shape)
    found = [p.join(of(shape), ["_k", "_cx", "_cy"]).where(within[shape]).select(*points.columns, "_ids") for shape in shapes]
    return reduce(DataFrame.unionAll, found)


def points_in_polygons(points: DataFrame, objects: DataFrame, size: float | None = None) -> DataFrame:
    """(point columns, object_id) for each point(x, y) inside each ring of objects(object_id, ring).

    An equi-join on square cells of several sizes: a ring has the size that is the next power of two times
    `size` (twice the median box by default) at or above its box, so it stands in four cells at most; a point
    stands in one cell of each size that occurs. No pair comes twice. The box is tested before the ring. A
    cell of very many points is one that Spark splits, as a plain join of the two follows. A ring that many
    objects have carries their ids and is tested once for them; pairs, whose number can grow with the square of
    the input, are put out where they are found and never shuffled."""
    return points_in_rings(points, with_ring_key(objects), size).select(*points.columns, F.inline("_ids"))


def top_hit(hits: DataFrame, key: list[str]) -> DataFrame:
    """One object per point: the one drawn last, of highest id."""
    return hits.groupBy(*key).agg(F.max("object_id").alias("object_id"))


def crossings(part: pa.Table, width: int, height: int) -> pa.RecordBatch:
    """The spans (row_, c0, c1, value) inside each of a part's rings, whose vertices come whole; of equal
    extents that of the highest id."""
    id_, no, x, y = (part[c].to_numpy() for c in ("object_id", "vertex_no", "x", "y"))
    order = np.lexsort((no, id_))
    id_, x, y = id_[order], x[order], y[order]
    first = np.flatnonzero(np.append(True, id_[1:] != id_[:-1]))
    after = np.arange(1, len(id_) + 1)
    after[np.append(first[1:], len(id_)) - 1] = first
    with np.errstate(invalid="ignore"):
        low, high = np.maximum(0, np.ceil(np.minimum(y, y[after]))), np.minimum(height - 1, np.ceil(np.maximum(y, y[after])) - 1)
        e = np.flatnonzero((y != y[after]) & (low <= high) & ~np.isnan(x + x[after]))
    n = (high[e] - low[e]).astype(np.int64) + 1
    row, e = ragged(low[e].astype(np.int64), n), np.repeat(e, n)
    f = after[e]
    at = x[e] + (row - y[e]) * (x[f] - x[e]) / (y[f] - y[e])
    order = np.lexsort((at, row, id_[e]))
    id_, row, at = id_[e][order], row[order], at[order]
    # Crossings of a ring and row come in pairs; a ring is closed, so that their number is even.
    new = np.append(True, (id_[1:] != id_[:-1]) | (row[1:] != row[:-1]))[: len(row)]
    place = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    a = np.flatnonzero((place % 2 == 0) & np.append(~new[1:], False)[: len(row)])
    c0, c1 = np.maximum(0, np.ceil(at[a])), np.minimum(width - 1, np.ceil(at[a + 1]) - 1)
    seen = c0 <= c1
    found = row[a[seen]], c0[seen].astype(np.int64), c1[seen].astype(np.int64), id_[a[seen]]
    stay = thinned(*found)
    return pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in found], names=["row_", "c0", "c1", "value"])


def rasterize(vertices: DataFrame, width: int, height: int) -> DataFrame:
    """Label mask, as spans (row_, c0, c1, value), of rings(object_id, vertex_no, x, y) in pixel units; where
    objects overlap, the highest id stays. Each pixel row crosses a ring's edges in pairs (even-odd,
    half-open); the pixels between the two of a pair are inside. No row is made per pixel, and Spark moves
    the vertices, not their crossings."""
    t = vertices.select(*[F.col(c).cast(k).alias(c) for c, k in (("object_id", "long"), ("vertex_no", "long"), ("x", "double"), ("y", "double"))])
    t = spread(t.dropna(), "object_id").sortWithinPartitions("object_id")
    return topmost(t.mapInArrow(lambda batches: grouped(batches, "object_id", lambda part: crossings(part, width, height)), "row_ long, c0 long, c1 long, value long"))


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open ring, started at the vertex furthest from the mean of all: no vertex lies further
    than the tolerance from what is left."""
    if tolerance <= 0 or len(ring) < 4:
        return ring
    start = int(((ring - ring.mean(0)) ** 2).sum(1).argmax())
    line = np.concatenate([np.roll(ring, -start, 0), ring[start : start + 1]])
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        p, q, m = line[i], line[j], line[i + 1 : j]
        d = q - p
        share = np.clip((m - p) @ d / max(d @ d, 1e-300), 0, 1)  # beyond an end the end itself is nearest
        far = np.hypot(*(m - p - share[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[:-1][keep[:-1]]


def triangulate(ring: np.ndarray) -> list[int]:
    """Ear clipping of a simple open ring: vertex indices, three a triangle. Only corners that turn inwards can
    lie in an ear, so a convex ring takes one pass, and others the ring's vertices times its inward ones, which are
    tested as arrays."""
    n = len(ring)
    if n < 3:
        return []
    x, y = ring[:, 0].tolist(), ring[:, 1].tolist()
    left = list(range(n))
    if sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in left) < 0:
        left.reverse()
    before = {b: a for a, b in zip(left[-1:] + left, left)}
    after = {a: b for b, a in before.items()}
    cross = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    xs, ys = ring[:, 0], ring[:, 1]
    inward = np.zeros(n, bool)
    inward[[v for v in left if cross(before[v], v, after[v]) <= 0]] = True
    some = np.flatnonzero(inward)

    def is_ear(a, b, c):
        if inward[b]:
            return False
        p, q = xs[some], ys[some]
        hit = np.ones(len(some), bool)
        for u, v in ((a, b), (b, c), (c, a)):
            hit &= (x[v] - x[u]) * (q - y[u]) - (y[v] - y[u]) * (p - x[u]) >= 0
        if hit.any():  # a vertex at the place of a corner doesn't lie in the ear
            for u in (a, b, c):
                hit &= (p != x[u]) | (q != y[u])
        return not hit.any()

    out: list[int] = []
    at, tried = left[0], 0
    while n > 3:
        a, c = before[at], after[at]
        if tried >= n:  # flat or self-crossing rest: cut its flattest corner, so that n - 2 triangles come out
            rest = [at]
            while after[rest[-1]] != at:
                rest.append(after[rest[-1]])
            at = min(rest, key=lambda v: abs(cross(before[v], v, after[v])))
            a, c = before[at], after[at]
        elif not is_ear(a, at, c):
            at, tried = c, tried + 1
            continue
        out += [a, at, c]
        after[a], before[c] = c, a
        changed = [at, a, c]
        was = inward[changed].tolist()
        inward[changed] = False, cross(before[a], a, after[a]) <= 0, cross(before[c], c, after[c]) <= 0
        if inward[changed].tolist() != was:
            some = np.flatnonzero(inward)
        at, n, tried = c, n - 1, 0
    return out + [before[at], at, after[at]]


#: Rings of so many vertices at most are triangulated together, as arrays of one row a ring.
TOGETHER = 64


def triangulate_alike(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`triangulate` of rings of one number of vertices, a row each, in step: at every turn each ring tests its next
    corner. Returns the triangles, and which rings have none as they cross themselves or are flat."""
    m, n = x.shape
    area = (np.roll(x, 1, 1) * y - x * np.roll(y, 1, 1)).sum(1)
    after = np.tile(np.roll(np.arange(n), -1), (m, 1))
    before = np.tile(np.roll(np.arange(n), 1), (m, 1))
    turned = area < 0
    after[turned], before[turned] = before[turned], after[turned]
    ring = np.arange(m)
    at = np.where(turned, n - 1, 0)
    cross = lambda r, a, b, c: (x[r, b] - x[r, a]) * (y[r, c] - y[r, a]) - (y[r, b] - y[r, a]) * (x[r, c] - x[r, a])
    every = ring[:, None]
    inward = cross(every, before, np.arange(n)[None, :], after) <= 0
    out, made, tried, hard = np.zeros((m, n - 2, 3), np.int32), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    r = ring if n > 3 else ring[:0]
    while len(r):
        a, b, c = before[r, at[r]], at[r], after[r, at[r]]
        px, py, within = x[r], y[r], inward[r]
        corners = [(px[np.arange(len(r)), v][:, None], py[np.arange(len(r)), v][:, None]) for v in (a, b, c)]
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            within &= (x2 - x1) * (py - y1) >= (y2 - y1) * (px - x1)
        for cx, cy in corners:  # the corners themselves, and vertices at their places, don't lie in the ear
            within &= (px != cx) | (py != cy)
        ear = ~inward[r, b] & ~within.any(1)
        e, ea, eb, ec = r[ear], a[ear], b[ear], c[ear]
        out[e, made[e]] = np.stack([ea, eb, ec], 1)
        after[e, ea], before[e, ec] = ec, ea
        inward[e, eb] = False
        for v in (ea, ec):
            inward[e, v] = cross(e, before[e, v], v, after[e, v]) <= 0
        made[e] += 1
        tried[r] = np.where(ear, 0, tried[r] + 1)
        at[r] = c
        hard[r] = tried[r] >= n - made[r]
        r = r[(n - made[r] > 3) & ~hard[r]]
    out[ring, n - 3] = np.stack([before[ring, at], at, after[ring, at]], 1)
    return out, hard


def triangulated(rings: pa.Array) -> pa.Array:
    """The triangles of each of a column of rings, small ones by number of vertices, in step."""
    lens = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    x, y = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    begin = np.cumsum(lens) - lens
    sizes = 3 * np.maximum(lens - 2, 0)
    ends = np.append(0, np.cumsum(sizes))
    out = np.zeros(int(ends[-1]), np.int32)
    for n in np.unique(lens[lens >= 3]).tolist():
        which = np.flatnonzero(lens == n)
        hard = which
        if n <= TOGETHER:
            place = begin[which][:, None] + np.arange(n)
            found, hopeless = triangulate_alike(x[place], y[place])
            out[ends[which][:, None] + np.arange(3 * (n - 2))] = found.reshape(len(which), -1)
            hard = which[hopeless]
        for i in hard.tolist():
            out[ends[i] : ends[i + 1]] = triangulate(np.stack([x[begin[i] : begin[i] + n], y[begin[i] : begin[i] + n]], 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def summarised(rings: pa.Array) -> list[pa.Array]:
    """n_vertices, cx, cy and area of each of a column of rings, as polygons.summaries has them: sums go from vertex to
    vertex, those of all rings of a batch together, and pass over nulls."""
    lens = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    x, y = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (0, 1))
    begin = np.cumsum(lens) - lens
    sums, known = np.zeros((3, len(lens))), np.zeros((3, len(lens)), np.int64)
    for k in range(int(lens.max(initial=0))):
        which = np.flatnonzero(lens > k)
        first = begin[which]
        at, nxt = first + k, first + np.where(k + 1 < lens[which], k + 1, 0)
        x2, y2 = (np.where(np.isnan(c[nxt]), c[first], c[nxt]) for c in (x, y))
        for i, v in enumerate((x[at], y[at], x[at] * y2 - x2 * y[at])):
            there = ~np.isnan(v)
            sums[i, which[there]] += v[there]
            known[i, which[there]] += 1
    parts = sums[0] / np.maximum(known[0], 1), sums[1] / np.maximum(known[1], 1), np.abs(sums[2]) / 2
    return [pa.array(lens), *[pa.array(v, mask=n == 0) for v, n in zip(parts, known)]]


def shapes(objects: DataFrame) -> DataFrame:
    """objects(object_id, ring) with `triangles`, n_vertices, cx, cy and area."""
    names = ["object_id", "ring", "triangles", "n_vertices", "cx", "cy", "area"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), triangulated(batch.column(1)), *summarised(batch.column(1))], names=names)

    kind = objects.schema["object_id"].dataType.simpleString()
    return objects.select("object_id", "ring").mapInArrow(run, f"object_id {kind}, ring {RING}, triangles array<int>, n_vertices long, cx double, cy double, area double")


def _rings(column: pa.Array) -> list[np.ndarray]:
    """Each ring of a column as an array, cut from the column's coordinates."""
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    points = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
    ends = np.cumsum(lens).tolist()
    return [points[a:b] for a, b in zip([0, *ends], ends)]


def _struct(rings: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rings) if rings else np.zeros((0, 2))
    lists = np.append(0, np.cumsum([len(r) for r in rings])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"]))


def simplify_rings(objects: DataFrame, tolerance: float = 0.75, name: str = "ring") -> DataFrame:
    """objects(object_id, ring) with simplified rings; under another name they stand beside the rings."""
    kept = ["object_id"] if name == "ring" else ["object_id", "ring"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], _struct([simplify(r, tolerance) for r in _rings(batch.column(1))])], names=[*kept, name])

    kinds = [objects.schema["object_id"].dataType.simpleString(), RING]
    return objects.select("object_id", "ring").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip([*kept, name], [*kinds[: len(kept)], RING])))


def triangulate_rings(objects: DataFrame) -> DataFrame:
    """objects(object_id, ring) with `triangles`, local vertex indices."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), triangulated(batch.column(1))], names=["object_id", "ring", "triangles"])

    return objects.select("object_id", "ring").mapInArrow(run, f"object_id {objects.schema['object_id'].dataType.simpleString()}, ring {RING}, triangles array<int>")


def polygons_from_labels(mask: DataFrame, level: Level = Level((1.0, 1.0)), tolerance: float = 0.75, least: int = 4) -> DataFrame:
    """(object_id, ring, pixel_area, area) of the labels of a mask, pixels or spans, in world units.

    Labels under `least` pixels go, and those whose ring has under 3 vertices. Sides are linked to chains inside
    blocks, and the chains of an object meet in one task, as its ring is one row; its longest outer ring stays,
    and holes and further pieces go. outlines() has the rings of objects too wide for that in long form."""
    sizes = boxes(as_spans(mask)).select(F.col("label").cast("long").alias("object_id"), "pixel_area").where(F.col("pixel_area") >= least)
    (sy, sx), (ty, tx) = level.scale, level.translation

    def traced(part: pa.Table) -> pa.RecordBatch:
        label, x, y, n, outer = linked(part)
        rank = np.lexsort((np.arange(len(n)), -n, ~outer, label))
        best = rank[np.append(True, label[rank][1:] != label[rank][:-1])]
        ends = np.cumsum(n)
        rings = [simplify(np.stack([x[j - m : j], y[j - m : j]], 1), tolerance) * [sx, sy] + [tx, ty] for j, m in zip(ends[best].tolist(), n[best].tolist())]
        rings = [r if o else r[:0] for r, o in zip(rings, outer[best].tolist())]
        of, first = np.unique(part["label"].to_numpy(), return_index=True)
        pixels = part["pixel_area"].to_numpy()[first[np.searchsorted(of, label[best])]]
        return pa.RecordBatch.from_arrays([pa.array(label[best]), _struct(rings), pa.array(pixels)], names=["object_id", "ring", "pixel_area"])

    # Sizes go along with the chains, so that rings are not shuffled again.
    chains = numbered_chains(mask).withColumnRenamed("label", "object_id").join(sizes, "object_id")
    chains = spread(chains.withColumnRenamed("object_id", "label"), "label").sortWithinPartitions("label")
    found = chains.mapInArrow(lambda batches: grouped(batches, "label", traced), f"object_id long, ring {RING}, pixel_area long")
    return found.where(F.size("ring") >= 3).withColumn("area", F.col("pixel_area") * F.lit(abs(sy * sx)))


def ring_area(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.arrays_zip(ring.alias("p"), nxt.alias("q")), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def round_trip(vertices: DataFrame, width: int, height: int, tolerance: float = 0.0) -> DataFrame:
    """(object_id, pixel_area, traced_area, error): rings drawn as a mask and traced back."""
    t = polygons_from_labels(rasterize(vertices, width, height), tolerance=tolerance)
    t = t.select("object_id", "pixel_area", ring_area(F.col("ring")).alias("traced_area"))
    return t.withColumn("error", F.abs(F.col("traced_area") - F.col("pixel_area")) / F.col("pixel_area"))


def ring_distance(points: Column, ring: Column) -> Column:
    """The greatest distance of a list of points from the closed ring's sides: one half of the Hausdorff distance of
    a ring and its simplification, the other being 0 as the latter's vertices are some of the former's."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def side(p, e):
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        share = ((p["x"] - e["p"]["x"]) * dx + (p["y"] - e["p"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0))))
        return F.hypot(p["x"] - e["p"]["x"] - t * dx, p["y"] - e["p"]["y"] - t * dy)

    sides = F.arrays_zip(ring.alias("p"), nxt.alias("q"))
    return F.array_max(F.transform(points, lambda p: F.array_min(F.transform(sides, lambda e: side(p, e)))))


def furthest_vertex(vertices: DataFrame) -> DataFrame:
    """(object_id, vertex_no): the vertex furthest from the mean of its ring, the first of equals."""
    mean = vertices.groupBy("object_id").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    far = F.round((F.col("x") - F.col("_mx")) ** 2 + (F.col("y") - F.col("_my")) ** 2, 2)
    return vertices.join(mean, "object_id").groupBy("object_id").agg(F.min_by("vertex_no", F.struct((-far).alias("d"), "vertex_no")).alias("vertex_no"))


def longest_ring(pieces: DataFrame) -> DataFrame:
    """One ring per object of pieces(object_id, piece, ring): the one with most vertices, the first of equals."""
    return pieces.groupBy("object_id").agg(F.min_by("ring", F.struct((-F.size("ring")).alias("n"), "piece")).alias("ring"))
