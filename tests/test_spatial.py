"""Small hand-made inputs and invariants of the spatial operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import grid as gr
from lattica.operators import extent as ext
from lattica.operators import features as feat
from lattica.operators import geometry as geo
from lattica.operators import outlines as out
from lattica.operators import points as pts
from lattica.operators import polygons as poly
from lattica.operators import raster as ras
from lattica.operators import spans
from lattica.operators.ranks import order_statistics
from lattica.sources import slide


def square(id_, x, y, s):
    return [(id_, i, float(a), float(b)) for i, (a, b) in enumerate(((x, y), (x + s, y), (x + s, y + s), (x, y + s)))]


def vertices(spark, rows):
    return spark.createDataFrame(rows, "object_id long, vertex_no int, x double, y double")


def test_hilbert_quadrants(spark):
    t = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "gx int, gy int")
    assert [r["hilbert"] for r in gr.with_hilbert(t, 1).collect()] == [0, 1, 2, 3]


def test_hilbert_is_a_walk(spark):
    t = spark.range(4096).select((F.col("id") % 64).cast("int").alias("gx"), F.floor(F.col("id") / 64).cast("int").alias("gy"))
    rows = sorted((r["hilbert"], r["gx"], r["gy"]) for r in gr.with_hilbert(t, 6).collect())
    assert [h for h, _, _ in rows] == list(range(4096))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_quantize_edges(spark):
    t = spark.createDataFrame([(0.0,), (10.0,), (-5.0,), (99.0,), (None,)], "x double")
    assert [r[0] for r in t.select(gr.cell("x", 0.0, 10.0, 4)).collect()] == [0, 3, 0, 3, None]
    assert [r[0] for r in t.select(gr.cell("x", 0.0, 0.0, 4)).collect()] == [0, 0, 0, 0, None]


def test_grid_choices():
    assert gr.choose_depth((0, 0, 1000, 10), 500) == 1
    assert gr.choose_depth((5, 5, 5, 5), 500) == 0
    assert gr.choose_level([1.0, 2.0, 4.0], 3.0) == 1 and gr.choose_level([2.0], 1.0) == 0
    g = gr.Grid(0, 0, 16, 8, 2)
    assert g.tile_size() == 4 and g.tile_range((3, 3, 5, 5)) == (0, 1, 0, 1)
    assert g.tile_range((16, 0, 20, 1)) is None or g.tile_range((16, 0, 20, 1))[3] == 3
    assert g.tile_range((100, 100, 110, 110)) is None


def test_levels_conserve_counts_and_members(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(rng.integers(0, 3, 500), rng.uniform(0, 100, 500), rng.uniform(0, 100, 500))]
    t = spark.createDataFrame(rows, "gene_id int, x double, y double")
    got = pts.point_levels(t, gr.Grid(0, 0, 100, 100, 3)).collect()
    members = {(x, y) for _, x, y in rows}
    for k in (1, 2, 3):
        assert sum(r["count"] for r in got if r["level"] == k) == 500
    assert all((r["x"], r["y"]) in members for r in got)
    finer = {(r["x"], r["y"]) for r in got if r["level"] == 1}
    assert all((r["x"], r["y"]) in finer for r in got if r["level"] == 2)


def test_points_without_optional_columns(spark):
    t = spark.createDataFrame([("a", 1.0, 2.0)], "feature_name string, x_location double, y_location double")
    assert pts.load_points(t).count() == 1
    with pytest.raises(ValueError):
        pts.load_points(t.drop("x_location"))
    q = spark.createDataFrame([("a", 1.0, 2.0, None, True), ("b", 1.0, 2.0, 30.0, None), ("c", 1.0, 2.0, 30.0, True)], "feature_name string, x_location double, y_location double, qv double, is_gene boolean")
    assert [r["name"] for r in pts.load_points(q).collect()] == ["c"]
    assert [tuple(r) for r in pts.gene_table(pts.load_points(q, None, False)).orderBy("gene_id").collect()] == [(0, "a", 1), (1, "b", 1), (2, "c", 1)]
    coded = pts.encode(pts.load_points(q, None, False), pts.gene_table(pts.load_points(q, None, False)))
    assert pts.pick_genes(coded, []).count() == 0 and pts.pick_genes(coded, None).count() == 3


def test_rings_open_close_interleave(spark):
    closed = square(1, 0, 0, 2) + [(1, 4, 0.0, 0.0)]
    three = [(2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)]
    t = poly.opened(vertices(spark, closed + square(3, 5, 5, 1) + three))
    assert {r["object_id"]: r["n"] for r in t.groupBy("object_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 3, 3: 4}
    s = {r["object_id"]: r for r in poly.summaries(t).collect()}
    assert s[1]["area"] == 4 and s[3]["area"] == 1 and (s[1]["cx"], s[1]["cy"]) == (1, 1)
    mixed = [x for p in zip(square(1, 0, 0, 2), square(3, 5, 5, 1)) for x in p]
    raw = spark.createDataFrame([(i, str(a), x, y) for i, (a, _, x, y) in enumerate(mixed)], "pos long, cell_id string, vertex_x double, vertex_y double")
    u = poly.summaries(poly.load_boundaries(raw, ["pos"])).collect()
    assert {(r["object_id"], r["area"]) for r in u} == {("1", 4.0), ("3", 1.0)}
    with pytest.raises(ValueError):
        poly.pick_columns(["a", "b"])


def test_dense_ids_and_offsets(spark):
    rows = [r for i in range(40) for r in square(i, (i * 37) % 101, (i * 53) % 97, 1 + i % 3)]
    t = poly.dense_ids(poly.placed(poly.summaries(vertices(spark, rows)), gr.Grid(0, 0, 105, 105, 3)), bits=4)
    got = sorted((r["cell_id"], r["hilbert"], r["object_id"]) for r in t.collect())
    assert [g[0] for g in got] == list(range(40)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    o = sorted((r["cell_id"], r["offset"]) for r in poly.offsets(t, bits=2).collect())
    assert [x for _, x in o] == [4 * i for i in range(40)]


def test_fit_check(spark):
    world = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "minx double, miny double, maxx double, maxy double")
    bounds = lambda x: spark.createDataFrame([(x, 0.0, x + 10.0, 10.0)], "minx double, miny double, maxx double, maxy double")
    assert ext.check_fits(bounds(0.0), world, "a") == 1
    with pytest.warns(UserWarning):
        assert round(ext.check_fits(bounds(4.0), world, "a"), 6) == 0.6
    for x in (6.0, 50.0):
        with pytest.raises(ValueError):
            ext.check_fits(bounds(x), world, "a")


def test_features(spark):
    objects = spark.createDataFrame([("1",), ("2",), ("3",)], "object_id string")
    cells = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 7.0)], "object_id int, area double")
    t = feat.join_attributes(objects, cells)
    assert {tuple(r) for r in t.collect()} == {("1", 5.0), ("2", 7.0), ("3", None)}
    c = feat.join_categories(objects, {"k": spark.createDataFrame([("1", 4), ("1", 5)], "id string, c int")})
    assert feat.is_categorical(c.schema["k"]) and {tuple(r) for r in c.collect()} == {("1", 4), ("2", None), ("3", None)}
    assert [tuple(r) for r in feat.category_counts(c, "k").collect()] == [("4", 1), ("unassigned", 2)]
    assert feat.hide_categories(c, "k", ["unassigned"]).count() == 1
    values = lambda v: spark.createDataFrame([(x,) for x in v], "v double")
    dom = lambda v: tuple(feat.robust_domain(values(v), "v").first())
    assert dom([3.0] * 5) == (3, 4) and dom([None, None]) == (0, 1)
    assert dom([float(i) for i in range(1, 51)]) == (1, 50) and dom([float(i) for i in range(1, 52)]) == (2, 50)
    r = values([0.0, 5.0, 10.0, None]).select(feat.ramp_position(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()
    assert [x[0] for x in r] == [0, 128, 255, 0]


def test_default_colour_and_columns(spark):
    t = spark.createDataFrame([(1, 2.0, 3, 4.0, 5.0, "s", 6.0)], "cell_id int, x_centroid double, transcript_counts int, cell_area double, area double, status string, other double")
    assert feat.colour_columns(t) == ["transcript_counts", "cell_area", "area", "other"] and feat.default_colour(t) == "cell_area"
    assert feat.default_colour(t.drop("cell_area")) == "transcript_counts" and feat.default_colour(t.select("other")) == "other"
    assert feat.default_colour(t.select("status")) is None


def test_first_row_wins(spark):
    t = spark.createDataFrame([(1, 9), (2, 5), (1, 3), (2, 7)], "k int, v int").coalesce(1)
    assert {tuple(r) for r in feat.first_per_key(t, "k").collect()} == {(1, 9), (2, 5)}
    assert {tuple(r) for r in feat.first_per_key(t, "k", ["v"]).collect()} == {(1, 3), (2, 5)}
    objects = spark.createDataFrame([(1,)], "object_id int")
    same = spark.createDataFrame([("1", 9), ("01", 3)], "object_id string, v int").coalesce(1)  # equal after the cast
    assert [tuple(r) for r in feat.join_attributes(objects, same).collect()] == [(1, 9)]


def test_mask_must_be_whole(spark):
    with pytest.raises(ValueError):
        ras.require_mask(spark.createDataFrame([(0, 0)], "row_ int, value int"))
    with pytest.raises(ValueError):
        ras.require_mask(spark.createDataFrame([(0, 0, 1.0)], "row_ int, col_ int, value double"))
    ras.require_mask(spark.createDataFrame([(0, 0, 1)], "row_ int, col_ int, value int"))


def test_tile_ranges_at_edges():
    g = gr.Grid(0, 0, 16, 16, 2)
    assert g.tile_range((0, 0, 4, 8)) == (0, 1, 0, 0) and g.tile_range((4, 4, 4.5, 4.5)) == (1, 1, 1, 1)
    assert g.tile_range((16, 0, 20, 1)) is None and gr.Grid(5, 5, 5, 5, 2).tile_range((0, 0, 9, 9)) is None


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 999), rng.integers(0, 5, 400).astype(float), np.append(rng.random(500), 1e12), np.full(7, 3.0)):
        t = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", 2.0)], "g string, v double").repartition(3)
        got = {r["g"]: r for r in order_statistics(t, ["g"], "v", {"first": lambda n: F.lit(1), "mid": lambda n: F.ceil(n / 2), "last": lambda n: n}).collect()}
        s = np.sort(values)
        assert (got["a"]["first"], got["a"]["mid"], got["a"]["last"], got["a"]["n"]) == (s[0], s[-(-len(s) // 2) - 1], s[-1], len(s)) and got["b"]["mid"] == 2.0


def test_open_sides_against_neighbours(spark):
    rng = np.random.default_rng(4)
    a = np.repeat(np.repeat(rng.integers(0, 4, (9, 11)), 3, 0), 3, 1)
    a[rng.random(a.shape) < 0.1] = 0
    want = []
    for r, c in zip(*np.nonzero(a)):
        for y, x in out.SIDES:
            if (a[r + y, c + x] if 0 <= r + y < a.shape[0] and 0 <= c + x < a.shape[1] else 0) != a[r, c]:
                want.append((int(a[r, c]), c + x / 2, r + y / 2))
    for step in (4, 256):
        got = out.side_chains(mask(spark, a), step).select("label", F.explode("points").alias("p")).select("label", "p.x", "p.y")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_traced_rings_against_a_walk(spark):
    """Each outline by a walk that keeps the object on its right, one pixel side at a time."""
    rng = np.random.default_rng(5)
    a = np.zeros((30, 40), int)
    for k in range(1, 9):
        r, c = rng.integers(0, 22), rng.integers(0, 30)
        a[r : r + rng.integers(3, 9), c : c + rng.integers(3, 9)] = k
    a[rng.random(a.shape) < 0.08] = 0
    full = lambda k, r, c: 0 <= r < a.shape[0] and 0 <= c < a.shape[1] and a[r, c] == k
    want = {}
    for k in np.unique(a[a > 0]).tolist():
        seen, rings = set(), []
        for r, c in np.argwhere(a == k).tolist():
            if not full(k, r - 1, c) and (r, c, 0) not in seen:
                ring, y, x, s = [], r, c, 0
                while (y, x, s) not in seen:
                    seen.add((y, x, s))
                    ring.append((x + out.SIDES[s][1] / 2, y + out.SIDES[s][0] / 2))
                    ahead = out.SIDES[(s + 1) % 4]
                    if not full(k, y + ahead[0], x + ahead[1]):
                        s = (s + 1) % 4
                    elif not full(k, y + ahead[0] + out.SIDES[s][0], x + ahead[1] + out.SIDES[s][1]):
                        y, x = y + ahead[0], x + ahead[1]
                    else:
                        y, x, s = y + ahead[0] + out.SIDES[s][0], x + ahead[1] + out.SIDES[s][1], (s + 3) % 4
                if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) > 0:
                    rings.append(ring)
        want[k] = max(map(len, rings))
        want[k] = {frozenset(ring) for ring in rings if len(ring) == want[k]}
    got = geo.polygons_from_labels(mask(spark, a), tolerance=0.0, least=1).collect()
    assert {r["object_id"] for r in got} == set(want)
    for r in got:
        assert frozenset((p["x"], p["y"]) for p in r["ring"]) in want[r["object_id"]]


@pytest.mark.parametrize("n", [600, 6000])
def test_triangles_of_a_large_ring(n):
    i = np.arange(n)
    reach = 1 + 0.5 * np.sin(i * 7)
    ring = np.stack([reach * np.cos(i * 2 * np.pi / n), reach * np.sin(i * 2 * np.pi / n)], 1)
    t = np.array(geo.triangulate(ring)).reshape(-1, 3)
    area = lambda p: np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]) / 2
    assert len(t) == n - 2 and abs(sum(area(ring[k]) for k in t) - area(ring)) < 1e-9 and all(area(ring[k]) > 0 for k in t)


def test_rings_triangulated_together():
    """Rings of one size in step have the triangles that each has by itself, self-crossing ones too."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rings = []
    for k in range(300):
        n = int(rng.choice([0, 1, 2, 3, 4, 5, 12, 40, 70]))
        turn = np.sort(rng.random(n)) * 2 * np.pi
        ring = (1 + 0.8 * rng.random((n, 1)) * (k % 3)) * np.stack([np.cos(turn), np.sin(turn)], 1)
        ring = ring[::-1] if k % 2 else ring
        rings.append(rng.random((n, 2)) if k % 11 == 0 else np.round(ring, 1) if k % 7 == 0 else ring)
    column = pa.array([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings] + [None], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    got = geo.triangulated(column).to_pylist()
    assert got == [geo.triangulate(r) for r in rings] + [[]]


def test_distance_of_a_ring(spark):
    rng = np.random.default_rng(7)
    turn = np.sort(rng.random(200)) * 2 * np.pi
    ring = np.stack([np.cos(turn) * (5 + rng.random(200)), np.sin(turn) * 5], 1)
    nested = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    for tolerance in (0.05, 0.5, 2.0):
        simple = geo.simplify(ring, tolerance)
        t = spark.createDataFrame([(nested(ring), nested(simple))], f"ring {geo.RING}, simple {geo.RING}")
        p, q = simple[None], np.roll(simple, -1, 0)[None]
        share = np.clip(((ring[:, None] - p) * (q - p)).sum(2) / ((q - p) ** 2).sum(2), 0, 1)
        want = np.hypot(*np.moveaxis(ring[:, None] - p - share[..., None] * (q - p), 2, 0)).min(1).max()
        got = t.select(geo.ring_distance(F.col("ring"), F.col("simple"))).first()[0]
        assert abs(got - want) < 1e-9 and got <= tolerance


def test_points_in_boxes_of_very_different_sizes(spark):
    rng = random.Random(3)
    boxes = [(i, rng.uniform(0, 100), rng.uniform(0, 100), 10.0 ** rng.uniform(-1, 2)) for i in range(60)]
    p = [(i, rng.uniform(0, 150), rng.uniform(0, 150)) for i in range(300)]
    rings = poly.rings(vertices(spark, [v for i, x, y, s in boxes for v in square(i, x, y, s)]))
    got = geo.points_in_polygons(spark.createDataFrame(p, "k int, x double, y double"), rings).collect()
    assert sorted((r["k"], r["object_id"]) for r in got) == sorted((k, i) for k, px, py in p for i, x, y, s in boxes if x < px < x + s and y < py < y + s)


def test_a_ring_of_many_objects_is_tested_once(spark):
    """Rings that many objects have, ids that several rings have, unknown coordinates, upright and flat rings."""
    corners = [[(2, 3), (8, 3), (8, 9), (2, 9)], [(2, 9), (8, 9), (8, 3), (2, 3)], [(8, 3), (8, 9), (2, 9), (2, 3)], [(0, 0), (6, 0), (6, 0), (6, 4), (0, 4)], [(0, 0), (9, 0), (5, 0), (5, 4), (0, 4)], [(0, 0), (0, 9), (0, 2)], [(1, 1), (9, 1), (5, 8)], [(1, 1), (None, 5), (7, 7), (5, None)], [(1, 1), (5, None), (7, 7), (None, 5)], [(1, 1), None, (7, 7)], []]
    rows = [(i * 100 + j if i else 7, None if r is None else [None if v is None else {"x": None if v[0] is None else float(v[0]), "y": None if v[1] is None else float(v[1])} for v in r]) for i in range(20) for j, r in enumerate([*corners, None])]
    objects = spark.createDataFrame(rows, f"object_id int, ring {geo.RING}")
    p = spark.createDataFrame([(i, i // 12 / 1.0, i % 12 / 1.0) for i in range(144)], "k int, x double, y double")

    def inside(ring, x, y):
        ring = [v and (v["x"], v["y"]) for v in ring or []]
        known = [[v[i] for v in ring if v and v[i] is not None] for i in (0, 1)]
        if not all(known) or not (min(known[0]) <= x <= max(known[0]) and min(known[1]) <= y <= max(known[1])):
            return False
        ends = [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1]) if p and q and None not in (*p, *q)]
        return sum((b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in ends) % 2 == 1

    want = sorted((r["k"], i) for r in p.collect() for i, ring in rows if inside(ring, r["x"], r["y"]))
    assert sorted((r["k"], r["object_id"]) for r in geo.points_in_polygons(p, objects).collect()) == want
    assert len(want) == 20 * geo.points_in_rings(p, geo.with_ring_key(objects)).count() > 0


def test_pairs_of_points_and_rings_are_not_shuffled(spark):
    """Each point lies in each ring and no two objects share one: no shuffle grows with the pairs."""
    n, held = 60, {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    objects = poly.rings(vertices(spark, [v for i in range(n) for v in square(i, -1.0 - i, -1.0, 100.0 + i)])).localCheckpoint()
    p = spark.createDataFrame([(i, i / 1.0, i / 2.0) for i in range(n)], "k int, x double, y double")
    for k in held:
        spark.conf.set(k, "-1")
    try:
        df = geo.points_in_polygons(p, objects, 1000.0)
        assert sorted(map(tuple, df.select("k", "object_id").collect())) == [(k, i) for k in range(n) for i in range(n)]
        df = df.select("*")
        assert len(df.collect()) == n * n
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    todo, shuffled = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if node.metrics().contains("shuffleRecordsWritten"):
            shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert shuffled and max(shuffled) <= 4 * n


def test_objects_of_a_crowded_ring_are_dealt_to_rows(spark, monkeypatch):
    """More objects than a row holds, ids without value and twice among them, beside a ring of one object."""
    monkeypatch.setattr(geo, "IDS", 3)
    ring = lambda s: [{"x": x, "y": y} for i, x, y in ((0, 0.0, 0.0), (1, s, 0.0), (2, s, s), (3, 0.0, s))]
    ids = [*range(40), 7, None, None]
    objects = spark.createDataFrame([(i, ring(4.0)) for i in ids] + [(99, ring(2.0))], f"object_id int, ring {geo.RING}")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 1.0)], "k int, x double, y double")
    got = sorted((r["k"], -1 if r["object_id"] is None else r["object_id"]) for r in geo.points_in_polygons(p, objects).collect())
    assert got == sorted([(k, -1 if i is None else i) for k in (1, 2) for i in ids] + [(1, 99)])
    rows = geo.with_objects(geo.with_ring_key(objects)).collect()
    assert len(rows) > 10 and sum(len(r["_ids"]) for r in rows) == len(ids) + 1


def test_manifest_is_replaced_in_one_step(spark, tmp_path):
    root = f"file://{tmp_path}/slide"
    base = {"format": 1, "name": "a", "world_units": "um", "world_bounds": [0.0, 0.0, 1.0, 1.0], "tile_depth": 0, "layers": []}
    for name in "ab":
        slide.write_manifest(spark, root, base | {"name": name})
        assert slide.read_manifest(spark, root)["name"] == name
    assert not [f for f in (tmp_path / "slide").iterdir() if f.name.startswith(".manifest-")]


def mask(spark, a):
    return spark.createDataFrame([(int(r), int(c), int(a[r, c])) for r, c in np.ndindex(a.shape)], "row_ int, col_ int, value int")


def test_trace_square_and_friends(spark):
    a = np.zeros((40, 60), int)
    a[5:15, 5:15] = 1  # 10 x 10
    a[0:6, 40:46] = 2  # at the edge
    a[20:30, 5:15] = 3
    a[23:26, 8:11] = 0  # a hole
    a[20:26, 30:36] = 4
    a[35:37, 50:52] = 4  # a second piece
    a[38, 0:3] = 5  # a speck
    got = {r["object_id"]: r for r in geo.polygons_from_labels(mask(spark, a), tolerance=0.0).withColumn("traced", geo.ring_area(F.col("ring"))).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert abs(got[1]["traced"] - 99.5) < 1.01 and got[1]["pixel_area"] == 100
    assert abs(got[3]["traced"] - got[1]["traced"]) < 1e-9
    assert abs(got[4]["traced"] - 36) < 2 and got[4]["pixel_area"] == 40
    xs = [p["x"] for p in got[2]["ring"]]
    assert min(xs) >= 39 and max(xs) <= 46
    assert ras.drop_report(ras.label_boxes(mask(spark, a))).first()["too_small"] == 1


def test_mask_in_as_many_tasks_as_set(spark):
    """Spark doesn't join a mask's small tasks to a few large ones; equal and overlapping squares keep the highest id."""
    rows = [v for i in range(1, 60) for v in square(i, i % 20 * 30 - 0.5, i % 7 * 20 - 0.5, 8 + i % 3)]
    m = geo.rasterize(vertices(spark, rows), 3000, 200)
    assert m.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spans.to_spans(m).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {}
    for i in range(1, 60):
        want |= {(i % 7 * 20 + r, i % 20 * 30 + c): i for r in range(8 + i % 3) for c in range(8 + i % 3)}
    assert {(r["row_"], r["col_"]): r["value"] for r in spans.pixels(m).collect()} == want
    assert geo.rasterize(vertices(spark, rows).limit(0), 30, 20).count() == 0


def test_rasterize_round_trip(spark):
    rows = [(o, n, x - 0.5, y - 0.5) for o, n, x, y in square(1, 3, 3, 10) + square(2, 20, 5, 8) + square(3, 24, 9, 8)]
    m = {(r["row_"], r["col_"]): r["value"] for r in spans.pixels(geo.rasterize(vertices(spark, rows), 40, 40)).collect()}
    assert sum(v == 1 for v in m.values()) == 100 and sum(v == 3 for v in m.values()) == 64 and sum(v == 2 for v in m.values()) == 64 - 16
    assert all(r["error"] < 0.05 for r in geo.round_trip(vertices(spark, rows), 40, 40).collect() if r["object_id"] != 2)


def test_triangles_cover_the_ring():
    def area(p):
        x, y = p[:, 0], p[:, 1]
        return abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2

    for ring in ([(0, 0), (1, 0), (0, 1)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (0, 4), (2, 1), (4, 4), (4, 0)]):
        p = np.array(ring, float)
        t = np.array(geo.triangulate(p)).reshape(-1, 3)
        assert len(t) == len(p) - 2 and abs(sum(area(p[i]) for i in t) - area(p)) < 1e-9
    assert geo.triangulate(np.zeros((2, 2))) == []


def test_simplify_keeps_corners():
    ring = np.array([(x, 0) for x in range(10)] + [(10, y) for y in range(10)] + [(10 - x, 10) for x in range(10)] + [(0, 10 - y) for y in range(10)], float)
    assert len(geo.simplify(ring, 0.1)) == 4


def test_points_in_polygons(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 2.0, 1.0), (4, 9.0, 9.0)], "k int, x double, y double")
    hits = geo.points_in_polygons(p, poly.rings(vertices(spark, square(1, 0, 0, 2) + square(2, 0.5, 0.5, 20))))
    assert {(r["k"], r["object_id"]) for r in hits.collect()} == {(1, 1), (1, 2), (2, 1), (3, 2), (4, 2)}
    assert {(r["k"], r["object_id"]) for r in geo.top_hit(hits, ["k"]).collect()} == {(1, 2), (2, 1), (3, 2), (4, 2)}


def test_raster_metadata(spark):
    text = '{"ome": {"multiscales": [{"datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 0.5, 0.25]}]}]}]}}'
    assert slide.raster_levels(spark, text) == [ras.Level((0.5, 0.25))]
    with pytest.raises(ValueError):
        slide.raster_levels(spark, '{"multiscales": [{"datasets": [{"path": "0", "coordinateTransformations": [{"type": "translation", "translation": [1, 2]}]}]}]}')
    level = ras.Level((1.0, 1.0), (0.0, 0.0), (100, 100), (32, 32))
    assert level.chunks((0, 0, 40, 10)) == (0, 0, 0, 1) and level.chunks((500, 0, 600, 10)) is None
    assert level.chunks((0, 32, 32, 64)) == (1, 1, 0, 0) and level.chunks((0, 0, 32.5, 96)) == (0, 2, 0, 1)
    assert level.chunks((96, 96, 100, 100)) == (3, 3, 3, 3) and level.chunks((-9, -9, 0, 0)) is None
    assert level.coarser(2) == ras.Level((4.0, 4.0), (0.0, 0.0), (25, 25), (32, 32))


def test_slide_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    raw = spark.createDataFrame([(f"g{i % 3}", float(i % 10) * 10, float(i // 10) * 10) for i in range(100)], "feature_name string, x_location double, y_location double")
    cells = vertices(spark, square(1, 0, 0, 20) + square(2, 50, 50, 30))
    m = slide.import_slide(spark, root, "s", raw, {"cells": cells}, tile_size=25.0)
    assert m["tile_depth"] == 2
    g = slide.grid_of(slide.read_manifest(spark, root))
    assert slide.view_points(spark, slide.layer_path(m, root, "points"), g, (0, 0, 90, 90), 0.0).count() == 100
    assert slide.view_points(spark, slide.layer_path(m, root, "points"), g, (0, 0, 90, 90), 0.0, []).count() == 0
    assert slide.view_polygons(spark, slide.layer_path(m, root, "cells"), g, (0, 0, 20, 20), "area").count() == 1
    assert slide.layer_statistics(spark, slide.layer_path(m, root, "cells")).first()["triangles"] == 4
    assert slide.add_segments(spark, root, "cells", cells)["layers"][-1]["id"] == "cells-2"
    slide.check_layers(spark, root)
    with pytest.raises(ValueError):
        slide.add_segments(spark, root, "far", vertices(spark, square(1, 5000, 5000, 20)))
    slide.write_manifest(spark, root, {"format": 1, "layers": [{"id": "gone", "kind": "points"}, {"id": "x", "kind": "other"}]})
    assert slide.layers(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        slide.check_layers(spark, root)
    slide.write_manifest(spark, root, {"format": 2})
    with pytest.raises(ValueError):
        slide.read_manifest(spark, root)


def test_image_levels(spark, tmp_path):
    a = np.arange(2 * 21 * 10).reshape(2, 21, 10)
    t = spark.createDataFrame([(int(c), int(r), int(x), int(a[c, r, x])) for c, r, x in np.ndindex(a.shape)], "channel long, row_ int, col_ int, value long")
    facts = slide.write_image_layer(t, f"file://{tmp_path}/i", ras.Level((2.0, 0.5), (3.0, 4.0)), coarsest=4)
    assert [c["channel"] for c in facts.pop("channels")] == ["0", "1"]
    assert facts == {"levels": 3, "scale": [2.0, 0.5], "translation": [3.0, 4.0], "shape": [21, 10], "chunk": [256, 256]}
    want = {(c, r, x): float(a[c, r, x]) for c, r, x in np.ndindex(a.shape)}
    for k in range(4):
        assert {(r["channel"], r["row_"], r["col_"]): r["value"] for r in slide.image_pixels(spark, f"file://{tmp_path}/i", k).collect()} == want
        boxes = {}
        for (c, r, x), v in want.items():
            boxes.setdefault((c, r // 2, x // 2), []).append(v)
        want = {key: sum(v) / len(v) for key, v in boxes.items()}


def test_import_folder(spark, tmp_path):
    root, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    with pytest.raises(ValueError):
        slide.import_folder(spark, root, to, "s")
    vertices(spark, square(1, 0, 0, 20) + square(2, 50, 50, 30)).toDF("cell_id", "n", "vertex_x", "vertex_y").coalesce(1).write.parquet(f"{root}/cell_boundaries.parquet")
    spark.createDataFrame([(1, 5.0), (2, 6.0)], "cell_id int, total double").write.parquet(f"{root}/cells.parquet")
    for name in ("kmeans_2_clusters", "graphclust"):
        spark.createDataFrame([(1, 4)], "Barcode int, Cluster int").write.csv(f"{root}/clusters/gene_expression_{name}", header=True)
    labels = np.zeros((20, 20), int)
    labels[4:14, 4:14] = 1
    mask(spark, labels).write.parquet(f"{root}/labels/other.parquet")
    for name in ("a", "dapi"):
        mask(spark, np.ones((300, 10), int)).write.parquet(f"{root}/images/{name}.parquet")
    (tmp_path / "in/images/dapi.json").write_text('{"multiscales": [{"datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 20]}]}]}]}')
    assert [(s["kind"], s["id"]) for s in slide.discover(spark, root)] == [("image", "dapi"), ("image", "a"), ("segments", "cell"), ("segments", "other")]
    m = slide.import_folder(spark, root, to, "s")
    assert m["world_bounds"] == [0.0, 0.0, 200.0, 300.0]
    assert [(l["id"], l["kind"], l["levels"]) for l in slide.layers(spark, to).orderBy("position").collect()] == [("dapi", "image", 1), ("a", "image", 1), ("cell", "segments", 0), ("other", "segments", 0)]
    slide.check_layers(spark, to)
    assert {(r["object_id"], r["total"], r["cluster"], r["kmeans_2"]) for r in spark.read.parquet(f"{slide.layer_path(m, to, 'cell')}/features").collect()} == {(1, 5.0, "4", "4"), (2, 6.0, None, None)}
    assert "total" not in spark.read.parquet(f"{slide.layer_path(m, to, 'other')}/features").columns
    assert slide.image_pixels(spark, slide.layer_path(m, to, "dapi"), 1).count() == 150 * 5


def test_tile_stream(spark, tmp_path):
    from lattica.streaming import tile_stream

    batch = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double")
    batch.write.parquet(f"{tmp_path}/in")
    g = gr.Grid(0, 0, 4, 4, 1)
    q = tile_stream(spark.readStream.schema("x double, y double").parquet(f"{tmp_path}/in"), g).writeStream.format("memory").queryName("tiles").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("tiles").collect())) == sorted(map(tuple, tile_stream(batch, g).collect()))


def test_simplified_rings_stand_beside_rings(spark):
    rings = poly.rings(vertices(spark, [(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.1), (1, 2, 8.0, 0.0), (1, 3, 8.0, 8.0), (1, 4, 0.0, 8.0), *square(2, 0, 0, 3)]))
    got = {r["object_id"]: (r["ring"], r["simple"]) for r in geo.simplify_rings(rings, 0.5, "simple").collect()}
    assert {k: (len(a), len(b)) for k, (a, b) in got.items()} == {1: (5, 4), 2: (4, 4)}
    assert {r["object_id"]: r["ring"] for r in geo.simplify_rings(rings, 0.5).collect()} == {k: b for k, (_, b) in got.items()}
    assert geo.simplify_rings(rings, 0.5, "simple").select("ring").exceptAll(rings.select("ring")).isEmpty()
