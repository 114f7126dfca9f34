"""Images as chunks and masks as spans, against arrays."""

from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import chunks as ch
from lattica.operators import geometry as geo
from lattica.operators import outlines
from lattica.operators import polygons as poly
from lattica.operators import raster as ras
from lattica.operators import spans
from lattica.sources import slide


@pytest.fixture(scope="module")
def image():
    """Two channels, an odd size, and pixels that are not there."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1000, (2, 45, 70)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    a[0, 16:32, 32:48] = np.nan  # a whole chunk
    return a


def table(spark, a):
    rows = [(int(c), int(r), int(x), int(a[c, r, x])) for c, r, x in np.ndindex(a.shape) if not np.isnan(a[c, r, x])]
    return spark.createDataFrame(rows, "channel int, row_ int, col_ int, value long").repartition(3)


def there(df):
    return {(r["channel"], r["row_"], r["col_"]): r["value"] for r in df.collect()}


def want(a):
    return {(c, r, x): a[c, r, x] for c, r, x in np.ndindex(a.shape) if not np.isnan(a[c, r, x])}


def half(a, how):
    out = np.full((a.shape[0], (a.shape[1] + 1) // 2, (a.shape[2] + 1) // 2), np.nan)
    for c, r, x in np.ndindex(out.shape):
        four = a[c, 2 * r : 2 * r + 2, 2 * x : 2 * x + 2].ravel()
        four = four[~np.isnan(four)]
        if len(four):
            out[c, r, x] = four.mean() if how == "mean" else four[0]
    return out


def test_chunks_round_trip(spark, image):
    t = ch.to_chunks(table(spark, image), (16, 16))
    assert there(ch.pixels(t)) == want(image) and t.schema["values"].dataType.elementType.typeName() == "long"
    got = {(r["channel"], r["chunk_row"], r["chunk_col"]): r for r in t.collect()}
    assert (0, 1, 2) not in got and len(got) == 2 * 3 * 5 - 1
    assert (got[1, 2, 4]["row0"], got[1, 2, 4]["height"], got[1, 2, 4]["width"]) == (32, 13, 6)
    sums = {(r["channel"], r["chunk_row"], r["chunk_col"]): r for r in ch.chunk_sums(t).collect()}
    part = image[1, 16:32, :16]
    assert (sums[1, 1, 0]["n"], sums[1, 1, 0]["total"], sums[1, 1, 0]["top"]) == (int((~np.isnan(part)).sum()), int(np.nansum(part)), int(np.nanmax(part)))
    twice = spark.createDataFrame([(0, 0, 5), (0, 0, 9), (0, 1, 2)], "row_ int, col_ int, value long")
    assert there(ch.pixels(ch.to_chunks(twice))) == {(0, 0, 0): 9, (0, 0, 1): 2}
    assert ch.to_chunks(twice.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["mean", "first"])
def test_downsampled_chunks(spark, image, how):
    t, a = ch.to_chunks(table(spark, image), (16, 16)), image
    for _ in range(3):
        t, a = ch.downsample(t, (16, 16), how), half(a, how)
        assert there(ch.pixels(t)) == pytest.approx(want(a))
    with pytest.raises(ValueError):
        ch.downsample(t, (15, 16))


def test_composited_chunks(spark, image):
    looks = [(0, 100.0, 900.0, 1.0, 0.0, 0.5), (1, 200.0, 200.0, 0.0, 1.0, 0.0)]  # the second has no range
    got = ch.colours(ch.composite(ch.to_chunks(table(spark, image), (16, 16)), spark.createDataFrame(looks, "channel int, lo double, hi double, r double, g double, b double")))
    share = np.clip((image[0] - 100) / 800, 0, 1)
    expect = {}
    for r, x in np.ndindex(share.shape):
        if not np.isnan(image[:, r, x]).all():
            s = 0.0 if np.isnan(share[r, x]) else share[r, x]
            expect[r, x] = (int(np.floor(round(s * 255, 6))), 0, int(np.floor(round(s * 127.5, 6))))
    assert {(r["row_"], r["col_"]): (r["r"], r["g"], r["b"]) for r in got.collect()} == expect


def test_view_of_an_image(spark, image, tmp_path):
    path = f"file://{tmp_path}/i"
    facts = slide.write_image_layer(table(spark, image), path, ras.Level((1.0, 2.0), (5.0, 7.0), chunk=(16, 16)), coarsest=20)
    assert facts["levels"] == 2 and facts["chunk"] == [16, 16] and [c["channel"] for c in facts["channels"]] == ["0", "1"]
    coarse = [half(half(image, "mean"), "mean")[c] for c in (0, 1)]
    assert [(c["lo"], c["hi"]) for c in facts["channels"]] == [pytest.approx(tuple(np.nanquantile(a, (0.01, 0.995)))) for a in coarse]
    fine = slide.view_image(spark, path, facts, (7.0, 5.0, 7.0 + 32, 5.0 + 16), 0.1)
    assert sorted((r["chunk_row"], r["chunk_col"]) for r in fine.collect()) == [(0, 0)]
    wide = slide.view_image(spark, path, facts, (7.0, 5.0, 7.0 + 65, 5.0 + 17), 4.0)  # level 1: pixels of 2 x 4, chunks of 32 x 64
    assert sorted((r["chunk_row"], r["chunk_col"]) for r in wide.collect()) == [(0, 0), (0, 1)]
    assert slide.view_image(spark, path, facts, (900.0, 0.0, 910.0, 9.0), 1.0).count() == 0
    plan = fine._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(chunk_row)" in plan and "GreaterThanOrEqual(chunk_row,0)" in plan
    again = slide.write_image_layer(slide.image_chunks(spark, path, 0).where("channel = 1"), f"{path}2", ras.Level((1.0, 2.0), chunk=(16, 16)), coarsest=1000)
    assert again["levels"] == 0 and there(slide.image_pixels(spark, f"{path}2", 0)) == want(image * np.array([np.nan, 1])[:, None, None])


def pixels_of(df):
    out = {}
    for r in df.collect():
        for c in range(r["c0"], r["c1"] + 1):
            assert (r["row_"], c) not in out
            out[r["row_"], c] = r["value"]
    return out


def test_the_highest_stays_on_top(spark, monkeypatch):
    rng = np.random.default_rng(3)
    drawn = []
    for _ in range(600):
        c0 = int(rng.integers(-20, 90))
        drawn.append((int(rng.integers(-3, 20)), c0, c0 + int(rng.choice([-1, 0, 1, 5, 60])), int(rng.integers(-2, 40))))
    drawn += [(5, 0, 99, 7)] * 50 + [(5, 0, 99, 50)]
    expect = {}
    for r, a, b, v in drawn:
        for c in range(a, b + 1):
            expect[r, c] = max(v, expect.get((r, c), v))
    df = spark.createDataFrame(drawn, "row_ int, c0 int, c1 int, value int").repartition(3)
    for sizes in ((64, 1024), (4, 16)):
        monkeypatch.setattr(spans, "ROWS", sizes[0])
        monkeypatch.setattr(spans, "COLS", sizes[1])
        assert pixels_of(spans.topmost(df)) == expect
    assert spans.topmost(df.limit(0)).count() == 0


def test_spans_of_masks(spark):
    rng = np.random.default_rng(4)
    a = np.repeat(rng.integers(0, 4, (20, 15)), 3, 1)
    px = spark.createDataFrame([(int(r), int(c), int(a[r, c])) for r, c in np.ndindex(a.shape)], "row_ int, col_ int, value int").repartition(3)
    longest = spans.to_spans(px)
    flat = [(r, v, len(list(g))) for r in range(20) for v, g in groupby(a[r].tolist()) if v]
    assert sorted((r["row_"], r["value"], r["c1"] - r["c0"] + 1) for r in longest.collect()) == sorted(flat)
    assert {(r["row_"], r["col_"]): r["value"] for r in spans.pixels(longest).collect()} == {(r, c): a[r, c] for r, c in np.ndindex(a.shape) if a[r, c]}
    first, rest = longest.withColumn("c1", F.col("c0")), longest.withColumn("c0", F.col("c0") + 1).where("c0 <= c1")
    cut = first.unionByName(rest)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spans.to_spans(cut)) == key(longest)
    columns = ["label", "row0", "col0", "row1", "col1", "pixel_area"]
    assert key(ras.label_boxes(px).select(columns)) == key(ras.label_boxes(cut).select(columns))
    chains = lambda df, step: sorted(((r["label"], r["start"], r["next"], r["points"]) for r in outlines.side_chains(df, step).collect()), key=repr)
    for step in (4, 256):  # pixels, the longest spans and cut ones have the same sides
        assert chains(px, step) == chains(longest, step) == chains(cut, step)


def test_a_large_object_is_few_rows(spark):
    """A square of 16 million pixels: its mask has rows in proportion to its height."""
    n = 4000
    ring = [(1, i, x - 0.5, y - 0.5) for i, (x, y) in enumerate(((0.0, 0.0), (n, 0.0), (n, n), (0.0, n)))]
    m = geo.rasterize(spark.createDataFrame([(a, b, float(x), float(y)) for a, b, x, y in ring], "object_id long, vertex_no int, x double, y double"), n + 10, n + 10)
    assert m.count() == n * -(-n // spans.COLS)
    assert ras.label_boxes(m).first()["pixel_area"] == n * n


def snail(turns):
    """A way of one label that winds inwards, with a gap of one pixel: its outline passes through all blocks."""
    n = 4 * turns + 3
    a = np.zeros((n, n), int)
    for k in range(0, 2 * turns, 2):
        a[k, max(k - 2, 0) : n - k] = a[k : n - k, n - k - 1] = a[n - k - 1, k : n - k] = 1
        a[k + 2 : n - k, k] = 1
    return a


@pytest.mark.parametrize("step", [4, 16])
def test_outlines_over_blocks(spark, tmp_path, step):
    """Rings in long form, ranked over blocks of any size, are those linked in one task, point by point."""
    rng = np.random.default_rng(step)
    a = np.zeros((60, 60), int)
    a[:59, :59] = snail(14)
    for k in range(2, 9):
        r, c = rng.integers(0, 50, 2)
        a[r : r + 9, c : c + 9] = k
    a[rng.random(a.shape) < 0.05] = 0
    px = spark.createDataFrame([(int(r), int(c), int(a[r, c])) for r, c in np.ndindex(a.shape)], "row_ int, col_ int, value int")
    want = {r["object_id"]: [(p["x"], p["y"]) for p in r["ring"]] for r in geo.polygons_from_labels(px, tolerance=0.0, least=1).collect()}
    got = {}
    for r in outlines.outlines(px, f"file://{tmp_path}/o", step).orderBy("object_id", "vertex_no").collect():
        got.setdefault(r["object_id"], []).append((r["vertex_no"], (r["x"], r["y"])))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: list(range(len(v))) for k, v in want.items()}
    assert {k: [p for _, p in v] for k, v in got.items()} == want


def test_paths_and_rings():
    after = np.array([3, -1, 5, 1, 6, 2, 8, 7, 4])  # 0 3 1; 2 5; 4 6 8; 7
    order, begins, ring = outlines.ordered(after)
    assert order.tolist() == [0, 3, 1, 2, 5, 4, 6, 8, 7] and begins.tolist() == [0, 3, 5, 8] and ring.tolist() == [False, True, True, True]
    assert [len(x) for x in outlines.ordered(np.zeros(0, np.int64))] == [0, 0, 0]


def test_closed_chains_are_not_ranked(spark, tmp_path):
    """A ring inside one block takes no part in the rounds; one across blocks does, and both come out."""
    t = spark.createDataFrame([(r, c, c + 2, v) for c, v in ((2, 1), (7, 2)) for r in (2, 3, 4)], "row_ long, c0 long, c1 long, value long")
    path = f"file://{tmp_path}/o"
    got = [tuple(r) for r in outlines.outlines(t, path, 8).groupBy("object_id").agg(F.count("*"), F.countDistinct("vertex_no"), F.max("vertex_no")).orderBy("object_id").collect()]
    assert got == [(1, 12, 12, 11), (2, 12, 12, 11)]
    chains = spark.read.parquet(f"{path}/chains")
    closed = {r["start"] for r in chains.where("next is null").collect()}
    assert closed and not closed & {r["node"] for r in spark.read.parquet(f"{path}/least/0").collect()}


def test_what_is_shuffled(spark):
    """A mask is drawn with a shuffle of rings and one of spans; chains hold numbers; no column goes along twice."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    square = [(i, k, float(x + i % 3), float(y)) for i in range(1, 40) for k, (x, y) in enumerate([(0, 0), (5, 0), (5, 5), (0, 5)])]
    drawn = geo.rasterize(spark.createDataFrame(square, "object_id long, vertex_no int, x double, y double"), 20, 20)
    assert plan(drawn).count("RepartitionByExpression") == 2
    assert pixels_of(drawn) == {(r, c): max(i for i in range(1, 40) if i % 3 <= c < i % 3 + 5) for r in range(5) for c in range(7)}
    assert outlines.numbered_chains(drawn).schema["sides"].dataType.simpleString() == "array<bigint>"
    traced = geo.polygons_from_labels(drawn, tolerance=0.0)
    assert {(r["object_id"], r["pixel_area"]) for r in traced.collect()} == {(38, 10), (39, 25)}  # 38 covers what 39 leaves of 37
    assert plan(traced).count("Join") == 1  # rings are in no join
    rows = [(1, 2, 3.0, 4.0), (1, 1, 9.0, 9.0), (1, 2, 3.0, 2.0), (1, 2, 1.0, 7.0)]
    t = poly.load_boundaries(spark.createDataFrame(rows, "k int, no int, a double, b double"), ["no", "a", "b", "k"], {"object_id": "k", "x": "a", "y": "b"})
    assert [(r["x"], r["y"]) for r in t.orderBy("vertex_no").collect()] == [(9.0, 9.0), (1.0, 7.0), (3.0, 2.0), (3.0, 4.0)]
    moved = plan(t).split("RepartitionByExpression")[1].split("Project [")[1].split("]")[0]
    assert len(moved.split(", ")) == 4
