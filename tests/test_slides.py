"""Layouts of dataset folders, commits of layers, stored indexes and domains."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import grid as gr
from lattica.operators import features as feat
from lattica.operators import geometry as geo
from lattica.operators import polygons as poly
from lattica.sources import layouts, manifest, slide, store


def square(id_, x, y, s):
    return [(id_, i, float(a), float(b)) for i, (a, b) in enumerate(((x, y), (x + s, y), (x + s, y + s), (x, y + s)))]


def vertices(spark, rows):
    return spark.createDataFrame(rows, "object_id long, vertex_no int, x double, y double")


def mask(spark, a):
    return spark.createDataFrame([(int(r), int(c), int(a[r, c])) for r, c in np.ndindex(a.shape)], "row_ int, col_ int, value int")


def boundary(spark, path, rows):
    vertices(spark, rows).select(F.col("object_id").alias("cell_id"), F.col("x").alias("vertex_x"), F.col("y").alias("vertex_y"), "vertex_no").coalesce(1).sortWithinPartitions("cell_id", "vertex_no").drop("vertex_no").write.parquet(path)


def clustering(spark, path, value):
    """One CSV file, as other programs write it."""
    fs, p = store.reach(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(f"Barcode,Cluster\n1,{value}\n".encode()))
    out.close()


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('data')}/in"
    boundary(spark, f"{root}/cell_boundaries.parquet", square(1, 0, 0, 20) + square(2, 50, 50, 30))
    boundary(spark, f"{root}/nucleus_boundaries.parquet", square(1, 5, 5, 5))
    spark.createDataFrame([(1, 5.0), (2, 6.0)], "cell_id int, total double").write.parquet(f"{root}/cells.parquet")
    for k, name in enumerate(("gene_expression_kmeans_10_clusters", "gene_expression_kmeans_9_clusters", "gene_expression_graphclust")):
        clustering(spark, f"{root}/analysis/clustering/{name}/clusters.csv", k + 1)
    clustering(spark, f"{root}/clusters/graphclust.csv", 99)  # the other layout has it too
    clustering(spark, f"{root}/clusters/extra.csv", 7)
    labels = np.zeros((40, 40), int)
    labels[4:14, 4:14] = 1
    for name in ("cell", "other"):
        mask(spark, labels).write.parquet(f"{root}/labels/{name}.parquet")
    for path in ("images/b.parquet", "images/DAPI.parquet", "morphology_focus/ch0.parquet", "morphology_focus.parquet"):
        mask(spark, np.ones((60, 10), int)).write.parquet(f"{root}/{path}")
    return root


def test_layouts_and_precedence(spark, dataset):
    found = slide.discover(spark, dataset)
    assert [(s["kind"], s["id"], s.get("visible")) for s in found] == [("image", "DAPI", None), ("image", "b", None), ("segments", "cell", True), ("segments", "nucleus", False), ("segments", "other", True)]
    cell = next(s for s in found if s["id"] == "cell")
    assert not cell.get("mask") and [c for c, _ in cell["categories"]] == ["cluster", "kmeans_9", "kmeans_10", "extra"]
    assert "analysis/clustering" in dict(cell["categories"])["cluster"]
    assert [layouts.clustering_name(n) for n in ("gene_expression_graphclust", "gene_expression_kmeans_2_clusters", "graphclust.csv", "own")] == ["cluster", "kmeans_2", "cluster", "own"]
    over = slide.discover(spark, dataset, [(f"{dataset}/morphology_focus/ch0.parquet", "red")])
    assert [(s["id"], s["colormap"]) for s in over if s["kind"] == "image"] == [("ch0", "red")]
    assert slide.discover(spark, f"{dataset}/nothing") == []


def test_import_with_other_images(spark, dataset, tmp_path):
    out = f"file://{tmp_path}/s"
    m = slide.import_folder(spark, dataset, out, "s", images=[(f"{dataset}/morphology_focus/ch0.parquet", "red"), (f"{dataset}/images/b.parquet", None)])
    assert [(l["id"], l["kind"], l["visible"], l["colormap"]) for l in slide.layers(spark, out).orderBy("position").collect()] == [
        ("ch0", "image", True, "red"), ("b", "image", True, "green"), ("cell", "segments", True, "viridis"), ("nucleus", "segments", False, "viridis"), ("other", "segments", True, "viridis"),
    ]
    rows = {r["object_id"]: r for r in spark.read.parquet(f"{slide.layer_path(m, out, 'cell')}/features").collect()}
    assert (rows[1]["cluster"], rows[1]["kmeans_9"], rows[1]["extra"], rows[2]["cluster"]) == ("3", "2", "7", None)
    assert slide.add_segments_from(spark, out, f"{dataset}/labels/cell.parquet")["layers"][-1]["id"] == "cell-2"
    m = slide.add_segments_from(spark, out, f"{dataset}/cell_boundaries.parquet", "again", f"{dataset}/cells.parquet", {"k": f"{dataset}/clusters/extra.csv"})
    assert m["layers"][-1]["categoricals"] == ["k"] and [a["id"] for a in m["added"]] == ["cell-2", "again"]
    assert {(r["object_id"], r["total"], r["k"]) for r in spark.read.parquet(f"{slide.layer_path(m, out, 'again')}/features").collect()} == {(1, 5.0, "7"), (2, 6.0, None)}
    big = mask(spark, np.eye(400, dtype=int))
    big.write.parquet(f"file://{tmp_path}/big.parquet")
    with pytest.raises(ValueError):  # before it is traced
        slide.add_segments_from(spark, out, f"file://{tmp_path}/big.parquet")


def test_a_failed_import_leaves_the_slide(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    cells = vertices(spark, square(1, 0, 0, 20) + square(2, 50, 50, 30))
    m = slide.import_slide(spark, root, "first", segments={"cells": cells})
    broken = cells.withColumn("x", F.when(F.col("object_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    points = spark.createDataFrame([("a", 1.0, 1.0)], "feature_name string, x_location double, y_location double")
    with pytest.raises(Exception, match="no"):
        slide.import_slide(spark, root, "second", points, {"cells": broken})
    with pytest.raises(Exception):  # after a layer was written
        slide.import_slide(spark, root, "second", points, {"cells": cells}, attributes=cells.select("object_id", F.raise_error(F.lit("no")).alias("v")))
    assert slide.read_manifest(spark, root)["name"] == "first"
    slide.check_layers(spark, root)
    assert spark.read.parquet(f"{slide.layer_path(m, root, 'cells')}/features").count() == 2
    again = slide.import_slide(spark, root, "second", segments={"cells": cells})
    assert slide.read_manifest(spark, root)["name"] == "second" and again["version"] == 2
    assert not store.exists(spark, slide.layer_path(m, root, "cells"))  # the first one's layers are gone
    with pytest.raises(ValueError):
        slide.import_slide(spark, root, "third")


def test_layers_added_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    cells = vertices(spark, square(1, 0, 0, 20) + square(2, 50, 50, 30))
    slide.import_slide(spark, root, "s", segments={"cells": cells})
    errors = []

    def add():
        try:
            slide.add_segments(spark, root, "cells", cells)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert [l["id"] for l in slide.read_manifest(spark, root)["layers"]] == ["cells", "cells-2", "cells-3", "cells-4", "cells-5"]
    slide.check_layers(spark, root)


def test_a_commit_sees_what_came_between(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    base = {"format": 1, "layers": []}
    assert manifest.latest(spark, root) is None
    manifest.commit(spark, root, lambda old: base)
    seen = []

    def late(old):
        seen.append([l["id"] for l in old["layers"]])
        if len(seen) == 1:  # someone else is faster
            manifest.commit(spark, root, lambda o: base | {"layers": [*o["layers"], {"id": "theirs", "kind": "points"}]})
        return base | {"layers": [*old["layers"], {"id": "mine", "kind": "points"}]}

    assert manifest.commit(spark, root, late)["version"] == 3
    assert seen == [[], ["theirs"]] and [l["id"] for l in slide.read_manifest(spark, root)["layers"]] == ["theirs", "mine"]
    assert not store.create(spark, f"{root}/manifests/00000003.json", "{}")


def test_tile_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    path, g = f"file://{tmp_path}/p", gr.Grid(0, 0, 100, 100, 3)
    rows = [(f"g{int(k)}", float(x), float(y)) for k, x, y in zip(rng.integers(0, 6, 400), rng.uniform(0, 60, 400), rng.uniform(0, 100, 400))]
    slide.write_point_layer(spark.createDataFrame(rows, "name string, x double, y double"), path, g)
    for level in range(4):
        tiles = slide.point_tiles(spark, path, level)
        want = {(r["tile_row"], r["tile_col"], r["n"], r["p"], r["a"], r["z"]) for r in tiles.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("count").alias("p"), F.min("gene_id").alias("a"), F.max("gene_id").alias("z")).collect()}
        assert {(r["tile_row"], r["tile_col"], r["rows"], r["points"], r["first_gene"], r["last_gene"]) for r in slide.tile_index(spark, path, level).collect()} == want
        some = {(r["tile_row"], r["tile_col"]) for r in slide.tile_index(spark, path, level, [0]).collect()}
        assert some == {(t[0], t[1]) for t in want if t[4] == 0} and slide.tile_index(spark, path, level, []).count() == 0
    assert {(r[0], r[1]) for r in gr.coarser_tiles(slide.tile_index(spark, path), 1).collect()} == {(r["tile_row"], r["tile_col"]) for r in slide.tile_index(spark, path, 1).collect()}


def test_domains_from_ranges(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0, 1, 3000), "b": rng.integers(-3, 3, 3000).astype(float), "c": np.exp(rng.normal(0, 30, 3000)), "d": np.full(3000, 7.0), "e": np.where(rng.random(3000) < 0.99, 0.0, 5.0)}
    values["a"][:5], values["c"][0], values["c"][1] = np.nan, np.inf, 5e-324
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*values.values())], ", ".join(f"{c} double" for c in values)).repartition(3)
    parts = df.where("b < 0"), df.where("b >= 0")
    ranges = feat.merged_ranges(*[feat.value_ranges(p, list(values)) for p in parts])
    got = {r["column"]: (r["lo"], r["hi"], r["n"]) for r in feat.domains(df, ranges).collect()}
    for c in values:
        assert got[c][:2] == tuple(feat.robust_domain(df, c).first()), c
        assert got[c][2] == df.where(F.col(c).isNotNull()).count()
    assert feat.domains(df, feat.value_ranges(df, [])).count() == 0


def test_views_read_the_rectangle_only(spark, tmp_path):
    path, g = f"file://{tmp_path}/c", gr.Grid(0, 0, 400, 400, 3)
    cells = vertices(spark, [r for i in range(64) for r in square(i, (i % 8) * 50 + 5, (i // 8) * 50 + 5, 10 + i)])
    slide.write_segment_layer(cells, path, g)
    view = slide.view_polygons(spark, path, g, (0, 0, 99, 49), "area")
    want = {i: 0 if i < 2 else None for i in range(2)}
    assert view.count() == len(want)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = view.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("LessThanOrEqual(tile_col,1)") == 2  # of the shapes and of the features
    lo, hi = feat.robust_domain(spark.read.parquet(f"{path}/features"), "area").first()
    table = spark.read.parquet(f"{path}/features").where("object_id < 2").select("cell_id", feat.ramp_position(F.col("area"), F.lit(lo), F.lit(hi)).alias("colour"))
    assert sorted(map(tuple, view.select("cell_id", "colour").collect())) == sorted(map(tuple, table.collect()))


def test_segment_layer_puts_rings_together_once(spark, tmp_path):
    """The vertices are read once for features, shapes and their sampled ranges; the shapes kept for that go."""
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    rows = [(i, j, x + 10.0 * i, y) for i in range(50) for j, (x, y) in enumerate(((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)))]
    kind = "object_id long, vertex_no int, x double, y double"
    cells = spark.createDataFrame(rows, kind)
    path = f"file://{tmp_path}/layer"
    slide.write_segment_layer(cells.mapInArrow(counted, kind), path, gr.Grid(0, 0, 500, 500, 2))
    assert n.value == len(rows)
    assert not (tmp_path / "layer" / "shapes").exists()
    assert {(r["object_id"], r["n_vertices"], r["area"], r["x_centroid"]) for r in spark.read.parquet(f"{path}/features").collect()} == {(i, 4, 12.0, 10.0 * i + 2) for i in range(50)}
    one = lambda t: sorted(map(tuple, t.select("object_id", "n_vertices", "cx", "cy", "area").collect()))
    assert one(geo.shapes(poly.rings(cells))) == one(poly.summaries(cells))
    odd = spark.createDataFrame([(1, 0, 0.1, 0.2), (1, 1, None, 3.0), (1, 2, 5.7, 0.3), (2, 0, None, None), (3, 0, 1.1, 2.2)], kind)
    assert one(geo.shapes(poly.rings(odd))) == one(poly.summaries(odd))
