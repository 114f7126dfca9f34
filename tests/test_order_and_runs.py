"""Rows of tables in several files, and runs over whole tables."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lattica.operators import features as feat
from lattica.operators import runs
from lattica.sources import order as files
from lattica.sources import slide


def in_files(spark, path, parts, schema, kind="parquet"):
    """Files part-00000 on, in the given order, each of one row group."""
    for i, rows in enumerate(parts):
        t = f"{path}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.format(kind).option("header", True).save(t)
    for i in range(len(parts)):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        p = fs.Path(f"{path}-{i}")
        f = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        f.mkdirs(fs.Path(path))
        one = next(s.getPath() for s in f.listStatus(p) if s.getPath().getName().startswith("part-"))
        assert f.rename(one, fs.Path(f"{path}/part-{i * 33334:05d}-x.{kind}"))


@pytest.mark.parametrize("sizes", [(5, 5), (1, 7, 1, 1), (9, 1)])
def test_a_ring_over_files(spark, tmp_path, sizes):
    """Files of any sizes, of part numbers of five digits and six: the ring is that of the single file."""
    ring = [(7, float(i), float(i * i)) for i in range(10)]
    at, parts = 0, []
    for n in sizes:
        parts.append(ring[at : at + n])
        at += n
    in_files(spark, f"file://{tmp_path}/b", parts, "cell_id int, vertex_x double, vertex_y double")
    got = slide.load_segments(spark, {"path": f"file://{tmp_path}/b"}, [])
    assert [r["x"] for r in got.orderBy("vertex_no").collect()] == [float(i) for i in range(10)]


def test_rows_carry_no_file_names(spark, tmp_path):
    """The place of a row in files of long names is one number; a folder's name may have any character."""
    path = f"file://{tmp_path}/a b%20c\u00e9+{'long' * 40}"
    in_files(spark, path, [[(7, 0.0, 1.0), (8, 5.0, 5.0)], [(7, 1.0, 0.0)], [(7, 2.0, 2.0), (7, 0.0, 1.0)]], "cell_id int, vertex_x double, vertex_y double")
    t, names = files.placed(spark.read.parquet(path))
    assert [t.schema[c].dataType.simpleString() for c in names] == ["bigint"] and "_path" not in t.columns
    assert [r["vertex_x"] for r in t.orderBy(*names).collect()] == [0.0, 5.0, 1.0, 2.0, 0.0]
    got = slide.load_segments(spark, {"path": path}, []).orderBy("object_id", "vertex_no").collect()
    assert [tuple(r) for r in got] == [(7, 0, 0.0, 1.0), (7, 1, 1.0, 0.0), (7, 2, 2.0, 2.0), (8, 0, 5.0, 5.0)]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_the_first_row_of_the_first_file(spark, tmp_path, kind):
    big = [(i % 50, i + 1000) for i in range(5000)]
    in_files(spark, f"file://{tmp_path}/t", [[(1, 1), (2, 2), (1, 3)], big, [(99, 9), (1, 0)]], "k int, v int", kind)
    t = spark.read.format(kind).option("header", True).option("inferSchema", True).load(f"file://{tmp_path}/t")
    got = {r["k"]: r["v"] for r in feat.first_per_key(t.where("v <> 2"), "k").collect()}
    assert got == {i: 1000 + i for i in range(50)} | {1: 1, 99: 9}
    objects = spark.createDataFrame([("1",), ("99",), ("x",)], "object_id string")
    assert {tuple(r) for r in feat.join_categories(objects, {"c": t}).collect()} == {("1", 1), ("99", 9), ("x", None)}


def want_runs(keys):
    out, at = [], 0
    for k, g in groupby(keys):
        n = len(list(g))
        out.append((len(out) + 1, k, n))
        at += n
    return out


@pytest.mark.parametrize("bits", [0, 2, 18])
def test_runs_over_files(spark, tmp_path, bits):
    """Runs that end with a block, cover many, and go from file to file; nulls are a key too."""
    rng = random.Random(bits)
    parts = [[(k,) for k in rng.choices(["a", "b", None], k=rng.randint(1, 6)) for _ in range(rng.randint(1, 9))] for _ in range(4)]
    parts += [[("b",)] * 30, [("b",)], [(None,)]]
    in_files(spark, f"file://{tmp_path}/r", parts, "k string")
    keys = [k for part in parts for (k,) in part]
    t, block, at = files.file_blocks(spark.read.parquet(f"file://{tmp_path}/r"), bits)
    got = sorted((r["run"], r["key"], r["length"]) for r in runs.run_table(t, "k", block, at).collect())
    assert got == want_runs(keys)
    rows = runs.numbered_runs(t, "k", block, at).orderBy(block, at).collect()
    assert [r["run"] for r in rows] == [n for n, _, length in want_runs(keys) for _ in range(length)]
    assert tuple(runs.grouped_already(t, "k", block, at).first()) == (3, len(got), False)


def test_grouped_and_empty_tables(spark, tmp_path):
    in_files(spark, f"file://{tmp_path}/g", [[(1,)] * 3 + [(5,)], [(5,), (None,), (None,)], [(None,), (2,)]], "k int")
    t, block, at = files.file_blocks(spark.read.parquet(f"file://{tmp_path}/g"), 1)
    assert tuple(runs.grouped_already(t, "k", block, at).first()) == (4, 4, True)
    none = t.where("k > 100")
    assert tuple(runs.grouped_already(none, "k", block, at).first()) == (0, 0, True)
    assert runs.run_table(none, "k", block, at).count() == 0
    with pytest.raises(ValueError):
        files.file_blocks(t.groupBy("k").count())


def test_runs_by_another_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab")) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, 500), "t int, k string").repartition(4)
    t, block, at = runs.range_blocks(df, ["t"], f"file://{tmp_path}/o", 7)
    assert sorted((r["run"], r["key"], r["length"]) for r in runs.run_table(t, "k", block, at).collect()) == want_runs([k for _, k in rows])
    assert t.select(F.countDistinct(block)).first()[0] > 3
