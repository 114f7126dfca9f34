"""The driver's tables seen as points, boundaries, attributes, categories and rasters, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.grid import Grid, with_cells, with_tiles
from lattica.operators import extent as ext
from lattica.operators import points as pts

DEPTH = 4
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
VERTEX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_points(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select(*KEY, F.col("p_brand").alias("feature_name"), F.col("l_extendedprice").alias("x_location"), (F.col("l_quantity") * 2000.0 + (F.col("l_suppkey") % 100) * 20.0).alias("y_location"), (F.col("l_discount") * 400.0).alias("qv"), (F.col("l_linestatus") == "O").alias("is_gene"))


def good_points(spark: SparkSession, d: str) -> DataFrame:
    return pts.load_points(raw_points(spark, d), keep=KEY)


def grid(df: DataFrame, depth: int = DEPTH, x: str = "x", y: str = "y") -> Grid:
    """The grid around a table: one row of extremes comes to the driver."""
    b = ext.extent(df, x, y).first()
    return Grid(*(float(b[k] or 0) for k in ext.BOUNDS), depth)


def point_grid(spark: SparkSession, d: str) -> Grid:
    return grid(good_points(spark, d))


def coded(spark: SparkSession, d: str) -> DataFrame:
    p = good_points(spark, d)
    return pts.encode(p, pts.gene_table(p))


def tiled(spark: SparkSession, d: str) -> DataFrame:
    g = point_grid(spark, d)
    return with_tiles(with_cells(coded(spark, d), g), g)


def draw():
    return pts.mix_hash(*KEY, method="md5")


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*VERTEX_ORDER)
    t = table(spark, d, "lineitem").withColumn("vertex_no", F.row_number().over(w) - 1)
    return t.select(F.col("l_orderkey").alias("object_id"), "vertex_no", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 2000.0).alias("y"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_totalprice").alias("cell_area"), F.col("o_orderstatus").alias("status"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("barcode"), (F.col("o_custkey") % 7 + 1).alias("cluster"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Squares as rings in long form, one per order, at places spread over the points' extent."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), (F.col("o_totalprice") % 105000).alias("x0"), ((F.col("o_custkey") % 1000) * 100.0).alias("y0"), (F.col("o_orderkey") % 300 + 200.0).alias("s"))
    ring = F.array(*[F.struct((F.col("x0") + F.col("s") * i).alias("x"), (F.col("y0") + F.col("s") * j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return t.select("object_id", ring.alias("ring"))


def small_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Squares of 3 to 10 pixels in long form; later ones cover earlier ones. The raster is 800 pixels high and
    gets 1000 columns for each 65536 order keys."""
    t = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("object_id"), (F.col("o_custkey") * 7 % 990 + F.floor(F.col("o_orderkey") / 65536) * 1000).cast("double").alias("x0"), (F.col("o_orderkey") * 13 % 790).cast("double").alias("y0"), (F.col("o_orderkey") % 8 + 3.0).alias("s"))
    ring = F.array(*[F.struct((F.col("x0") + F.col("s") * i - 0.5).alias("x"), (F.col("y0") + F.col("s") * j - 0.5).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return t.select("object_id", F.posexplode(ring).alias("vertex_no", "v")).select("object_id", "vertex_no", "v.x", "v.y")


def mask_width(spark: SparkSession, d: str) -> int:
    return 1000 * ((table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // 65536 + 1)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_"), F.posexplode("embedding").alias("col_", "v"), "label")
    return t.select("row_", "col_", F.floor((F.col("v").cast("double") + 1.0) * 1000.0).cast("bigint").alias("value"), "label", "v")


def channels(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select((F.col("row_") % 3).alias("channel"), F.floor(F.col("row_") / 3).alias("row_"), "col_", "value")


def mask(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("row_", "col_", F.when(F.col("v") > 0, F.col("label")).otherwise(0).cast("bigint").alias("value"))


SQL = {
    "points": "points as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand as feature_name, l_extendedprice as x_location, l_quantity * 2000.0e0 + (l_suppkey % 100) * 20.0e0 as y_location, l_discount * 400.0e0 as qv, l_linestatus = 'O' as is_gene from lineitem join part on l_partkey = p_partkey)",
    "good": "good as (select feature_name as name, x_location as x, y_location as y, l_orderkey, l_linenumber, l_partkey, l_suppkey from points where qv >= 20 and is_gene)",
    "genes": "genes as (select (row_number() over (order by name) - 1)::int as gene_id, name, count(*) as count from good group by name)",
    "b": "b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy, greatest(max(x) - min(x), max(y) - min(y)) as span from good)",
    "tiled": "tiled as (select *, gy >> 12 as tile_row, gx >> 12 as tile_col from (select g.*, gene_id, greatest(0, least(65535, floor((x - minx) / span * 65536)))::int as gx, greatest(0, least(65535, floor((y - miny) / span * 65536)))::int as gy from good g join genes using (name), b))",
    "boundaries": "boundaries as (select l_orderkey as object_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as vertex_no, l_extendedprice as x, l_quantity * 2000.0e0 as y from lineitem)",
    "edges": "edges as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from boundaries window w as (partition by object_id order by vertex_no))",
    "objects": "objects as (select object_id, count(*) as n_vertices, avg(x) as cx, avg(y) as cy, abs(sum(x * y2 - x2 * y)) / 2 as area from edges group by object_id)",
    "cells": "cells as (select o_orderkey as object_id, o_totalprice as cell_area, o_orderstatus as status from orders)",
    "clusters": "clusters as (select o_orderkey as barcode, o_custkey % 7 + 1 as cluster from orders where o_orderpriority <> '5-LOW')",
    "boxes": "boxes as (select o_orderkey as object_id, o_totalprice % 105000 as x0, (o_custkey % 1000) * 100.0e0 as y0, o_orderkey % 300 + 200.0e0 as s from orders)",
    "small": "small as (select o_orderkey + 1 as object_id, o_custkey * 7 % 990 + o_orderkey // 65536 * 1000 as x0, o_orderkey * 13 % 790 as y0, o_orderkey % 8 + 3 as s from orders)",
    "pixels": "pixels as (select vec_id as row_, pos - 1 as col_, floor((v::double + 1.0) * 1000.0)::bigint as value, label, v from (select vec_id, label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as v from embeddings))",
    "channels": "channels as (select row_ % 3 as channel, row_ // 3 as row_, col_, value from pixels)",
    "mask": "mask as (select row_, col_, case when v > 0 then label else 0 end::bigint as value from pixels)",
    "boxes_of": "boxes_of as (select value as label, min(row_) as row0, min(col_) as col0, max(row_) as row1, max(col_) as col1, count(*) as pixel_area from mask where value <> 0 group by value)",
}
NEEDS = {"good": ["points"], "genes": ["good"], "b": ["good"], "tiled": ["genes", "b"], "edges": ["boundaries"], "objects": ["edges"], "channels": ["pixels"], "mask": ["pixels"], "boxes_of": ["mask"]}


def with_(*names: str, more: str = "") -> str:
    """The WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join([SQL[n] for n in order] + ([more] if more else [])) + " "
