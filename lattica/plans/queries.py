"""One query per operator over the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import grid as gr
from lattica.operators import chunks as ch
from lattica.operators import extent as ext
from lattica.operators import features as feat
from lattica.operators import geometry as geo
from lattica.operators import points as pts
from lattica.operators import polygons as poly
from lattica.operators import raster as ras
from lattica.operators import runs, spans
from lattica.operators.outlines import outlines
from lattica.sources import order as files
from lattica.sources import slide

from . import tables as T
from .tables import with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
RECT = (20000.0, 20000.0, 60000.0, 70000.0)
TILE = ["tile_row", "tile_col"]
#: Rows of a file of a table that a query writes in order; a task sorts the rows of its file.
FILE_ROWS = 1 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder; a temporary one only where that is unset and driver and
    executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/layers-{uuid.uuid4().hex}"


def r(c, n=6):
    return F.round(c, n)


# Scans, sources, sinks


@query(with_("good") + "select name, x, y, l_orderkey, l_linenumber from good")
def s1_scan_points(spark, d):
    return pts.load_points(T.raw_points(spark, d), keep=("l_orderkey", "l_linenumber"))


@query(with_("boundaries") + "select object_id, vertex_no, x, y from boundaries b where not (vertex_no = (select max(vertex_no) from boundaries m where m.object_id = b.object_id) and vertex_no >= 3 and exists (select 1 from boundaries f where f.object_id = b.object_id and f.vertex_no = 0 and f.x = b.x and f.y = b.y))")
def s2_scan_boundaries(spark, d):
    t = T.table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "cell_id", "l_extendedprice": "vertex_x"}).withColumns({"vertex_y": F.col("l_quantity") * 2000.0, "l_extendedprice": F.col("vertex_x")})
    return poly.load_boundaries(t, list(T.VERTEX_ORDER))


@query("select l_suppkey as object_id, row_number() over (partition by l_suppkey order by l_linenumber, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 as vertex_no, l_extendedprice as x, l_quantity as y from lineitem")
def s2_boundary_files(spark, d):
    """A boundary table in eight files, or more so that none has far over FILE_ROWS rows, each with a few vertices of
    every ring: rings go on from file to file."""
    path, by = folder(spark), ["l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    lines = T.table(spark, d, "lineitem")
    lines.repartitionByRange(max(8, math.ceil(lines.count() / FILE_ROWS)), *by).sortWithinPartitions(*by).write.parquet(path)
    named = {"object_id": "l_suppkey", "x": "l_extendedprice", "y": "l_quantity"}
    return slide.load_segments(spark, {"path": path, "named": named}, [])


@query("select o_orderkey as id, o_totalprice as cell_area, o_orderstatus as status from orders")
def s3_scan_attributes(spark, d):
    return T.cells(spark, d).withColumnRenamed("object_id", "id")


@query(with_("clusters") + "select barcode::varchar as id, cluster::varchar as category from clusters")
def s4_scan_category_csv(spark, d):
    path = folder(spark)
    T.clusters(spark, d).toDF("Barcode", "Cluster").write.csv(path, header=True)
    return spark.read.csv(path, header=True).toDF("id", "category")


@query(with_("good") + "select 0 as position, 'points' as id, 'points' as kind, 'points' as path, 'points' as name, true as visible, 4 as levels from (select count(*) from good)")
def s6_read_manifest(spark, d):
    path = folder(spark)
    g = T.point_grid(spark, d)
    found = [{"id": "points", "kind": "points", "path": "points", "levels": g.depth}, {"id": "x", "kind": "later"}]
    slide.write_manifest(spark, path, {"format": 1, "name": "s", "world_bounds": [g.minx, g.miny, g.maxx, g.maxy], "tile_depth": g.depth, "layers": found})
    return slide.layers(spark, path).select("position", "id", "kind", "path", "name", "visible", "levels")


LEVELS_SQL = with_("tiled", more="""
lv as (select *, md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) as draw,
  greatest(0, least(255, floor((x - minx) / span * 256)))::int as bx, greatest(0, least(255, floor((y - miny) / span * 256)))::int as by_ from tiled, b),
levels as (select k.level, (by_ >> (k.level - 1)) >> 5 as tile_row, (bx >> (k.level - 1)) >> 5 as tile_col, by_ >> (k.level - 1) as bin_row, bx >> (k.level - 1) as bin_col, gene_id,
  first(x order by draw, x, y) as x, first(y order by draw, x, y) as y, count(*) as count from lv, (select unnest([1, 2, 3, 4]) as level) k group by all)""")


def levels(spark, d):
    return pts.point_levels(T.coded(spark, d), T.point_grid(spark, d), T.draw())


@query(with_("tiled", more="t as (select 0 as level, tile_row, tile_col, gene_id, x, y, 1 as count from tiled)") + "select tile_row, tile_col, gene_id, count(*) as n, sum(count)::bigint as total, round(sum(x), 3) as sx from t group by all")
def s9_write_point_tiles(spark, d):
    path, g = folder(spark), T.point_grid(spark, d)
    slide.write_point_layer(T.good_points(spark, d), path, g)
    return slide.point_tiles(spark, path, 0).groupBy(*TILE, "gene_id").agg(F.count("*").alias("n"), F.sum("count").alias("total"), r(F.sum("x"), 3).alias("sx"))


OBJECT_TILES = """ob as (select min(x) as minx, min(y) as miny, greatest(max(x) - min(x), max(y) - min(y)) as span from boundaries),
placed as (select o.*, greatest(0, least(65535, floor((cx - minx) / span * 65536)))::int as gx, greatest(0, least(65535, floor((cy - miny) / span * 65536)))::int as gy from objects o, ob),
otiles as (select *, gy >> 12 as tile_row, gx >> 12 as tile_col from placed)"""
HILBERT_OBJECTS = OBJECT_TILES + ", " + gr.hilbert_sql("otiles", "object_id, n_vertices, tile_row, tile_col, gx, gy, area, cx, cy") + ", ranked as (select *, h as hilbert, row_number() over (order by h, object_id) - 1 as cell_id from h16)"


def object_grid(spark, d):
    return T.grid(T.boundaries(spark, d))


def ranked(spark, d):
    return poly.dense_ids(poly.placed(poly.summaries(T.boundaries(spark, d)), object_grid(spark, d)))


@query(with_("objects", more=HILBERT_OBJECTS) + "select cell_id, tile_row, tile_col, n_vertices + 1 as closed from ranked")
def s10_write_polygon_tiles(spark, d):
    path, g = folder(spark), object_grid(spark, d)
    slide.write_segment_layer(T.boundaries(spark, d), path, g)
    return slide.polygon_tiles(spark, path, g, (g.minx, g.miny, g.maxx, g.maxy)).select("cell_id", *TILE, F.size("ring").cast("long").alias("closed"))


@query(with_("objects", "cells", "clusters", more=HILBERT_OBJECTS) + "select r.cell_id, r.object_id, c.cell_area, coalesce(k.cluster, -1) as cluster from ranked r left join cells c using (object_id) left join clusters k on k.barcode = r.object_id")
def s11_write_features(spark, d):
    path = folder(spark)
    slide.write_segment_layer(T.boundaries(spark, d), path, object_grid(spark, d), T.cells(spark, d), {"cluster": T.clusters(spark, d)})
    return spark.read.parquet(f"{path}/features").select("cell_id", "object_id", "cell_area", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query(with_("genes") + "select * from genes")
def s12_write_gene_table(spark, d):
    path = folder(spark)
    pts.gene_table(T.good_points(spark, d)).orderBy("gene_id").write.parquet(path)
    return spark.read.parquet(path)


@query(with_("tiled") + "select tile_row, tile_col, gene_id, x, y from tiled where tile_row between 3 and 9 and tile_col between 2 and 11 and gene_id in (1, 3, 5)")
def s13_read_point_tiles(spark, d):
    path, g = folder(spark), T.point_grid(spark, d)
    slide.write_point_layer(T.good_points(spark, d), path, g)
    t = slide.point_tiles(spark, path, 0).where(F.col("tile_row").between(3, 9) & F.col("tile_col").between(2, 11))
    return pts.pick_genes(t, [1, 3, 5]).select(*TILE, "gene_id", "x", "y")


@query(with_("objects", more=HILBERT_OBJECTS) + "select r.cell_id, case when t.i = r.n_vertices then 0 else t.i end as vertex_no, b.x, b.y from ranked r, unnest(range(0, r.n_vertices + 1)) as t(i) join boundaries b on b.object_id = r.object_id and b.vertex_no = case when t.i = r.n_vertices then 0 else t.i end")
def s14_read_closed_rings(spark, d):
    rings = poly.rings(T.boundaries(spark, d)).select("object_id", poly.closed("ring").alias("ring")).join(ranked(spark, d).select("object_id", "cell_id", "n_vertices"), "object_id")
    t = rings.select("cell_id", "n_vertices", F.posexplode("ring").alias("i", "v"))
    return t.select("cell_id", F.when(F.col("i") == F.col("n_vertices"), 0).otherwise(F.col("i")).cast("long").alias("vertex_no"), "v.x", "v.y")


@query(with_("pixels") + "select (row_ // 16) * 4 + col_ // 16 as block, count(*) as n, sum(value)::bigint as total from pixels group by 1")
def s17_raster_blocks(spark, d):
    t = ch.chunk_sums(ch.to_chunks(T.pixels(spark, d), (16, 16)))
    return t.select((F.col("chunk_row") * 4 + F.col("chunk_col")).cast("long").alias("block"), "n", "total")


@query(with_("channels") + "select channel, row_, col_, value from channels")
def s18_write_raster(spark, d):
    path = folder(spark)
    slide.write_image_layer(T.channels(spark, d), path, ras.Level((1.0, 1.0)), coarsest=16)
    return slide.image_pixels(spark, path, 0).withColumn("channel", F.col("channel").cast("long"))


@query(with_("pixels") + "select row_, col_, greatest(0, least(65535, floor(round((row_ // 64 + col_ // 64) % 2 * 20000 + (sin(row_ / 37.0e0) + cos(col_ / 53.0e0) + 2) * 5000, 6))))::int as value from pixels")
def s19_test_card(spark, d):
    return T.pixels(spark, d).select("row_", "col_", ras.card_value(F.col("row_"), F.col("col_")).alias("value"))


MASK_SQL = "drawn as (select row_, col_, max(object_id) as value from (select object_id, unnest(range(y0, y0 + s)) as row_, x0, s from small), unnest(range(x0, x0 + s)) as t(col_) group by all)"


@query(with_("small", more=MASK_SQL) + "select row_, col_, value from drawn")
def s20_write_label_mask(spark, d):
    path = folder(spark)
    geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800).write.parquet(path)
    return spans.pixels(spark.read.parquet(path)).select(F.col("row_").cast("long").alias("row_"), F.col("col_").cast("long").alias("col_"), "value")


# Projections, filters


@query("select l_extendedprice as x, l_quantity as q from lineitem")
def p1_pruned_scan(spark, d):
    return T.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"))


@query(with_("points") + "select feature_name as name, x_location as x, y_location as y from points where qv >= 20")
def p3_quality_filter(spark, d):
    return pts.load_points(T.raw_points(spark, d), genes_only=False)


@query(with_("points") + "select feature_name as name, x_location as x, y_location as y from points where is_gene")
def p4_control_filter(spark, d):
    return pts.load_points(T.raw_points(spark, d), min_qv=None)


@query(with_("tiled") + "select gene_id, x, y from tiled where gene_id in (0, 2, 7)")
def p5_gene_subset(spark, d):
    return pts.pick_genes(T.coded(spark, d).select("gene_id", "x", "y"), [0, 2, 7])


def rect_sql(rect=RECT):
    size = "(span / 16)"
    low = lambda v, m: f"greatest(0, floor(({v} - {m}) / {size}))"
    high = lambda v, m: f"least(15, ceil(({v} - {m}) / {size}) - 1)"
    return f"tile_row between {low(rect[1], 'miny')} and {high(rect[3], 'miny')} and tile_col between {low(rect[0], 'minx')} and {high(rect[2], 'minx')}"


@query(with_("tiled") + f"select tile_row, tile_col, gene_id, x, y from tiled, b where {rect_sql()}")
def p6_rectangle_tiles(spark, d):
    return gr.in_rect(T.tiled(spark, d), T.point_grid(spark, d), RECT).select(*TILE, "gene_id", "x", "y")


@query(with_("boxes_of") + "select * from boxes_of where pixel_area >= 4")
def p8_drop_specks(spark, d):
    return ras.drop_specks(ras.label_boxes(T.mask(spark, d)))


@query(with_("mask") + "select value, count(*) as n from mask where value <> 0 group by value")
def p9_drop_background(spark, d):
    return T.mask(spark, d).where("value <> 0").groupBy("value").agg(F.count("*").alias("n"))


@query(with_("boundaries") + "select object_id, count(*) as n from boundaries group by object_id having count(*) >= 3")
def p10_drop_degenerate_rings(spark, d):
    return poly.rings(T.boundaries(spark, d)).where(F.size("ring") >= 3).select("object_id", F.size("ring").cast("long").alias("n"))


CATEGORY = with_("cells", "clusters", more="joined as (select c.object_id, c.cell_area, k.cluster from cells c left join clusters k on k.barcode = c.object_id)")


def categorised(spark, d):
    return feat.join_categories(T.cells(spark, d), {"cluster": T.clusters(spark, d)})


@query(CATEGORY + "select object_id, cluster from joined where coalesce(cluster::varchar, 'unassigned') not in ('2', 'unassigned')")
def p11_hide_categories(spark, d):
    return feat.hide_categories(categorised(spark, d), "cluster", ["2", "unassigned"]).select("object_id", "cluster")


FIT = "f as (select layer, greatest(0, least(x1, 60000) - greatest(x0, 0)) * greatest(0, least(y1, 60000) - greatest(y0, 0)) / (greatest(x1 - x0, 1e-9) * greatest(y1 - y0, 1e-9)) as inside from (select name as layer, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from good group by name))"


@query(with_("good", more=FIT) + "select layer, round(inside, 9) as inside, case when inside < 0.5 then 'refuse' when inside < 1 - 1e-9 then 'warn' else 'ok' end as verdict from f")
def p17_fit_check(spark, d):
    bounds = T.good_points(spark, d).groupBy(F.col("name").alias("layer")).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    world = spark.createDataFrame([(0.0, 0.0, 60000.0, 60000.0)], "minx double, miny double, maxx double, maxy double")
    return ext.fit_report(bounds, world).withColumn("inside", r("inside", 9))


@query(with_("genes") + "select * from genes where contains(lower(name), '#2')")
def p18_search_genes(spark, d):
    return pts.search(pts.gene_table(T.good_points(spark, d)), "  #2 ")


@query(with_("genes") + "select name from genes")
def p19_no_ghost_genes(spark, d):
    return pts.gene_table(T.good_points(spark, d)).select("name")


# Joins


@query(with_("objects", "cells") + "select object_id, n_vertices, cell_area, status from objects left join cells using (object_id)")
def j1_join_attributes(spark, d):
    return feat.join_attributes(poly.summaries(T.boundaries(spark, d)), T.cells(spark, d)).select("object_id", "n_vertices", "cell_area", "status")


@query(CATEGORY + "select object_id, cell_area, coalesce(cluster, -1) as cluster from joined")
def j2_join_categories(spark, d):
    return categorised(spark, d).select("object_id", "cell_area", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("select c_custkey as object_id, coalesce(k, -1) as category from customer left join (select o_custkey, arg_max(o_orderkey % 7, o_orderkey) as k from orders group by 1) on o_custkey = c_custkey")
def j2_category_files(spark, d):
    """A category CSV in six files, ids repeated: of each id the first row of the first file counts."""
    path = folder(spark)
    t = T.table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 7).alias("k"), "o_orderkey")
    t.repartitionByRange(6, F.desc("o_orderkey")).sortWithinPartitions(F.desc("o_orderkey")).drop("o_orderkey").write.csv(path, header=True)
    objects = T.table(spark, d, "customer").select(F.col("c_custkey").alias("object_id"))
    return feat.join_categories(objects, {"category": spark.read.csv(path, header=True)}).select("object_id", F.coalesce(F.col("category").cast("long"), F.lit(-1)).alias("category"))


@query(with_("tiled") + "select gene_id, x, y from tiled")
def j3_encode_genes(spark, d):
    return T.coded(spark, d).select("gene_id", "x", "y")


@query(with_("tiled") + "select t.x, t.y, g.name, g.count from tiled t join genes g using (gene_id)")
def j4_decode_genes(spark, d):
    genes = pts.gene_table(T.good_points(spark, d))
    return pts.decode(T.coded(spark, d).select("gene_id", "x", "y"), genes).select("x", "y", "name", "count")


@query(with_("boundaries", "cells") + "select object_id, vertex_no, cell_area from boundaries left join cells using (object_id)")
def j5_gather_attributes(spark, d):
    return T.boundaries(spark, d).join(T.cells(spark, d), "object_id", "left").select("object_id", "vertex_no", "cell_area")


RECTS_SQL = """rects as (select s_suppkey as rect_id, (s_suppkey * 7919 % 100000)::double as x0, (s_suppkey * 104729 % 90000)::double as y0 from supplier),
cover as (select rect_id, unnest(range(greatest(0, floor((y0 - miny) / (span / 16)))::bigint, least(15, ceil((y0 + 9000 - miny) / (span / 16)) - 1)::bigint + 1)) as tile_row, greatest(0, floor((x0 - minx) / (span / 16)))::bigint as c0, least(15, ceil((x0 + 12000 - minx) / (span / 16)) - 1)::bigint as c1 from rects, b)"""
COVERED = "select rect_id, tile_row, tile_col from (select rect_id, tile_row, unnest(range(c0, c1 + 1)) as tile_col from cover) where (tile_row, tile_col) in (select (tile_row, tile_col) from tiled)"


def rects(spark, d):
    k = F.col("s_suppkey")
    t = T.table(spark, d, "supplier").select(k.alias("rect_id"), (k * 7919 % 100000).cast("double").alias("x0"), (k * 104729 % 90000).cast("double").alias("y0"))
    return t.withColumns({"x1": F.col("x0") + 12000, "y1": F.col("y0") + 9000})


@query(with_("tiled", more=RECTS_SQL) + COVERED)
def j6_written_rectangle_tiles(spark, d):
    """From the index of a written layer; no points are read for it."""
    path, g = folder(spark), T.point_grid(spark, d)
    slide.write_point_layer(T.good_points(spark, d), path, g)
    return gr.rect_tiles(slide.tile_index(spark, path), g, rects(spark, d))


@query(with_("cells", "clusters") + "select object_id from cells where object_id not in (select barcode from clusters)")
def j7_unassigned(spark, d):
    return T.cells(spark, d).join(T.clusters(spark, d), F.col("object_id") == F.col("barcode"), "left_anti").select("object_id")


@query(with_("small", more=MASK_SQL + ", bx as (select value as label, min(row_) as row0, min(col_) as col0, max(row_) as row1, max(col_) as col1 from drawn group by value), w as (select ceil(1000 * (max(o_orderkey) // 65536 + 1) / 64.0)::bigint as per from orders)") + "select label, case when (row0 // 64) * per + col0 // 64 = (row1 // 64) * per + col1 // 64 then (row0 // 64) * per + col0 // 64 else -1 end as home from bx, w")
def j8_home_blocks(spark, d):
    width = T.mask_width(spark, d)
    return ras.home_block(ras.label_boxes(geo.rasterize(T.small_boxes(spark, d), width, 800)), 64, width).select("label", "home")


@query(with_("good", "boxes") + "select l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, object_id from good, boxes where x >= x0 and x < x0 + s and y >= y0 and y < y0 + s")
def j9_points_in_polygons(spark, d):
    p = T.good_points(spark, d).select(*T.KEY, "x", "y")
    return geo.points_in_polygons(p, T.boxes(spark, d))


# Aggregations


@query(with_("b") + "select minx, miny, maxx, maxy from b")
def a1_extent(spark, d):
    return ext.extent(T.good_points(spark, d))


@query(with_("good", "boundaries") + "select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from (select x, y from good union all select x, y from boundaries)")
def a2_union_extent(spark, d):
    return ext.union_extent(ext.extent(T.good_points(spark, d)), ext.extent(T.boundaries(spark, d)))


@query(with_("genes") + "select name, count from genes")
def a3_gene_counts(spark, d):
    return pts.gene_table(T.good_points(spark, d)).select("name", "count")


@query(with_("objects") + "select object_id, n_vertices from objects")
def a4_vertex_counts(spark, d):
    return poly.summaries(T.boundaries(spark, d)).select("object_id", "n_vertices")


@query(with_("objects") + "select object_id, round(cx, 6) as cx, round(cy, 6) as cy from objects")
def a5_centroids(spark, d):
    return poly.summaries(T.boundaries(spark, d)).select("object_id", r("cx").alias("cx"), r("cy").alias("cy"))


@query(with_("objects") + "select object_id, round(area, 2) as area from objects")
def a6_ring_areas(spark, d):
    return poly.summaries(T.boundaries(spark, d)).select("object_id", r("area", 2).alias("area"))


@query(LEVELS_SQL + "select level, tile_row, tile_col, gene_id, x, y, count from levels")
def a7_level_of_detail(spark, d):
    return levels(spark, d)


@query(with_("channels") + "select channel, round(quantile_cont(value, 0.01), 6) as lo, round(quantile_cont(value, 0.995), 6) as hi from channels group by channel")
def a8_contrast_limits(spark, d):
    return ras.contrast(T.channels(spark, d)).select("channel", r("lo").alias("lo"), r("hi").alias("hi"))


@query(with_("channels", more="q as (select channel, quantile_disc(value, 0.01) as lo, quantile_disc(-value, 0.005) as hi from channels where (row_ * 64 + col_) % 3 = 0 group by channel)") + "select channel, lo, case when -hi <= lo then lo + 1 else -hi end as hi from q")
def a9_sampled_contrast(spark, d):
    return ras.sampled_contrast(T.channels(spark, d), F.col("row_") * 64 + F.col("col_"), 3)


@query(with_("channels") + "select channel, greatest(1, max(value)) as top from channels group by channel")
def a10_channel_maximum(spark, d):
    return ras.channel_maximum(T.channels(spark, d))


@query(with_("cells", more="q as (select quantile_disc(cell_area, 0.02) as lo, -quantile_disc(-cell_area, 0.02) as hi, min(cell_area) as a, max(cell_area) as z from cells)") + "select case when hi <= lo then a else lo end as lo, case when hi <= lo then case when z <= a then a + 1 else z end else hi end as hi from q")
def a11_robust_domain(spark, d):
    return feat.robust_domain(T.cells(spark, d), "cell_area")


DOMAIN_SQL = """v as (select 'o_totalprice' as "column", o_totalprice as v from orders union all select 'o_custkey', o_custkey from orders union all select 'l_discount', l_discount from lineitem),
q as (select "column", count(*) as n, quantile_disc(v, 0.02) as lo, -quantile_disc(-v, 0.02) as hi, min(v) as a, max(v) as z from v group by 1)"""


@query(f"""with {DOMAIN_SQL} select "column", n, case when hi <= lo then a else lo end as lo, case when hi <= lo then case when z <= a then a + 1 else z end else hi end as hi from q""")
def a11_merged_domains(spark, d):
    """Domains of the columns of two layers, from the ranges that each of them keeps."""
    path = folder(spark)
    parts = {"orders": ["o_totalprice", "o_custkey"], "lineitem": ["l_discount"]}
    for name, columns in parts.items():
        feat.value_ranges(T.table(spark, d, name), columns).write.parquet(f"{path}/{name}")
    ranges = feat.merged_ranges(*[spark.read.parquet(f"{path}/{name}") for name in parts])
    values = T.table(spark, d, "orders").select(*parts["orders"], F.lit(None).cast("double").alias("l_discount"))
    values = values.unionByName(T.table(spark, d, "lineitem").select(F.lit(None).cast("double").alias("o_totalprice"), F.lit(None).cast("long").alias("o_custkey"), "l_discount"))
    return feat.domains(values, ranges)


@query(with_("boxes_of") + "select * from boxes_of")
def a12_label_boxes(spark, d):
    return ras.label_boxes(T.mask(spark, d))


@query(CATEGORY + "select coalesce(cluster::varchar, 'unassigned') as category, count(*) as count from joined group by 1")
def a13_category_counts(spark, d):
    return feat.category_counts(categorised(spark, d), "cluster")


@query(with_("objects", more=HILBERT_OBJECTS) + "select count(*) as objects, sum(n_vertices)::bigint as vertices, sum(greatest(n_vertices - 2, 0))::bigint as triangles, count(distinct (tile_row, tile_col)) as tiles from ranked")
def a14_layer_statistics(spark, d):
    path = folder(spark)
    slide.write_segment_layer(T.boundaries(spark, d), path, object_grid(spark, d))
    return slide.layer_statistics(spark, path)


@query(with_("tiled") + "select distinct tile_row >> 2 as tile_row, tile_col >> 2 as tile_col from tiled")
def a15_coarse_tile_index(spark, d):
    return gr.coarser_tiles(T.tiled(spark, d), 2)


@query(LEVELS_SQL.rstrip() + """, fine as (select 0 as level, tile_row, tile_col, count(*) as "rows", count(*) as points, min(gene_id) as first_gene, max(gene_id) as last_gene, 1 as tile_max from tiled group by all)
select * from fine union all select level, tile_row, tile_col, count(*), sum(count)::bigint, min(gene_id), max(gene_id), max(count) from levels group by all""")
def a15_stored_tile_index(spark, d):
    """The index that a point layer keeps: all tiles of all levels."""
    path = folder(spark)
    slide.write_point_layer(T.good_points(spark, d), path, T.point_grid(spark, d))
    return spark.read.parquet(f"{path}/index")


@query(LEVELS_SQL + "select level, tile_row, tile_col, max(count) as tile_max, count(*) as n from levels group by all")
def a16_tile_maximum(spark, d):
    return pts.tile_maximum(levels(spark, d)).groupBy("level", *TILE).agg(F.max("tile_max").alias("tile_max"), F.count("*").alias("n"))


@query(with_("boxes_of") + "select label, pixel_area * 0.25e0 as area from boxes_of")
def a17_label_areas(spark, d):
    return ras.label_areas(ras.label_boxes(T.mask(spark, d)), ras.Level((0.5, 0.5))).select("label", "area")


@query(with_("small", more=MASK_SQL + ", n as (select count(*) as n from drawn group by value)") + "select count(*) filter (n >= 9) as kept, count(*) filter (n < 9) as too_small from n")
def a18_drop_report(spark, d):
    return ras.drop_report(ras.label_boxes(geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800)), 9)


@query(with_("channels", more="s as (select row_, col_, greatest(0.0e0, least(1.0e0, (value - 800) / 400.0e0)) as v, channel from channels)") + "select row_, col_, floor(least(255.0e0, round(sum(v * case channel when 0 then 1.0e0 when 1 then 0.5e0 else 0.0e0 end) * 255, 6)))::int as r, floor(least(255.0e0, round(sum(v * case channel when 1 then 0.5e0 else 0.25e0 end) * 255, 6)))::int as g, floor(least(255.0e0, round(sum(v * case channel when 2 then 1.0e0 else 0.0e0 end) * 255, 6)))::int as b from s group by row_, col_")
def a19_composite(spark, d):
    looks = spark.createDataFrame([(0, 800.0, 1200.0, 1.0, 0.25, 0.0), (1, 800.0, 1200.0, 0.5, 0.5, 0.0), (2, 800.0, 1200.0, 0.0, 0.25, 1.0)], "channel long, lo double, hi double, r double, g double, b double")
    t = ch.colours(ch.composite(ch.to_chunks(T.channels(spark, d)), looks))
    return t.withColumns({c: F.col(c).cast("long") for c in ("row_", "col_")})


@query(with_("channels") + "select channel, row_ >> 1 as row_, col_ >> 1 as col_, round(avg(value), 6) as value from channels group by all")
def a20_downsample(spark, d):
    t = ch.pixels(ch.downsample(ch.to_chunks(T.channels(spark, d))))
    return t.select("channel", F.col("row_").cast("long").alias("row_"), F.col("col_").cast("long").alias("col_"), r("value").alias("value"))


@query(with_("genes") + "select name, gene_id from genes")
def a21_used_genes(spark, d):
    return pts.gene_table(T.good_points(spark, d)).select("name", "gene_id")


@query(with_("mask") + "select row_ // 64 as chunk, max(value) as top, round(avg((value <> 0)::int), 9) as filled from mask group by 1")
def a22_filled_share(spark, d):
    return ch.chunk_sums(ch.to_chunks(T.mask(spark, d), (64, 64))).select(F.col("chunk_row").cast("long").alias("chunk"), "top", r("filled", 9).alias("filled"))


# Windows


@query(with_("genes") + "select gene_id, name from genes")
def w1_dense_gene_ids(spark, d):
    return pts.gene_table(T.good_points(spark, d)).select("gene_id", "name")


@query(with_("objects", more=HILBERT_OBJECTS) + "select object_id, hilbert, cell_id from ranked")
def w2_dense_cell_ids(spark, d):
    return ranked(spark, d).select("object_id", "hilbert", "cell_id")


@query(with_("edges") + "select object_id, vertex_no, x, y, x2, y2 from edges")
def w3_next_vertex(spark, d):
    return poly.edges(T.boundaries(spark, d))


@query(with_("tiled", more="g as (select tile_row, tile_col, gene_id, count(*) as n from tiled group by all)") + "select 0 as level, tile_row, tile_col, gene_id, n, coalesce(sum(n) over (partition by tile_row, tile_col order by gene_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from g")
def w4_gene_runs(spark, d):
    return pts.gene_runs(T.tiled(spark, d).withColumn("level", F.lit(0)))


RUNS = "select o_custkey, o_orderkey, o_orderstatus, case when row_number() over w = 1 or lag(o_orderstatus) over w is distinct from o_orderstatus then 1 else 0 end as new from orders window w as (partition by o_custkey order by o_orderkey)"


@query(f"select o_custkey, o_orderkey, o_orderstatus, sum(new) over (partition by o_custkey order by o_orderkey)::bigint as run from ({RUNS})")
def w5_key_runs(spark, d):
    t = T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return poly.key_runs(t, "o_orderstatus", ["o_orderkey"], "o_custkey")


def table_runs_sql(table, key):
    """Rows of a table numbered as they stand in it, and whether each begins a run."""
    return f"(select *, case when i = 0 or lag(k) over (order by i) is distinct from k then 1 else 0 end as new from (select row_number() over () - 1 as i, {key} as k from {table}))"


@query(f"select run, any_value(k) as key, min(i) as first, count(*) as length from (select *, sum(new) over (order by i)::bigint as run from {table_runs_sql('events', 'event_type')}) group by run")
def w5_table_runs(spark, d):
    """Runs of event types over the whole table in file order, by blocks of 1,024 rows."""
    t, block, at = files.file_blocks(T.table(spark, d, "events").select("event_type"), 10)
    return runs.run_table(t, "event_type", block, at).select("run", "key", "first", "length")


@query("select event_id, user_id, sum(new) over (order by ts, event_id)::bigint as run from (select event_id, ts, user_id, case when row_number() over (order by ts, event_id) = 1 or lag(event_type) over (order by ts, event_id) is distinct from event_type then 1 else 0 end as new from events)")
def w5_ordered_runs(spark, d):
    """The same in the order of another column: the run of each event by time."""
    t = T.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    t, block, at = runs.range_blocks(t, ["ts", "event_id"], folder(spark))
    return runs.numbered_runs(t, "event_type", block, at).select("event_id", "user_id", "run")


@query(with_("objects", more=HILBERT_OBJECTS) + 'select cell_id, n_vertices, coalesce(sum(n_vertices) over (order by cell_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from ranked')
def w6_ragged_offsets(spark, d):
    return poly.offsets(ranked(spark, d)).select("cell_id", "n_vertices", "offset")


@query(with_("boundaries") + "select object_id, vertex_no, x, y from boundaries")
def w7_index_in_group(spark, d):
    return T.boundaries(spark, d)


@query("select l_suppkey as object_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 as vertex_no, l_extendedprice as x from lineitem")
def w8_stable_vertex_order(spark, d):
    t = T.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "object_id")
    return poly.numbered(t, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]).select("object_id", "vertex_no", F.col("l_extendedprice").alias("x"))


@query(with_("boundaries") + "select object_id, vertex_no, x, y from boundaries")
def w9_open_closed_rings(spark, d):
    closed = poly.rings(T.boundaries(spark, d)).where(F.size("ring") >= 3).select("object_id", poly.closed("ring").alias("ring"))
    small = poly.rings(T.boundaries(spark, d)).where(F.size("ring") < 3)
    return poly.opened(poly.flat_rings(closed.unionByName(small)))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n = 1")
def w10_first_match(spark, d):
    return feat.first_per_key(T.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query("select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey from orders group by o_custkey")
def w10_first_in_files(spark, d):
    """The first row of each key in a table of eight files."""
    path, by = folder(spark), ["o_totalprice", "o_orderkey"]
    T.table(spark, d, "orders").repartitionByRange(8, *by).sortWithinPartitions(*by).write.parquet(path)
    return feat.first_per_key(spark.read.parquet(path), "o_custkey").select("o_custkey", "o_orderkey")


# Sorts, top-k


@query(with_("tiled", more=gr.hilbert_sql("tiled", "x, y, gx, gy")) + "select x, y, h as hilbert from h16")
def o1_hilbert_sort(spark, d):
    t = gr.with_hilbert(T.tiled(spark, d))
    return t.repartitionByRange("hilbert").sortWithinPartitions("hilbert", *T.KEY).select("x", "y", "hilbert")


@query(with_("tiled") + "select tile_row, tile_col, gene_id, x, y from tiled")
def o2_gene_major_sort(spark, d):
    t = gr.with_hilbert(T.tiled(spark, d))
    return t.repartitionByRange(*TILE).sortWithinPartitions(*TILE, "gene_id", "hilbert").select(*TILE, "gene_id", "x", "y")


@query(with_("genes") + "select * from genes order by count desc, gene_id")
def o3_genes_by_abundance(spark, d):
    return pts.by_abundance(pts.gene_table(T.good_points(spark, d)))


@query(with_("genes") + "select *, greatest(0, (select count(*) from genes) - 10) as more from genes order by count desc, gene_id limit 10")
def o4_capped_genes(spark, d):
    return pts.by_abundance(pts.gene_table(T.good_points(spark, d)), 10)


@query(with_("boundaries", more="m as (select object_id, avg(x) as mx, avg(y) as my from boundaries group by object_id)") + "select object_id, first(vertex_no order by round((x - mx) ** 2 + (y - my) ** 2, 2) desc, vertex_no) as vertex_no from boundaries join m using (object_id) group by object_id")
def o6_furthest_vertex(spark, d):
    return geo.furthest_vertex(T.boundaries(spark, d))


@query(with_("boundaries", more="p as (select l_suppkey as s, l_orderkey as piece, count(*) as n from lineitem group by all)") + "select s as object_id, first(piece order by n desc, piece) as piece, max(n) as n from p group by s")
def o7_longest_ring(spark, d):
    t = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("object_id"), F.col("l_orderkey").alias("piece")).agg(F.collect_list("l_orderkey").alias("ring"))
    return geo.longest_ring(t).select("object_id", F.col("ring")[0].alias("piece"), F.size("ring").cast("long").alias("n"))


# Sets


@query(with_("boundaries", "boxes", "good", more="u as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from (select x, y from boundaries union all select x0 + s * i, y0 + s * i from boxes, (values (0), (1)) v(i) union all select x, y from good))") + "select k.id, k.kind, minx, miny, maxx, maxy from u, (values ('cells', 'segments'), ('boxes', 'segments'), ('points', 'points')) k(id, kind)")
def u1_union_layers(spark, d):
    """A slide of discovered and extra layers: all are listed, in one world around them all."""
    path = folder(spark)
    m = slide.import_slide(spark, path, "u1", T.raw_points(spark, d), {"cells": T.boundaries(spark, d)}, extra={"boxes": poly.flat_rings(T.boxes(spark, d))}, tile_size=6500.0)
    return slide.layers(spark, path).select("id", "kind", *[F.lit(v).alias(b) for v, b in zip(m["world_bounds"], ext.BOUNDS)])


@query(with_("boundaries", "small", more=MASK_SQL) + "select 'boundaries' as origin, object_id, count(*) - (count(*) >= 4 and arg_min(x, vertex_no) = arg_max(x, vertex_no) and arg_min(y, vertex_no) = arg_max(y, vertex_no))::int as n from boundaries group by all union all select 'mask', value, 0 from drawn group by value having count(*) >= 4")
def u2_one_schema(spark, d):
    """Boundary tables and label masks are loaded to the same columns; of mask rings the number is not compared."""
    path = folder(spark)
    geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800).write.parquet(path)
    a = slide.load_segments(spark, {"path": f"{d}/lineitem.parquet", "named": {"object_id": "l_orderkey", "x": "l_extendedprice", "y": "l_quantity"}}, list(T.VERTEX_ORDER))
    both = a.withColumn("origin", F.lit("boundaries")).unionByName(slide.load_segments(spark, {"path": path, "tolerance": 0.0}, []).withColumn("origin", F.lit("mask")))
    return both.groupBy("origin", "object_id").agg(F.count("*").alias("n")).select("origin", "object_id", F.when(F.col("origin") == "mask", 0).otherwise(F.col("n")).cast("long").alias("n"))


@query(with_("genes") + "select * from genes where name <> 'Brand#23'")
def u3_all_but_one(spark, d):
    return pts.all_but(pts.gene_table(T.good_points(spark, d)), "Brand#23")


@query(with_("tiled", more=RECTS_SQL) + f"select distinct tile_row, tile_col from ({COVERED})")
def u4_tile_intersection(spark, d):
    path = folder(spark)
    slide.write_tile_index(T.tiled(spark, d).withColumns({"level": F.lit(0), "count": F.lit(1).cast("long")}), path)
    index = slide.tile_index(spark, path)
    return gr.rect_tiles(index, T.point_grid(spark, d), rects(spark, d)).select(*TILE).intersect(index.select(*TILE))


@query(LEVELS_SQL + "select level, count(*) as n, sum(count)::bigint as points from levels group by level")
def u5_union_levels(spark, d):
    return levels(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.sum("count").alias("points"))


@query("select id, kind, visible, n from (select 'image' as kind, 'dapi' as id, true as visible, count(*) as n from embeddings union all select 'segments', 'cell', true, count(distinct l_orderkey) from lineitem union all select 'segments', 'nucleus', false, count(distinct l_suppkey) from lineitem union all select 'points', 'transcripts', true, count(*) from lineitem)")
def u1_discovered_layouts(spark, d):
    """A dataset folder in which one layer lies in several layouts: the source that counts, and its rows."""
    root = folder(spark)
    lines, px = T.table(spark, d, "lineitem"), T.pixels(spark, d).select("row_", "col_", "value")
    vertices = lambda key: lines.select(F.col(key).alias("cell_id"), F.col("l_extendedprice").alias("vertex_x"), F.col("l_quantity").alias("vertex_y"))
    lines.write.parquet(f"{root}/transcripts.parquet")
    vertices("l_orderkey").write.parquet(f"{root}/cell_boundaries.parquet")
    vertices("l_suppkey").write.parquet(f"{root}/nucleus_boundaries.parquet")
    for place in ("dapi.ome.parquet", "images/other.parquet", "morphology_focus/x.parquet", "labels/cell.parquet"):
        (px.where("col_ = 0") if place.startswith("dapi") else px.limit(5)).write.parquet(f"{root}/{place}")
    count = {"image": F.count("*"), "points": F.count("*"), "segments": F.countDistinct("cell_id")}
    one = lambda s: spark.read.parquet(s["path"]).agg(count[s["kind"]].alias("n")).select(F.lit(s["id"]).alias("id"), F.lit(s["kind"]).alias("kind"), F.lit(s.get("visible", True)).alias("visible"), "n")
    return reduce(DataFrame.unionByName, [one(s) for s in slide.discover(spark, root)])


# Scalar functions


@query(with_("tiled", more=gr.hilbert_sql("tiled", "gx, gy")) + "select gx, gy, h as hilbert from h16")
def f1_hilbert_index(spark, d):
    return gr.with_hilbert(T.tiled(spark, d)).select("gx", "gy", "hilbert")


@query(with_("tiled") + "select x, y, gx, gy from tiled")
def f2_quantize(spark, d):
    return T.tiled(spark, d).select("x", "y", "gx", "gy")


@query(with_("tiled") + "select gx, gy, tile_row, tile_col from tiled")
def f3_tile_of_cell(spark, d):
    return T.tiled(spark, d).select("gx", "gy", *TILE)


@query(with_("pixels") + "select row_, col_, 10.0e0 + col_ * 0.5e0 as x, 20.0e0 + row_ * 0.25e0 as y from pixels")
def f6_row_to_world(spark, d):
    return T.pixels(spark, d).select("row_", "col_").withColumns(ras.to_world(ras.Level((0.25, 0.5), (20.0, 10.0))))


@query(with_("good") + "select x, y, (x - 10.0e0) / 0.5e0 as col_, (y - 20.0e0) / 0.25e0 as row_ from good")
def f7_world_to_pixel(spark, d):
    return T.good_points(spark, d).select("x", "y").withColumns(ras.to_pixel(ras.Level((0.25, 0.5), (20.0, 10.0))))


@query(with_("tiled") + "select gx, gx >> 1 as coarser from tiled")
def f8_coarser_bin(spark, d):
    return T.tiled(spark, d).select("gx", F.shiftright("gx", 1).alias("coarser"))


@query(with_("tiled") + "select gy, gy >> 5 as tile from tiled")
def f9_bin_to_tile(spark, d):
    return T.tiled(spark, d).select("gy", F.shiftright("gy", gr.BIN_BITS).alias("tile"))


@query(with_("good") + "select l_orderkey, md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) as draw from good")
def f10_mix_hash(spark, d):
    return T.good_points(spark, d).select("l_orderkey", T.draw().alias("draw"))


@query(with_("boxes") + "select object_id, round(greatest(0.0e0, least(x0 + s, 60000) - greatest(x0, 20000)) * greatest(0.0e0, least(y0 + s, 70000) - greatest(y0, 20000)) / (s * s), 6) as inside from boxes")
def f11_overlap_fraction(spark, d):
    ring = F.col("ring")
    a = ring[0]["x"], ring[0]["y"], ring[2]["x"], ring[2]["y"]
    return T.boxes(spark, d).select("object_id", r(ext.overlap_fraction(a, tuple(map(F.lit, RECT)))).alias("inside"))


@query(CATEGORY + "select object_id, coalesce(trunc(cluster * 1.5e0)::bigint::varchar, 'unassigned') as category from joined")
def f12_category_key(spark, d):
    return categorised(spark, d).select("object_id", feat.category_key(F.col("cluster") * 1.5).alias("category"))


@query(with_("cells") + "select object_id, greatest(0, least(255, floor((cell_area - 50000) * 255 / 150000.0e0 + 0.5)))::int as position from cells")
def f13_ramp_position(spark, d):
    return T.cells(spark, d).select("object_id", feat.ramp_position(F.col("cell_area"), F.lit(50000.0), F.lit(200000.0)).alias("position"))


@query(CATEGORY + "select object_id, coalesce(((cluster - 4) % 5 + 5) % 5, -1) as slot from joined")
def f14_palette_slot(spark, d):
    return categorised(spark, d).select("object_id", F.coalesce(feat.palette_slot(F.col("cluster") - 4, 5), F.lit(-1)).alias("slot"))


@query(LEVELS_SQL + "select level, tile_row, tile_col, gene_id, x, y, round(1.2e0 + 4.8e0 * sqrt(count / (max(count) over (partition by level, tile_row, tile_col))::double), 6) as diameter from levels")
def f15_dot_diameter(spark, d):
    return pts.dot_size(levels(spark, d)).select("level", *TILE, "gene_id", "x", "y", r("diameter").alias("diameter"))


@query(with_("objects") + "select object_id, n_vertices + 1 as n from objects")
def f16_close_rings(spark, d):
    return poly.rings(T.boundaries(spark, d)).select("object_id", F.size(poly.closed("ring")).cast("long").alias("n"))


@query(f"select o_custkey, count(distinct o_orderstatus) as n_keys, sum(new)::bigint as n_runs, count(distinct o_orderstatus) = sum(new) as contiguous from ({RUNS}) group by o_custkey")
def f17_contiguity(spark, d):
    t = T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return poly.contiguous(t, "o_orderstatus", ["o_orderkey"], "o_custkey")


GROUPED = (("orders", "o_orderkey"), ("orders", "o_orderstatus"), ("lineitem", "l_orderkey"), ("events", "event_type"), ("events", "event_id"))


@query(" union all ".join(f"select '{t}' as source, '{k}' as key, count(distinct k) as n_keys, sum(new)::bigint as n_runs, count(distinct k) = sum(new) as grouped from {table_runs_sql(t, k)}" for t, k in GROUPED))
def f17_grouped_tables(spark, d):
    """Whether tables stand grouped by a key in their files."""
    def one(name, key):
        t, block, at = files.file_blocks(T.table(spark, d, name).select(key), 10)
        return runs.grouped_already(t, key, block, at).select(F.lit(name).alias("source"), F.lit(key).alias("key"), "n_keys", "n_runs", "grouped")

    return reduce(DataFrame.unionByName, [one(*x) for x in GROUPED])


# Geometry


def one_span_a_row(mask):
    """(object_id) of labels that are one run of pixels in each of their rows, each run touching the one above. Spans
    are joined up per task first; then a label's rows lie in one task for all that follows."""
    rows = mask.groupBy(F.col("value").alias("object_id"), "row_").agg(F.min("c0").alias("a"), F.max("c1").alias("z"), F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    w = Window.partitionBy("object_id").orderBy("row_")
    above = F.lag("row_").over(w) == F.col("row_") - 1
    t = rows.withColumns({"pa": F.when(above, F.lag("a").over(w)), "pz": F.when(above, F.lag("z").over(w))})
    ok = (F.col("n") == F.col("z") - F.col("a") + 1) & (F.col("pa").isNull() | ((F.col("pa") <= F.col("z")) & (F.col("pz") >= F.col("a"))))
    return t.groupBy("object_id").agg(F.bool_and(ok).alias("ok"), F.count_if(F.col("pa").isNull()).alias("tops")).where("ok and tops = 1").select("object_id")


def drawn_mask(spark, d):
    """The mask of the small boxes, written, as it is read more than once."""
    path = folder(spark)
    geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800).write.parquet(path)
    return spark.read.parquet(path)


@query(with_("small", more=MASK_SQL) + "select value as object_id, count(*) as pixel_area, count(*) * 0.25e0 as area from drawn group by value having count(*) >= 4")
def r1_masks_to_polygons(spark, d):
    m = drawn_mask(spark, d)
    return geo.polygons_from_labels(m, ras.Level((0.5, 0.5)), 0.0).select("object_id", "pixel_area", "area")


#: Of a traced outline: each side between a pixel and another label gives a vertex, and cut corners take area.
#: An object in one piece without holes, whose pixels touch along sides only, has all of them in one ring.
OUTLINE_SQL = MASK_SQL + """, sides as (select d.value, d.row_, d.col_, sum((n.value is null)::int) as open from drawn d, (values (0, 1), (1, 0), (0, -1), (-1, 0)) s(r, c) left join drawn n on n.row_ = d.row_ + s.r and n.col_ = d.col_ + s.c and n.value = d.value group by all),
spans as (select value, row_, min(col_) as a, max(col_) as z, count(*) as n from drawn group by value, row_),
whole as (select value from (select *, lag(a) over w as pa, lag(z) over w as pz, lag(row_) over w as pr from spans window w as (partition by value order by row_)) group by value having bool_and(n = z - a + 1) and bool_and(pr is null or (pr = row_ - 1 and pa <= z and pz >= a)))"""


@query(with_("small", more=OUTLINE_SQL) + "select value as object_id, sum(open)::bigint as n_vertices from sides join whole using (value) group by value having count(*) >= 4")
def r2_trace_outlines(spark, d):
    m = drawn_mask(spark, d)
    rings = geo.polygons_from_labels(m, tolerance=0.0).select("object_id", F.size("ring").cast("long").alias("n_vertices"))
    return rings.join(one_span_a_row(m), "object_id", "left_semi")


@query(with_("small", more=OUTLINE_SQL) + "select value as object_id, sum(open)::bigint as n_vertices from sides join whole using (value) group by value")
def r2_wide_outlines(spark, d):
    """Outlines ranked across blocks of 64 pixels, in long form."""
    m = drawn_mask(spark, d)
    t = outlines(m, folder(spark), 64).groupBy("object_id").agg(F.countDistinct("vertex_no").alias("n_vertices"))
    return t.join(one_span_a_row(m), "object_id", "left_semi")


@query(with_("boundaries", more="""m as (select object_id, avg(x) as mx, avg(y) as my, count(*) as n from boundaries group by object_id),
far as (select object_id, max((x - mx) ** 2 + (y - my) ** 2) as far from boundaries join m using (object_id) group by object_id)""") + "select object_id, n as before, true as kept, true as near, true as starts_far from m join far using (object_id)")
def r3_simplify_rings(spark, d):
    """Simplified rings held against their rings: only vertices of the ring stay, in the ring's order; no vertex
    lies further off than the tolerance; and the one furthest from the mean stays, first."""
    t = geo.simplify_rings(poly.rings(T.boundaries(spark, d)), 1500.0, "simple")
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)
    off = lambda v: F.pow(v["x"] - mean(xs), F.lit(2.0)) + F.pow(v["y"] - mean(ys), F.lit(2.0))
    place = F.transform("simple", lambda v: F.array_position("ring", v))
    turned = F.transform(place, lambda i: F.pmod(i - F.get(place, F.lit(0)), F.size("ring").cast("long")))
    few = F.size("ring") < 4  # stay as they are
    kept = (F.array_min(place) > 0) & (few | (F.size("ring") > F.size(F.array_distinct("ring"))) | (turned == F.array_sort(turned)))
    far = few | (off(F.get("simple", F.lit(0))) >= F.array_max(F.transform("ring", off)) * (1 - 1e-9))
    near = geo.ring_distance(F.col("ring"), F.col("simple")) <= 1500.0 + 1e-6
    return t.select("object_id", F.size("ring").cast("long").alias("before"), kept.alias("kept"), near.alias("near"), far.alias("starts_far"))


@query(with_("small", more=MASK_SQL) + "select row_, col_, value from drawn")
def r4_rasterize(spark, d):
    return spans.pixels(geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800)).select("row_", "col_", "value")


STARS = "stars as (select object_id, i as vertex_no, s * (1 + 0.9e0 * (1 - i % 2 * (object_id % 5 + 1) / 8.0e0) * cos(i * pi() / 6)) as x, s * (1 + 0.9e0 * (1 - i % 2 * (object_id % 5 + 1) / 8.0e0) * sin(i * pi() / 6)) as y from boxes, (select unnest(range(12)) as i)), star_edges as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from stars window w as (partition by object_id order by vertex_no))"


def stars(spark, d):
    """Simple rings of 12 vertices that turn in and out, by order."""
    t = T.boxes(spark, d).select("object_id", F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"), (F.col("object_id") % 300 + 200.0).alias("s"))
    reach = lambda i: 0.9 * (1 - F.lit(i % 2) * (F.col("object_id") % 5 + 1) / 8.0)
    ring = F.array(*[F.struct((F.col("x0") + F.col("s") * (1 + reach(i) * F.cos(F.lit(i * math.pi / 6)))).alias("x"), (F.col("y0") + F.col("s") * (1 + reach(i) * F.sin(F.lit(i * math.pi / 6)))).alias("y")) for i in range(12)])
    return t.select("object_id", ring.alias("ring"))


@query(with_("boxes", more=STARS) + "select object_id, 10 as n, round(abs(sum(x * y2 - x2 * y)) / 2, 5) as area, 10 as facing from star_edges group by object_id")
def r5_triangulate(spark, d):
    """Triangles of simple rings: their number, the sum of their areas, and how many turn as the ring does."""
    t = geo.triangulate_rings(stars(spark, d)).select("object_id", "ring", "triangles", F.explode(F.sequence(F.lit(0), F.size("triangles") - 3, F.lit(3))).alias("i"))
    p, q, z = (F.col("ring")[F.col("triangles")[F.col("i") + k]] for k in range(3))
    area = ((q["x"] - p["x"]) * (z["y"] - p["y"]) - (z["x"] - p["x"]) * (q["y"] - p["y"])) / 2
    return t.withColumn("a", area).groupBy("object_id").agg(F.count("*").cast("int").alias("n"), r(F.sum(F.abs("a")), 5).alias("area"), F.count_if(F.col("a") > 0).cast("int").alias("facing"))


@query(with_("objects", more=HILBERT_OBJECTS) + "select cell_id, coalesce(sum(n_vertices) over w, 0)::bigint as first, (coalesce(sum(n_vertices) over w, 0) + n_vertices - 1)::bigint as last, n_vertices::bigint as used, 3 * (n_vertices - 2) as n from ranked where n_vertices >= 3 window w as (partition by tile_row, tile_col order by cell_id rows between unbounded preceding and 1 preceding)")
def r6_tile_local_triangles(spark, d):
    keys = ranked(spark, d).where("n_vertices >= 3").select("object_id", "cell_id", "n_vertices", *TILE)
    t = geo.triangulate_rings(poly.rings(T.boundaries(spark, d))).join(keys, "object_id")
    all_ = poly.tile_indices(t)
    return all_.select("cell_id", F.array_min("triangles").cast("long").alias("first"), F.array_max("triangles").cast("long").alias("last"), F.size(F.array_distinct("triangles")).cast("long").alias("used"), F.size("triangles").cast("long").alias("n"))


@query(with_("small", more=OUTLINE_SQL) + "select value as object_id, count(*) as pixel_area, true as close from drawn join whole using (value) group by value having count(*) >= 4")
def r7_round_trip(spark, d):
    """Rings drawn as a mask and traced back, of objects in one piece: a contour through half-way points cuts at most
    an eighth of a pixel from each of its corners, and there are no more corners than vertices."""
    mask = drawn_mask(spark, d)
    t = geo.polygons_from_labels(mask, tolerance=0.0).join(one_span_a_row(mask), "object_id", "left_semi")
    close = F.abs(geo.ring_area(F.col("ring")) - F.col("pixel_area")) <= F.size("ring") / 8
    return t.select("object_id", "pixel_area", close.alias("close"))


# Jobs


def imported(spark, d):
    path = folder(spark)
    slide.import_slide(spark, path, "lineitems", T.raw_points(spark, d), {"cells": T.boundaries(spark, d)}, T.cells(spark, d), {"cluster": T.clusters(spark, d)}, tile_size=6500.0)
    return path


IMPORT_SQL = """world as (select min(x) as minx, min(y) as miny, greatest(max(x) - min(x), max(y) - min(y)) as span from (select x, y from good union all select x, y from boundaries)),
wt as (select 2 ** greatest(0, least(16, round_even(log2(greatest(span / 6500.0e0, 1)), 0))) as tiles, minx, miny, span from world),
places as (select 'cells' as id, cx as x, cy as y, 1 as n from objects union all select 'points', x, y, 1 from good)"""


@query(with_("objects", "good", more=IMPORT_SQL) + "select id, greatest(0, least(tiles - 1, floor((y - miny) / span * tiles)))::int as tile_row, greatest(0, least(tiles - 1, floor((x - minx) / span * tiles)))::int as tile_col, sum(n)::bigint as n from places, wt group by all")
def e1_import_slide(spark, d):
    """A slide imported whole: the objects and points of every tile of both layers, as the manifest has them."""
    path = imported(spark, d)
    m = slide.read_manifest(spark, path)
    count = {"segments": "objects", "points": "points"}
    index = lambda l: spark.read.parquet(f"{path}/{l['path']}/index")
    one = lambda l: (index(l).where("level = 0") if l["kind"] == "points" else index(l)).select(F.lit(l["id"]).alias("id"), F.col("tile_row").cast("int").alias("tile_row"), F.col("tile_col").cast("int").alias("tile_col"), F.col(count[l["kind"]]).alias("n"))
    return reduce(DataFrame.unionByName, [one(l) for l in m["layers"]])


@query(with_("boxes") + "select 'cells-2' as id, count(*) as objects from boxes")
def e2_add_segmentation(spark, d):
    path = imported(spark, d)
    m = slide.add_segments(spark, path, "cells", poly.flat_rings(T.boxes(spark, d)))
    return spark.read.parquet(f"{path}/{m['layers'][-1]['path']}/features").agg(F.count("*").alias("objects")).select(F.lit(m["layers"][-1]["id"]).alias("id"), "objects")


@query(with_("tiled") + "select k.level, count(*) as points from tiled, (select unnest([1, 2, 3, 4]) as level) k group by k.level")
def e3_point_layer(spark, d):
    path = folder(spark)
    slide.write_point_layer(T.good_points(spark, d), path, T.point_grid(spark, d))
    return spark.read.parquet(f"{path}/coarse").groupBy("level").agg(F.sum("count").alias("points"))


@query(with_("objects", more=HILBERT_OBJECTS) + "select tile_row, tile_col, count(*) as objects, sum(n_vertices)::bigint as vertices from ranked group by all")
def e4_polygon_layer(spark, d):
    path = folder(spark)
    slide.write_segment_layer(T.boundaries(spark, d), path, object_grid(spark, d))
    return spark.read.parquet(f"{path}/polygons").groupBy(*TILE).agg(F.count("*").alias("objects"), F.sum(F.size("ring")).alias("vertices"))


@query(with_("tiled", more="v as (select greatest(0, least(255, floor((x - minx) / span * 256)))::int as bx, greatest(0, least(255, floor((y - miny) / span * 256)))::int as by_, gene_id, span, minx, miny from tiled, b), w as (select by_ >> 5 as tile_row, bx >> 5 as tile_col, gene_id, span, minx, miny from v)") + "select tile_row, tile_col, gene_id, count(*) as points from w where gene_id in (1, 2, 3) and tile_row between greatest(0, floor((20000 - miny) / (span / 8))) and least(7, ceil((70000 - miny) / (span / 8)) - 1) and tile_col between greatest(0, floor((20000 - minx) / (span / 8))) and least(7, ceil((60000 - minx) / (span / 8)) - 1) group by all")
def e5_viewport_points(spark, d):
    path, g = folder(spark), T.point_grid(spark, d)
    slide.write_point_layer(T.good_points(spark, d), path, g)
    t = slide.view_points(spark, path, g, RECT, g.tile_size(3) / 32, [1, 2, 3])
    return t.groupBy(*TILE, "gene_id").agg(F.sum("count").alias("points"))


@query(with_("objects", "clusters", more=HILBERT_OBJECTS + ", ospan as (select minx, miny, span from ob)") + f"select cell_id, cluster % 20 as colour from ranked left join clusters on barcode = object_id, ospan where coalesce(cluster::varchar, 'unassigned') not in ('unassigned', '3') and {rect_sql()}")
def e6_viewport_polygons(spark, d):
    path, g = folder(spark), object_grid(spark, d)
    slide.write_segment_layer(T.boundaries(spark, d), path, g, T.cells(spark, d), {"cluster": T.clusters(spark, d)})
    return slide.view_polygons(spark, path, g, RECT, "cluster", ["unassigned", "3"]).select("cell_id", "colour")


RAMP_SQL = "q as (select quantile_disc(cell_area, 0.02) as lo, -quantile_disc(-cell_area, 0.02) as hi from ranked join cells using (object_id))"


@query(with_("objects", "cells", more=HILBERT_OBJECTS + ", ospan as (select minx, miny, span from ob), " + RAMP_SQL) + f"select cell_id, greatest(0, least(255, floor((cell_area - lo) * 255 / (hi - lo) + 0.5)))::int as colour from ranked left join cells using (object_id), ospan, q where {rect_sql()}")
def e6_viewport_ramp(spark, d):
    """The polygons of a rectangle coloured by a measurement over its stored domain."""
    path, g = folder(spark), object_grid(spark, d)
    slide.write_segment_layer(T.boundaries(spark, d), path, g, T.cells(spark, d))
    return slide.view_polygons(spark, path, g, RECT, "cell_area").select("cell_id", "colour")


@query(with_("channels", more="""half as (select channel, row_ >> 1 as row_, col_ >> 1 as col_, avg(value) as value from channels group by all),
s as (select row_, col_, greatest(0.0e0, least(1.0e0, (value - 800) / 400.0e0)) as v, channel from half where row_ < 48 and col_ >= 16)""") + "select row_, col_, floor(least(255.0e0, round(sum(v * case channel when 0 then 1.0e0 else 0.0e0 end) * 255, 6)))::int as r, floor(least(255.0e0, round(sum(v * case channel when 1 then 1.0e0 else 0.0e0 end) * 255, 6)))::int as g, floor(least(255.0e0, round(sum(v * case channel when 2 then 1.0e0 else 0.0e0 end) * 255, 6)))::int as b from s group by row_, col_")
def e7_viewport_image(spark, d):
    """The chunks of a rectangle at the second level of an image of 16 x 16 chunks, composited."""
    path = folder(spark)
    facts = slide.write_image_layer(T.channels(spark, d), path, ras.Level((1.0, 1.0), chunk=(16, 16)), coarsest=16)
    looks = slide.channel_looks(spark, facts).withColumns({"lo": F.lit(800.0), "hi": F.lit(1200.0)})
    t = ch.colours(slide.view_image(spark, path, facts, (40.0, 20.0, 64.0, 90.0), 2.5, looks))
    return t.withColumns({c: F.col(c).cast("long") for c in ("row_", "col_")})


@query(with_("small", more=MASK_SQL) + "select row_, count(*) as pixels, count(distinct value) as labels, sum(value)::bigint as total from drawn group by row_")
def s20_mask_spans(spark, d):
    """The mask's longest spans: pixels, labels and sum of labels of each row."""
    t = spans.to_spans(geo.rasterize(T.small_boxes(spark, d), T.mask_width(spark, d), 800)).withColumn("n", F.col("c1") - F.col("c0") + 1)
    return t.groupBy("row_").agg(F.sum("n").alias("pixels"), F.countDistinct("value").alias("labels"), F.sum(F.col("n") * F.col("value")).alias("total"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Points per gene, with one representative position, in each bin of a rectangle, good rows only."""
    g = T.point_grid(spark, d)
    genes = pts.gene_table(T.good_points(spark, d))
    level = pts.first_level(T.coded(spark, d), g, T.draw())
    t = level.where(F.col("bx").between(32, 95) & F.col("by").between(32, 95))
    return pts.decode(t.select("by", "bx", "gene_id", F.col("count").alias("n"), F.col("pick.x").alias("x"), F.col("pick.y").alias("y")), genes.select("gene_id", "name"))
