"""Slides: a folder of Parquet layers on one grid, with a JSON manifest.

Files are reached by Spark's own readers and Hadoop's file system, so a slide can be in any store."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.grid import Grid, choose_depth, choose_level, in_rect
from lattica.operators import chunks as ch
from lattica.operators import extent as ext
from lattica.operators import features as feat
from lattica.operators import geometry as geo
from lattica.operators import points as pts
from lattica.operators import polygons as poly
from lattica.operators import raster as ras
from lattica.operators.raster import Level, require_mask
from lattica.operators.spans import is_spans

from . import store
from .layouts import discover
from .manifest import FORMAT, check_layers, commit, free_id, grid_of, latest, layer_path, layers, read_manifest, write_manifest

__all__ = ["check_layers", "discover", "grid_of", "layer_path", "layers", "read_manifest", "write_manifest"]


# Raster metadata


def raster_levels(spark: SparkSession, text: str) -> list[Level]:
    """Scale and translation of each level from multiscale JSON, bare or under `ome`. No scale: an error."""
    transforms = "array<struct<type:string,scale:array<double>,translation:array<double>>>"
    schema = f"multiscales array<struct<datasets:array<struct<path:string,coordinateTransformations:{transforms}>>>>"
    t = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", f"{schema}, ome struct<{schema.replace(' ', ':', 1)}>").alias("j"))
    t = t.select(F.posexplode(F.coalesce("j.multiscales", "j.ome.multiscales")[0]["datasets"]).alias("level", "d"))
    kind = lambda k: F.get(F.filter("d.coordinateTransformations", lambda x: x["type"] == k), F.lit(0))[k]
    out = []
    for r in t.select("level", kind("scale").alias("scale"), kind("translation").alias("translation")).orderBy("level").collect():
        if not r["scale"]:
            raise ValueError(f"raster level {r['level']} has no scale")
        out.append(Level(tuple(r["scale"][-2:]), tuple((r["translation"] or [0.0, 0.0])[-2:])))
    return out


# Image layers


def image_level(image: DataFrame, level: Level) -> Level:
    """The level with the shape of an image, pixels or chunks, where it has none."""
    if all(level.shape):
        return level
    ends = (F.max(F.col("row0") + F.col("height")), F.max(F.col("col0") + F.col("width"))) if ch.is_chunked(image) else (F.max("row_") + 1, F.max("col_") + 1)
    row = image.agg(*[F.coalesce(e, F.lit(0)).cast("int") for e in ends]).first()
    return Level(level.scale, level.translation, (row[0], row[1]), level.chunk)


def write_image_layer(image: DataFrame, path: str, level: Level, how: str = "mean", coarsest: int = 256) -> dict:
    """Every channel of an image, pixels(row_, col_, value, and channel, else 0) or chunks of level.chunk, at level
    0 and at coarser ones, each from the one before, until the longer side has `coarsest` pixels at most. One
    row per chunk under level=<k>/channel=<c>, sorted by chunk, so that a range of chunks prunes the scan. The
    facts for the manifest hold each channel's contrast and greatest value on the coarsest level."""
    spark, level, k = image.sparkSession, image_level(image, level), 0
    t, shape = image if ch.is_chunked(image) else ch.to_chunks(image, level.chunk), level.shape
    kind = t.schema["channel"].dataType
    while True:
        t.repartitionByRange(*ch.KEYS).sortWithinPartitions(*ch.KEYS).write.mode("overwrite").partitionBy("channel").parquet(f"{path}/level={k}")
        if max(shape) <= max(coarsest, 1):
            break
        t = ch.downsample(image_chunks(spark, path, k).withColumn("channel", F.col("channel").cast(kind)), level.chunk, how)
        shape, k = tuple((n + 1) // 2 for n in shape), k + 1
    looks = []
    if any(shape):
        values = image_chunks(spark, path, k).select(F.col("channel").cast("string").alias("channel"), F.explode("values").alias("value")).where(F.col("value").isNotNull())
        found = ras.contrast(values).join(ras.channel_maximum(values), "channel").orderBy("channel").collect()  # a row a channel
        looks = [{"channel": r["channel"], **{c: float(r[c]) for c in ("lo", "hi", "top")}} for r in found]
    return {"levels": k, "scale": list(level.scale), "translation": list(level.translation), "shape": list(level.shape), "chunk": list(level.chunk), "channels": looks}


def image_chunks(spark: SparkSession, path: str, level: int) -> DataFrame:
    """The chunks of one level of an image layer."""
    return spark.read.parquet(f"{path}/level={level}").select(*ch.KEYS, "row0", "col0", "height", "width", "values")


def image_pixels(spark: SparkSession, path: str, level: int) -> DataFrame:
    return ch.pixels(image_chunks(spark, path, level))


#: Colours that channels get in turn where none are given; a single channel is white.
CHANNEL_COLOURS = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0))


def channel_looks(spark: SparkSession, layer: dict, colours: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(channel, lo, hi, r, g, b) of an image layer of the manifest: its contrast limits, and the given colours by
    channel or one of CHANNEL_COLOURS each."""
    known = layer["channels"]
    pick = lambda i, c: (colours or {}).get(c) or ((1.0, 1.0, 1.0) if len(known) == 1 else CHANNEL_COLOURS[i % len(CHANNEL_COLOURS)])
    rows = [(c["channel"], c["lo"], c["hi"], *map(float, pick(i, c["channel"]))) for i, c in enumerate(known)]
    return spark.createDataFrame(rows, "channel string, lo double, hi double, r double, g double, b double")


def view_image(spark: SparkSession, path: str, layer: dict, rect, world_per_pixel: float, looks: DataFrame | None = None) -> DataFrame:
    """The composited chunks of a viewport (see chunks.composite): the coarsest level whose pixels are not coarser
    than the screen's, and of it only the chunks that the rectangle touches, which prunes the scan."""
    base = Level(tuple(layer["scale"]), tuple(layer["translation"]), tuple(layer["shape"]), tuple(layer["chunk"]))
    k = choose_level([max(base.scale) * 2**i for i in range(layer["levels"] + 1)], world_per_pixel)
    chunks = ch.in_range(image_chunks(spark, path, k), base.coarser(k).chunks(rect))
    looks = channel_looks(spark, layer) if looks is None else looks
    return ch.composite(chunks.withColumn("channel", F.col("channel").cast("string")), looks.withColumn("channel", F.col("channel").cast("string")))


# Point layers


def write_tile_index(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The written tiles of tiles(level, tile_row, tile_col, gene_id, count): rows, points, and the range of genes of
    each. What asks which tiles there are reads this small table and no points."""
    t = tiles.groupBy("level", "tile_row", "tile_col").agg(F.count("*").alias("rows"), F.sum("count").alias("points"), F.min("gene_id").alias("first_gene"), F.max("gene_id").alias("last_gene"), F.max("count").alias("tile_max"))
    t.repartitionByRange(1, "level", "tile_row", "tile_col").write.mode(mode).parquet(f"{path}/index")


def tile_index(spark: SparkSession, path: str, level: int = 0, genes: list[int] | None = None) -> DataFrame:
    """The written tiles of a level; with genes, those that may hold one of them."""
    t = spark.read.parquet(f"{path}/index").where(F.col("level") == level)
    if genes is not None:
        t = t.where(F.exists(F.array(*map(F.lit, sorted(genes))).cast("array<int>"), lambda g: (g >= F.col("first_gene")) & (g <= F.col("last_gene"))))
    return t


def write_point_layer(points: DataFrame, path: str, grid: Grid) -> dict:
    """Tiles of points(name, x, y) at all levels, the gene table and the tile index. Files are clustered by level
    and Hilbert tile, gene-major in a tile, so that filters on tiles and genes prune row groups. The points are
    read for the genes and for level 0; the coarser levels come from what level 0 has written."""
    genes = pts.gene_table(points)
    genes.orderBy("gene_id").write.mode("overwrite").parquet(f"{path}/genes")
    spark = points.sparkSession
    coded = pts.encode(points, spark.read.parquet(f"{path}/genes"))
    fine = pts.fine_tiles(coded, grid).select("level", "tile_row", "tile_col", "gene_id", "x", "y", "count", "hilbert")
    fine = fine.withColumn("tile_key", F.shiftright("hilbert", 2 * (16 - grid.depth)))
    fine.repartitionByRange("tile_key", "hilbert").sortWithinPartitions("tile_key", "gene_id", "hilbert").drop("hilbert", "tile_key").write.mode("overwrite").parquet(f"{path}/tiles/level=0")
    tiles = spark.read.parquet(f"{path}/tiles/level=0")
    tiles = tiles.select(F.lit(0).alias("level"), "tile_row", "tile_col", "gene_id", "x", "y", "count")
    if grid.depth:
        coarse = pts.point_levels(tiles, grid)
        coarse.repartitionByRange("level", "tile_row", "tile_col").sortWithinPartitions("level", "tile_row", "tile_col", "gene_id", "y", "x").write.mode("overwrite").partitionBy("level").parquet(f"{path}/coarse")
        tiles = tiles.unionByName(spark.read.parquet(f"{path}/coarse").select(tiles.columns))
    write_tile_index(tiles, path)
    return {"levels": grid.depth}


def point_tiles(spark: SparkSession, path: str, level: int) -> DataFrame:
    if level == 0:
        return spark.read.parquet(f"{path}/tiles/level=0").select("tile_row", "tile_col", "gene_id", "x", "y", "count")
    return spark.read.parquet(f"{path}/coarse").where(F.col("level") == level).drop("level")


def view_points(spark: SparkSession, path: str, grid: Grid, rect, world_per_pixel: float, genes: list[int] | None = None) -> DataFrame:
    """The dots of a viewport: the coarsest level whose bins are not coarser than a pixel, the tiles that the
    rectangle touches, the genes asked for."""
    scales = [0.0] + [grid.tile_size(grid.depth - k) / 32 for k in range(1, grid.depth + 1)]
    level = choose_level(scales, world_per_pixel)
    return pts.pick_genes(in_rect(point_tiles(spark, path, level), grid, rect, grid.depth - level), genes)


# Polygon layers


def load_segments(spark: SparkSession, source: dict, order: list[str] | None = None) -> DataFrame:
    """Vertices (object_id, vertex_no, x, y) from a boundary table or a label mask of pixels or spans."""
    df = spark.read.parquet(source["path"])
    if source.get("mask") or {"row_", "col_", "value"} <= set(df.columns) or is_spans(df):
        require_mask(df)
        return poly.flat_rings(geo.polygons_from_labels(df, source.get("level", Level((1.0, 1.0))), source.get("tolerance", 0.75)))
    return poly.load_boundaries(df, order, source.get("named"))


def write_segment_layer(vertices: DataFrame, path: str, grid: Grid, attributes: DataFrame | None = None, categories: dict[str, DataFrame] | None = None) -> dict:
    """Polygon tiles (ring, triangles) and the feature table of vertices(object_id, vertex_no, x, y), with the tile
    index, and ranges and domains of the columns that objects can be coloured by. Rings are put together,
    triangulated and summed up once, and written under path until features and polygons are made from them."""
    spark = vertices.sparkSession
    geo.shapes(poly.rings(vertices)).write.mode("overwrite").parquet(f"{path}/shapes")
    shapes = spark.read.parquet(f"{path}/shapes")
    objects = shapes.drop("ring", "triangles").withColumnsRenamed({"cx": "x_centroid", "cy": "y_centroid"})
    objects = objects.withColumns({"cx": F.col("x_centroid"), "cy": F.col("y_centroid")})
    placed = poly.dense_ids(poly.placed(objects, grid)).drop("cx", "cy", "gx", "gy")
    table = feat.join_attributes(placed, attributes) if attributes is not None else placed
    table = feat.join_categories(table, categories) if categories else table
    table.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/features")
    written = spark.read.parquet(f"{path}/features")
    feat.value_ranges(written, feat.colour_columns(written)).write.mode("overwrite").parquet(f"{path}/ranges")
    feat.domains(written, spark.read.parquet(f"{path}/ranges")).write.mode("overwrite").parquet(f"{path}/domains")
    keys = written.select("object_id", "cell_id", "tile_row", "tile_col")
    tiles = shapes.join(keys, "object_id").select("tile_row", "tile_col", "cell_id", "ring", "triangles")
    tiles.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/polygons")
    store.delete(spark, f"{path}/shapes")
    index = written.groupBy("tile_row", "tile_col").agg(F.count("*").alias("objects"), F.sum("n_vertices").alias("vertices"))
    index.repartitionByRange(1, "tile_row", "tile_col").write.mode("overwrite").parquet(f"{path}/index")
    return {"color_by": feat.default_colour(table), "categoricals": sorted(categories or {})}


def polygon_tiles(spark: SparkSession, path: str, grid: Grid, rect) -> DataFrame:
    """The polygons of the tiles that a rectangle touches, rings closed."""
    t = in_rect(spark.read.parquet(f"{path}/polygons"), grid, rect)
    return t.select("tile_row", "tile_col", "cell_id", poly.closed("ring").alias("ring"), "triangles")


def view_polygons(spark: SparkSession, path: str, grid: Grid, rect, colour_by: str, hidden: list[str] = ()) -> DataFrame:
    """The polygons of a viewport with a colour position: a ramp over the layer's stored domain of all objects for
    a measurement, a palette slot for a categorical column, whose hidden categories are left out. Only the
    rectangle's tiles of shapes and of features are read, and one row of the domains."""
    table = spark.read.parquet(f"{path}/features")
    shapes = polygon_tiles(spark, path, grid, rect).join(in_rect(table, grid, rect).select("cell_id", colour_by), "cell_id")
    if feat.is_categorical(table.schema[colour_by]):
        shapes = feat.hide_categories(shapes, colour_by, list(hidden))
        return shapes.withColumn("colour", feat.palette_slot(F.col(colour_by), 20))
    domain = spark.read.parquet(f"{path}/domains").where(F.col("column") == colour_by).first()
    lo, hi = (domain["lo"], domain["hi"]) if domain else (0.0, 1.0)  # a column without values
    return shapes.withColumn("colour", feat.ramp_position(F.col(colour_by).cast("double"), F.lit(lo), F.lit(hi)))


def layer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(objects, vertices, triangles, tiles) of a polygon layer."""
    t = spark.read.parquet(f"{path}/polygons")
    return t.agg(F.count("*").alias("objects"), F.sum(F.size("ring")).alias("vertices"), F.sum(F.floor(F.size("triangles") / 3)).alias("triangles"), F.countDistinct("tile_row", "tile_col").alias("tiles"))


# Jobs


def new_folder(kind: str) -> str:
    """A layer's folder, of a name that no other layer has: what is written there is seen once it is committed."""
    return f"{kind}/{uuid.uuid4().hex}"


def import_slide(spark: SparkSession, out: str, name: str, points: DataFrame | None = None, segments: dict[str, DataFrame] | None = None, attributes: DataFrame | None = None, categories: dict[str, DataFrame] | None = None, extra: dict[str, DataFrame] | None = None, tile_size: float = 500.0, min_qv: float | None = 20, genes_only: bool = True, source: str = "", images: dict[str, tuple[DataFrame, Level]] | None = None, bare: tuple[str, ...] = (), facts: dict[str, dict] | None = None) -> dict:
    """Builds a slide: one world around all layers, every layer tiled on it, then the manifest. points is a raw
    point table; segments are vertex tables by id; extra ones must fit the world so far before they widen it,
    in order, and get an id like cell-2 where theirs is taken. images are pixel or chunk tables by id with
    their finest level. Segments named in bare don't take the attributes and categories; facts by id, such as
    visible or colormap, go to the manifest as they are.

    Layers are written to new folders; the manifest that names them comes last, and the layers of the slide that
    was there before go after that. If anything fails, that slide stays as it is."""
    good = pts.load_points(points, min_qv, genes_only) if points is not None else None
    images = {id_: (df, image_level(df, level)) for id_, (df, level) in (images or {}).items()}
    all_segments = dict(segments or {})
    parts = [ext.extent(df) for df in ([good] if good is not None else []) + list(all_segments.values())]
    parts += [spark.createDataFrame([tuple(map(float, level.bounds))], ", ".join(f"{b} double" for b in ext.BOUNDS)) for _, level in images.values()]
    world = ext.union_extent(*parts) if parts else None
    for id_, df in (extra or {}).items():
        bounds = ext.extent(df)
        if world is not None:
            ext.check_fits(bounds, world, id_)
        world = bounds if world is None else ext.union_extent(world, bounds)
        all_segments[free_id(id_, set(all_segments))] = df
    row = world.first() if world is not None else None
    if row is None or row["minx"] is None:
        raise ValueError(f"{source or name}: no layer has an extent")
    bounds = tuple(float(row[b]) for b in ext.BOUNDS)
    grid = Grid(*bounds, choose_depth(bounds, tile_size))
    found = []

    def add(id_: str, kind: str, write) -> None:
        path = new_folder(kind)
        found.append({"id": id_, "kind": kind, "path": path} | write(f"{out}/{path}") | {k: v for k, v in (facts or {}).get(id_, {}).items() if v is not None})

    for id_, (df, level) in images.items():
        add(id_, "image", lambda path, df=df, level=level: write_image_layer(df, path, level))
    for id_, df in all_segments.items():
        more = (None, None) if id_ in bare else (attributes, categories)
        add(id_, "segments", lambda path, df=df, more=more: write_segment_layer(df, path, grid, *more))
    if good is not None:
        add("points", "points", lambda path: write_point_layer(good, path, grid))
    manifest = {"format": FORMAT, "name": name, "world_units": "um", "world_bounds": list(bounds), "tile_depth": grid.depth, "layers": found, "source": {"platform": "tables", "path": source, "imported": datetime.datetime.now(datetime.timezone.utc).isoformat(), "tile_size": tile_size, "min_qv": min_qv, "genes_only": genes_only}}
    old = []

    def swap(before: dict | None) -> dict:
        old[:] = [layer["path"] for layer in (before or {}).get("layers") or [] if layer.get("path")]
        return manifest

    manifest = commit(spark, out, swap)
    for path in old:
        store.delete(spark, f"{out}/{path}")
    return manifest


def _loaded(spark: SparkSession, source: dict) -> DataFrame:
    """load_segments of a source, a mask's scale taken from the JSON beside it."""
    return load_segments(spark, source | ({"level": _first_level(spark, source["levels"])} if source.get("levels") else {}), [])


def _first_level(spark: SparkSession, path: str | None) -> Level:
    return raster_levels(spark, spark.read.text(path, wholetext=True).first()[0])[0] if path else Level((1.0, 1.0))


def _attributes(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.parquet(path)
    return t if "object_id" in t.columns else t.withColumnRenamed("cell_id", "object_id")


def import_folder(spark: SparkSession, root: str, out: str, name: str, images: list[tuple[str, str | None]] | None = None, **options) -> dict:
    """import_slide of all that discover finds under root; images (path, colour map) replace those found; other
    options are import_slide's."""
    found = discover(spark, root, images)
    if not found:
        raise ValueError(f"{root}: nothing to import")
    of = lambda kind: [s for s in found if s["kind"] == kind]
    tables = [s for s in of("segments") if not s.get("mask")]
    attributes = next((_attributes(spark, s["cells"]) for s in tables if s["cells"]), None)
    categories = {n: spark.read.csv(p, header=True) for s in tables for n, p in s["categories"]}
    return import_slide(
        spark, out, name, next((spark.read.parquet(s["path"]) for s in of("points")), None), {s["id"]: _loaded(spark, s) for s in of("segments")}, attributes, categories,
        images={s["id"]: (spark.read.parquet(s["path"]), _first_level(spark, s["levels"])) for s in of("image")}, bare=tuple(s["id"] for s in of("segments") if s.get("mask")),
        facts={s["id"]: {"visible": s.get("visible"), "colormap": s.get("colormap")} for s in found}, source=root, **options,
    )


def add_segments(spark: SparkSession, root: str, id_: str, vertices: DataFrame, attributes: DataFrame | None = None, categories: dict[str, DataFrame] | None = None, source: str = "") -> dict:
    """Adds a segmentation to a slide on the grid it has; its id gets -2, -3, ... if taken. The layer is written
    before the manifest names it; of several added at once none is lost."""
    manifest = latest(spark, root)
    if manifest is None:
        raise ValueError(f"{root}: no manifest")
    world = spark.createDataFrame([tuple(manifest["world_bounds"])], ", ".join(f"{b} double" for b in ext.BOUNDS))
    ext.check_fits(ext.extent(vertices), world, id_)
    path = new_folder("segments")
    facts = write_segment_layer(vertices, f"{root}/{path}", grid_of(manifest), attributes, categories)

    def change(newest: dict) -> dict:
        layer = {"id": free_id(id_, {known["id"] for known in newest["layers"]}), "kind": "segments", "path": path, **facts}
        return newest | {"layers": [*newest["layers"], layer], "added": [*(newest.get("added") or []), {"kind": "segments", "id": layer["id"], "path": source}]}

    return commit(spark, root, change)


def add_segments_from(spark: SparkSession, root: str, path: str, id_: str | None = None, cells: str | None = None, categories: dict[str, str] | None = None, named: dict[str, str] | None = None, tolerance: float = 0.75) -> dict:
    """add_segments of a boundary table or a mask, with its attribute table and category CSVs by feature name. A mask
    takes its scale from the JSON of its name beside it; that its extent fits is checked before it is traced,
    and it takes no attributes and categories, as its labels are not the objects' ids."""
    manifest = latest(spark, root)
    stem = store.name(path).removesuffix(".parquet")
    beside = f"{store.folder(path)}/{stem}.json"
    df = spark.read.parquet(path)
    mask = {"row_", "col_", "value"} <= set(df.columns) or is_spans(df)
    source = {"path": path, "named": named, "tolerance": tolerance, "mask": mask}
    if mask and manifest is not None:
        level = _first_level(spark, beside if store.exists(spark, beside) else None)
        last = df.agg(F.max("row_").alias("row_"), F.max("c1" if is_spans(df) else "col_").alias("col_")).first()
        level = Level(level.scale, level.translation, ((last["row_"] or 0) + 1, (last["col_"] or 0) + 1), level.chunk)
        rows = ", ".join(f"{b} double" for b in ext.BOUNDS)
        ext.check_fits(spark.createDataFrame([tuple(map(float, level.bounds))], rows), spark.createDataFrame([tuple(manifest["world_bounds"])], rows), path)
        source["level"] = level
    more = (None, None) if mask else (_attributes(spark, cells) if cells else None, {n: spark.read.csv(p, header=True) for n, p in (categories or {}).items()})
    return add_segments(spark, root, id_ or stem, load_segments(spark, source, []), *more, source=path)
