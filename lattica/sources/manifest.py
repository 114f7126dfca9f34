"""Manifests of slides: what they hold, and how layers are committed to them.

Layers are written into folders of their own before a manifest names them, and a manifest is a new file of the next
number, which only one writer can make; so a job that fails leaves the slide as it was, and of two jobs at
once the second one adds to what the first one made. That holds where the store's rename is one step, as HDFS's is;
for a local disk, whose rename is not, jobs of one driver also take turns."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.grid import Grid

from . import store

FORMAT = 1
KINDS = ("image", "segments", "points")
#: Colour maps of channels by position, and of other layers by kind, where none is given (fixed values).
CHANNEL_COLORMAPS = ("blue", "green", "red", "cyan", "magenta", "yellow")
COLORMAPS = {"segments": "viridis", "points": "yellow"}
TURN = threading.Lock()
SCHEMA = """format int, version int, name string, world_units string, world_bounds array<double>, tile_depth int,
source struct<platform:string,path:string,imported:string,tile_size:double,min_qv:double,genes_only:boolean>,
layers array<struct<id:string,kind:string,path:string,name:string,visible:boolean,levels:int,colormap:string,color_by:string,categoricals:array<string>,scale:array<double>,translation:array<double>,shape:array<int>,chunk:array<int>,channels:array<struct<channel:string,lo:double,hi:double,top:double>>>>,
added array<struct<kind:string,id:string,path:string>>"""


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """Replaces the manifest in one step."""
    store.replace(spark, f"{root}/manifest.json", json.dumps(manifest, indent=1))


def _checked(row, root: str) -> dict:
    if row is None or row["format"] is None:
        raise ValueError(f"{root}: no manifest")
    if row["format"] > FORMAT:
        raise ValueError(f"{root}: format {row['format']} is newer than {FORMAT}")
    return row.asDict(recursive=True)


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The manifest as a dict; a newer format is refused."""
    return _checked(spark.read.schema(SCHEMA).json(f"{root}/manifest.json", multiLine=True).first(), root)


def _numbered(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """The numbered manifests, the newest last."""
    paths = store.found(spark, f"{root}/manifests/*.json")
    return sorted((int(m[1]), p) for p in paths if (m := re.fullmatch(r"(\d+)\.json", store.name(p))))


def latest(spark: SparkSession, root: str) -> dict | None:
    """The newest committed manifest, else the one that was written without a number, else None."""
    numbered = _numbered(spark, root)
    if numbered:
        return _checked(spark.read.schema(SCHEMA).json(numbered[-1][1], multiLine=True).first(), root)
    return read_manifest(spark, root) if store.exists(spark, f"{root}/manifest.json") else None


def commit(spark: SparkSession, root: str, change: Callable[[dict | None], dict], tries: int = 100) -> dict:
    """Makes change(newest manifest, or None) the newest one, and returns it. Where another writer was first, change
    is asked again with what that one made. Then manifest.json is replaced, until it is the newest."""
    for _ in range(tries):
        numbered = _numbered(spark, root)
        version = numbered[-1][0] + 1 if numbered else 1
        manifest = change(latest(spark, root)) | {"version": version}
        with TURN:
            first = store.create(spark, f"{root}/manifests/{version:08d}.json", json.dumps(manifest, indent=1))
        if first:
            break
    else:
        raise RuntimeError(f"{root}: others committed {tries} times meanwhile")
    with TURN:
        shown = None
        while shown != (shown := _numbered(spark, root)[-1]):
            write_manifest(spark, root, latest(spark, root))
    return manifest


def layers(spark: SparkSession, root: str) -> DataFrame:
    """One row per layer, with defaults for missing fields; layers of unknown kind are skipped."""
    read_manifest(spark, root)
    t = spark.read.schema(SCHEMA).json(f"{root}/manifest.json", multiLine=True).select(F.posexplode("layers").alias("position", "l")).select("position", "l.*")
    t = t.where(F.col("kind").isin(*KINDS))
    channel = F.get(F.array(*map(F.lit, CHANNEL_COLORMAPS)), F.col("position") % len(CHANNEL_COLORMAPS))
    other = F.create_map(*[F.lit(x) for kv in COLORMAPS.items() for x in kv])[F.col("kind")]
    d = {"name": F.col("id"), "path": F.col("id"), "visible": F.lit(True), "levels": F.lit(0), "categoricals": F.array().cast("array<string>"), "colormap": F.when(F.col("kind") == "image", channel).otherwise(other)}
    return t.withColumns({k: F.coalesce(F.col(k), v) for k, v in d.items()})


def layer_path(manifest: dict, root: str, id_: str) -> str:
    """The folder of a layer of the manifest."""
    for layer in manifest["layers"]:
        if layer["id"] == id_:
            return f"{root}/{layer.get('path') or id_}"
    raise KeyError(f"{root}: no layer {id_}")


def check_layers(spark: SparkSession, root: str) -> None:
    """Raises if a layer is listed but not there."""
    gone = [r["id"] for r in layers(spark, root).collect() if not store.exists(spark, f"{root}/{r['path']}")]
    if gone:
        raise FileNotFoundError(f"{root}: missing layers {', '.join(gone)}")


def grid_of(manifest: dict) -> Grid:
    return Grid(*manifest["world_bounds"], manifest["tile_depth"])


def free_id(id_: str, taken: set[str]) -> str:
    """The id, or the first of id-2, id-3, ... that is not taken."""
    n, out = 1, id_
    while out in taken:
        n += 1
        out = f"{id_}-{n}"
    return out
