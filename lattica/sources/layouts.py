"""What a dataset folder offers: sources found by layouts, and which of them count.

Each rule names a place where a layer may lie, a pattern, and the rank of its layout. Sources are rows of a small table;
of one kind and id the lowest rank counts, and of images only those of the lowest rank that has any."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: (kind, rank, pattern): where layers lie in known layouts (fixed values). Rasters are Parquet tables of pixels,
#: chunks or spans here; `.ome` marks images that come with all channels.
RULES = (
    ("points", 0, "transcripts.parquet"),
    ("cells", 0, "cells.parquet"),
    ("segments", 0, "cell_boundaries.parquet"),
    ("segments", 0, "nucleus_boundaries.parquet"),
    ("segments", 1, "labels/*"),
    ("image", 0, "*.ome.parquet"),
    ("image", 1, "images/*.parquet"),
    ("image", 2, "morphology_focus/*.parquet"),
    ("image", 3, "morphology_focus.parquet"),
    ("category", 0, "analysis/clustering/*/clusters.csv"),
    ("category", 1, "clusters/*"),
)
#: Ids of boundary tables, and those that are not shown at first: nuclei lie inside the cells' outlines (fixed values).
BOUNDARIES = {"cell_boundaries.parquet": "cell", "nucleus_boundaries.parquet": "nucleus"}
HIDDEN = ("nucleus",)
#: The parts around the name of a clustering, and the one that is shown first with its name here (fixed values).
BEFORE_CLUSTERING, AFTER_CLUSTERING, FIRST_CLUSTERING, FIRST_NAME = "gene_expression_", "_clusters", "graphclust", "cluster"
SOURCES = "kind string, id string, rank int, path string, levels string, place array<string>"
ORDER = {"image": 0, "segments": 1, "points": 2}


def clustering_name(entry: str) -> str:
    """The feature's name of a clustering, from its folder or file."""
    inner = re.match(f"(?:{BEFORE_CLUSTERING})?(?P<inner>.*?)(?:{AFTER_CLUSTERING})?(?:[.]csv)?$", entry)["inner"]
    return {FIRST_CLUSTERING: FIRST_NAME}.get(inner, inner)


def clustering_place(feature: str) -> list[str]:
    """A key that puts the first clustering first, then those of few clusters: numbers by value."""
    numbers = [part.zfill(9) for part in re.findall("[0-9]+", feature)]
    return ["" if feature == FIRST_NAME else "a", *numbers, feature]


def source_table(spark: SparkSession, root: str) -> DataFrame:
    """(kind, id, rank, path, levels, place): every source that a rule finds under root; levels is the JSON with a
    raster's scales beside it, place sorts the sources of a kind."""
    rows = []
    for kind, rank, pattern in RULES:
        for path in store.found(spark, f"{root}/{pattern}"):
            entry = store.name(path)
            if entry.endswith(".json"):
                continue
            stem = re.sub(r"([.]ome)?[.]parquet$", "", entry)
            if kind == "category":
                id_ = clustering_name(store.name(store.folder(path)) if entry == "clusters.csv" and rank == 0 else entry)
                place = clustering_place(id_)
            else:
                id_ = BOUNDARIES.get(entry, stem) if kind == "segments" else stem
                place = ["a" if "dapi" in id_.lower() else "b" if kind == "image" else "", id_]
            beside = f"{store.folder(path)}/{stem}.json"
            rows.append((kind, id_, rank, path, beside if kind in ("image", "segments") and store.exists(spark, beside) else None, place))
    return spark.createDataFrame(rows, SOURCES)


def counting(sources: DataFrame) -> DataFrame:
    """The sources that count, in order."""
    of_id = F.row_number().over(Window.partitionBy("kind", "id").orderBy("rank", "path"))
    of_kind = F.min("rank").over(Window.partitionBy("kind"))
    t = sources.withColumns({"_n": of_id, "_least": of_kind}).where("_n = 1").where((F.col("kind") != "image") | (F.col("rank") == F.col("_least")))
    return t.drop("_n", "_least").orderBy("kind", "place")


def discover(spark: SparkSession, root: str, images: list[tuple[str, str | None]] | None = None) -> list[dict]:
    """The layers of a dataset folder: kind, id, path and options. images (path, colour map) stand for all images
    found. Boundary tables take the shared attributes and the clusterings; masks take none."""
    rows = [r.asDict() for r in counting(source_table(spark, root)).collect()]  # a row a file of a few folders
    cells = next((r["path"] for r in rows if r["kind"] == "cells"), None)
    categories = [(r["id"], r["path"]) for r in rows if r["kind"] == "category"]
    out = []
    for r in rows:
        base = {"kind": r["kind"], "id": r["id"], "path": r["path"]}
        if r["kind"] == "segments":
            table = r["rank"] == 0
            out.append(base | {"visible": r["id"] not in HIDDEN} | ({"cells": cells, "categories": categories} if table else {"mask": True, "levels": r["levels"]}))
        elif r["kind"] == "image" and images is None:
            out.append(base | {"levels": r["levels"]})
        elif r["kind"] == "points":
            out.append(base)
    for path, colormap in images or []:
        stem = re.sub(r"([.]ome)?[.]parquet$", "", store.name(path))
        beside = f"{store.folder(path)}/{stem}.json"
        out.append({"kind": "image", "id": stem, "path": path, "levels": beside if store.exists(spark, beside) else None, "colormap": colormap})
    return sorted(out, key=lambda s: ORDER[s["kind"]])
