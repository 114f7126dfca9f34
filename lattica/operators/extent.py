"""Extents of layers, their union, and whether a layer fits a world."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("minx", "miny", "maxx", "maxy")


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def union_extent(*extents: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, extents)
    return both.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def overlap_fraction(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The share of rectangle a that lies in b; sides count as 1e-9 at least."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(a[0].isNotNull(), w * h / (F.greatest(a[2] - a[0], F.lit(1e-9)) * F.greatest(a[3] - a[1], F.lit(1e-9))))


def fit_report(layers: DataFrame, world: DataFrame) -> DataFrame:
    """(layer, inside, verdict) for each layer's bounds: 'refuse' under half inside, 'warn' if not all, else 'ok'.
    world is one row."""
    w = world.toDF(*[f"w_{b}" for b in BOUNDS])
    inside = overlap_fraction(tuple(F.col(b) for b in BOUNDS), tuple(F.col(f"w_{b}") for b in BOUNDS))
    verdict = F.when(F.col("inside") < 0.5, "refuse").when(F.col("inside") < 1 - 1e-9, "warn").otherwise("ok")
    return layers.crossJoin(w).select("layer", inside.alias("inside")).withColumn("verdict", verdict)  # world is one row


def check_fits(bounds: DataFrame, world: DataFrame, label: str) -> float:
    """Raises if less than half of a layer's extent lies in the world; warns if not all of it does."""
    row = fit_report(bounds.withColumn("layer", F.lit(label)), world).first()
    if row["inside"] is None:
        raise ValueError(f"{label}: no rows")
    if row["verdict"] == "refuse":
        raise ValueError(f"{label}: only {row['inside']:.0%} of its extent lies inside the world; are its units right?")
    if row["verdict"] == "warn":
        warnings.warn(f"{label}: {row['inside']:.1%} of its extent lies inside the world", stacklevel=2)
    return row["inside"]
