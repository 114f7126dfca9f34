"""Exact order statistics without holding a group's values in one place."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of equal width into which a group's values are dealt.
RANGES = 4096


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column per rank): the value of rank 1 to n of the ascending values that are not null. ranks
    give the rank from n, the group's number of values; groups without values give no row.

    Values are counted first, so equal ones cost one row. The counts of RANGES ranges say in which range a
    rank lies, and only the counts of these ranges are summed one by one."""
    one = [F.lit(0).alias("_g")] if not by else []
    keys = by or ["_g"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, *one, value).agg(F.count("*").alias("_c"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_z"), F.sum("_c").alias("n"))
    width = F.col("_z").cast("double") - F.col("_a").cast("double")
    at = F.when(width > 0, F.floor((F.col(value).cast("double") - F.col("_a").cast("double")) / width * RANGES)).otherwise(0)
    dealt = counts.join(ends.drop("n"), keys).select(*keys, value, "_c", at.alias("_r"))
    sizes = dealt.groupBy(*keys, "_r").agg(F.sum("_c").alias("_s"))
    sizes = sizes.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_r")) - F.col("_s")).join(ends.select(*keys, "n"), keys)
    asked = [(F.col("_before") < rank(F.col("n"))) & (rank(F.col("n")) <= F.col("_before") + F.col("_s")) for rank in ranks.values()]
    inside = dealt.join(sizes.where(reduce(or_, asked)).drop("_s"), [*keys, "_r"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy(value))
    inside = inside.withColumn("_upto", upto)
    out = inside.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_upto") >= rank(F.col("n")), F.col(value))).alias(name) for name, rank in ranks.items()])
    return out.drop("_g") if not by else out
