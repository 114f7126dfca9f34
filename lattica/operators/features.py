"""Per-object attributes: joins, categories, value domains and colour positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.order import placed

from .ranks import order_statistics

#: Measurements that are coloured by first, if present (fixed values).
PREFERRED = ("cell_area", "nucleus_area", "transcript_counts", "total_counts", "area")
NEVER = ("id", "cell_id", "object_id", "x_centroid", "y_centroid")
UNASSIGNED = "unassigned"


def first_per_key(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The first row of each key in the given order, or the first row of the first file that the table is read
    from (see sources.order): an aggregate, so that rows of a frequent key are thinned out before the shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    rows, order = (rows, order) if order else placed(rows)
    place = F.struct(*order)
    t = rows.select(F.col(f"`{key}`").alias("_k"), place.alias("_p"), whole.alias("_w"))
    return t.groupBy("_k").agg(F.min_by("_w", "_p").alias("_w")).select("_w.*")


def join_attributes(objects: DataFrame, cells: DataFrame, key: str = "object_id", order: list[str] | None = None) -> DataFrame:
    """Left join of an attribute table, its id cast to the objects' type and then its first row per id; a column
    the attributes also have (such as a computed area) gives way to theirs. The row count stays."""
    right = first_per_key(cells.withColumn(key, F.col(key).cast(objects.schema[key].dataType)), key, order)
    return objects.drop(*[c for c in right.columns if c != key]).join(right, key, "left")


def join_categories(objects: DataFrame, tables: dict[str, DataFrame], key: str = "object_id", order: list[str] | None = None) -> DataFrame:
    """Left joins of category tables (first column the id, second the category): first match wins, null where
    there is none; the new columns carry the metadata {"categorical": true}."""

    def add(df, item):
        name, t = item
        t = t.toDF(key, name, *t.columns[2:])
        t = first_per_key(t.withColumn(key, F.col(key).cast(objects.schema[key].dataType)), key, order)
        t = t.select(key, F.col(name).alias(name, metadata={"categorical": True}))
        return df.join(t, key, "left")

    return reduce(add, tables.items(), objects)


def is_categorical(field: T.StructField) -> bool:
    """Whether a column is marked; the marker may be true or 'true'."""
    return str((field.metadata or {}).get("categorical", "")).lower() == "true"


def colour_columns(df: DataFrame) -> list[str]:
    """Columns that objects can be coloured by: numeric, neither id nor centroid."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NEVER]


def default_colour(df: DataFrame) -> str | None:
    usable = colour_columns(df)
    return next((c for c in PREFERRED if c in usable), usable[0] if usable else None)


def category_key(value: str | Column) -> Column:
    """The category as text: the number truncated, 'unassigned' for null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(v.cast("double").cast("bigint").cast("string"), F.lit(UNASSIGNED))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(category, count), ascending by number, 'unassigned' last."""
    t = df.groupBy(F.col(column).cast("double").cast("bigint").alias("_v")).agg(F.count("*").alias("count"))
    return t.orderBy(F.asc_nulls_last("_v")).select(F.coalesce(F.col("_v").cast("string"), F.lit(UNASSIGNED)).alias("category"), "count")


def hide_categories(df: DataFrame, column: str, hidden: list[str]) -> DataFrame:
    return df.where(~category_key(column).isin(hidden)) if hidden else df


def robust_domain(df: DataFrame, column: str, low: float = 0.02) -> DataFrame:
    """(lo, hi): the nearest-rank `low` and 1 - low percentiles of the values; least and greatest where those
    are equal; hi = lo + 1 where those are too; 0 and 1 without values."""
    v = F.col(column).cast("double")
    rank = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(low)))
    found = order_statistics(df.select(v.alias("_v")), [], "_v", {"_lo": rank, "_hi": lambda n: n + 1 - rank(n), "_min": lambda n: F.lit(1), "_max": lambda n: n})
    t = df.sparkSession.range(1).select(F.lit(0).alias("_one")).join(found.withColumn("_one", F.lit(0)), "_one", "left")
    flat = F.col("_hi") <= F.col("_lo")
    t = t.select(F.coalesce(F.when(flat, F.col("_min")).otherwise(F.col("_lo")), F.lit(0.0)).alias("lo"), F.when(flat, F.col("_max")).otherwise(F.col("_hi")).alias("hi"))
    return t.select("lo", F.when(F.coalesce("hi", "lo") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


#: Ranges of values a power of two has: their relative width is under 1 / 100.
STEPS = 128


def value_range(value: Column) -> Column:
    """The number of a value's range: the same for all tables, ascending with the value, fine around 0."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * STEPS).cast("int") + 1100 * STEPS  # doubles begin at 2 ** -1074
    return F.when(value == 0, 0).otherwise(F.when(value > 0, size).otherwise(-size))


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, range, n, least, greatest): how many values of each column lie in each range. One pass over df, at
    most some 280,000 rows a column; tables of several layers are merged by merged_ranges."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, range int, n long, least double, greatest double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    t = df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return t.groupBy("column", value_range(F.col("v")).alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def merged_ranges(*tables: DataFrame) -> DataFrame:
    """The ranges of all layers together."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy("column", "range").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def domains(df: DataFrame, ranges: DataFrame, low: float = 0.02) -> DataFrame:
    """(column, n, lo, hi) of every column of value_ranges: the domain that robust_domain gives. The ranges say
    where the percentiles lie; only the values there are counted one by one, in one pass over df."""
    whole = Window.partitionBy("column")
    t = ranges.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("range")), "a": F.min("least").over(whole), "z": F.max("greatest").over(whole)})
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(low)))
    t = t.withColumn("asked", F.explode(F.array(F.struct(F.lit("lo").alias("what"), rank.alias("rank")), F.struct(F.lit("hi").alias("what"), (F.col("total") + 1 - rank).alias("rank")))))
    t = t.where((F.col("asked.rank") <= F.col("upto")) & (F.col("asked.rank") > F.col("upto") - F.col("n")))
    t = t.select("column", "range", "asked.what", (F.col("asked.rank") - F.col("upto") + F.col("n")).alias("rank"), "total", "a", "z")
    columns = [r["column"] for r in ranges.select("column").distinct().collect()]  # columns of a table
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n long, lo double, hi double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in sorted(columns)])
    values = df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = values.withColumn("range", value_range(F.col("v"))).join(t.select("column", "range").distinct(), ["column", "range"]).groupBy("column", "range", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("column", "range").orderBy("v")))
    found = t.join(values, ["column", "range"]).where("upto >= rank").groupBy("column", "what", "total", "a", "z").agg(F.min("v").alias("v"))
    one = found.groupBy("column", F.col("total").alias("n"), "a", "z").agg(F.min(F.when(F.col("what") == "lo", F.col("v"))).alias("lo"), F.min(F.when(F.col("what") == "hi", F.col("v"))).alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    one = one.select("column", "n", F.when(flat, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("z")).otherwise(F.col("hi")).alias("hi"))
    return one.select("column", "n", "lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def ramp_position(value: Column, lo: Column, hi: Column) -> Column:
    """0 to 255 along a value ramp; null values lie at its bottom."""
    inside = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value - lo) * 255 / (hi - lo) + 0.5))).cast("int")
    return F.when(value.isNotNull(), inside).otherwise(0)


def palette_slot(category: Column, size: int) -> Column:
    return F.pmod(category.cast("bigint"), F.lit(size)).cast("int")
