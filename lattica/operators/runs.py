"""Runs of equal consecutive keys over a whole table, without a window over the table.

A scan that carries its state over block boundaries: rows are counted inside blocks of bounded size, a small table
of blocks says what each one takes over from those before, and both are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _inside(rows: DataFrame, key: str, block: str, at: str) -> DataFrame:
    """rows with `_run`: runs begun inside the block before or at each row; a block's first row begins none yet."""
    w = Window.partitionBy(block).orderBy(at)
    new = (F.row_number().over(w) > 1) & ~F.lag(key).over(w).eqNullSafe(F.col(key))
    return rows.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _carried(edges: DataFrame, block: str) -> DataFrame:
    """(block, _base): the run that each block's first row has, counted from 1. edges(block, _first, _last, _runs)
    has a row a block, so this window covers a table smaller than the rows by a block's size."""
    w = Window.orderBy(block)
    begins = (F.row_number().over(w) == 1) | ~F.lag("_last").over(w).eqNullSafe(F.col("_first"))
    t = edges.withColumn("_begins", begins.cast("long"))
    before = F.coalesce(F.sum(F.col("_begins") + F.col("_runs")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select(block, (before + F.col("_begins")).alias("_base"))


def _edges(inside: DataFrame, key: str, block: str, at: str) -> DataFrame:
    boxed = F.struct(F.col(key).alias("k"))  # min_by and max_by pass over nulls, but not over a struct of one
    return inside.groupBy(block).agg(F.min_by(boxed, at)["k"].alias("_first"), F.max_by(boxed, at)["k"].alias("_last"), F.max("_run").alias("_runs"))


def numbered_runs(rows: DataFrame, key: str, block: str, at: str) -> DataFrame:
    """rows with `run`, the number of its run in the whole table, from 1.

    block and at are the order: blocks hold consecutive rows and sort as the table does, `at` sorts the rows of a
    block. One shuffle by block of bounded size, whatever the length of a run or the number of its key."""
    inside = _inside(rows, key, block, at)
    carried = _carried(_edges(inside, key, block, at), block)
    return inside.join(carried, block).withColumn("run", F.col("_run") + F.col("_base")).drop("_run", "_base")


def run_table(rows: DataFrame, key: str, block: str, at: str) -> DataFrame:
    """(run, key, first_block, first, length) of each run. Rows are counted by block and run first, so a run of
    any length costs one row a block."""
    inside = _inside(rows, key, block, at)
    carried = _carried(_edges(inside, key, block, at), block)
    boxed = F.struct(F.col(key).alias("k"))
    parts = inside.groupBy(block, "_run").agg(F.first(boxed)["k"].alias("key"), F.min(at).alias("_first"), F.count("*").alias("_n"))
    parts = parts.join(carried, block).withColumn("run", F.col("_run") + F.col("_base"))
    least = F.min(F.struct(F.col(block).alias("b"), F.col("_first").alias("f")))
    t = parts.groupBy("run").agg(F.first(F.struct("key"))["key"].alias("key"), least.alias("_l"), F.sum("_n").alias("length"))
    return t.select("run", "key", F.col("_l.b").alias("first_block"), F.col("_l.f").alias("first"), "length")


def grouped_already(rows: DataFrame, key: str, block: str, at: str) -> DataFrame:
    """One row (n_keys, n_runs, grouped): whether each key of the table, null included, is one run. A table without
    rows is grouped."""
    inside = _inside(rows, key, block, at)
    edges = _edges(inside, key, block, at)
    last = _carried(edges, block).join(edges.select(block, "_runs"), block).agg(F.coalesce(F.max(F.col("_base") + F.col("_runs")), F.lit(0)).alias("n_runs"))
    keys = rows.select(F.struct(F.col(key)).alias("k")).groupBy("k").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_keys"))
    return keys.crossJoin(last).withColumn("grouped", F.col("n_keys") == F.col("n_runs"))  # one row each


def range_blocks(rows: DataFrame, order: list[str], path: str, blocks: int | None = None) -> tuple[DataFrame, str, str]:
    """rows in the given order, as blocks: the table and the names of its block and place columns. The rows are
    sorted by ranges and written under path, so that blocks stay what they are when a task is run again."""
    by = [F.col(c) for c in order]
    t = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    t = t.withColumn("_block", F.spark_partition_id()).sortWithinPartitions(*by)
    t.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path), "_block", "_at"
