"""The order of rows in files: the first row of the first file comes first, however Spark deals files to tasks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a file that form one block, as a power of two.
BLOCK_BITS = 18


def file_name(path: str | Column = "_metadata.file_path") -> Column:
    """A key that sorts files by folder, then the number that Spark gives the parts of a table (of any number
    of digits), then name."""
    c = F.col(path) if isinstance(path, str) else path
    number = F.regexp_extract(c, r"/part-(\d{1,18})[^/]*$", 1)
    return F.struct(F.regexp_extract(c, "^(.*/)", 1).alias("folder"), F.coalesce(number.try_cast("long"), F.lit(-1)).alias("number"), c.alias("path"))


def has_files(df: DataFrame) -> bool:
    """Whether a table still knows which files its rows come from: it is read and filtered, not shuffled."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
        return True
    except AnalysisException:
        return False


def has_row_index(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


#: Rows of a Parquet file, as a power of two, for which a place is one number.
ROW_BITS = 40


def placed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of a table with columns that sort as its files do, and the names of these: file, place of the block in
    it, row. Files are numbered in a small table of their names, so that no name travels with a row. Parquet numbers
    a file's rows; of other formats a block of a file is read by one task from its first row on, so the row numbers
    of that task are in order inside it. Rows without files, as those made by the driver, have the order of
    partitions."""
    if not has_files(df):
        return df.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    path = F.col("_metadata.file_path").alias("_path")
    numbers = df.select(path).distinct().select("_path", (F.row_number().over(Window.orderBy(file_name("_path"))) - 1).alias("_file"))
    if has_row_index(df):
        t = df.select("*", path, F.col("_metadata.row_index").alias("_row")).join(F.broadcast(numbers), "_path").drop("_path")
        return t.withColumn("_row", F.shiftleft(F.col("_file").cast("long"), ROW_BITS) + F.col("_row")).drop("_file"), ["_row"]
    t = df.select("*", path, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return t.join(F.broadcast(numbers), "_path").drop("_path"), ["_file", "_start", "_row"]


def file_blocks(df: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, str, str]:
    """The rows of a Parquet table with their block of 2 ** bits rows of a file, and their place in it: the table
    and the names of the two columns. Both sort as the files do."""
    if not (has_files(df) and has_row_index(df)):
        raise ValueError("the rows have no place in Parquet files; give an order")
    row = F.col("_metadata.row_index")
    return df.select("*", F.struct(file_name().alias("file"), F.shiftright(row, bits).alias("n")).alias("_block"), row.alias("_at")), "_block", "_at"
