"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again as the next stage's docs. The first four
return the columns of documents, whatever else these are called. Rows without a doc_id are documents too:
the stages that need a name for each document take one from the text, beyond all ids. Empty tables pass
through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.decontamination import contaminated
from lattica.llm.mixing import mixed
from lattica.llm.near_dedup import near_groups
from lattica.llm.quality_rules import quality_rules
from lattica.llm.resharding import resharded
from lattica.llm.tables import Scratch, table


def free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that docs has no column of."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def named(docs: DataFrame, key: str) -> DataFrame:
    """docs with `key`: doc_id, or for rows without one 2 ** 62 and more, by a hash of the text."""
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(F.xxhash64("text"), F.lit(2**62))))


def by_key(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows that share a doc_id are judged by their own texts."""
    id_, hash_ = free(docs, "id_"), free(docs, "hash_")
    rejected = quality_rules(docs, table(spark, sf_dir, "labels")).where("not kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(rejected, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (those without one come
    last), once: of rows that share a doc_id the least by text, then by the other columns."""
    key = free(docs, "key_")
    rows = named(docs, key)
    kept = Scratch(spark).cut(near_groups(by_key(rows, key), words=5, percent=80).where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")))
    once = rows.join(kept.where("n = 1").select(key), key, "left_semi")
    several = rows.join(kept.where("n > 1").select(key), key, "left_semi")
    order = Window.partitionBy(key).orderBy("text", *[c for c in docs.columns if c != "text"])
    rank = free(docs, "rank_")
    first = several.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return once.select(docs.columns).unionByName(first.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that share a doc_id are one document."""
    key = free(docs, "key_")
    rows = named(docs, key)
    # Written, so that Spark joins a table of known size: it broadcasts a small one, and no text is shuffled.
    leaks = Scratch(spark).cut(contaminated(by_key(rows, key), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct())
    return rows.join(leaks, key, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as many times as the mix takes it; documents without words go."""
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed(docs).where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards of near equal bytes, from 12 by source: their files are written in the shared folder; the rows
    are those of the files."""
    return resharded(docs, F.crc32(F.coalesce("source", F.lit(""))) % 12, 12)


STAGES = [("quality rules", quality), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The isolation forest and near-duplicate groups are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
