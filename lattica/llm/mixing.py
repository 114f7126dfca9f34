"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are dealt to so many buckets by a seeded hash; a task orders one bucket at a time.
BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_filling(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to sources(source, unnamed, source_size, weight): the budget, share * all sizes, is dealt by
    weight; no source gets above most * source_size, and what it leaves goes to the others by weight
    until none is above. Sorted by cap per weight, the capped ones are a prefix, so one running sum
    finds the level. There is one row per source, so the global windows are as small as that list."""
    order = Window.orderBy(F.col("cap") / F.col("weight"), "unnamed", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    t = sources.withColumn("cap", F.col("source_size") * F.lit(most))
    t = t.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("budget", F.sum("source_size").over(all_) * F.lit(share))
    t = t.withColumn("level", (F.col("budget") - F.col("used")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap"))
    return t.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("weight"))).drop("cap", "used", "open", "budget", "level")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """One row per input row of docs(doc_id, source, text): doc_id, size, source_size, target, taken, and row, a
    struct of all columns of docs; where that is read, texts are shuffled once, with their buckets.

    size is the number of words. Sources in code-point order, null last, take the weights in turn; see
    water_filling. All documents of a source are taken floor(target / source_size) times; one more time
    those that come first in a seeded order, while the middle of the document lies under the rest of the
    target, so that a source misses its target by less than half a document. Buckets of the seeded hash
    are summed first; a running sum over them tells where a bucket begins, and only the inside of a
    bucket is ordered row by row. Null and blank texts have size 0 and take 0, very long ones are sized
    whole; a null source is a source; a null doc_id is drawn by its text; repeated rows are separate, and
    stand next to each other in the order; other columns are ignored; an
    empty table gives an empty result. Reruns agree, as the order depends on doc_id and seed alone."""
    key = [F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed")]
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, word_count().alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("draw"), whole_row.alias("row"))
    rows = rows.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    buckets = rows.drop("row").groupBy("source", "unnamed", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("source", "unnamed").agg(F.sum("bucket_size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("unnamed", "source")) - 1
    turn = F.array(*map(F.lit, weights))
    sources = sources.withColumn("weight", F.get(turn, number % len(weights)).cast("long"))
    targets = water_filling(sources, share, most).select("source", "unnamed", "source_size", "target")
    place = buckets.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source", "unnamed").orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    place = place.join(targets, ["source", "unnamed"])
    inner = Window.partitionBy("source", "unnamed", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inner)).join(place, ["source", "unnamed", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("before") + F.col("upto") - F.col("size") / F.lit(2.0)
    taken = whole * F.col("size") + F.when(middle < rest, F.col("size")).otherwise(0)
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "row")


ORACLE = r"""
with rows_ as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat('mix-1', ':', coalesce(doc_id::varchar, md5(coalesce(text, ''))))) as draw
  from documents
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number
  from rows_ group by source
), weighed as (
  select *, case number % 3 when 0 then 3 when 1 then 1 else 2 end as weight, source_size * 2.0::double as cap from ranked
), filled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from weighed
  window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), levelled as (
  select *, (select level from filled where level * weight <= cap order by cap / weight, source nulls last limit 1) as final_level from filled
), targets as (
  select source, source_size, case when final_level is null or final_level * weight > cap then cap else final_level * weight end as target from levelled
), placed as (
  select r.doc_id, r.size, t.source_size, t.target,
         sum(r.size) over (partition by r.source order by r.draw, r.doc_id, r.size rows between unbounded preceding and current row) as upto,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole
  from rows_ r join targets t on r.source is not distinct from t.source
)
select doc_id, size, source_size, target::double as target,
       (whole * size + case when upto - size / 2.0::double < target - whole * source_size then size else 0 end)::bigint as taken
from placed
"""
