"""Exact top-k inner products by buckets of vector length, with coordinate or length pruning in each."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import Scratch

#: Vectors in a bucket differ in length by this factor at most.
RATIO = 0.9
#: Vectors of a part of a bucket, and queries of a block, on average.
PART, BLOCK = 16384, 4096
#: The longest vectors that give the first thresholds, at least; coordinates looked at by coordinate pruning.
SEEDS, FOCUS = 4096, 3
LAST = (1 << 63) - 1
VECTOR = "row long, id long, v array<long>, len double"
OUT = "query long, query_id long, vec_id long, score long"


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(row, id, v, len): floor(scale * x) of the vectors that are not null and have only finite components; row
    names a row, id is vec_id, or the greatest long for null."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    t = table.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), "embedding").where(ok)
    t = t.select(F.monotonically_increasing_id().alias("row"), "id", v.alias("v"))
    return t.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def matrix(column, width: int) -> np.ndarray:
    """The lists of a column as rows, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def products(q, p, most: float):
    """Inner products of rows as int64, exact: lengths bound them, so floats do where their whole numbers reach."""
    for kind, bound in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if most < bound:
            return (q.astype(kind) @ p.astype(kind).T).astype(np.int64)
    return np.clip(q.astype(object) @ p.astype(object).T, -(1 << 63), LAST).astype(np.int64)


def best_of(score, ids, k: int):
    """Positions of the k best, highest score first, then smallest id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], ~score[at]))[:k]]
    return np.lexsort((ids, ~score))[:k]


def probe(q: pa.Table, p: pa.Table, k: int) -> pa.Table:
    """The best k of the bucket part p for each query of the block q, none below the query's threshold.

    The threshold over both lengths is the least cosine that can reach it here. Over 1: no product. Else the
    feasible range of each of the query's FOCUS strongest coordinates follows from it (two vectors whose
    angle is small have similar angles to each axis); where a sorted coordinate leaves less than half of
    what the least length leaves, its range is taken, else all vectors long enough, in one product."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if q.num_rows and p.num_rows:
        width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (q, p))
        long_first = np.lexsort((p["id"].to_numpy(), -p["len"].to_numpy()))
        pv, plen = matrix(p["v"], width)[long_first], p["len"].to_numpy()[long_first]
        pid, prow = p["id"].to_numpy()[long_first], p["row"].to_numpy()[long_first]
        qv, qlen, qid, qrow = matrix(q["v"], width), q["len"].to_numpy(), q["id"].to_numpy(), q["row"].to_numpy()
        floor_ = q["theta"].fill_null(-LAST - 1).to_numpy()
        unit = pv / np.maximum(plen, 1e-300)[:, None]
        sorted_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        reach = np.zeros(len(qv), np.int64)  # how many of the longest can reach the threshold
        short: dict[int, np.ndarray] = {}
        for i in range(len(qv)):
            if floor_[i] <= 0 or not qlen[i]:
                reach[i] = len(pv) if floor_[i] <= 0 else 0
                continue
            need = floor_[i] / qlen[i] * (1 - 1e-9)
            reach[i] = np.searchsorted(-plen, -need, "right")
            cosine = need / plen[0] if plen[0] else 2.0
            if reach[i] == 0 or cosine > 1:
                reach[i] = 0
                continue
            angle, mine = np.arccos(cosine), qv[i] / qlen[i]
            ranges = []
            for f in np.argsort(-np.abs(mine))[:FOCUS].tolist():
                if f not in sorted_:
                    order = np.argsort(unit[:, f])
                    sorted_[f] = order, unit[order, f]
                own = np.arccos(np.clip(mine[f], -1, 1))
                a = np.searchsorted(sorted_[f][1], np.cos(min(np.pi, own + angle)) - 1e-9, "left")
                b = np.searchsorted(sorted_[f][1], np.cos(max(0.0, own - angle)) + 1e-9, "right")
                ranges.append((int(b - a), f, int(a), int(b)))
            if ranges and min(ranges)[0] < reach[i] / 2:
                _, f, a, b = min(ranges)
                at = sorted_[f][0][a:b]
                for n, f2, a2, b2 in ranges:
                    if f2 != f and n < reach[i]:
                        edge = sorted_[f2][1][[a2, b2 - 1]] if n else (1.0, 0.0)
                        at = at[(unit[at, f2] >= edge[0]) & (unit[at, f2] <= edge[1])]
                short[i] = at[at < reach[i]]

        def take(i, at, score):
            ok = (score >= floor_[i]) & (prow[at] != qrow[i])
            at, score = at[ok], score[ok]
            best = best_of(score, pid[at], k)
            for column, values in zip(out, (np.full(len(best), qrow[i]), np.full(len(best), qid[i]), pid[at[best]], score[best])):
                column.append(values)

        most = float(qlen.max() * plen[0]) * (1 + 1e-9)
        for i, at in short.items():
            if len(at):
                take(i, at, products(qv[i : i + 1], pv[at], most)[0])
        rest = np.array([i for i in np.argsort(reach) if reach[i] and i not in short], np.int64)
        for j in range(0, len(rest), 256):
            some = rest[j : j + 256]
            n = int(reach[some].max())
            for i, score in zip(some.tolist(), products(qv[some], pv[:n], most)):
                at = np.flatnonzero(score >= floor_[i])
                take(i, at, score[at])
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table({n: c.astype(np.int64) for n, c in zip(("query", "query_id", "vec_id", "score"), columns)})


def searched(queries: DataFrame, vectors: DataFrame, blocks: int, buckets: list[dict], only: dict[int, int] | None, k: int) -> DataFrame:
    """The best k of each part for each query (row, id, v, len, theta, block): each query goes to the parts of the
    buckets whose longest vector can reach its threshold, each vector to the blocks of queries. `only`: the
    first so many parts of these buckets."""
    listed = [b | {"parts": min(b["parts"], only[b["bucket"]]) if only else b["parts"]} for b in buckets if not only or b["bucket"] in only]
    known = F.from_json(F.lit(json.dumps(listed)), "array<struct<bucket:int,longest:double,parts:int>>")
    able = F.filter(known, lambda b: F.col("theta").isNull() | (F.col("len") * b["longest"] * (1 + 1e-9) >= F.col("theta")))
    q = queries.withColumn("b", F.explode(able)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)))
    q = q.select("row", "id", "v", "len", "theta", "block", "b.bucket", "part").toDF("row", "id", "v", "len", "theta", "block", "bucket", "part")
    v = vectors
    if only:
        v = v.join(F.broadcast(vectors.sparkSession.createDataFrame([(b["bucket"], b["parts"]) for b in listed], "bucket int, upto int")), "bucket").where("part < upto").drop("upto")
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("row", "id", "v", "len", "block", "bucket", "part")
    keys = ["block", "bucket", "part"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(lambda a, b: probe(a, b, k), OUT)


def top_products(table: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of table(vec_id, embedding) whose vec_id is divisible by
    `every`, the k other rows of greatest inner product of floor(scale * x), equal ones by vec_id.

    Vectors are dealt to buckets of similar length, and buckets by a hash to parts of bounded size, so that one
    length or one vector that many rows share makes more parts. The longest few thousand vectors give each
    query a first threshold; then only buckets that can reach it are searched, see probe. Each pair of
    a block of queries and a part is one task's work; results per query are its k best of each part.

    Vectors that are null, or hold null, NaN or infinity, take no part. Shorter vectors are filled up with zeros;
    without components a vector has product 0 with all. Products beyond a long stand at its ends. Rows that
    share an id are rows of their own: each is asked, and a copy is another's result. Null ids come last
    among equals and are not asked. An empty table gives no rows; other columns are ignored."""
    spark = table.sparkSession
    scratch = Scratch(spark)
    bucket = F.when(F.col("len") > 0, -F.floor(F.log("len") / F.lit(-np.log(RATIO)))).otherwise(1 << 20).cast("int")
    vectors = scratch.cut(whole_vectors(table, scale).withColumn("bucket", bucket))
    # One row per bucket: doubles have some 7,000 such lengths, whatever the number of vectors.
    asked = (F.col("id") % every == 0) & (F.col("id") != LAST)
    sizes = vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max("len").alias("longest"), F.count_if(asked).alias("asked")).orderBy("bucket").collect()
    buckets = [{"bucket": r["bucket"], "longest": r["longest"], "parts": -(-r["n"] // PART)} for r in sizes]
    blocks = max(1, -(-sum(r["asked"] for r in sizes) // BLOCK))
    parts = F.broadcast(spark.createDataFrame([(b["bucket"], b["parts"]) for b in buckets], "bucket int, parts int"))
    vectors = vectors.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    queries = vectors.where(asked).select("row", "id", "v", "len", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    seeds, have = {}, 0
    for r, b in zip(sizes, buckets):
        if have < SEEDS:
            seeds[b["bucket"]] = min(b["parts"], -(-(SEEDS - have) * b["parts"] // r["n"]))
            have += r["n"] * seeds[b["bucket"]] // b["parts"]
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = searched(queries.withColumn("theta", F.lit(None).cast("long")), vectors, blocks, buckets, seeds, k)
    first = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("theta"))
    queries = scratch.cut(queries.join(first, "row", "left"))
    found = searched(queries, vectors, blocks, buckets, None, k)
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "score")


ORACLE = """with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score from v q, v c where q.vec_id % 20 = 0 and q.r <> c.r)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 20"""
