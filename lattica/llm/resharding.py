"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of given capacity."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Scratch

#: Each old shard is dealt to so many blocks by a hash; the driver sees one row per block at most.
BLOCKS = 1024


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """flow[i][j] from sources to sinks at the least total cost(i, j) * flow, all supply placed.

    Successive shortest paths (label correcting) on the small graph of shards; sum(capacity) must
    reach sum(supply)."""
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a, b, r, c):
        for x, y, z, w in ((a, b, r, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y), room.append(z), price.append(w)

    for i, s in enumerate(supply):
        arc(start, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        arc(n + j, end, c, 0)
    while True:
        far, via, queue = {start: 0}, {}, deque([start])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if room[e] and far[x] + price[e] < far.get(to[e], float("inf")):
                    far[to[e]], via[to[e]] = far[x] + price[e], e
                    queue.append(to[e])
        if end not in far:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in graph[i]:
            if n <= to[e] < n + m and not e & 1:
                flow[i][to[e] - n] = room[e ^ 1]
    return flow


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (a null has none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def reshard(docs: DataFrame, old: Column, old_shards: int, shards: int = 16, capacity: list[int] | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Deals docs(doc_id, text) from old shards to new ones; returns the placed rows and the transfers.

    old: the present shard of a row, 0 to old_shards - 1 (null: 0). capacity: bytes of each new shard;
    by default the total in equal parts. Row sizes are summed over hashed blocks of each old shard; the
    flow over the totals says how many bytes go from shard i to shard j, where staying (i = j) is free.
    Each old shard is then cut, block after block and inside a cut block row after row in hashed order,
    into runs of those lengths; a row goes where its middle lies, so every shard misses its flow by
    less than one row at each cut. Rows: doc_id, size, text_crc32, old_shard, block, shard, slot and row,
    a struct of all columns of docs; slots are gapless from 0 in a shard. Transfers: (old shard, new shard,
    bytes), moves and stays.

    A null text counts as empty; null ids, repeated and equal rows are rows like others; an empty table
    gives an empty result. The law knows no groups: equal texts may go to different shards. A very long text is a row
    like others. Where row is read, texts are shuffled once, by ranges of (old_shard, block)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text_crc32")).withColumn("block", F.pmod("draw", F.lit(BLOCKS)).cast("int"))
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("block_size"))
    supply = [0] * old_shards
    for r in blocks.groupBy("old_shard").agg(F.sum("block_size").alias("bytes")).collect():  # old_shards rows
        supply[r["old_shard"]] = r["bytes"]
    total = sum(supply)
    capacity = capacity or [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    runs = []
    for i, out in enumerate(flow):
        at = 0
        for j in sorted(range(len(out)), key=lambda j: (j != i, j)):
            if out[j]:
                at += out[j]
                runs.append((i, at, j))
    spark = docs.sparkSession
    ends = spark.createDataFrame(runs or [(0, 0, 0)], "old_shard int, run_end long, run_shard int")
    ends = ends.groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("run_end", "run_shard"))).alias("runs"))
    starts = blocks.withColumn("before", F.sum("block_size").over(Window.partitionBy("old_shard").orderBy("block")) - F.col("block_size")).drop("block_size")
    starts = starts.join(ends, "old_shard")
    inner = Window.partitionBy("old_shard", "block").orderBy("draw", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.col("upto") - F.col("size") / F.lit(2.0)

    def dealt(t: DataFrame) -> DataFrame:  # starts has old_shards * BLOCKS rows at most
        t = t.withColumn("upto", F.sum("size").over(inner)).join(F.broadcast(starts), ["old_shard", "block"])
        return t.withColumn("middle", middle).withColumn("shard", F.filter("runs", lambda r: r["run_end"] > F.col("middle"))[0]["run_shard"]).drop("upto", "before", "runs", "middle")

    counts = dealt(rows.drop("row")).groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block")) - F.col("n")).drop("n")
    order = Window.partitionBy("shard", "old_shard", "block").orderBy("draw", "doc_id", "text_crc32", "size")
    rows = dealt(rows.repartitionByRange("old_shard", "block")).withColumn("slot", F.row_number().over(order) - 1)
    rows = rows.join(F.broadcast(offsets), ["shard", "old_shard", "block"]).withColumn("slot", (F.col("slot") + F.col("offset")).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "slot", "row"), [(i, j, b) for i, out in enumerate(flow) for j, b in enumerate(out) if b]


def affected(transfers: list[tuple[int, int, int]]) -> list[int]:
    """The shards that lose or gain rows."""
    return sorted({x for i, j, _ in transfers if i != j for x in (i, j)})


def file_columns(docs: DataFrame) -> list[str]:
    """The columns of docs that files hold beside shard and slot; docs read from such files have old ones of these."""
    return [c for c in docs.columns if c.lower() not in ("shard", "slot")]


def rewrite_affected(docs: DataFrame, placed: DataFrame, transfers: list[tuple[int, int, int]], path: str) -> list[int]:
    """Writes the new files of the affected shards under path/shard=<n>, each placed row once with the columns
    of docs and its slot; the files of a shard hold ascending runs of slots. The folder of an affected shard
    that has no rows any more is deleted. Other shards keep their files. Returns the affected shards."""
    changed, spark = affected(transfers), docs.sparkSession
    if not changed:
        return changed
    moved = placed.where(F.col("shard").isin(changed))
    folders = {s: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}") for s in changed}
    fs = folders[changed[0]].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stale = {s for s in changed if fs.exists(folders[s])}
    if stale:
        stale -= {r["shard"] for r in moved.select("shard").distinct().collect()}  # as many rows as shards
    out = moved.select(*[F.col("row").getField(c).alias(c) for c in file_columns(docs)], "slot", "shard").sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for s in stale:
        fs.delete(folders[s], True)
    return changed


def resharded(docs: DataFrame, old: Column, old_shards: int, shards: int = 16, capacity: list[int] | None = None) -> DataFrame:
    """reshard and rewrite_affected in the shared folder; digest rows read from the files written: doc_id, size,
    text_crc32, law, shard, slot, grown_shard (null), old_shard. Shards that keep exactly their rows have no new
    files, theirs are of the placement. old reads columns of docs but shard and slot."""
    placed, transfers = reshard(docs, old, old_shards, shards, capacity)
    path = f"{Scratch(docs.sparkSession).root}/shards"
    done = rewrite_affected(docs, placed, transfers, path)
    digest = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"]
    rest = placed.where(~F.col("shard").isin(done)).select("doc_id", "size", "text_crc32", *digest)
    if not done:
        return rest
    schema = T.StructType([docs.schema[c] for c in file_columns(docs)] + [T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    files = docs.sparkSession.read.schema(schema).parquet(path).withColumn("old_shard", F.coalesce(old.cast("int"), F.lit(0)))
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *digest)
    alone = any(i == j and i not in done for i, j, _ in transfers)
    return files.unionByName(rest) if alone else files
