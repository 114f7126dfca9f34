"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch
from .texts import LOWER, chunks, distinct, keys, mix, shingle_list, shingle_sets, span_hashes, words

SLOTS = 64
#: Bits of each Bloom filter, and probes; filters have this size whatever the benchmark's.
BLOOM_BITS, PROBES = 1 << 23, 3
U = np.uint64


def slot_keys(minima, slot: int, size: int):
    return mix(minima ^ U((slot << 32) + size)).view(np.int64)


def bits(values):
    """Bit numbers of the probes of int64 keys."""
    x = values.view(U)
    return [(mix(x + U(p * 0x2545F4914F6CDD1D & (2**64 - 1))) & U(BLOOM_BITS - 1)).astype(np.int64) for p in range(PROBES)]


def contains(bloom, values):
    """Which keys a filter may hold."""
    at = np.arange(len(values))
    for p in range(PROBES):
        b = (mix(values[at].view(U) + U(p * 0x2545F4914F6CDD1D & (2**64 - 1))) & U(BLOOM_BITS - 1)).astype(np.int64)
        at = at[(bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0]
    return at


def bloom_filter(column: DataFrame):
    """A Bloom filter of the distinct values of a one-column table, built on the executors."""

    def run(batches):
        bloom = np.zeros(BLOOM_BITS >> 3, np.uint8)
        for batch in batches:
            for b in bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                np.bitwise_or.at(bloom, b >> 3, (1 << (b & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.tobytes()], pa.binary())], names=["bloom"])

    parts = column.distinct().repartition(8).mapInArrow(run, "bloom binary").collect()  # 8 filters of BLOOM_BITS bits
    bloom = np.zeros(BLOOM_BITS >> 3, np.uint8)
    for r in parts:
        bloom |= np.frombuffer(bytes(r["bloom"]), np.uint8)
    return bloom


def item_sets(items: DataFrame, n: int) -> DataFrame:
    """(item_id, shingle) of the distinct shingles of each item."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                values, which = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + which)), pa.array(values.view(np.int64))], names=["item_id", "shingle"])

    return items.mapInArrow(run, "item_id long, shingle long")


def item_signatures(sets: DataFrame) -> DataFrame:
    """(item_id, size class, key) for the MinHash slots of each item. The class of an item is the power
    of two at or above its number of shingles."""
    parts = sets.groupBy("item_id").agg(F.collect_list("shingle").alias("shingles"))

    def run(batches):
        multipliers = keys(SLOTS, 8)
        for batch in batches:
            ids, sizes, out = [], [], []
            for item, got in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = got.values.to_numpy(zero_copy_only=False).view(U)
                size = 1 << int(len(values) - 1).bit_length()
                for s in range(SLOTS):
                    ids.append(item), sizes.append(size), out.append(int(slot_keys((values * multipliers[s]).min(keepdims=True), s, size)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.int64())], names=["item_id", "size_class", "key"])

    return parts.mapInArrow(run, "item_id long, size_class int, key long")


def probes(docs: DataFrame, n: int, classes: list[int], key_bloom, shingle_bloom) -> DataFrame:
    """(doc_id, keys, shingles) of the documents with a window whose MinHash key the filter may hold.

    For each size class w, the windows of a document are its runs of 2 w consecutive shingles from every
    w-th one on; an item of the class that stands in the document as a whole lies inside one of them."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((key_bloom, shingle_bloom))  # two filters of BLOOM_BITS bits

    def run(batches):
        key_bloom, shingle_bloom = shared.value
        multipliers = keys(SLOTS, 8)
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                low = LOWER[data]
                starts, ends, doc = words(low, offsets)
                values, which = shingle_list(span_hashes(low, starts, ends), doc, n)
                if not len(values):
                    continue
                count = np.bincount(which, minlength=len(offsets) - 1)
                first = np.cumsum(count) - count
                found_doc, found_key = [], []
                levels = []
                for w in classes:  # ascending powers of two: blocks of one class are runs of those of the last
                    per = -(-count // w)
                    ids = np.repeat(np.arange(len(count)), per)
                    inner = np.arange(len(ids)) - np.repeat(np.cumsum(per) - per, per)
                    if levels:
                        at = (np.cumsum(levels[-1][3]) - levels[-1][3])[ids] + inner * (w // levels[-1][0])
                    else:
                        at = first[ids] + inner * w
                    joined = np.append(ids[1:] == ids[:-1], False)
                    levels.append((w, at, ids, per, np.flatnonzero(joined)))
                for s in range(SLOTS):
                    low_ = values * multipliers[s]
                    for w, at, ids, _, joined in levels:
                        low_ = np.minimum.reduceat(low_, at)
                        window = low_.copy()
                        window[joined] = np.minimum(low_[joined], low_[joined + 1])
                        key = slot_keys(window, s, w)
                        hit = contains(key_bloom, key)
                        if len(hit):
                            found_doc.append(ids[hit])
                            found_key.append(key[hit])
                if not found_doc:
                    continue
                who, what = np.concatenate(found_doc), np.concatenate(found_key)
                what, who = distinct(what.view(U), who)
                order = np.argsort(who, kind="stable")
                what, who = what[order].view(np.int64), who[order]
                hot = np.zeros(len(count), bool)
                hot[who] = True
                mine = np.flatnonzero(hot[which])
                values, which = distinct(values[mine], which[mine])
                at = contains(shingle_bloom, values.view(np.int64))
                values, which = values[at].view(np.int64), which[at]
                docs_ = np.flatnonzero(hot)
                lists = lambda v, w: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(w, minlength=len(count))[docs_])), pa.int32()), pa.array(v))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + docs_)), lists(what, who), lists(values, which)], names=["doc_id", "keys", "shingles"])

    return docs.mapInArrow(run, "doc_id long, keys array<long>, shingles array<long>")


def rare_meetings(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, item_id) of the documents of found(doc_id, shingles) that hold one of an item's rarest shingles, by
    the number of items that have it. Who holds `percent` of an item's n shingles holds one of any n -
    ceil(percent / 100 * n) + 1 of them; so what many items share is asked for only where they differ in less."""
    common = sets.groupBy("shingle").agg(F.count("*").alias("items"))
    item = Window.partitionBy("item_id")
    t = sets.join(common, "shingle").withColumns({"place": F.row_number().over(item.orderBy("items", "shingle")), "n": F.count("*").over(item)})
    rare = t.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("item_id", "shingle")
    return found.select("doc_id", F.explode("shingles").alias("shingle")).join(rare, "shingle").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the pairs where the document holds at least
    `percent` per cent of the item's distinct `words`-word shingles (lower-cased A-Z).

    Candidates come from MinHash: items are partitioned by size, and each size class is compared with
    windows of whole documents of about twice that size, so that a short item inside a long document
    keeps a Jaccard similarity of 0.19 or more; one equal slot of 64 makes a candidate (a contained
    contiguous item is missed with a probability below 2e-6). Bloom filters of fixed size leave the documents
    with such a slot; these meet items by the items' rarest shingles, so that a phrase that all items begin
    with brings no pairs; pairs with an equal slot are verified on the full sets. A very long document is one
    row of shingles that some item may have.

    An item or document of under `words` words is one shingle; null and blank ones have none and match
    nothing. Null ids are left out. Rows that share an id are one document or item. Other columns are
    ignored. Equal items give a pair each. Empty tables give none."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    sets = scratch.cut(item_sets(items, words).distinct())
    signs = scratch.cut(item_signatures(sets))
    classes = sorted(r["size_class"] for r in signs.select("size_class").distinct().collect())  # powers of two
    found = scratch.cut(probes(docs, words, classes, bloom_filter(signs.select("key")), bloom_filter(sets.select("shingle"))))
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n_item"), F.collect_list("shingle").alias("own")).join(signs.groupBy("item_id").agg(F.collect_list("key").alias("own_keys")), "item_id")
    held = found.groupBy("doc_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("keys", "shingles")])
    out = scratch.cut(rare_meetings(found, sets, percent)).join(sizes, "item_id").join(held, "doc_id").where(F.arrays_overlap("keys", "own_keys"))
    out = out.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared")).where(f"100 * n_shared >= {percent} * n_item")
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


ORACLE = r"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents where doc_id is not null
  union all select 'i', item_id, text from benchmark where item_id is not null
), split_ as (
  select kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from texts
), shingles as (
  select distinct kind, id, array_to_string(w[i:i + 4], ' ') as s
  from (select kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split_ where len(w) > 0)
), sizes as (
  select id as item_id, count(*) as n_item from shingles where kind = 'i' group by id
), shared as (
  select d.id as doc_id, i.id as item_id, count(*) as n_shared
  from shingles d join shingles i on d.s = i.s where d.kind = 'd' and i.kind = 'i' group by d.id, i.id
)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from shared join sizes using (item_id) where 100 * n_shared >= 80 * n_item
"""
