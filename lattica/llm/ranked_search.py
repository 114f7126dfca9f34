"""Ranked lexical search: posting lists blocked by document similarity, with exact summary bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Scratch
from .texts import LOWER, chunks, span_hashes, words

#: Bytes of terms: letters and digits, and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Documents of a shard; documents of a block of a posting list on average; axes of the sketch that blocks go by.
SHARD, BLOCK, AXES = 8192, 32, 32
#: Documents of the heaviest lists that give first scores, times k.
FIRST = 16
#: Items are searched in rounds of about this many terms, as their terms go to every task.
MOST_TERMS = 1 << 19


def terms(data, offsets):
    """64-bit hashes of the terms of each text, and their text numbers; only A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets, TERM)
    return span_hashes(data, starts, ends), doc


def counted(hashes, doc, known, count: int):
    """(text number, position in the sorted `known`, occurrences) of the hashes that are in `known`, by text."""
    if not len(known):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    own = known[at] == hashes
    key, n = np.unique(doc[own] * len(known) + at[own], return_counts=True)
    return key // len(known), key % len(known), n


def lists(values, doc, count: int):
    """Values of ascending text numbers as a list per text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(count + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, hash, times): the terms of each row of items(item_id, text); item names a row."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                hashes, doc = terms(data, offsets)
                known = np.unique(hashes)
                which, at, n = counted(hashes, doc, known, len(offsets) - 1)
                take = pa.array(which + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(known[at].view(np.int64)), pa.array(n)], names=["item", "item_id", "hash", "times"])

    t = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return t.mapInArrow(run, "item long, item_id long, hash long, times long")


def forward(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, n, ids, tfs) of docs(doc_id, text): the number of all terms, and those of `known` with their
    occurrences. Documents without any term are left out."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                hashes, doc = terms(data, offsets)
                count = len(offsets) - 1
                n = np.bincount(doc, minlength=count)
                which, at, tf = counted(hashes, doc, known, count)
                columns = [batch.column(0).slice(row, count), pa.array(n), lists(at, which, count), lists(tf, which, count)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "ids", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def ragged(starts, lens):
    """The numbers of the ranges [start, start + len), one after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)


class Shard:
    """Some documents: their vectors (ids and parts of the score, ascending ids) and posting lists."""

    def __init__(self, doc_ids, n, ids, tfs, ptr, weight, total: int, length: int):
        m = 100 - 75 + (75 * n * total) // length
        self.doc_ids, self.ids, self.ptr, self.weight = doc_ids, ids, ptr, weight
        doc = np.repeat(np.arange(len(n)), np.diff(ptr))
        self.value = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.argsort(ids, kind="stable")
        self.posted, self.list_value = doc[order], self.value[order]
        self.begin = np.searchsorted(ids[order], np.arange(len(weight) + 1))
        self.blocked: dict[int, tuple] = {}
        # A sketch of each vector on fixed random axes: near ones point the same way.
        axis = np.random.default_rng(7).standard_normal((1024, AXES)).astype(np.float32)
        sketch = np.zeros((len(n), AXES), np.float32)
        some = np.flatnonzero(np.diff(ptr))
        if len(some):
            for i in range(AXES):
                sketch[some, i] = np.add.reduceat(self.value * axis[(ids * 40503) % 1024, i], ptr[some])
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)

    def docs_of(self, term: int):
        return self.posted[self.begin[term] : self.begin[term + 1]]

    def top_of(self, term: int) -> int:
        values = self.list_value[self.begin[term] : self.begin[term + 1]]
        return int(values.max()) if len(values) else 0

    def scores(self, docs, asked):
        """Whole scores of documents for the item's times per term."""
        lens = np.diff(self.ptr)[docs]
        at = ragged(self.ptr[docs], lens)
        sums = np.append(0, np.cumsum(self.value[at] * asked[self.ids[at]]))
        ends = np.cumsum(lens)
        return sums[ends] - sums[ends - lens]

    def blocks(self, term: int):
        """A posting list's documents by block, where blocks begin, and each block's summary: the greatest value
        of each coordinate among its documents, as (block, id, value). Documents go to the nearest by
        sketch of some of their own, one for BLOCK of them."""
        if term not in self.blocked:
            docs = self.docs_of(term)
            if len(docs) > BLOCK:
                middle = self.sketch[docs[:: BLOCK]]
                near = np.concatenate([(self.sketch[docs[i : i + 1024]] @ middle.T).argmax(1) for i in range(0, len(docs), 1024)])
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            else:
                first = np.zeros(min(1, len(docs)), np.int64)
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(docs))))
            lens = np.diff(self.ptr)[docs]
            at = ragged(self.ptr[docs], lens)
            key = np.repeat(number, lens) * len(self.weight) + self.ids[at]
            bits = len(key).bit_length()
            key = np.sort((key << bits) + np.arange(len(key)))  # the place rides along: faster than an argsort
            key, order = key >> bits, key & ((1 << bits) - 1)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            most = np.maximum.reduceat(self.value[at[order]], start)
            block, id_ = key[start] // len(self.weight), key[start] % len(self.weight)
            self.blocked[term] = docs, np.append(first, len(docs)), np.searchsorted(block, np.arange(len(first) + 1)), id_, most
        return self.blocked[term]

    def search(self, ids, times, floor_: int, k: int):
        """(documents, scores) of the k best for an item, none below floor_, equal scores by doc_id.

        The item's lists go by their greatest part of a score. What has not been met in the lists before can
        only score by this list and those after it: under the threshold, the rest is left out. In a list,
        blocks whose summary scores less than the threshold are left out, by these same terms."""
        tops = times * np.array([self.top_of(t) for t in ids.tolist()], np.int64)
        order = np.argsort(-tops, kind="stable")
        rest = np.cumsum(tops[order][::-1])[::-1]
        asked, whole = np.zeros(len(self.weight), np.int64), np.zeros(len(self.weight), np.int64)
        asked[ids] = whole[ids] = times
        seen = np.zeros(len(self.doc_ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, term in enumerate(ids[order].tolist()):
            if rest[i] < max(floor_, 1):
                break
            members, first, begin, id_, most = self.blocks(term)
            sums = np.append(0, np.cumsum(most * asked[id_]))
            able = sums[begin[1:]] - sums[begin[:-1]] >= floor_
            new = members[ragged(first[:-1][able], np.diff(first)[able])]
            new = new[~seen[new]]
            seen[new] = True
            asked[term] = 0
            if len(new):
                got = self.scores(new, whole)
                docs, scores = np.append(docs, new[got >= floor_]), np.append(scores, got[got >= floor_])
                if len(docs) > k:
                    best = np.lexsort((self.doc_ids[docs], -scores))[:k]
                    docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    floor_ = max(floor_, int(scores.min()))
        return docs, scores

    def first_scores(self, ids, times, k: int):
        """The k best scores among the documents of the item's heaviest lists here, for a first threshold."""
        heavy = ids[np.argsort(-times * self.weight[ids], kind="stable")]
        enough = int(np.searchsorted(np.cumsum(self.begin[heavy + 1] - self.begin[heavy]), FIRST * k)) + 1
        docs = np.unique(np.concatenate([self.docs_of(t) for t in heavy[:enough].tolist()])) if len(heavy) else np.zeros(0, np.int64)
        asked = np.zeros(len(self.weight), np.int64)
        asked[ids] = times
        scores = self.scores(docs, asked)
        best = np.argsort(-scores, kind="stable")[:k]
        return docs[best], scores[best]


def over_shards(vectors: DataFrame, items: list[tuple], weight, total: int, length: int, k: int, floors: dict[int, int] | None) -> DataFrame:
    """(item, doc_id, score) of each shard's search for each item (number, ids, times). A shard is the next SHARD
    rows of a partition: with floors the whole search, else first scores."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SHARD):
                yield batch.slice(i, SHARD)

    def found(part: pa.Table):
        n = part["n"].to_numpy()
        ids, tfs = part["ids"].combine_chunks(), part["tfs"].combine_chunks()
        ptr = ids.offsets.to_numpy().astype(np.int64)
        last = (1 << 63) - 1
        shard = Shard(part["doc_id"].fill_null(last).to_numpy(), n, ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), ptr - ptr[0], weight, total, length)
        null = part["doc_id"].is_null().to_numpy()
        out = [], [], []
        for number, own, times in items:
            docs, scores = shard.search(own, times, floors.get(number, 1), k) if floors is not None else shard.first_scores(own, times, k)
            good = scores > 0
            for column, values in zip(out, (np.full(int(good.sum()), number), docs[good], scores[good])):
                column.append(values)
        item, docs, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(shard.doc_ids[docs], mask=null[docs]), pa.array(scores)], names=["item", "doc_id", "score"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in rows(batches):
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= SHARD:
                yield found(pa.Table.from_batches(waiting).combine_chunks())
                waiting = []
        if waiting:
            yield found(pa.Table.from_batches(waiting).combine_chunks())

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs(doc_id, text) of highest score for each row of
    items(item_id, text), scores above 0 only, equal ones by doc_id.

    Terms are runs of ASCII letters and digits and all other characters beyond ASCII. A document becomes a
    vector over the items' terms in its partition; counts for lengths and weights cover all documents. Shards
    of documents are searched by posting lists whose blocks hold similar documents, see Shard, above a
    threshold that each item's first scores in all shards give. Only the best k per item and shard are sorted.

    Items go in rounds of MOST_TERMS terms, each over all documents, so what goes to a task is bounded. Null and
    empty texts have no terms: such items have no rows, such documents count nowhere. Each row is an item or a
    document of its own, also where rows repeat; null doc_ids come last among equals. Empty tables give no
    rows; other columns are ignored. Terms are compared by 64-bit hashes."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = scratch.cut(item_terms(items))
    rounds = max(1, -(-asked.count() // MOST_TERMS))
    asked = asked.withColumn("round", F.pmod(F.xxhash64("item"), F.lit(rounds)))
    out = None
    for r in range(rounds):
        own = asked.where(F.col("round") == r).orderBy("item", "hash").toPandas()
        known = np.unique(own["hash"].to_numpy().astype(np.int64).view(np.uint64))
        at = np.searchsorted(known, own["hash"].to_numpy().astype(np.int64).view(np.uint64))
        numbers, first = np.unique(own["item"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(own))
        batch = [(int(n), at[i:j], own["times"].to_numpy()[i:j]) for n, i, j in zip(numbers, first, ends)]
        vectors = scratch.cut(forward(docs, known))
        size = vectors.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        held = vectors.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
        weights = held.select("id", F.floor(1000 * F.log((2.0 * size["N"] + 2) / (2 * F.col("df") + 1))).alias("w")).toPandas()
        weight = np.zeros(len(known), np.int64)
        weight[weights["id"].to_numpy().astype(np.int64)] = weights["w"].to_numpy()
        total, length = int(size["N"]), max(1, int(size["L"]))
        if size["N"]:
            firsts = ranked(over_shards(vectors, batch, weight, total, length, k, None), k).where(F.col("rank") == k)
            floors = {x["item"]: x["score"] for x in firsts.select("item", "score").collect()}  # a number an item of the round
            best = scratch.cut(ranked(over_shards(vectors, batch, weight, total, length, k, floors), k))
            out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""with toks as (select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as t from (select row_number() over () as r, doc_id, text from documents)),
itoks as (select i, item_id, t, count(*) as times from (select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as t from (select row_number() over () as i, item_id, text from benchmark)) group by all),
lens as (select r, any_value(doc_id) as doc_id, count(*) as n from toks group by r),
size as (select count(*) as n_docs, sum(n)::bigint as l from lens),
m as (select r, doc_id, 100 - 75 + ((75 * n * n_docs) // l) as m from lens, size),
tf as (select r, t, count(*) as tf from toks where t in (select t from itoks) group by all),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, size group by t, n_docs),
s as (select i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from itoks join tf using (t) join w using (t) join m using (r) group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0) where rank <= 10"""
