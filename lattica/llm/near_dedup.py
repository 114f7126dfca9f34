"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import Scratch
from .texts import chunks, keys, mix, repeated, shingle_sets

SLOTS, BANDS = 128, 32
#: A pair at the least similarity has fewer equal slots than asked for with this probability at most.
MISS = 1e-10
#: Words of 64 bits in the maps of a member's differences from its pivot; a power of two.
MAP_WORDS = 4


def superminhash(values, which, count: int, slots: int = SLOTS):
    """Signatures (count x slots, uint64) of the sets given by distinct values with set numbers.

    Step j deals each element the j-th entry of its own random permutation of the slots and the value
    j + r, 0 <= r < 1, kept as j << 56 | r; a slot keeps its smallest value. A set stops as soon as all
    of its slots hold values below j, which no later step can lower. An empty set keeps the maximum."""
    sig = np.full((count, slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = sig.reshape(-1)
    perm = None
    open_ = np.zeros(count, bool)
    for j in range(slots):
        x = mix(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = np.int64(j) + (((x >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(56)) | (mix(x ^ np.uint64(0x632BE59BD9B4E019)) >> np.uint64(8))
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(values))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, which * slots + slot, value)
        open_[:] = False
        live = np.unique(which)
        open_[live] = sig[live].max(1) >= (np.uint64(j + 1) << np.uint64(56))
        stay = open_[which]
        if not stay.any():
            break
        values, which = values[stay], which[stay]
        if j == 0:
            k = k[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(values), 1))
            perm[np.arange(len(values)), k] = 0
        else:
            perm = perm[stay]
    return sig


def signatures(docs: DataFrame, words: int, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n, f1, f2, bands, sketch): size and 128-bit fingerprint of the shingle set, its band keys, and
    four bits of each slot, sixteen to a word. Sets of under 4 shingles get neither of these: at 0.8 they are
    linked with equal sets only."""
    schema = "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>"
    width = slots // bands

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                count = len(offsets) - 1
                values, which = shingle_sets(data, offsets, words)
                n = np.bincount(which, minlength=count)
                f = np.zeros((2, count), np.uint64)
                has = np.flatnonzero(n)
                if len(has):
                    at = (np.cumsum(n) - n)[has]
                    for i in (0, 1):
                        f[i, has] = np.add.reduceat(mix(values ^ np.uint64(0x8CB92BA72F3D8DD7 * (i + 1) & (2**64 - 1))), at)
                wide = n >= 4
                stay = wide[which]
                number = np.cumsum(wide) - 1
                sig = superminhash(values[stay], number[which[stay]], int(wide.sum()), slots)
                q = keys(slots, 4).reshape(bands, width)
                band = mix((sig.reshape(-1, bands, width) * q).sum(2, dtype=np.uint64) + keys(bands, 5)).view(np.int64)
                nibble = (mix(sig) & np.uint64(15)).reshape(-1, slots // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                sketch = np.bitwise_or.reduce(nibble, 2).view(np.int64)
                lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wide * width)), pa.int32()), pa.array(x.reshape(-1)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, count), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists(band, bands), lists(sketch, slots // 16)], names=["doc_id", "n", "f1", "f2", "bands", "sketch"])

    return docs.mapInArrow(run, schema)


def least_equal(percent: int, slots: int = SLOTS) -> int:
    """How many slots of two signatures must be equal, so that a pair of the similarity fails with MISS at most."""
    p, below = percent / 100, 0.0
    for k in range(slots + 1):
        below += comb(slots, k) * p**k * (1 - p) ** (slots - k)
        if below > MISS:
            return k
    return slots


def equal_slots(x, y):
    """How many of the sixteen slots of two words of a sketch are equal."""
    t = x.bitwiseXOR(y)
    for shift in (2, 1):
        t = t.bitwiseOR(F.shiftrightunsigned(t, shift))
    return F.lit(16) - F.bit_count(t.bitwiseAND(F.lit(0x1111111111111111)))


def verified(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """pairs(a, b) with the exact sizes of the intersection and union of their shingle sets, and MAP_WORDS
    * 64 bits each for the shingles that b lacks (lost) and those that a lacks (won)."""
    maps = [f"{kind}{i}" for kind in ("lost", "won") for i in range(MAP_WORDS)]
    schema = "a long, b long, both long, any long, " + ", ".join(f"{m} long" for m in maps)

    def bitmaps(values, which, count):
        out = np.zeros((count, MAP_WORDS), np.uint64)
        bit = mix(values ^ np.uint64(0x3C79AC492BA7B653))
        np.bitwise_or.at(out, (which, (bit & np.uint64(MAP_WORDS - 1)).astype(np.int64)), np.uint64(1) << ((bit >> np.uint64(8)) & np.uint64(63)))
        return list(out.view(np.int64).T)

    def run(batches):
        for batch in batches:
            whole = pa.chunked_array([batch.column(2), batch.column(3)]).combine_chunks()
            rows = len(batch)
            at = 0
            while at < rows:  # rows of some MB at a time
                size, end = 0, at
                while end < rows and (end == at or size < 1 << 20):
                    size += len(batch.column(2)[end].as_buffer() or b"") + len(batch.column(3)[end].as_buffer() or b"")
                    end += 1
                found = []
                for base in (at, rows + at):
                    parts = [shingle_sets(d, o, words) + (r,) for r, d, o in chunks(whole.slice(base, end - at), 1 << 40)]
                    found.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + p[2] for p in parts])))
                n = sum(np.bincount(w, minlength=end - at) for _, w in found)
                value, which = np.concatenate([v for v, _ in found]), np.concatenate([w for _, w in found])
                twice = repeated(value, which)
                both = np.bincount(which[twice], minlength=end - at) // 2
                lost, won = (np.flatnonzero(~twice & side) for side in (np.arange(len(value)) < len(found[0][0]), np.arange(len(value)) >= len(found[0][0])))
                columns = [both, n - both, *bitmaps(value[lost], which[lost], end - at), *bitmaps(value[won], which[won], end - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["a", "b", "both", "any", *maps])
                at = end

    text = docs.where("doc_id is not null").select("doc_id", F.col("text"))
    left = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A n B| >= percent * |A u B| for their sets of distinct `words`-word
    shingles of the lower-cased text. Equal sets become one class first. Bands of the signatures give
    candidates among classes: each member of a bucket is verified against the bucket's most central one;
    then pairs of a bucket that still lie in different components are verified, unless they are ruled out:
    by bitmaps of what each member lacks of the pivot and adds to it, which limit what two members share,
    or by signatures with fewer equal slots than a similar pair has (but for a probability of MISS). So
    the copies of a large group cost about one test each. Texts are joined to pairs by id; the partition of
    a pivot with very many members is one that Spark splits, since a plain join of texts follows.

    Null or blank texts have an empty set and are linked with nothing. A null doc_id takes part in no
    link of its own: its component_id is that of its equals, or null, and kept is false. Rows that share
    a doc_id are one document. A very long text is read whole, in one task each time. Columns besides doc_id and
    text are ignored. An empty table gives none. percent is 80 to 100."""
    if not 80 <= percent <= 100:  # bands and the sets of under 4 shingles are right from 80 on
        raise ValueError("percent must be 80 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.cut(signatures(docs, words))
    share = percent / 100
    classes = sig.where("doc_id is not null and n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class"))
    classes = scratch.cut(classes)
    member = sig.where("doc_id is not null and n >= 4").join(classes.select(F.col("class").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi")
    banded = member.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    sized = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.cut(banded.join(sized, "key"))
    # A bucket's pivot is its most central member: the one that meets most others over all its buckets.
    central = met.groupBy("id").agg(F.sum("size").alias("met")).select("id", (F.col("met") * 1048576 + F.pmod(F.xxhash64("id"), F.lit(1048576))).alias("central"))
    central = scratch.cut(central)
    pivots = met.select("key", "id").join(central, "id").groupBy("key").agg(F.max_by("id", "central").alias("pivot"))
    inside = scratch.cut(met.select("key", "id", "n").join(pivots, "key"))
    scratch.drop(met)
    sizes = classes.select(F.col("class").alias("pivot"), "n").groupBy("pivot").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first = inside.where("id <> pivot").select("pivot", "id", "n").distinct().join(sizes, "pivot")
    first = first.where(f"most >= {share} * n - 1e-9 and n >= {share} * least - 1e-9").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    tested = scratch.cut(verified(first, docs, words))
    linked = lambda t: t.where(f"100 * both >= {percent} * any").select("a", "b")
    links = linked(tested)
    # Rows that share a doc_id join the classes of their different texts.
    several = sig.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"), F.min("f2").alias("lo2"), F.max("f2").alias("hi2")).where("lo <> hi or lo2 <> hi2").select("doc_id")
    if not several.isEmpty():
        same = scratch.cut(sig.where("n > 0").join(several, "doc_id", "left_semi").join(classes, ["f1", "f2", "n"]).select("doc_id", "class").distinct())
        same = same.join(same.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("class <> a")
        links = links.unionByName(same.select("a", F.col("class").alias("b")))
    known = components(links, scratch)
    if not inside.isEmpty():
        placed = inside.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        loose = placed.join(mixed, "key").withColumnRenamed("component", "part")
        maps = [f"{kind}{i}" for kind in ("lost", "won") for i in range(MAP_WORDS)]
        like = tested.withColumnsRenamed({"a": "pivot", "b": "id"}).groupBy("pivot", "id").agg(F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("both", "any", *maps)]).where("times = 1")
        loose = loose.join(like, ["pivot", "id"], "left")
        itself = F.col("id") == F.col("pivot")
        loose = loose.join(member.select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"]), "id")
        words_ = SLOTS // 16
        loose = scratch.cut(loose.select("key", "id", "n", "part", *[F.col("sketch")[i].alias(f"s{i}") for i in range(words_)], F.when(itself, F.col("n")).otherwise(F.col("both")).alias("core"), F.when(itself, 0).otherwise(F.col("any") - F.col("n")).alias("lost"), *[F.when(itself, 0).otherwise(F.col(m)).alias(m) for m in maps]))
        a, b = (loose.select("key", *[F.col(c).alias(f"{c}_{s}") for c in loose.columns if c != "key"]) for s in "ab")
        # Bits that only one of two maps has stand for as many shingles that the other set lacks.
        alone = lambda kind, x, y: sum(F.bit_count(F.col(f"{kind}{i}_{x}").bitwiseAND(F.bitwise_not(f"{kind}{i}_{y}"))) for i in range(MAP_WORDS))
        inside_pivot = F.col("core_a") + F.col("lost_a") - F.greatest(F.col("lost_a") + alone("lost", "b", "a"), F.col("lost_b") + alone("lost", "a", "b"))
        outside = F.least(*[F.col(f"n_{x}") - F.col(f"core_{x}") - alone("won", x, y) for x, y in ("ab", "ba")])
        may = F.coalesce((100 + percent) * (inside_pivot + outside) >= percent * (F.col("n_a") + F.col("n_b")), F.lit(True))
        alike = sum(equal_slots(F.col(f"s{i}_a"), F.col(f"s{i}_b")) for i in range(words_)) >= least_equal(percent)
        rest = a.join(b, "key").where((F.col("part_a") < F.col("part_b")) & (F.col("n_a") >= share * F.col("n_b") - 1e-9) & (F.col("n_b") >= share * F.col("n_a") - 1e-9) & may & alike)
        rest = rest.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
        for x, y in (("a", "b"), ("b", "a")):
            rest = rest.join(tested.select(F.col("a").alias(x), F.col("b").alias(y)), ["a", "b"], "left_anti")
        more = scratch.cut(verified(rest, docs, words).select("a", "b", "both", "any"))
        # Links between components join these, as a graph of components.
        between = linked(more)
        for x in "ab":
            between = between.join(known.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")), x, "left").withColumn(x, F.coalesce(f"part_{x}", x)).drop(f"part_{x}")
        if not between.isEmpty():
            whole = components(between, scratch)
            known = known.unionByName(whole.join(known, "node", "left_anti")).join(whole.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
            known = scratch.cut(known.select("node", F.coalesce("top", "component").alias("component")))
    scratch.keep(sig, classes, known)
    final = classes.join(known.withColumnRenamed("node", "class"), "class", "left").select("f1", "f2", "n", F.coalesce("component", "class").alias("component_id"))
    out = sig.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
