"""Removal of repeated byte strings by a column-wise collection Burrows-Wheeler transform.

A corpus has too many suffixes to hold their order in tables of a few times its size, and a column-wise
construction takes as many rounds as its longest member has symbols. So the strings of `length` bytes
are first dealt to anchors: the anchor of a string is its smallest K-gram by a hash, the first of equals,
so equal strings have equal anchors at equal places. The strings of a text that share one anchor
occurrence overlap in one run, whose bytes are at most 2 * length - K. Runs that stand alone need no
look; equal runs are repeats as a whole; the distinct runs of an anchor are the collection whose
transform and common prefixes are built, one symbol per run and round, in at most that many rounds."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .texts import chunks, keys, mix

LENGTH, K = 100, 32
PIECE = 1 << 20
#: Runs whose transform is built together, about: the anchors of a block are whole. The runs of anchors of more
#: distinct ones than CROWD are cut around longer anchors until none has more.
BLOCK, CROWD = 390, 3000
U = np.uint64
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def powers(base: int, n: int):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, U)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U(pow(base, have, 1 << 64))
        have += step
    return out


def runs(data, offsets, length: int = LENGTH, k: int = K):
    """The anchored runs of the texts: (anchor hash, run hash, text number, first start, number of starts).

    Pieces of a long text overlap by length - 1 bytes, so that each string is in one piece."""
    symbol = keys(256, 11)
    bounds = []
    for d in range(len(offsets) - 1):
        for at in range(int(offsets[d]), int(offsets[d + 1]) - length + 1, PIECE):
            bounds.append((d, at, min(at + PIECE + length - 1, int(offsets[d + 1]))))
    out = []
    b = 0
    while b < len(bounds):
        e, size = b, 0
        while e < len(bounds) and (e == b or size + bounds[e][2] - bounds[e][1] <= PIECE):
            size += bounds[e][2] - bounds[e][1]
            e += 1
        part = bounds[b:e]
        b = e
        x = np.concatenate([data[s:t] for _, s, t in part])
        n = len(x)
        up, down = powers(ODD, n), powers(INVERSE, n + 1)
        sums = np.append(U(0), np.cumsum(symbol[x] * up))
        grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        ranked = (grams & U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U)
        width, span = length - k + 1, 1
        low = ranked
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])  # of each start of `width` grams
        anchor = (low & U(0xFFFFFF)).astype(np.int64)
        lens = np.array([t - s for _, s, t in part])
        begin = np.cumsum(lens) - lens
        good = np.zeros(n + 1, np.int8)
        good[begin] += 1
        good[begin + lens - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(good[:-1]) > 0)
        of = np.searchsorted(begin, starts, "right") - 1
        a = anchor[starts]
        new = np.append(True, (a[1:] != a[:-1]) | (of[1:] != of[:-1]))
        first = np.flatnonzero(new)
        lo = starts[first]
        many = np.diff(np.append(first, len(starts)))
        a, of = a[first], of[first]
        end = lo + many - 1 + length
        content = mix((sums[end] - sums[lo]) * down[lo] ^ mix(((a - lo) * 65536 + many).astype(U)))
        doc = np.array([p[0] for p in part])[of]
        out.append((grams[a], content, doc, lo - begin[of] + np.array([p[1] for p in part])[of] - offsets[doc], many))
    if not out:
        return np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


OCCURRENCES = "anchor long, run long, doc_id long, text_hash long, start long, many long"


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """The runs of docs(doc_id, text_hash, text). Of equal runs in one batch only the first goes on to
    the shuffle; the others are repeats whatever else there is, and get a key of their own, many < 0."""

    def run(batches):
        for batch in batches:
            parts = []
            for row, data, offsets in chunks(batch.column(2), 4 << 20):
                a, r, d, s, m = runs(data, offsets, length, k)
                parts.append((a, r, d + row, s, m))
            if not parts:
                continue
            a, r, d, s, m = (np.concatenate(c) for c in zip(*parts))
            key = a ^ mix(r)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order] = np.append(False, same) | np.append(same, False)
            at = np.flatnonzero(twice)
            if len(at):
                ids = np.asarray(batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False))[d[at]]
                group = np.lexsort((s[at], ids, key[at]))
                first = at[group]
                # Equal places (repeated rows) are no repeats of each other: each is as early as the other.
                lead = np.append(True, key[first][1:] != key[first][:-1])
                lead_at = first[np.maximum.accumulate(np.where(lead, np.arange(len(first)), 0))]
                equal = (ids[group] == np.asarray(batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False))[d[lead_at]]) & (s[first] == s[lead_at])
                later = first[~lead & ~equal]
                a = a.copy()
                m = m.copy()
                m[later] = -m[later]
                a[later] = mix(key[later] + np.arange(len(later), dtype=U))
            pick = pa.array(d)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(s), pa.array(m)], names=["anchor", "run", "doc_id", "text_hash", "start", "many"])

    return docs.mapInArrow(run, OCCURRENCES)


def judged(found: DataFrame, length: int) -> DataFrame:
    """Spans that are repeats as a whole (kind 0: start, end in bytes), and the first of each of the distinct
    runs of an anchor that has several (kind 1: start, many), from occurrences sorted within anchors. A run at
    the place of the first one in another text of its doc_id counts as distinct too.

    Of earlier batches only the first row of the last run is remembered, and the last anchor's first run
    until a second one turns up: an anchor of any number of occurrences takes no more memory than a batch."""
    schema = "kind int, anchor long, run long, doc_id long, text_hash long, start long, many long"

    def told(batch, kind, at):
        pick = pa.array(at)
        many = np.abs(batch.column("many").to_numpy()[at])
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(batch.column(c).take(pick) for c in ("anchor", "run", "doc_id", "text_hash", "start")), pa.array(many)], names=[f.split()[0] for f in schema.split(", ")])

    def run(batches):
        last = held = None  # last: anchor, run, and doc_id, start and text of the run's first row
        for batch in batches:
            if not len(batch):
                continue
            a, r, d, s, m, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "run", "doc_id", "start", "many", "text_hash"))
            new_a = np.append(last is None or a[0] != last[0], a[1:] != a[:-1])
            new_r = new_a | np.append(last is None or r[0] != last[1], r[1:] != r[:-1])
            lead = np.maximum.accumulate(np.where(new_r, np.arange(len(a)), -1))
            before = (0, 0, 0) if last is None else last[2:]
            lead_d, lead_s, lead_h = (np.where(lead < 0, b, c[lead]) for b, c in zip(before, (d, s, h)))
            equal = (d == lead_d) & (s == lead_s)
            later = ~new_r & ~equal | (m < 0)
            distinct = np.flatnonzero(new_r)
            several = np.zeros(len(a), bool)
            if len(distinct):
                opens = new_a[distinct]
                several[distinct] = ~opens | np.append(~opens[1:], False)
                if held is not None and not opens[0]:
                    yield held
                held = told(batch, np.ones(1), distinct[-1:]) if opens[-1] and not later[distinct[-1]] else None
            keep = np.flatnonzero(later | several | equal & (h != lead_h))
            yield told(batch, np.where(later[keep], 0, 1), keep)
            last = a[-1], r[-1], lead_d[-1], lead_s[-1], lead_h[-1]

    return found.mapInArrow(run, schema)


def placed(strings: DataFrame, k: int) -> DataFrame:
    """strings(anchor, ..., bytes) with the place of the anchor in each run (`at`) and its bytes (`core`)."""
    symbol = keys(256, 11)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw = batch.column("bytes").to_pylist()
            x = np.frombuffer(b"".join(raw), np.uint8)
            lens = np.array([len(r) for r in raw])
            sums = np.append(U(0), np.cumsum(symbol[x] * powers(ODD, len(x))))
            grams = mix((sums[k:] - sums[:-k]) * powers(INVERSE, len(x) - k + 1))
            owner = np.repeat(np.arange(len(raw)), lens)[: len(grams)]
            hit = np.flatnonzero(grams == batch.column("anchor").to_numpy().view(U)[owner])
            # A run's anchor is the first of its equals; those over the edge of two runs come after it.
            at = hit[np.unique(owner[hit], return_index=True)[1]] - (np.cumsum(lens) - lens)
            yield batch.append_column("at", pa.array(at.astype(np.int32))).append_column("core", pa.array(np.full(len(at), k, np.int32)))

    return strings.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strings.schema) + ", at int, core int")


def recut(strings: DataFrame, length: int) -> DataFrame:
    """Each run cut in two at most, around longer anchors. A string of `length` bytes with its anchor's `core`
    in it has half of its other bytes or more to the left of that, or to the right: the strings of the first
    kind take that half before the core into their anchor, those of the other kind the half behind. Equal
    strings hold the core at equal places, so they get equal anchors again, and after seven cuts of a core of
    32 in 100 bytes an anchor is a whole string."""
    half = F.expr(f"int(({length} - core + 1) div 2)")
    other = F.lit(length) - F.col("core") - half + 1
    skip = F.greatest(F.lit(0), F.col("at") - half + 1)
    kept = F.least(F.col("many"), F.col("at") - half + 1)

    def part(side, core, start, many, raw, at, longer):
        return F.struct(F.xxhash64("anchor", F.lit(side), core).alias("anchor"), start.cast("long").alias("start"), many.cast("long").alias("many"), raw.alias("bytes"), at.cast("int").alias("at"), (F.col("core") + longer).cast("int").alias("core"))

    raw, at = F.col("bytes"), F.col("at")
    left = part(0, F.substring(raw, at - half + 1, half), F.col("start"), kept, F.substring(raw, F.lit(1), (kept - 1 + length).cast("int")), at - half, half)
    right = part(1, F.substring(raw, at + F.col("core") + 1, other), F.col("start") + skip, F.col("many") - skip, F.substring(raw, skip + 1, F.lit(2 * length)), at - skip, other)
    cut = strings.select("doc_id", "text_hash", F.explode(F.filter(F.array(left, right), lambda p: p["many"] > 0)).alias("p"))
    return cut.select("p.anchor", "doc_id", "text_hash", "p.start", "p.many", "p.bytes", "p.at", "p.core")


def uncrowded(strings: DataFrame, scratch: Scratch, length: int, k: int, block: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The distinct runs of crowded anchors cut until none has more than `block`: (spans that are repeats as a
    whole, runs to be compared). Equal runs meet by their bytes, pre-aggregated before the shuffle, so a hot
    anchor or run fills no task."""
    spans, few = [], []
    columns_ = ["anchor", "doc_id", "text_hash", "start", "many", "bytes"]
    hot = placed(strings, k)
    while not hot.isEmpty():
        hot = scratch.cut(recut(hot, length))
        first = scratch.cut(hot.groupBy("anchor", "bytes").agg(F.min(F.struct("doc_id", "start")).alias("first")))
        runs_of = scratch.cut(first.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1"))
        met = hot.join(first, ["anchor", "bytes"]).withColumn("later", F.struct("doc_id", "start") != F.col("first"))
        spans.append(met.where("later").select("doc_id", "text_hash", "start", (F.col("start") + F.col("many") - 1 + length).alias("end")))
        met = met.where("not later").join(runs_of, "anchor")
        few.append(met.where(F.col("runs") <= block).select(*columns_))
        hot = met.where(F.col("runs") > block).select(*columns_, "at", "core")
    return spans, few


def transform(strings: list, cap: int):
    """Sorted suffixes of a collection of symbol arrays (uint16), with the common prefix of each and the one
    before, up to cap symbols.

    Column-wise construction: round j inserts, for each string, the suffix of its last j symbols, found
    from the round before by sorting on the symbol in front (the transform); the common prefix of two
    neighbours with the same symbol is one more than the least between their tails. Each round reads the
    arrays of the last one in order and writes new ones. Returns (position in the joined text, prefix)
    without the empty suffixes."""
    return columns(np.concatenate(strings), np.array([len(s) for s in strings]), cap)


def columns(text, lens, cap: int):
    """`transform` of the strings of the given lengths that stand one after the other in text."""
    end = np.cumsum(lens)
    is_start = np.zeros(len(text) + 1, bool)
    is_start[end - lens] = True
    n = len(lens)
    at, prefix = end.astype(np.int64), np.zeros(n, np.uint16)  # the empty suffixes, at their strings' ends
    whole = lens == 0  # suffixes that are a whole string have no symbol in front
    for _ in range(int(lens.max())):
        open_ = np.flatnonzero(~whole)
        symbol = text[at[open_] - 1]
        by = np.argsort(symbol, kind="stable")
        order, symbol = open_[by], symbol[by]
        value = np.zeros(len(order), np.uint16)
        ask = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(ask):  # least prefix between consecutive places of one symbol, over ranges of doubled length
            lo = order[ask - 1] + 1
            width = order[ask] - lo + 1
            level = np.frexp(width.astype(float))[1] - 1
            table, span, top = prefix, 1, int(level.max())
            got = np.zeros(len(ask), np.uint16)
            for depth in range(top + 1):
                here = np.flatnonzero(level == depth)
                if len(here):
                    got[here] = np.minimum(table[lo[here]], table[lo[here] + width[here] - span])
                if depth < top:
                    table = np.minimum(table[:-span], table[span:])
                    span *= 2
            value[ask] = np.minimum(got.astype(np.int64) + 1, cap)
        inserted = at[order] - 1
        at = np.concatenate([end, inserted])
        prefix = np.concatenate([np.zeros(n, np.uint16), value])
        whole = np.concatenate([lens == 0, is_start[inserted]])
    return at[n:], prefix[n:]


def windows(x, size: int):
    """Numbers of the strings of `size` bytes at each place of x, equal and in order as these are."""
    if size > 8:  # by two overlapping or touching shorter ones
        half = (size + 1) // 2
        low = windows(x, half).astype(np.uint64)
        code = low[: len(x) - size + 1] << U(32) | low[size - half :]
    else:
        code = np.zeros(len(x) - size + 1, U)
        for i in range(size):
            code = code << U(8) | x[i : len(x) - size + 1 + i]
    return np.unique(code, return_inverse=True)[1]


def symbols(x, lens, length: int):
    """The strings of the given lengths in x, in symbols of `size` bytes, for a size that divides the length:
    each string in `size` copies, cut at its end by 0, 1, ... bytes and at its front to whole symbols, so
    that each place starts a suffix of one of them. A size is taken whose symbols have 16-bit numbers.
    Returns (symbols, symbols in each copy, size, string number and cut of each copy)."""
    begin = np.cumsum(lens) - lens
    for size in (w for w in (10, 5, 4, 2, 1) if length % w == 0):
        owner, cut = np.repeat(np.arange(len(lens)), size), np.tile(np.arange(size), len(lens))
        many = (lens[owner] - cut) // size
        first = (begin + lens)[owner] - cut - many * size
        places = np.repeat(first - size * (np.cumsum(many) - many), many) + size * np.arange(int(many.sum()))
        number = windows(x, size)[places]
        if number.max() >= 65536:
            names, number = np.unique(number, return_inverse=True)
            if len(names) > 65536:
                continue
        return number.astype(np.uint16), many, size, owner, cut


def repeats(rows, length: int = LENGTH):
    """Runs (list of (doc key, start, many, bytes)) of whole anchors: which starts are repeats of an earlier
    string, as (run number, offset). Places order by doc key, then start."""
    size_of = np.array([len(r[3]) for r in rows])
    text, lens, size, source, cut = symbols(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), size_of, length)
    at, prefix = columns(text, lens, length // size)
    begin = np.cumsum(lens) - lens
    part = np.searchsorted(begin + lens, at, "right")  # a suffix of one symbol or more lies inside its string
    owner = source[part]
    offset = size_of[owner] - cut[part] - (begin[part] + lens[part] - at) * size
    group = np.cumsum(prefix < length // size)
    many = np.array([r[2] for r in rows])
    use = np.flatnonzero(offset < many[owner])
    owner, offset, group = owner[use], offset[use], group[use]
    if not len(owner):
        return owner, offset
    doc = np.array([r[0] for r in rows])[owner]
    place = np.array([r[1] for r in rows])[owner] + offset
    order = np.lexsort((place, doc, group))
    new = np.append(True, group[order][1:] != group[order][:-1])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = order[~((doc[order] == doc[lead]) & (place[order] == place[lead]))]
    return owner[later], offset[later]


def compared(strings: DataFrame, length: int) -> DataFrame:
    """Spans of repeats among the distinct runs of each anchor, from rows sorted within anchors."""
    schema = "doc_id long, text_hash long, start long, end long"

    def settle(t):
        ids = t["doc_id"]
        rows = list(zip(ids.to_pylist(), t["start"].to_pylist(), t["many"].to_pylist(), t["bytes"].to_pylist()))
        owner, offset = repeats(rows, length)
        start = t["start"].to_numpy()[owner] + offset
        return pa.RecordBatch.from_arrays([ids.combine_chunks().take(pa.array(owner)), t["text_hash"].combine_chunks().take(pa.array(owner)), pa.array(start), pa.array(start + length)], names=["doc_id", "text_hash", "start", "end"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            a = t["anchor"].to_numpy()
            at = 0
            while True:
                cut = int(np.searchsorted(a, a[min(at + BLOCK, len(a) - 1)], "left"))
                if cut <= at:
                    cut = int(np.searchsorted(a, a[at], "right"))
                if cut >= len(a) or a[cut - 1] == a[-1]:
                    break
                yield settle(t.slice(at, cut - at))
                at = cut
            rest = t.slice(at)
        if rest is not None and len(rest):
            yield settle(rest)

    return strings.mapInArrow(run, schema)


def merged(starts, ends):
    """The union of byte ranges as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def repeated_strings(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = CROWD) -> DataFrame:
    """One row per input row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of `length` bytes of its document's UTF-8 text covers it that also starts
    earlier: in a document of smaller doc_id, or in the same document further left. Strings are judged
    on the input, and never cross documents. spans lists the maximal removed runs (start, end).

    A null or short text loses nothing. A null doc_id sorts before all others. Rows with equal doc_id and
    text are equally early: none repeats the other; rows of one doc_id and different texts are compared
    by start. Other columns are ignored; an empty table gives none. A doc_id of -2^63 counts as null. Texts
    may be of any length: they are read in pieces that overlap by length - 1 bytes. The runs of anchors of
    more than `block` distinct ones are cut around longer anchors first, so that a transform has a bounded
    number of members at any size."""
    if not k < length < 1 << 16:
        raise ValueError(f"strings must be longer than an anchor's {k} bytes, and shorter than 65,536")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    order = ["anchor", "run", "doc_id", "start"]
    found = occurrences(docs, length, k).repartition("anchor").sortWithinPartitions(*order)
    told = scratch.cut(judged(found, length))
    whole = told.where("kind = 0").select("doc_id", "text_hash", "start", (F.col("start") + F.col("many") - 1 + length).alias("end"))
    asked = told.where("kind = 1").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "start", "many")).alias("asked"))
    cuts = docs.join(asked, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    cuts = cuts.select("doc_id", "text_hash", F.encode("text", "UTF-8").alias("raw"), F.explode("asked").alias("asked"))
    piece = F.expr(f"substring(raw, int(asked.start + 1), int(asked.many - 1 + {length}))")
    strings = cuts.select("asked.anchor", "doc_id", "text_hash", "asked.start", "asked.many", piece.alias("bytes"))
    crowded = scratch.cut(told.where("kind = 1").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block).select("anchor"))
    strings = scratch.cut(strings)
    again, few = uncrowded(strings.join(crowded, "anchor", "left_semi"), scratch, length, k, block)
    few = reduce(DataFrame.unionByName, few, strings.join(crowded, "anchor", "left_anti"))
    near = scratch.cut(compared(few.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start"), length))
    again = [scratch.cut(reduce(DataFrame.unionByName, again))] if again else []
    scratch.keep(told, near, *again)
    spans = reduce(DataFrame.unionByName, [near, *again], whole).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            removed, n_spans, sha, sizes, lists = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if spans.is_valid:
                    starts, ends = merged(*(spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
                h, at = hashlib.sha256(), 0
                for s, e in zip(starts.tolist(), ends.tolist()):
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                sizes.append(len(raw)), removed.append(int((ends - starts).sum())), n_spans.append(len(starts)), sha.append(h.hexdigest())
                lists.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
            struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, n_spans)), pa.array(sha, pa.string()), pa.array(lists, struct)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = docs.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
