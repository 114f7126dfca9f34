"""Runs of repeated phrases: recursive frequency splitting, then a lag scan of what survives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import chunks, mix, span_hashes, words

#: A run holds its period so many times at least, and so many words.
TIMES, LEAST = 4, 6
#: Lags below this are compared at every word, longer ones only where a block of words comes again.
NEAR = 16
RUNS = "array<struct<start:long,length:long,period:long>>"


def surviving(keys, doc):
    """Segments (first word, end) in which every word occurs TIMES or more, none shorter than LEAST.

    A word of a run occurs in it once a period, so a word with fewer occurrences in its segment lies in no run
    and splits it; the parts are counted again until nothing changes. Only parts of a segment that was
    split are looked at again. Equal keys of different words would only keep more."""
    at, segment, done = np.arange(len(keys)), doc, []
    while len(at):
        _, which, count = np.unique(keys[at] ^ mix(segment.astype(np.uint64)), return_inverse=True, return_counts=True)
        common = count[which] >= TIMES
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        stable = np.logical_and.reduceat(common, first)
        ends = np.append(first[1:], len(at))
        done += [(at[first[stable]], at[ends[stable] - 1] + 1)]
        keep = common & ~np.repeat(stable, ends - first)
        at, segment = at[keep], segment[keep]
        if len(at):
            cut = np.append(True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1]))
            segment = np.cumsum(cut) - 1
            long_ = np.bincount(segment)[segment] >= LEAST
            at, segment = at[long_], segment[long_]
    firsts, ends = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
    order = np.argsort(firsts)
    keep = order[ends[order] - firsts[order] >= LEAST]
    return firsts[keep], ends[keep]


def agree(a, i: int, j: int, step: int) -> int:
    """How many values from a[i] and a[j] on (backwards for step -1) are equal one by one."""
    n, size = 0, 64
    while True:
        room = min(size, len(a) - max(i, j) if step > 0 else min(i, j) + 1)
        if room <= 0:
            return n
        x, y = (a[i : i + room], a[j : j + room]) if step > 0 else (a[i - room + 1 : i + 1][::-1], a[j - room + 1 : j + 1][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return n + int(differ[0])
        n, i, j, size = n + room, i + step * room, j + step * room, 2 * size


def near_runs(a, found: list) -> None:
    """Adds the runs of periods below NEAR: every lag is compared at every word."""
    for q in range(1, min(NEAR, len(a))):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]]).astype(np.int8)
        turn = np.diff(same)
        for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if e - s + q >= max(LEAST, TIMES * q) and all(q % p or (a[s : s + q] != a[s + p : s + q + p]).any() for p in range(1, q)):
                found.append((s, e - s + q, q))


def far_runs(a, longest: int, found: list) -> None:
    """Adds the runs of periods from NEAR up to a quarter of the longest segment.

    For periods q from w to 2w, w a power of two, words agree with those q further on over 3q at least, so over
    some block of w words that begins at a multiple of w. Blocks are named by pairs of names of half the
    size, and a block's name is looked up at the next w to 2w words only: as many comparisons as words for each w.
    A block inside a run whose period divides the lag has that lag without being a run of it."""
    name, w, n = a, 1, len(a)
    while TIMES * w <= longest:
        if w >= NEAR:
            block = np.arange(0, n - 2 * w + 1, w)
            to = block[:, None] + w + np.arange(w)[None, :]
            inside = to + w <= n
            at, lag = np.nonzero((name[np.minimum(to, len(name) - 1)] == name[block][:, None]) & inside)
            at, lag = block[at], lag + w
            left = np.ones(len(at), bool)
            for s, length, p in list(found):
                i, j = np.searchsorted(at, (s, s + length))
                left[i:j] &= (lag[i:j] % p != 0) | (at[i:j] + lag[i:j] + w > s + length)
            at, lag = at[left], lag[left]
            order = np.lexsort((at, lag))
            last, upto = 0, 0
            for i, q in zip(at[order].tolist(), lag[order].tolist()):
                if q == last and i < upto:
                    continue
                s = i - agree(a, i - 1, i + q - 1, -1) if i else 0
                last, upto = q, i + agree(a, i, i + q, 1)
                if upto - s + q >= TIMES * q:
                    found.append((s, upto - s + q, q))
        pair = name[: max(n - 2 * w + 1, 0)] * np.int64(n + 1) + name[w : w + max(n - 2 * w + 1, 0)]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        w *= 2


def runs_of(data, starts, ends, doc) -> list[tuple[int, int, int]]:
    """(first word, length, period) of the runs of all words, by start and period. Words are compared as bytes."""
    firsts, stops = surviving(span_hashes(data, starts, ends), doc)
    if not len(firsts):
        return []
    ids: dict[bytes, int] = {}
    raw = data.tobytes()
    at = np.concatenate([np.arange(i, j + 1) for i, j in zip(firsts, stops)])  # and one place after each segment
    last = np.cumsum(stops - firsts + 1) - 1
    inner = np.ones(len(at), bool)
    inner[last] = False
    a = np.empty(len(at), np.int64)
    a[inner] = [ids.setdefault(raw[s:e], len(ids)) for s, e in zip(starts[at[inner]].tolist(), ends[at[inner]].tolist())]
    a[last] = len(ids) + np.arange(len(last))  # separators, no two alike
    a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    found: list[tuple[int, int, int]] = []
    near_runs(a, found)
    far_runs(a, int((stops - firsts).max()), found)
    return sorted((int(at[s]), length, q) for s, length, q in found)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs(doc_id, text): all maximal stretches of words
    `[^\\x20\\x09-\\x0D]+` with smallest period q that are max(6, 4 q) words long or more, by start and period,
    counted from word 0; and the words of the text without those that repeat a run's first q, joined by one space.

    Words that occur too rarely in their segment to be in a run split it, until no segment changes; surviving
    segments are scanned by lags. Whole texts, no shuffle: a text of n words costs n log n for each power of
    two of its period. Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows and null ids each give a row; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                starts, ends, doc = words(data, offsets)
                count = len(offsets) - 1
                begin = np.searchsorted(doc, np.arange(count + 1))
                runs: list[list] = [[] for _ in range(count)]
                for s, length, q in runs_of(data, starts, ends, doc):
                    runs[doc[s]].append({"start": s - int(begin[doc[s]]), "length": length, "period": q})
                texts = []
                for k in range(count):
                    w = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    if runs[k]:
                        gone = np.zeros(len(w) + 1, np.int64)
                        for r in runs[k]:
                            gone[r["start"] + r["period"]] += 1
                            gone[r["start"] + r["length"]] -= 1
                        w = [w[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                    texts.append(b" ".join(w))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, count), pa.array(np.diff(begin)), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with every tenth text, by the CRC of its id, made periodic from some word on; texts of
    rows without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    t = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"), F.floor(h / 10).alias("g"))
    t = t.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    t = t.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    # A copy of the words from a on, cut to one period, as often as it fits and one more, cut to the words there are.
    period = F.slice("w", F.col("a").cast("int") + 1, F.least("p", F.col("n") - F.col("a")).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    whole = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.flatten(F.array_repeat(period, times)))
    return t.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(whole, F.lit(1), F.col("n").cast("int")), " ")).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """The query's columns from those of periodic_runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    t = runs.withColumn("b", best)
    return t.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("(1000 * b.length) div -b.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
