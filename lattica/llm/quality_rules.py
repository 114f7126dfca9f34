"""Quality rules: rule statistics of each document, and an isolation forest over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .texts import chunks, distinct, repeated, span_hashes, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_echoes")
SCHEMA = "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
#: Repeated lines and windows are left to the base rules: many good documents quote a line again.
FEATURES = ("symbols", "word_length", "upper", "marks", "echoes")
#: Sizes of the forest and of what it is fitted on; the thresholds use every labelled row.
TREES, SAMPLE, FIT_ROWS, DEPTH = 200, 64, 20_000, 8
#: A labelled good document is rejected at most this often by the calibrated threshold.
GOOD_LOSS = 0.005
BINS = 2000


def counts(data, offsets):
    """The COUNTS of each text of a chunk, as rows of an array."""
    n = len(offsets) - 1
    out = np.zeros((len(COUNTS), n), np.int64)
    total = lambda flag: np.diff(np.append(0, np.cumsum(flag))[offsets])
    starts, ends, doc = words(data, offsets)
    out[0] = np.bincount(doc, minlength=n)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    solid = np.cumsum(inside[:-1]) > 0
    out[1] = total(solid & ((data & 0xC0) != 0x80))
    out[2] = total(SYMBOL[data])
    out[5] = total((data >= 0x41) & (data <= 0x5A))
    out[6] = total(MARK[data])
    # Lines: each ends at a newline or at its text's end; those without a word don't count.
    stop = np.zeros(len(data) + 1, bool)
    stop[np.flatnonzero(data == 0x0A)] = True
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(stop) + 1]))
    cuts = cuts[cuts <= len(data)]
    if len(cuts) > 1:
        a, b = cuts[:-1], cuts[1:]
        b = b - stop[b - 1]
        with_word = np.diff(np.searchsorted(starts, cuts)) > 0
        a, b = a[with_word], b[with_word]
        line_doc = np.searchsorted(offsets, a, "right") - 1
        _, first = distinct(span_hashes(data, a, b, 6), line_doc)
        out[3] = np.bincount(line_doc, minlength=n) - np.bincount(first, minlength=n)
    hashes = span_hashes(data, starts, ends)
    echo = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[7] = np.bincount(doc[1:][echo], minlength=n) if len(echo) else 0
    got, at = windows(hashes, doc, 8)
    if len(got):
        edge = np.zeros(len(starts) + 1, np.int64)
        at = at[repeated(got, doc[at])]
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + 8, 1)
        out[4] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and COUNTS for each row of docs(doc_id, text); a null text has zeros."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                values = counts(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(offsets) - 1) for c in (0, 2)), *map(pa.array, values)], names=["doc_id", "text_hash", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SCHEMA)


def features(get):
    """The forest's features from a function that gives a count's column as floats."""
    n, chars = np.maximum(get("n_words"), 1), np.maximum(get("word_chars"), 1)
    return np.stack([get("n_symbols") / chars, np.log(chars / n), get("n_upper") / chars, get("n_marks") / chars, get("n_echoes") / n], 1)


def fit_forest(x, seed: int = 7):
    """An isolation forest: TREES trees over SAMPLE rows each, as arrays (feature, split, left, right, length)."""
    rng = np.random.default_rng(seed)
    forest = []

    def average(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    for _ in range(TREES):
        rows = x[rng.permutation(len(x))[: min(SAMPLE, len(x))]]
        nodes = []

        def grow(part, depth):
            me = len(nodes)
            nodes.append([0, 0.0, -1, -1, depth + average(len(part))])
            lo, hi = part.min(0), part.max(0)
            open_ = np.flatnonzero(hi > lo)
            if depth < DEPTH and len(part) > 1 and len(open_):
                f = int(rng.choice(open_))
                split = float(rng.uniform(lo[f], hi[f]))
                under = part[:, f] <= split
                if under.any() and not under.all():
                    nodes[me][:2] = f, split
                    nodes[me][2] = grow(part[under], depth + 1)
                    nodes[me][3] = grow(part[~under], depth + 1)
            return me

        grow(rows, 0)
        a = np.array(nodes)
        forest.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return forest, average(min(SAMPLE, len(x))) or 1.0


def anomaly(forest, x):
    """2 ** -(mean path length / its expectation) of each row; near 1 for anomalies."""
    trees, usual = forest
    length = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, right, path in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            down = left[at] >= 0
            if not down.any():
                break
            under = x[rows, feature[at]] <= split[at]
            at = np.where(down, np.where(under, left[at], right[at]), at)
        length += path[at]
    return 2.0 ** -(length / len(trees) / usual)


def scored(stats: DataFrame, forest) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = features(lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float))
            yield batch.append_column("anomaly", pa.array(anomaly(forest, x) if len(x) else np.zeros(0)))

    return stats.mapInArrow(run, SCHEMA + ", anomaly double")


def threshold(marked: DataFrame, labels: DataFrame) -> float:
    """The anomaly score above which a document is rejected: among the scores that reject at most a
    share GOOD_LOSS of the good labelled rows, the one that rejects most of the bad ones above its
    share of good ones. Without labels of both kinds, 0.75. Counts are taken over all labelled rows."""
    truth = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    bins = marked.where("doc_id is not null").join(truth, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.count("*").alias("rows"))
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in bins.collect():  # BINS rows at most
        good[r["bin"]], bad[r["bin"]] = r["good"], r["rows"] - r["good"]
    if not good.sum() or not bad.sum():
        return 0.75
    above_good, above_bad = (x[::-1].cumsum()[::-1] / x.sum() for x in (good, bad))
    gain = np.where(above_good <= GOOD_LOSS, above_bad - above_good, -1)
    return int(gain.argmax()) / BINS


def hash_sample(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """About n of the rows, n at most: those first by a hash of the key columns. A count and a bound on the hash
    (with a tenth of n and 64 rows to spare) leave little more than n in all partitions together to be sorted."""
    total = rows.count()
    draw = F.xxhash64(*key)
    share = min(1.0, (1.1 * n + 64) / max(total, 1))
    return rows.where(draw <= min(int(-(2**63) + share * 2**64), 2**63 - 1) if share < 1 else F.lit(True)).orderBy(draw, *key).limit(n)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, anomaly, kept, text_hash.

    base_failed: under 20 words, or over 30 % of the words lie in repeated 8-word windows. kept: not
    base_failed and an anomaly score below the threshold calibrated on labels(doc_id, quality). The forest
    is fitted on fit_rows documents of 20 words or more, the first by a hash of their counts and id (a
    bounded sample of numbers that comes to the driver); thresholds count all labelled rows. text_hash tells
    apart rows that share a doc_id. Null texts count as empty, and so fail; a very long text is counted
    whole, in one task; equal scores are judged alike; a null doc_id is judged by its text; repeated rows are
    judged alike; other columns are ignored; an empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.cut(rule_statistics(docs))
    sample = hash_sample(stats.where("n_words >= 20"), fit_rows, "n_words", "word_chars", "n_symbols", "doc_id")
    rows = sample.toPandas()  # fit_rows rows of numbers at most
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if not len(rows):
        return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), F.lit(0.0).alias("anomaly"), (~failed).alias("kept"), "text_hash")
    rows = rows.sort_values(["doc_id", *COUNTS])
    marked = scratch.cut(scored(stats, fit_forest(features(lambda c: rows[c].to_numpy(float)))))
    scratch.drop(stats)
    limit = threshold(marked.where(~failed), labels)
    return marked.select("doc_id", *COUNTS, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") < limit)).alias("kept"), "text_hash")
