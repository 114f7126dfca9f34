"""Quality classifier by co-training: a text view and a metadata view teach each other, then vote."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import counts, hash_sample, threshold
from .tables import Scratch
from .texts import LOWER, chunks, mix, span_hashes, words

#: Hashed words, and hashed values of the metadata columns.
WORD_SLOTS, META_SLOTS = 1 << 14, 64
SHAPES, METAS = 6, 4
WIDTH = SHAPES + META_SLOTS + METAS
#: Bounds of the samples that the classifiers are fitted on: labelled rows, and the pool of unlabelled ones.
LABELLED_ROWS, POOL_ROWS = 8_000, 8_000
ROUNDS, PER_ROUND, SURE = 5, 400, 0.95
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class View:
    """Feature rows: dense columns, then hashed words as (row, slot, value) of a slot that a row has, then 1."""

    def __init__(self, dense, word_slots: int = 0, rows=None, slots=None, values=None):
        none = np.zeros(0, np.int64)
        self.dense, self.word_slots = np.asarray(dense, float), word_slots
        self.rows, self.slots, self.values = (none, none, none) if rows is None else (rows, slots, values)

    def __len__(self):
        return len(self.dense)

    def take(self, at):
        number = np.full(len(self), -1)
        number[at] = np.arange(len(at))
        has = number[self.rows] >= 0
        return View(self.dense[at], self.word_slots, number[self.rows[has]], self.slots[has], self.values[has])

    def times(self, beta):
        """The product with one weight a column."""
        d = self.dense.shape[1]
        words_ = beta[d:-1]
        return self.dense @ beta[:d] + np.bincount(self.rows, self.values * words_[self.slots], minlength=len(self)) + beta[-1]

    def back(self, v, power: int = 1):
        """The sums of v times each column, or times its squares."""
        return np.concatenate([v @ self.dense**power, np.bincount(self.slots, v[self.rows] * self.values**power, minlength=self.word_slots), [v.sum()]])


def vectors(batch, word_slots: int):
    """Features of a batch of COLUMNS, in runs: (first row, dense columns, words as (rows, slots, values)). The dense
    columns are SHAPES of the text view and META_SLOTS + METAS of the metadata view."""
    for row, data, offsets in chunks(batch.column(1)):
        n = len(offsets) - 1
        c = counts(data, offsets).astype(np.float64)
        n_words, chars = np.maximum(c[0], 1), np.maximum(c[1], 1)
        low = LOWER[data]
        starts, ends, doc = words(low, offsets)
        slot = (span_hashes(low, starts, ends) & np.uint64(word_slots - 1)).astype(np.int64) if len(starts) else starts
        cell, times = np.unique(doc * word_slots + slot, return_counts=True)
        rows, slots = np.divmod(cell.astype(np.int64), word_slots)
        values = np.log1p(times) / np.log1p(n_words)[rows]
        x = np.zeros((n, WIDTH), np.float32)
        x[:, :SHAPES] = np.stack([10 * c[2] / chars, np.log(chars / n_words), 5 * c[4] / n_words, 5 * c[5] / chars, 10 * c[6] / chars, 10 * c[7] / n_words], 1)
        for k, name in enumerate(("lang", "source")):
            column = batch.column(batch.schema.get_field_index(name)).slice(row, n)
            for _, d, o in chunks(column, 1 << 62):
                full = np.flatnonzero(np.diff(o))
                if len(full):
                    slot = (mix(span_hashes(d, o[:-1][full], o[1:][full], 9 + k)) & np.uint64(META_SLOTS - 1)).astype(np.int64)
                    x[full, SHAPES + slot] += 1
        said = batch.column(batch.schema.get_field_index("n_chars")).slice(row, n).fill_null(0).to_numpy(zero_copy_only=False).astype(float)
        lines = np.diff(np.append(0, np.cumsum(data == 0x0A))[offsets]) + 1
        x[:, SHAPES + META_SLOTS :] = np.stack([np.log1p(np.maximum(said, 0)) / 10, np.log(lines) / 5, np.log1p(np.maximum(said, 0) / lines) / 10, c[3] / lines], 1)
        yield row, x, (rows, slots, values.astype(np.float32))


def views(x, word_slots: int, sparse):
    return View(x[:, :SHAPES], word_slots, *sparse), View(x[:, SHAPES:])


def solved(product, right, diagonal, most: int = 50, close: float = 1e-3):
    """x of product(x) = right by conjugate gradients, scaled by the diagonal."""
    x, left = np.zeros(len(right)), right.copy()
    along = z = left / diagonal
    size, goal = left @ z, close**2 * (left @ left)
    for _ in range(most):
        if left @ left <= goal or size <= 0:
            break
        image = product(along)
        rate = size / (along @ image)
        x, left = x + rate * along, left - rate * image
        z = left / diagonal
        size, before = left @ z, size
        along = z + size / before * along
    return x


def fit_logistic(view: View, y, beta=None, l2: float = 1e-3, steps: int = 25):
    """Weights of a ridge logistic regression, the intercept last (Newton's method); both classes weigh alike."""
    y = y.astype(float)
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    beta = np.zeros(view.dense.shape[1] + view.word_slots + 1) if beta is None else beta
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(view.times(beta), -30, 30)))
        curve = w * np.maximum(p * (1 - p), 1e-6)
        step = solved(lambda v: view.back(curve * view.times(v)) + l2 * v, view.back(w * (p - y)) + l2 * beta, view.back(curve, 2) + l2)  # noqa: B023
        beta = beta - step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def held_out(y):
    """Each fourth labelled row of each class, for the calibration: of a class of under four rows none."""
    out = np.zeros(len(y), bool)
    for label in (0, 1):
        at = np.flatnonzero((y > 0) == label)
        out[at[3::4]] = True
    return out


def co_train(both: tuple[View, View], y, rounds: int = ROUNDS):
    """The two views' models and their calibration (scale text, scale metadata, shift). y: 1, 0, or -1 for
    the rows of the pool.

    Each round a view labels the pool's rows it is surest of, at most PER_ROUND of each class with a
    probability of SURE or more, for the other view. The margins of both views are calibrated together on the
    held-out rows."""
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    held = held_out(y[known])
    at = [known[~held], known[~held]]
    said = [y[known[~held]], y[known[~held]]]
    free = [y < 0, y < 0]
    models = [None, None]
    for r in range(rounds + 1):
        for v in (0, 1):
            models[v] = fit_logistic(both[v].take(at[v]), said[v], models[v])
        if r == rounds or not len(pool):
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(both[v].times(models[v]), -30, 30)))
            other = 1 - v
            for label, sure in ((1, p), (0, 1 - p)):
                new = np.flatnonzero(free[other] & (sure >= SURE))
                new = new[np.argsort(-sure[new], kind="stable")][:PER_ROUND]
                free[other][new] = False
                at[other], said[other] = np.append(at[other], new), np.append(said[other], np.full(len(new), label))
    at, truth = known[held], y[known[held]]
    margins = View(np.stack([both[v].times(models[v])[at] for v in (0, 1)], 1))
    ok = held.any() and 0 < truth.mean() < 1
    return models, fit_logistic(margins, truth) if ok else np.array([1.0, 0.0, 0.0])


def quality_classifier(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, word_slots: int = WORD_SLOTS) -> DataFrame:
    """One row per input row of docs: doc_id, text_margin, meta_margin, score, kept.

    score is the calibrated probability of labels.quality = 1 (classes weighed alike); kept is a score
    above the threshold that loses at most a share quality_rules.GOOD_LOSS of all labelled good rows and
    finds most of the bad ones. Fitted on labelled_rows labelled and pool_rows unlabelled documents, the
    first by a hash of their id; the text view hashes words to word_slots slots, a power of two. Every
    document is scored, a very long one whole, in one task. Equal rows score alike; a doc_id with several
    labels has the greatest, and one with several rows enters the sample once, with the least of their
    features. Where too few labels of a kind are there to hold some out (see held_out), margins are not
    calibrated and the text margin alone makes the score. Null texts and metadata have empty features; null ids are scored, never sampled;
    repeated rows score alike; other columns are ignored; without labels of both kinds the score is 0.5 and
    all is kept; an empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pool = docs.select("doc_id").where("doc_id is not null").distinct().join(truth, "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    known = truth.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = scratch.cut(hash_sample(known, labelled_rows, "doc_id").unionByName(hash_sample(pool, pool_rows, "doc_id")))

    def features(batches):
        for batch in batches:
            for row, x, (rows, slots, values) in vectors(batch, word_slots):
                cuts = np.searchsorted(rows, np.arange(len(x) + 1))
                lists = lambda a, t: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(a, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), batch.column(5).slice(row, len(x)), pa.array([r.tobytes() for r in x], pa.binary()), lists(slots, pa.int32()), lists(values, pa.float32())], names=["doc_id", "quality", "x", "slots", "times"])

    sample = docs.join(F.broadcast(chosen), "doc_id")  # labelled_rows + pool_rows pairs of numbers
    rows = sample.select(*COLUMNS, "quality").mapInArrow(features, "doc_id long, quality int, x binary, slots array<int>, times array<float>")
    least = F.min(F.struct("quality", "x", "slots", "times")).alias("r")  # of rows that share an id the same one in each run
    rows = rows.groupBy("doc_id").agg(least).select("doc_id", "r.*").toArrow().sort_by("doc_id").combine_chunks()
    y = rows["quality"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(y), WIDTH)
    n = rows["slots"].combine_chunks().value_lengths().to_numpy()
    flat = [rows[c].combine_chunks().flatten().to_numpy() for c in ("slots", "times")]
    known = y >= 0
    if not known.any() or not 0 < (y[known] > 0).mean() < 1:
        half = F.lit(0.0)
        return docs.select("doc_id", half.alias("text_margin"), half.alias("meta_margin"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    models, scale = co_train(views(x, word_slots, (np.repeat(np.arange(len(y)), n), *flat)), np.where(known, y > 0, -1))

    def run(batches):
        for batch in batches:
            for row, x, sparse in vectors(batch, word_slots):
                t, m = (view.times(model) for view, model in zip(views(x, word_slots, sparse), models))
                score = 1 / (1 + np.exp(-np.clip(scale[0] * t + scale[1] * m + scale[2], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.array(t), pa.array(m), pa.array(score)], names=["doc_id", "text_margin", "meta_margin", "score"])

    marked = scratch.cut(docs.select(*COLUMNS).mapInArrow(run, "doc_id long, text_margin double, meta_margin double, score double"))
    limit = threshold(marked.withColumn("anomaly", 1 - F.col("score")), truth)
    return marked.withColumn("kept", 1 - F.col("score") < limit)
