"""Vectorised text helpers for Arrow batches: words, lines, 64-bit hashes and shingle sets.

Hashes are 64-bit multilinear sums with a finaliser; two different strings collide with a probability
below 2**-50, which the operators treat as equality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x):
    """splitmix64's finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int = 0):
    """n pseudo-random odd uint64."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def chunks(column, size: int = CHUNK):
    """Splits a string column into runs of rows of about `size` bytes: (first row, bytes, offsets).
    A null counts as an empty text; a longer text is one run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data, offsets, solid=SOLID):
    """Words [^\\x20\\x09-\\x0D]+ of each text, or runs of other bytes that `solid` says: (start, end, text number)."""
    solid = solid[data]
    if not solid.any():
        return (np.zeros(0, np.int64),) * 3
    full = offsets[1:] > offsets[:-1]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data, starts, ends, seed: int = 1):
    """A hash of each of the spans, which must be disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    firsts = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
    values = (data[at + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * keys(int(lens.max()), seed)[at]
    return mix(np.add.reduceat(values, firsts) ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def windows(hashes, doc, n: int):
    """Hashes of n consecutive words of one text, and the index of the first of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k, q in enumerate(keys(n, 2)):
        total += hashes[at + k] * q
    return mix(total), at


def shingle_list(hashes, doc, n: int):
    """All n-word shingles with their text numbers, by text; a text of fewer words is one shingle."""
    got, at = windows(hashes, doc, n)
    which = doc[at]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))
    short = count < n
    if short.any():
        first, count = first[short], count[short]
        total = count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for k, q in enumerate(keys(n, 3)):
            has = count > k
            total[has] += hashes[first[has] + k] * q
        got, which = np.concatenate([got, mix(total)]), np.concatenate([which, doc[first]])
        order = np.argsort(which, kind="stable")
        got, which = got[order], which[order]
    return got, which


def distinct(values, which):
    """The distinct (value, text number) pairs, by text number."""
    if not len(values):
        return values, which
    key = values ^ mix(which.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(key)
    key = key[order]
    kept = np.sort(order[np.append(True, key[1:] != key[:-1])])
    return values[kept], which[kept]


def repeated(values, which):
    """Whether each value occurs twice or more for its text number."""
    key = values ^ mix(which.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    if len(key):
        out[order] = np.append(False, same) | np.append(same, False)
    return out


def shingle_sets(data, offsets, n: int):
    """Distinct shingles of the lower-cased texts, and their text numbers, by text."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets)
    return distinct(*shingle_list(span_hashes(data, starts, ends), doc, n))
