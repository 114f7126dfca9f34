"""Token counts of sections by offsets: a document is encoded once, and its tokens' spans meet its sections."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "largest")
#: A run of white space (of the pattern's \s) that is cut out: the pattern's search takes the square of its length,
#: and runs out of stack on very long ones.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")


def encoding(path: str, pattern: str):
    """The tokenizer and the byte length of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def tokens_of(tokenizer, raw: bytes):
    """The tokens of a whole text. A long run of white space is one piece of the pattern but for its last
    character, which the pattern leaves to a word that follows; so it is cut out there and merged by itself,
    with the same tokens. Bytes that are no UTF-8 are pieces of their own."""
    out, at = [], 0
    while at < len(raw):
        try:
            text, bad, end = raw[at:].decode(), b"", len(raw)
        except UnicodeDecodeError as e:
            text, bad, end = raw[at : at + e.start].decode(), raw[at + e.start : at + e.end], at + e.end
        here = 0
        for m in BLANKS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out.append(tokenizer.encode_to_numpy(text[here : m.start()], disallowed_special=()))
            out.append(np.array(tokenizer._encode_single_piece(text[m.start() : stop].encode()), np.int64))
            here = stop
        if here < len(text):
            out.append(tokenizer.encode_to_numpy(text[here:], disallowed_special=()))
        if bad:
            out.append(np.array(tokenizer._encode_single_piece(bad), np.int64))
        at = end
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def attributed(ends, cuts, rule: str = "first"):
    """Tokens end at the byte offsets `ends`; sections begin at `cuts` (first 0). Returns the tokens of
    each section, each token counted once, and how many of the section's tokens cross its end or start.
    first, last: the section of the token's first or last byte; largest: the one with most of its
    bytes, the first of equals."""
    starts = np.append(0, ends[:-1])
    a, b = np.searchsorted(cuts, starts, "right") - 1, np.searchsorted(cuts, ends - 1, "right") - 1
    own = a if rule == "first" else b if rule == "last" else a.copy()
    cross = np.flatnonzero(a != b)
    if rule == "largest":
        bounds = np.append(cuts, max(int(ends[-1]) if len(ends) else 0, cuts[-1]))
        for i in cross:
            parts = [min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]) for s in range(a[i], b[i] + 1)]
            own[i] = a[i] + int(np.argmax(parts))
    return np.bincount(own, minlength=len(cuts)), np.bincount(own[cross], minlength=len(cuts))


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """One row per section of each row of docs(doc_id, text): doc_id, section, n_bytes, n_tokens, n_crossing.

    Sections are the lines of the text, each with the newline that ends it, numbered from 0. The whole
    text is encoded once by the byte-level tokenizer; a token belongs to one section, by `rule` (see
    attributed) if it crosses a boundary, so the sections' tokens add up to the document's. The join of
    token spans with sections is a merge of two sorted lists inside the document. A null or empty text is
    one section without tokens; a very long text is encoded whole, in one task; repeated rows and null ids are kept; other columns are ignored; an empty
    table gives none. The vocabulary's path is read on the executors."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        tokenizer, lengths = encoding(vocabulary, pattern)
        for batch in batches:
            ids, out = [], [[], [], [], []]
            for row, data, offsets in chunks(batch.column(1)):
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    text = raw[offsets[i] : offsets[i + 1]]
                    newlines = np.flatnonzero(data[offsets[i] : offsets[i + 1]] == 0x0A) + 1
                    cuts = np.append(0, newlines[newlines < len(text)])
                    tokens = tokens_of(tokenizer, text)
                    n, cross = attributed(np.cumsum(lengths[tokens]), cuts, rule) if len(tokens) else (np.zeros(len(cuts), np.int64),) * 2
                    ids.append(np.full(len(cuts), row + i))
                    for column, values in zip(out, (np.arange(len(cuts)), np.diff(np.append(cuts, len(text))), n, cross)):
                        column.append(values)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in out)], names=["doc_id", "section", "n_bytes", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, section long, n_bytes long, n_tokens long, n_crossing long")
