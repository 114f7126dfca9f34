"""Top-k products, ranked search and periodic runs against brute force, with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import norm_topk, periodic_runs, ranked_search

LONG = 1 << 63
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def whole(x):
    return max(-LONG, min(LONG - 1, math.floor(64 * x)))


def best_products(rows, every=20, k=20):
    ok = [(i, [whole(x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, e) in enumerate(ok):
        if i is not None and i % every == 0:
            all_ = [(-max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(e, f)))), LONG if j is None else j, j) for b, (j, f) in enumerate(ok) if b != a]
            out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(all_, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    """Lengths from a thousandth to a thousand, a group of near copies, exact copies and rows that take no part."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        n = int(rng.choice([0, 3, 8])) if rng.random() < 0.1 else 8
        v = rng.normal(size=n) * np.exp(rng.normal() * 1.5)
        if rng.random() < 0.3:
            v = np.array([1, 0.5, -0.2, 0.3, 0, 0, 0.1, 2]) + rng.normal(size=8) * 0.005
        rows.append((i, v.astype("float32").tolist()))
    rows += [(None, [1.0] * 8), (None, None), (40, None), (60, [1.0, None]), (80, [math.nan] * 8), (100, [math.inf] * 8), (100, [-math.inf] + [1.0] * 7)]
    return rows + [(20, rows[20][1])] * 2 + [(-20, [2.0**20] * 8), (120, [0.0] * 8), (140, [])]


@pytest.mark.parametrize("sizes", [(16384, 4096, 4096), (37, 11, 64)])
def test_top_products(spark, vectors, sizes, monkeypatch):
    for name, value in zip(("PART", "BLOCK", "SEEDS"), sizes):
        monkeypatch.setattr(norm_topk, name, value)
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], "vec_id long, embedding array<float>, row int, len string").repartition(3)
    got = sorted((tuple(r) for r in norm_topk.top_products(df).select("query_id", "rank", "vec_id", "score").collect()), key=repr)
    assert got == best_products(vectors)


def test_top_products_of_very_long_and_of_few_vectors(spark):
    rows = [(i, [3e30 * (1 if i % 3 else -1), 1.0]) for i in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in norm_topk.top_products(df).collect()), key=repr)
    assert got == best_products(rows) and {r[3] for r in got} == {-LONG, LONG - 1}
    assert norm_topk.top_products(df.limit(0)).count() == 0


def test_coordinate_pruning_keeps_the_best(monkeypatch):
    """The probe by itself, with thresholds that make it prune by coordinates, and by length."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    p = rng.integers(-50, 50, (3000, 12))
    p[:200] = p[0] + rng.integers(-1, 2, (200, 12))
    table = lambda m, **more: pa.table({"row": np.arange(len(m)), "id": np.arange(len(m)), "v": pa.array(m.tolist(), pa.list_(pa.int64())), "len": np.sqrt((m * m).sum(1).astype(float)), **more})
    scores = p[:40] @ p.T
    theta = [int(np.sort(np.delete(s, i))[-10]) for i, s in enumerate(scores)]
    asked = []
    monkeypatch.setattr(norm_topk, "products", lambda q, c, most, f=norm_topk.products: asked.append(len(q) * len(c)) or f(q, c, most))
    got = norm_topk.probe(table(p[:40], theta=theta), table(p), 10).to_pylist()
    for i, s in enumerate(scores):
        want = sorted((-int(x), j) for j, x in enumerate(s) if j != i)[:10]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == i] == want
    assert sum(asked) < 0.5 * 40 * len(p)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def best_documents(docs, items, k=10):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    count, total = sum(map(bool, terms)), sum(map(len, terms))
    df = {}
    for t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (i, _), t in zip(docs, terms):
            s = 0
            for x in TERM.findall(lower(text)):
                if x in t:
                    m = 25 + 75 * len(t) * count // total
                    s += math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(8192, 32, 1 << 19), (40, 4, 30)])
def test_search(spark, sizes, monkeypatch):
    for name, value in zip(("SHARD", "BLOCK", "MOST_TERMS"), sizes):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgé日" for b in ("", "n", "Zq", "77", "ß")]
    say = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, say(rng.randint(0, 40))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)] + [docs[7], docs[7], (None, docs[8][1]), (None, None), (300, None), (301, ""), (302, "-- !!"), (303, say(20000)), (304, "A a Á á İ")]
    items = [(i, say(rng.randint(1, 12))) for i in range(20)] + [(50, None), (51, ""), (52, "nothingofthis"), (53, docs[7][1]), (53, "a"), (None, "an"), (54, "an an AN"), (55, "Á")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item long".replace("item long", "score string")).repartition(4)
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, hash int").repartition(2)
    got = sorted((tuple(r) for r in ranked_search.search(d, b).collect()), key=repr)
    assert got == best_documents(docs, items)


def test_search_without_rows(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(d, b).count() == 0
    assert ranked_search.search(b.toDF("doc_id", "text"), d.toDF("item_id", "text")).count() == 0


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def phrases(rng, parts):
    w = []
    for _ in range(parts):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 20])]) for _ in range(rng.choice([1, 2, 3, 8, 40]))]
        w += base * rng.choice([1, 3, 4, 5, 6]) + base[: rng.randint(0, len(base))] + [rng.choice("xyzuvé") for _ in range(rng.randint(0, 4))]
    return w


def result(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(phrases(rng, rng.randint(0, 6)))) for i in range(250)]
    rows += [(None, rows[3][1]), (None, None), (7, None), (8, ""), (9, " \n\t "), (10, "a"), (11, "a " * 5), (12, "a " * 6), (13, "ab " * 8000), rows[5], rows[5], (14, "  x y " * 9)]
    long_ = [str(rng.randrange(400)) for _ in range(900)]
    rows += [(15, " ".join(long_ * 5)), (16, " ".join(rng.choice("ab") for _ in range(1500)))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, runs string, w string").repartition(4)
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.looped(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((result(*r) for r in rows), key=repr)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_long_texts():
    """Half a million words of one, two and fifty thousand words a period."""
    import pyarrow as pa

    from lattica.llm.texts import chunks, words

    for w, run in ((["a"] * 500_000, (0, 500_000, 1)), (["a", "b"] * 200_000, (0, 400_000, 2)), ([str(i) for i in range(50_000)] * 6, (0, 300_000, 50_000))):
        _, data, offsets = next(chunks(pa.array([" ".join(w)])))
        assert periodic_runs.runs_of(data, *words(data, offsets)) == [run]
