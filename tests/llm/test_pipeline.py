"""The corpus pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline
from lattica.llm.quality_rules import quality_rules

D = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality_rules(docs, spark.read.parquet(f"{D}/labels.parquet")).where("kept").collect()}
    one = stages["quality rules"](spark, docs, D)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)

    two = stages["near-dedup"](spark, one, D)
    sets = {r["doc_id"]: shingles(r["text"]) for r in one.collect()}
    ids = sorted(sets)
    group = {i: i for i in ids}
    for _ in ids:
        before = dict(group)
        for i in ids:
            for j in ids:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i in ids if group[i] == i)

    three = stages["decontamination"](spark, two, D)
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = {i for i in ids if group[i] == i and not any(x and 100 * len(x & sets[i]) >= 80 * len(x) for x in items)}
    assert {r["doc_id"] for r in three.collect()} == clean

    four = stages["mixing"](spark, three, D)
    times = {}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert four.columns == docs.columns and set(times) <= clean and max(times.values()) <= 2

    five = stages["sharding"](spark, four, D).collect()
    assert len(five) == sum(times.values())
    for s in range(16):
        assert sorted(r["slot"] for r in five if r["shard"] == s) == list(range(sum(r["shard"] == s for r in five)))


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, D).count() > 0
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_odd_rows(spark):
    """Null ids, rows that share an id, repeated rows, nulls in any column and columns of clashing names."""
    good = [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect() if r["text"] and 60 < len(r["text"].split()) < 300 and len(set(r["text"].split())) > 30][:12]
    leak = spark.read.parquet(f"{D}/benchmark.parquet").first()["text"]
    t = [" ".join(f"{w}{i}" for w in g.split()) for i, g in enumerate(good)]
    rows = [(1, t[0]), (1, t[1]), (2, t[2]), (2, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (3, t[4]), (None, t[5] + " " + leak), (4, t[6] + " " + leak), (5, None), (None, None), (6, ""), (7, t[7])]
    docs = spark.createDataFrame([(i, x, None, "s" if n % 2 else None, None, 1, 2, 3, 4, 5) for n, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _times int, key_ int, rank_ int, row int, taken int")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, docs, D)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    judged = {(r["doc_id"], r["text_hash"]) for r in quality_rules(docs, spark.read.parquet(f"{D}/labels.parquet")).where("kept").collect()}
    assert one.columns == docs.columns and {x for _, x in pairs(one)} <= {x for _, x in rows if x}
    assert one.count() == sum((r["doc_id"], r["h"]) in judged for r in docs.selectExpr("doc_id", "xxhash64(text) as h").collect())
    two = pairs(stages["near-dedup"](spark, docs.where("text is not null"), D))
    assert two == sorted([(1, min(t[0], t[1])), (2, t[2]), (None, t[3]), (3, t[4]), (None, t[5] + " " + leak), (4, t[6] + " " + leak), (6, ""), (7, t[7])], key=repr)
    three = stages["decontamination"](spark, docs, D)
    assert pairs(three) == sorted([x for x in rows if not x[1] or leak not in x[1]], key=repr) and three.columns == docs.columns
    four = stages["mixing"](spark, three, D)
    got = pairs(four)
    assert four.columns == docs.columns and set(got) <= {x for x in rows if x[1]} and len(got) <= 2 * len(rows)
    assert stages["sharding"](spark, four, D).count() == len(got)
